import hashlib
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm.chat_format import fold_events, read_back, render
from lamella.llm.queries import op6_chat_format

LOG = "conv_id long, message long, seq long, kind string, role string, text string"
PIECES = ["\\", "\\p", "\\e", "<", "|", "<|turn|>", "<|text|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "<<SYS>>", "é", "\n", "a", "😀", "$1", "["]


def fold(spark, rows):
    return {r.conv_id: [(m.role, m.text) for m in r.messages] for r in fold_events(spark.createDataFrame(rows, LOG)).collect()}


def test_query_against_brute_force(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(x for _, role, x in rows if role == "assistant")
        want[conv] = (len(rows), digest("".join(f"{role}\n{x}\n" for _, role, x in rows)), len(loss), digest(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op6_chat_format(spark, sf_dir).collect()}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|text|>b"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=1, max_size=12))
def test_round_trip(spark, turns):
    rows = [(1, i, i, "message", role, text) for i, (role, text) in enumerate(turns)]
    formatted = render(fold_events(spark.createDataFrame(rows, LOG)))
    row = read_back(formatted).collect()[0]
    assert [(t.role, t.text) for t in row.turns] == turns
    assert [t for t in row.loss_texts if t] == [t for role, t in turns if role == "assistant" and t]
    assert row.formatted_chars == len(formatted.collect()[0].formatted)
    assert sum(r.n for r in formatted.collect()[0].loss_runs) == row.formatted_chars


def test_events_are_folded(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"),
        (1, 0, 4, "edit", None, "hi!"), (1, 1, 5, "regenerate", None, "Good "), (1, 1, 6, "delta", None, "day"), (1, 300, 7, "message", "user", None), (1, 2, 8, "message", "user", "gone"), (1, 2, 9, "delete", None, None),
        (2, 0, 0, "delta", "assistant", "x"), (None, None, None, None, None, None), (3, 0, 0, "delete", None, None),
    ]
    assert fold(spark, rows) == {1: [("user", "hi!"), ("assistant", "Good day"), ("user", "")], 2: [("assistant", "x")], None: [("", "")], 3: []}


def test_repeated_rows_and_empty_table(spark):
    assert fold(spark, [(1, 0, 0, "message", "user", "a")] * 2) == {1: [("user", "a")] * 2}
    assert fold(spark, []) == {}


def test_many_messages_cross_ranges(spark):
    rows = [(9, i, i, "message", "user", str(i)) for i in reversed(range(1000))]
    assert fold(spark, rows)[9] == [("user", str(i)) for i in range(1000)]


def test_one_long_stream_of_deltas(spark):
    n = 60000
    rows = spark.range(n).selectExpr("1L conv_id", "id div 30000 message", "id seq", "'delta' kind", "'assistant' role", "concat(id % 10, '') text")
    start = time.monotonic()
    got = {r.conv_id: [m.text for m in r.messages] for r in fold_events(rows).collect()}
    assert got == {1: ["0123456789" * 3000] * 2} and time.monotonic() - start < 30


def folded(rows):
    """The rules of fold_events, one event after another."""
    out = {}
    for conv, message, _, kind, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "message", r[4], r[5])):
        done = out.setdefault(conv, [])
        open_ = bool(done) and done[-1][0] == message
        if kind == "delete":
            if open_:
                done.pop()
        elif kind == "message" or not open_:
            done.append((message, role, text))
        else:
            last = done.pop()
            done.append((message, last[1], last[2] + text if kind == "delta" else text))
    return {k: [(role, text) for _, role, text in v] for k, v in out.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(254, 258), st.sampled_from(["message", "delta", "delta", "edit", "regenerate", "delete"]), st.sampled_from(["user", "assistant"]), st.sampled_from(["a", "b", ""])), min_size=1, max_size=40))
def test_events_against_one_after_another(spark, events):
    rows = [(c, m, i, k, r, t) for i, (c, m, k, r, t) in enumerate(events)]
    assert fold(spark, rows) == folded(rows)
