import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from lamella.llm.language_id import UNDETERMINED, Parser, Samples, held_out, identify, sample_labelled, suffix_automaton
from lamella.llm.queries import op3_language_id

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs home to the other animals "
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund und laeuft dann nach hause zu den anderen "
SAMPLES = Samples((("de", (GERMAN,)), ("en", (ENGLISH,))))


def test_automaton_accepts_exactly_the_substrings():
    sequence = [1, 2, 1, 1, 3, 2, 1, 2]
    moves = suffix_automaton(sequence)
    parts = {tuple(sequence[i:j]) for i in range(9) for j in range(i, 9)}

    def walk(state, path):
        assert path in parts
        return 1 + sum(walk(to, (*path, c)) for c, to in moves[state].items())

    assert walk(0, ()) == len(parts)


def parsed_by_hand(samples, text):
    """Bits a character of each language: the longest substring of its sample, again and again."""
    learned = {c for _, texts in samples.texts for t in texts for c in t.lower() if c.isalpha()}

    def letters(t):
        out = [c if c in learned else None if c.isalpha() else " " for c in t.lower()]
        return [c for i, c in enumerate(out) if i == 0 or c != " " or out[i - 1] != " "]

    marked, costs = letters(text), {}
    for lang, texts in samples.texts:
        parts = [letters(t) for t in texts]
        known = " " + "".join("".join(p) + " " for p in parts)
        at = count = 0
        while at < len(marked):
            n = 0
            while at + n < len(marked) and marked[at + n] is not None and "".join(marked[at : at + n + 1]) in known:
                n += 1
            at, count = at + max(n, 1), count + 1
        costs[lang] = count * math.log2(len(known) + 1) / max(len(marked), 1)
    return costs


def compare(samples, texts):
    parser = Parser(samples)
    costs, known, _ = parser.costs(texts)
    for i, text in enumerate(texts):
        if known[i]:
            want = parsed_by_hand(samples, text)
            assert {lang: round(float(costs[k, i]), 9) for k, lang in enumerate(parser.languages)} == {k: round(v, 9) for k, v in want.items()}


def test_phrases_against_brute_force():
    long = ("The dog jumps home und der Hund läuft. " * 40 + "zzz 123 ") * 3
    compare(SAMPLES, ["The dog jumps home", "Hund und Fuchs", "zzz qqq", "ωδ dog", " ", long, None, "", long[::-1]])


def test_phrases_go_on_over_chunks_and_flushes(monkeypatch):
    from lamella.llm import language_id

    monkeypatch.setattr(language_id, "CHUNK", 8)
    monkeypatch.setattr(language_id, "SIDE_BY_SIDE", 5)
    compare(SAMPLES, [ENGLISH * 3, "a", (GERMAN + ENGLISH) * 2, ENGLISH.upper()[3:] + "ß" * 9])


def test_many_letters_and_languages(monkeypatch):
    """More letters than dense columns, and more languages than any list of common ones."""
    from lamella.llm import language_id

    monkeypatch.setattr(language_id, "DENSE", 3)
    chinese = "".join(chr(0x4E00 + i * i % 300) for i in range(700))
    samples = Samples((("de", (GERMAN,)), ("zh", (chinese,)), *((f"x{i}", (ENGLISH[i:] + chr(0x3B1 + i % 20),)) for i in range(70))))
    compare(samples, [chinese[100:260] + "x" + chinese[5:9], GERMAN[::-1], "der hund"])


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 30, f"l{i % 100}") for i in range(300)]
    samples = sample_labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(samples.texts) == 100


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = sample_labelled(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    got = {r.doc_id: r for r in op3_language_id(spark, sf_dir).collect()}
    texts = sorted((r for r in docs.collect() if r.text), key=lambda r: len(r.text))
    for r in [*texts[:12], *texts[60:70]]:
        if any(c.isalpha() for c in r.text):
            costs = parsed_by_hand(samples, r.text)
            (best, low), (_, second) = sorted(costs.items(), key=lambda x: (x[1], x[0]))[:2]
            assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - (1 - low / second)) < 1e-9


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the lazy dog and the fox", "x"), (5, "Der HUND und der Fuchs", "x"), (5, "Der HUND und der Fuchs", "x"), (6, "the dog jumps " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred) for r in identify(df, SAMPLES).collect()]
    assert sorted(got) == [(1, UNDETERMINED), (2, UNDETERMINED), (3, UNDETERMINED), (4, "en"), (5, "de"), (5, "de"), (6, "en")]
    assert identify(df.limit(0), SAMPLES).count() == 0
    nothing = sample_labelled(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {UNDETERMINED}
