import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamella.llm.packing import Packer, encoder, pack, powers
from lamella.llm.queries import op2_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, documents, size):
    """Every id in one piece, gapless sequences, digests, and padding only where allowed."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(documents[doc]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_query_against_the_library(spark, sf_dir):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(op2_packing(spark, sf_dir).collect(), documents, 1024) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 5))
def test_windows(lengths, open_windows):
    packer, out = Packer(32, open_windows), []
    for doc, n in enumerate(lengths):
        out += packer.add(doc, 0, np.full(n, doc, "<u4"), n)
        assert len(packer.windows) <= open_windows
    done, tail = packer.finish()
    assert all(sum(len(p[2]) for p in s) == 32 for s in out + done)
    ends = powers(tail)
    assert all((n := sum(len(p[2]) for p in s)) & (n - 1) == 0 for s in ends)
    seen = np.concatenate([p[2] for s in out + done + ends for p in s]) if lengths else np.zeros(0)
    assert sorted(seen.tolist()) == sorted(np.repeat(np.arange(len(lengths)), lengths).tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " the", "  ", "\n", "é", "'s", "12", "<|endoftext|>", "中", " "]) | st.characters(codec="utf-8"), max_size=30).map("".join))
def test_ids_equal_the_library(text):
    assert encoder(PATH)(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b", 3), (4, "x" * 5000, 4), (5, "word " * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = pack(df, PATH, keep_ids=True).collect()
    assert check(got, {d: t for d, t, _ in rows}, 1024) == 0
    assert all(len(r.ids) == 4 * r.length for r in got)
    twice = df.where("doc_id = 2").union(df.where("doc_id = 2"))
    assert [(r.doc_id, r.start, r.length) for r in pack(twice, PATH).collect()] == [(2, 0, 1)] * 2
    assert pack(df.limit(0), PATH).count() == 0
