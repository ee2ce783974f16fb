"""Bounded-space online packing of token sequences into windows of a fixed size.

Each partition keeps at most `open_windows` windows open. A document first fills whole windows by itself;
what remains is placed best-fit: into the open window that it leaves with the least room. Where it fits
into none and no more may be opened, the fullest window is topped up with the head of the remainder and
emitted, so that it needs no padding. At the end of a partition the windows still open are merged, the
fullest first, into full windows and one tail of less than a window. Tails of up to `merge_width`
partitions meet in one task and are merged the same way; the last tail of such a group is cut at powers
of two, so that no sequence needs padding beyond the next power of two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.memory import give_back
from lamella.llm.storage import materialize

#: Specials of the byte-level vocabulary are recognised inside texts by the tokenizer's default.
_SAFE_BELOW = "ɐ"
_RUN = 2000

SCHEMA = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tail_of long"


class Encoder:
    """Ids of texts by a tokenizers file, as that library gives them by default without special tokens.

    Texts of Latin letters without overlong runs go through a rank table made from the same file, which
    gives equal ids faster; all others go through the library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.specials}
        from public_tokenizers import PATTERN

        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        import re

        self.overlong = re.compile(rf"\S{{{_RUN}}}|\s{{{_RUN}}}").search

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if max(text) >= _SAFE_BELOW or any(s in text for s in self.specials) or (len(text) >= _RUN and self.overlong(text)):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_ordinary(text), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs pieces, one after another; a piece is (doc, start, ids, doc_tokens).

    add() and finish() return the sequences that are complete, as lists of pieces.
    """

    def __init__(self, size: int, open_windows: int):
        self.size, self.limit = size, open_windows
        self.windows: list[list] = []
        self.used: list[int] = []

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> list[list]:
        done, at = [], 0
        while len(ids) - at >= self.size:
            done.append([(doc, start + at, ids[at : at + self.size], doc_tokens)])
            at += self.size
        while (rest := len(ids) - at) > 0:
            best = max((u for u in self.used if u + rest <= self.size), default=None)
            if best is not None:
                k = self.used.index(best)
            elif len(self.used) < self.limit:
                self.windows.append([])
                self.used.append(0)
                k = len(self.used) - 1
            else:
                k = self.used.index(max(self.used))
            take = min(rest, self.size - self.used[k])
            self.windows[k].append((doc, start + at, ids[at : at + take], doc_tokens))
            self.used[k] += take
            at += take
            if self.used[k] == self.size:
                done.append(self.windows.pop(k))
                self.used.pop(k)
        return done

    def finish(self) -> tuple[list[list], list]:
        """Merges the open windows; the sequences now full, and the pieces of the tail."""
        order = sorted(range(len(self.used)), key=lambda k: (-self.used[k], k))
        pieces = [p for k in order for p in self.windows[k]]
        self.windows, self.used, self.limit = [], [], 1
        done = [s for doc, start, ids, n in pieces for s in self.add(doc, start, ids, n)]
        return done, self.windows[0] if self.windows else []


def powers(pieces: list) -> list[list]:
    """Cuts the pieces of one tail into sequences whose lengths are powers of two, the largest first."""
    total, out = sum(len(p[2]) for p in pieces), []
    pieces = list(pieces)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        sequence = []
        while want:
            doc, start, ids, n = pieces.pop(0)
            sequence.append((doc, start, ids[:want], n))
            if len(ids) > want:
                pieces.insert(0, (doc, start + want, ids[want:], n))
            want -= min(want, len(ids))
        out.append(sequence)
    return out


def _batch(sequences: list[tuple[int, list]], tail_of: int | None, kind: pa.DataType) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(8)]
    for number, pieces in sequences:
        offset = 0
        for doc, start, ids, n in pieces:
            for column, value in zip(columns, (doc, start, len(ids), ids.tobytes(), n, None if tail_of is not None else number, offset, tail_of), strict=True):
                column.append(value)
            offset += len(ids)
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tail_of"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(
    df: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, open_windows: int = 64, merge_width: int = 256, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian unsigned 32-bit; null unless keep_ids),
    ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of end_id alone. Repeated rows are packed once each, a null id is
    kept, an empty table gives no rows, and other columns are not read. Sequences hold `size` tokens, but
    for a few of a power of two at the end of each group of `merge_width` partitions. Texts stay in their
    partitions; only tails, less than a window for each partition, move.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer_path), Packer(size, open_windows)
        part, number, doc_kind = TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_kind, out, held = batch.schema.field(0).type, [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), end])
                for sequence in packer.add(doc.as_py(), 0, ids, len(ids)):
                    out.append(((part << 32) + number, sequence))
                    number += 1
                held += len(ids)
                if held > 1 << 20:
                    yield _batch(out, None, doc_kind)
                    out, held = [], 0
            yield _batch(out, None, doc_kind)
        if doc_kind is not None:
            done, tail = packer.finish()
            yield _batch([((part << 32) + number + i, s) for i, s in enumerate(done)], None, doc_kind)
            yield _batch([(0, tail)], part, doc_kind)
        give_back()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        packer, rows = Packer(size, 1), table.sort_by([("tail_of", "ascending"), ("offset", "ascending")]).to_pylist()
        done = [s for r in rows for s in packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])]
        tail = packer.finish()[1]
        first = (1 << 62) + (key[0].as_py() << 32)
        return pa.Table.from_batches([_batch([(first + i, s) for i, s in enumerate(done + powers(tail))], None, table.schema.field("doc_id").type)])

    pieces = df.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(windows, schema).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        pieces = pieces.withColumn("ids", F.when(F.col("tail_of").isNotNull(), F.col("ids")))
    pieces = materialize(pieces, "pieces")
    tails = pieces.where("tail_of is not null").withColumn("merge_group", F.floor(F.col("tail_of") / merge_width)).drop("ids_crc32")
    merged = tails.groupBy("merge_group").applyInArrow(merge, schema).withColumn("ids_crc32", F.crc32("ids"))
    out = pieces.where("tail_of is null").unionByName(merged)
    names = [F.col("doc_id").alias(id_col), "start", "length", *(["ids"] if keep_ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*names)
