"""N-gram Jaccard join: exact self-join of texts on their sets of word shingles.

Overlaps are products of the sparse incidence matrix (texts by shingles) with its transpose, computed in
blocks. Bounds from the set sizes keep the blocks small, and lose no pair:

1. Texts with equal sets are one class; links are sought between classes. Of each class only the shingles
   first in the order of their hashes are compared at first, in a few bytes each: a linked class shares a
   least number of these (`ahead`). Classes that share fewer have no link. The others are made a bit filter,
   which lets some more pass but none of them be lost.
2. Shingles of these go, as packed bytes, to buckets by hash, where those that only one class has are dropped.
   Of a shingle that HOT classes of one batch share, a bucket gets only their number: their list goes
   elsewhere, spread over all tasks, and meets the count of the shingle in a join, so that no shingle
   gathers its classes in one task. A class with fewer shared shingles than the bound on its overlap has
   no link and is dropped whole.
3. Two linked classes share one of their rarest shingles (a prefix whose length follows from the size
   bound; rarest first by exact counts over all texts). Classes that share a prefix shingle, in the same
   or neighbouring size bands, are candidates; a star for each shingle connects them.
4. Within each connected group of candidates, blocks of the incidence matrix are multiplied: columns of
   many rows as dense products, the others by counting pairs. Pairs below the bound are discarded.
   Groups beyond one block are multiplied first along the diagonal, with some common rows in each block;
   only rows that stay outside the largest component are then multiplied with all others.

Keys of classes are 64-bit hashes with 64-bit checks beside them. If two sets with different checks have one
key, all keys are formed anew with another seed, so that only sets equal in 128 bits are one class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.components import Forest, connected_components
from lamella.llm.memory import give_back, text_runs
from lamella.llm.shingles import mix, set_key, shingle_sets
from lamella.llm.storage import materialize, release_table

GRAM_BYTES = 7
#: Shingles that a task sorts at once, and those that it packs at once. Larger ones need more memory, in
#: each Python worker about 60 bytes a shingle, and give fewer, larger rows to shuffle.
BUCKET_GRAMS = 1 << 20
PACKED_GRAMS = 1 << 20
#: A shingle that so many classes of a batch share is counted there.
HOT = 16
#: Rows and bytes of shingles of a block that is multiplied.
BLOCK_ROWS, BLOCK_BYTES = 2048, 64 << 20
HUBS = 64
DENSE = 48
#: Of a set, the share of shingles that is sent ahead beyond the least that two linked sets must meet in. More
#: of them cost bytes for every text, and leave fewer texts whose shingles are all sent.
AHEAD = 10
#: Bits of a segment of the filter, bits for each class, those set for each, and segments at most.
SEGMENT_BITS, CLASS_BITS, PROBES, SEGMENTS = 1 << 20, 16, 4, 256


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(sorted_values)]]))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _rows(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def need(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of this size can have with a linked one."""
    return -(-percent * sizes // 100)


def ahead(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its least shingles a set of this size sends ahead, and how many of them a linked set sends too.

    Of the overlap of two linked sets, the k-th least shingle is among the n - need + k least of each. A set
    sends so many for its own k, which grows with n; a linked set has need shingles at least, so its k is not
    below that of need.
    """
    k = lambda n: np.maximum(1, np.minimum(need(n, percent), -(-AHEAD * n // 100)))
    least = need(sizes, percent)
    return np.minimum(sizes, sizes - least + k(sizes)), k(least)


#: Seeds tried until no two sets share a key; checks are formed with one beyond.
SEEDS = 8
COLD, COUNT, LIST = range(3)
SHARED = "bucket int, kind byte, classes binary, sizes binary, counts binary, grams binary, classes_with binary"


def set_table(df: DataFrame, id_col: str, text_col: str, width: int, seed: int = 0) -> DataFrame:
    """id, n_shingles, class and check (null for texts without words) of every row."""
    names, kinds = ["id", "n_shingles", "class", "check"], [pa.int64()] * 4

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_runs(batch.column(1)):
                sets = shingle_sets(texts, width)
                classes, checks = ([set_key(s, k) if len(s) else None for s in sets] for k in (seed, SEEDS))
                yield _rows(names, kinds, [batch.column(0)[a:b].cast(pa.int64()), [len(s) for s in sets], classes, checks])
        give_back()

    return df.select(id_col, text_col).mapInArrow(keys, "id long, n_shingles long, class long, check long")


def _classes(df: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, int]:
    """The set table, its classes with their least ids, sizes and copies, and the first seed whose keys tell all sets apart."""
    for seed in range(SEEDS):
        rows = materialize(set_table(df, id_col, text_col, width, seed), "sets")
        found = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.min("check").alias("check"), F.max("check").alias("other"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
        classes = materialize(found, "classes")
        if classes.where(F.col("check") != F.col("other")).isEmpty():
            return rows.drop("check"), classes.select("class", "least", "n", "copies"), seed
        release_table(rows)
        release_table(classes)
    raise RuntimeError(f"different sets share a key under each of {SEEDS} seeds")


#: Bytes of a shingle and of a class that are sent ahead, and the tag of a shingle that several classes of a batch have.
SHORT_BYTES, TAG_BYTES, MANY = 4, 5, 0


def _tag(classes, size: int):
    """From 1 on: a class in so many bytes. For columns and arrays."""
    n = (1 << 8 * size) - 1
    return classes % n + 1 if isinstance(classes, np.ndarray) else F.pmod(classes, F.lit(n)) + 1


def _cut(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _whole(column: pa.ChunkedArray, n: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n] = raw
    return out.view("<u8").ravel()


def _met(df: DataFrame, text_col: str, width: int, percent: int, buckets: int, seed: int = 0) -> DataFrame:
    """tag, met: of the shingles that classes send ahead, how many some other class sends too; in parts, to be summed.

    Bytes cut from shingles and copies of a text in several tasks can only make the numbers too great. A
    batch counts what several of its classes have itself, and sends one such shingle for all of them.
    """
    names, kinds = ["bucket", "tags", "grams", "met"], [pa.int32(), *[pa.binary()] * 3]

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            tags = _tag(np.array([k for k, _ in held], np.int64), TAG_BYTES)
            owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
            # the least shingles are spread over all buckets, which follow the order of the mixed ones
            grams = mix(np.concatenate([s for _, s in held])) if held else np.zeros(0, np.uint64)
            order = np.argsort(grams)
            grams, owner = grams[order], owner[order]
            place = _bucket(grams, buckets)
            short = grams & np.uint64((1 << 8 * SHORT_BYTES) - 1)
            first, with_ = _runs(grams)
            many = with_ > 1
            met = np.bincount(owner[_ragged(first[many], with_[many])], minlength=len(held)).astype(np.int64)
            # shingles of one class that look alike would be counted once: it meets as many as it has
            alike = np.lexsort((short, place, owner))
            same = np.flatnonzero((short[alike[1:]] == short[alike[:-1]]) & (place[alike[1:]] == place[alike[:-1]]) & (owner[alike[1:]] == owner[alike[:-1]]))
            twice = owner[alike[same]]
            met[twice] = np.bincount(owner, minlength=len(held))[twice]
            tag, place, short = np.where(many, MANY, tags[owner[first]]), place[first], short[first]
            out: list[list] = [[] for _ in names]
            for start, n in zip(*_runs(place), strict=True):
                part = slice(start, start + n)
                for column, value in zip(out, (int(place[start]), _cut(tag[part], TAG_BYTES), _cut(short[part], SHORT_BYTES), b""), strict=True):
                    column.append(value)
            if met.any():
                spread = int(mix(tags[:1].view(np.uint64))[0] % np.uint64(buckets))
                for column, value in zip(out, (spread, _cut(tags[met > 0], TAG_BYTES), b"", met[met > 0].tobytes()), strict=True):
                    column.append(value)
            return _rows(names, kinds, out)

        for batch in batches:
            for _, _, texts in text_runs(batch.column(0)):
                sets = shingle_sets(texts, width)
                lengths = ahead(np.array([len(s) for s in sets], np.int64), percent)[0].tolist()
                for s, n in zip(sets, lengths, strict=True):
                    if len(s) and (key := set_key(s, seed)) not in seen:
                        seen.add(key)
                        held.append((key, s[:n].copy()))
                        total += n
                if total > PACKED_GRAMS:
                    yield flush()
                    held, total = [], 0
        yield flush()
        give_back()

    def counted(table: pa.Table) -> pa.Table:
        give_back()
        is_counts = np.array([len(x) > 0 for x in table.column("met").to_pylist()], bool)
        counts, table = table.filter(pa.array(is_counts)), table.filter(pa.array(~is_counts))
        short, tags = _whole(table.column("grams"), SHORT_BYTES), _whole(table.column("tags"), TAG_BYTES)
        order = np.lexsort((tags, short))
        short, tags = short[order], tags[order]
        new = np.ones(len(short), bool)
        new[1:] = (short[1:] != short[:-1]) | (tags[1:] != tags[:-1])
        short, tags = short[new], tags[new]
        first, lengths = _runs(short)
        tags = tags[_ragged(first[lengths > 1], lengths[lengths > 1])]
        tags, met = np.unique(tags[tags != MANY], return_counts=True)
        before, (number,) = _whole(counts.column("tags"), TAG_BYTES), _unpack(counts, {"met": "<i8"})
        return pa.Table.from_batches([_rows(["tag", "met"], [pa.int64()] * 2, [np.concatenate([tags, before]).view(np.int64), np.concatenate([met, number])])])

    packed = df.select(text_col).mapInArrow(sent, "bucket int, tags binary, grams binary, met binary")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(counted, "tag long, met long")


def _near(classes: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """class, n, copies of all classes that can have links, a table in the shared folder."""

    def enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = ahead(batch.column(1).to_numpy(), percent)[1]
            yield batch.filter(pa.array(batch.column(3).to_numpy() >= least)).select([0, 1, 2])

    tagged = classes.select("class", "n", "copies", _tag(F.col("class"), TAG_BYTES).alias("tag"))
    met = met.groupBy("tag").agg(F.sum("met").alias("met"))
    found = tagged.join(met, "tag").select("class", "n", "copies", "met").mapInArrow(enough, "class long, n long, copies long")
    # classes of one tag can't be told apart there
    alike = tagged.groupBy("tag").agg(F.count("*").alias("k")).where("k > 1").select("tag")
    return materialize(found.unionByName(tagged.join(alike, "tag").select("class", "n", "copies")), "near")


class ClassFilter:
    """Bits that tell of any class of a table that it is there, and of a few others too. At most SEGMENTS segments."""

    def __init__(self, near: DataFrame, rows: int):
        self.segments = max(1, min(SEGMENTS, -(-rows * CLASS_BITS // SEGMENT_BITS)))
        self.bits = np.zeros((self.segments, SEGMENT_BITS // 8), np.uint8)
        segments = self.segments

        def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _rows(["segment", "class"], [pa.int64()] * 2, [ClassFilter.segment(batch.column(0).to_numpy(), segments), batch.column(0)])

        def filled(key: tuple, table: pa.Table) -> pa.Table:
            bits = np.zeros(SEGMENT_BITS, bool)
            for at in ClassFilter.places(table.column("class").to_numpy()):
                bits[at] = True
            return pa.Table.from_batches([_rows(["segment", "bits"], [pa.int64(), pa.binary()], [[key[0].as_py()], [np.packbits(bits, bitorder="little").tobytes()]])])

        for r in near.select("class").mapInArrow(placed, "segment long, class long").groupBy("segment").applyInArrow(filled, "segment long, bits binary").collect():
            self.bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)

    @staticmethod
    def segment(classes: np.ndarray, segments: int) -> np.ndarray:
        return _bucket(mix(classes.view(np.uint64)), segments).astype(np.int64)

    @staticmethod
    def places(classes: np.ndarray) -> Iterator[np.ndarray]:
        at = mix(classes.view(np.uint64))
        for _ in range(PROBES):
            at = mix(at + np.uint64(0x9E3779B97F4A7C15))
            yield (at & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)

    def holds(self, classes: np.ndarray) -> np.ndarray:
        segment, found = ClassFilter.segment(classes, self.segments), np.ones(len(classes), bool)
        for at in ClassFilter.places(classes):
            found &= (self.bits[segment, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def false_share(self) -> float:
        """The share of other classes that it lets pass."""
        return float(np.bitwise_count(self.bits).sum() / (self.bits.size * 8)) ** PROBES


def _packed_grams(df: DataFrame, text_col: str, width: int, buckets: int, among: ClassFilter, seed: int = 0) -> DataFrame:
    """Shingles of each class that the filter holds, once for each partition and batch, packed by bucket.

    Rows of COLD hold classes and their shingles. Rows of COUNT hold hot shingles, with how many classes have
    each in counts. Rows of LIST hold one hot shingle and its classes, in any bucket.
    """
    names = ["bucket", "kind", "classes", "sizes", "counts", "grams"]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            keys = np.array([k for k, _ in held], np.int64)
            sizes = np.array([len(s) for _, s in held], np.uint32)
            grams = np.concatenate([s for _, s in held]) if held else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(held)), sizes)
            out: list[list] = [[] for _ in names]

            def add(*values) -> None:
                for column, value in zip(out, values, strict=True):
                    column.append(value)

            order = np.argsort(grams, kind="stable")
            first, with_ = _runs(grams[order])
            hot = with_ >= HOT
            if hot.any():
                spread = int(mix(keys[:1].view(np.uint64))[0])
                where = _bucket(grams[order][first[hot]], buckets)
                for k, (start, n) in enumerate(zip(first[hot].tolist(), with_[hot].tolist(), strict=True)):
                    who = owner[order[start : start + n]]
                    add((spread + k) % buckets, LIST, keys[who].tobytes(), sizes[who].tobytes(), b"", grams[order[start]].tobytes())
                by_bucket = np.argsort(where, kind="stable")
                values, numbers = grams[order][first[hot]][by_bucket], with_[hot][by_bucket].astype(np.uint32)
                for start, n in zip(*_runs(where[by_bucket]), strict=True):
                    part = slice(start, start + n)
                    add(int(where[by_bucket][start]), COUNT, b"", b"", numbers[part].tobytes(), values[part].tobytes())
                cold = np.ones(len(grams), bool)
                cold[order[_ragged(first[hot], with_[hot])]] = False
                owner, grams = owner[cold], grams[cold]
            place = _bucket(grams, buckets).astype(np.uint32)
            order = np.argsort(place, kind="stable")
            place, owner, grams = place[order], owner[order], grams[order]
            for start, n in zip(*_runs(place), strict=True):
                mine = owner[start : start + n]
                first, counts = _runs(mine)
                who = mine[first]
                body = np.ascontiguousarray(grams[start : start + n]).view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES].tobytes()
                add(int(place[start]), COLD, keys[who].tobytes(), sizes[who].tobytes(), counts.astype(np.uint32).tobytes(), body)
            return _rows(names, [pa.int32(), pa.int8(), *[pa.binary()] * 4], out)

        for batch in batches:
            for _, _, texts in text_runs(batch.column(0)):
                sets = [s for s in shingle_sets(texts, width) if len(s)]
                keys = np.array([set_key(s, seed) for s in sets], np.int64)
                for i in np.flatnonzero(among.holds(keys)).tolist():
                    if (key := int(keys[i])) not in seen:
                        s = sets[i]
                        seen.add(key)
                        held.append((key, s))
                        total += len(s)
                if total > PACKED_GRAMS:
                    yield flush()
                    held, total = [], 0
        yield flush()
        give_back()

    return df.select(text_col).mapInArrow(packed, "bucket int, kind byte, classes binary, sizes binary, counts binary, grams binary")


def _unpack(table: pa.Table, kinds: dict) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in kinds.items()]


def _packed_by_class(classes: np.ndarray, sizes: np.ndarray, grams: np.ndarray, with_: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Occurrences of shingles (class, its size, shingle, how many classes have it) packed by bucket of the class."""
    names = [x.split()[0] for x in SHARED.split(", ")]
    place = _bucket(classes.view(np.uint64), buckets).astype(np.uint32)
    order = np.lexsort((classes, place))
    place, classes, sizes, grams, with_ = place[order], classes[order], sizes[order], grams[order], with_[order]
    out: list[list] = [[] for _ in names]
    for start, n in zip(*_runs(place), strict=True):
        part = slice(start, start + n)
        first, lengths = _runs(classes[part])
        values = (int(place[start]), COLD, classes[part][first].tobytes(), sizes[part][first].astype(np.uint32).tobytes(), lengths.astype(np.uint32).tobytes(), grams[part].tobytes(), with_[part].astype(np.uint32).tobytes())
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return _rows(names, [pa.int32(), pa.int8(), *[pa.binary()] * 5], out)


def _shared_grams(packed: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket, the shingles that two classes have, with their class counts, packed by class; the counts
    of hot shingles; and the lists as they came. A table in the shared folder.
    """

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        kinds = table.column("kind").to_numpy()
        lists = table.filter(pa.array(kinds == LIST))
        table, counted = table.filter(pa.array(kinds == COLD)), table.filter(pa.array(kinds == COUNT))
        # of hot shingles: the sums of what batches counted
        hot, numbers = _unpack(counted, {"grams": "<u8", "counts": "<u4"})
        hot, which = np.unique(hot, return_inverse=True)
        numbers = np.bincount(which, numbers, len(hot)).astype(np.int64)
        classes, sizes, counts = _unpack(table, {"classes": "<i8", "sizes": "<u4", "counts": "<u4"})
        raw = b"".join(table.column("grams").to_pylist())
        grams = np.zeros((len(raw) // GRAM_BYTES, 8), np.uint8)
        grams[:, :GRAM_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, GRAM_BYTES)
        grams = grams.view(np.uint64).ravel()
        short = hot & np.uint64((1 << 8 * GRAM_BYTES) - 1)  # the bucket stands for the last byte
        by_short = np.argsort(short)

        def hot_place(values: np.ndarray) -> np.ndarray:
            """Where the shingles are among the hot ones; -1 for others."""
            if not len(hot):
                return np.full(len(values), -1)
            at = np.minimum(np.searchsorted(short[by_short], values), len(hot) - 1)
            return np.where(short[by_short][at] == values, by_short[at], -1)

        row = np.repeat(np.arange(len(classes)), counts)
        order = np.argsort(grams)
        grams, row = grams[order], row[order]
        starts, lengths = _runs(grams)
        several = (lengths > 1) | (hot_place(grams[starts]) >= 0)
        keep = _ragged(starts[several], lengths[several])
        grams, row = grams[keep], row[keep]
        order = np.lexsort((classes[row], grams))
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (classes[row[1:]] != classes[row[:-1]])
        grams, row = grams[new], row[new]
        starts, lengths = _runs(grams)
        at = hot_place(grams[starts])
        also = np.flatnonzero(at >= 0)
        numbers[at[also]] += lengths[also]
        total = lengths.copy()
        total[also] = numbers[at[also]]
        with_ = np.repeat(total, lengths)
        grams, row, with_ = grams[with_ > 1], row[with_ > 1], with_[with_ > 1]
        grams = grams | (np.uint64(key[0].as_py() & 0xFF) << np.uint64(56))
        found = _packed_by_class(classes[row], sizes[row], grams, with_, buckets)
        hot = short | (np.uint64(key[0].as_py() & 0xFF) << np.uint64(56))
        n = len(hot)
        nothing = [b""] * n
        summed = _rows(found.schema.names, [f.type for f in found.schema], [[key[0].as_py()] * n, [COUNT] * n, nothing, nothing, nothing, [x.tobytes() for x in hot], [x.tobytes() for x in numbers.astype(np.uint32)]])
        passed = lists.append_column("classes_with", pa.array([b""] * len(lists), pa.binary())).select(found.schema.names).cast(found.schema)
        # lists name their shingle as buckets do
        names = [_named(x.as_py(), buckets) for x in lists.column("grams")]
        passed = passed.set_column(passed.schema.get_field_index("grams"), "grams", pa.array(names, pa.binary()))
        return pa.concat_tables([pa.Table.from_batches([found, summed]), passed])

    return materialize(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared, SHARED), "shared")


def _named(gram: bytes, buckets: int) -> bytes:
    """A shingle with the last byte of its bucket in place of its own."""
    value = np.frombuffer(gram, "<u8")
    return gram[:GRAM_BYTES] + bytes([int(_bucket(value, buckets)[0]) & 0xFF])


def _with_hot(shared: DataFrame, buckets: int) -> DataFrame:
    """The packed occurrences of all shared shingles, also of hot ones: their lists, with their counts."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_py(), "<i8") for x in batch.column("classes")]
            if lists:
                times = [len(x) for x in lists]
                sizes = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), "<u4")
                each = lambda name, kind: np.repeat(np.frombuffer(b"".join(batch.column(name).to_pylist()), kind), times)  # noqa: E731, B023
                yield _packed_by_class(np.concatenate(lists), sizes, each("grams", "<u8"), each("total", "<u4"), buckets)

    lists = shared.where(F.col("kind") == LIST).select("grams", "classes", "sizes")
    counts = shared.where(F.col("kind") == COUNT).select("grams", F.col("classes_with").alias("total"))
    # both sides are read from files, so adaptive execution can split the lists of one shingle
    return shared.where(F.col("kind") == COLD).unionByName(lists.join(counts, "grams").mapInArrow(spread, SHARED))


def _candidate_sets(shared: DataFrame, percent: int, buckets: int) -> DataFrame:
    """class, n, grams (its shared shingles) and prefix (the rarest of them) of classes that may have links."""
    names = ["class", "n", "grams", "prefix"]

    def sets(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        classes, sizes, counts, grams, with_ = _unpack(table, {"classes": "<i8", "sizes": "<u4", "counts": "<u4", "grams": "<u8", "classes_with": "<u4"})
        owner = np.repeat(classes, counts)
        size = np.repeat(sizes, counts)
        order = np.lexsort((grams, with_, owner))
        # a class whose text is in several tasks may have a shingle from each
        new = np.ones(len(order), bool)
        new[1:] = (owner[order[1:]] != owner[order[:-1]]) | (grams[order[1:]] != grams[order[:-1]])
        order = order[new]
        owner, size, grams = owner[order], size[order], grams[order]
        out: list[list] = [[] for _ in names]
        for start, m in zip(*_runs(owner), strict=True):
            n = int(size[start])
            least = int(need(np.int64(n), percent))
            if m >= least:
                mine = grams[start : start + m]
                for column, value in zip(out, (int(owner[start]), n, np.sort(mine).tobytes(), mine[: m - least + 1].tobytes()), strict=True):
                    column.append(value)
        return pa.Table.from_batches([_rows(names, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], out)])

    return shared.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(sets, "class long, n long, grams binary, prefix binary")


def _candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: stars that connect all classes which share a prefix shingle and lie in near size bands.

    A batch links what it holds itself and passes on one class for each shingle and band; of these the least
    is found by partial aggregation, and joined to the others.
    """
    ratio = np.log(100 / percent) if percent < 100 else 1.0

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prefixes = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(2)]
            owner = np.repeat(np.arange(len(classes)), [len(p) for p in prefixes])
            gram = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            band = np.floor(np.log(sizes[owner]) / ratio + 1e-9).astype(np.int64)
            gram, owner, band = np.concatenate([gram, gram]), classes[np.concatenate([owner, owner])], np.concatenate([band, band + 1])
            order = np.lexsort((owner, band, gram))
            gram, owner, band = gram[order], owner[order], band[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (band[1:] != band[:-1])
            starts = np.flatnonzero(new)
            lengths = np.diff(np.concatenate([starts, [len(gram)]]))
            first = np.repeat(owner[starts], lengths) if len(starts) else owner
            links = np.unique(np.stack([owner[~new], first[~new]], 1), axis=0) if (~new).any() else np.zeros((0, 2), np.int64)
            nothing, zeros = np.zeros(len(links), np.int64), np.zeros(len(starts), np.int64)
            yield _rows(["gram", "band", "a", "b"], [pa.int64()] * 4, [np.concatenate([gram[starts].view(np.int64), nothing]), np.concatenate([band[starts], nothing - 1]), np.concatenate([owner[starts], links[:, 0]]), np.concatenate([zeros, links[:, 1]])])

    found = materialize(sets.select("class", "n", "prefix").mapInArrow(stars, "gram long, band long, a long, b long"), "prefix")
    local = found.where("band < 0").select("a", "b")
    met = found.where("band >= 0").select("gram", "band", "a")
    least = met.groupBy("gram", "band").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = met.join(materialize(least, "least"), ["gram", "band"]).where("a <> b").select("a", "b")
    return local.unionByName(across)


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Product of the incidence matrix of sorted distinct values with its transpose."""
    m = len(rows)
    sizes = np.array([len(r) for r in rows])
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts, lengths = _runs(values)
    product = np.zeros(m * m, np.int64)
    wide = np.flatnonzero(lengths > DENSE)
    for i in range(0, len(wide), 2048):
        some = wide[i : i + 2048]
        dense = np.zeros((m, len(some)), np.float32)
        dense[owner[_ragged(starts[some], lengths[some])], np.repeat(np.arange(len(some)), lengths[some])] = 1
        product += (dense @ dense.T).astype(np.int64).ravel()
    for d in np.unique(lengths[(lengths > 1) & (lengths <= DENSE)]).tolist():
        at = starts[lengths == d]
        step = max(1, (1 << 21) // (d * d))
        for i in range(0, len(at), step):
            ids = owner[at[i : i + step, None] + np.arange(d)]
            product += np.bincount((ids[:, :, None] * m + ids[:, None, :]).ravel(), minlength=m * m)
    return product.reshape(m, m)


def _linked(table: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows whose similarity reaches percent; a spanning forest of them."""
    classes, sizes = table.column("class").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    classes, first = np.unique(classes, return_index=True)
    sizes = sizes[first]
    grams = table.column("grams")
    product = overlaps([np.frombuffer(grams[int(i)].as_py(), "<u8") for i in first])
    least = percent * (sizes[:, None] + sizes[None, :] - product)
    a, b = np.nonzero(np.triu(100 * product >= least, 1))
    forest = Forest()
    for x, y in zip(classes[a].tolist(), classes[b].tolist(), strict=True):
        forest.join(x, y)
    return forest.stars()


def _links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: true links, enough of them to connect what is connected."""
    names, kinds = ["a", "b"], [pa.int64(), pa.int64()]

    def block(table: pa.Table) -> pa.Table:
        found = list(_linked(table, percent))
        return pa.Table.from_batches([_rows(names, kinds, [[x for x, _ in found], [y for _, y in found]])])

    held = materialize(sets.select("class", "n", "grams").join(groups.withColumnRenamed("node", "class"), "class"), "members")
    # rows counts as many as its bytes would fill: blocks are bounded in both
    units = F.greatest(F.count("*"), F.ceil(F.sum(F.octet_length("grams")) * F.lit(BLOCK_ROWS / BLOCK_BYTES)))
    sized = materialize(held.groupBy("label").agg(units.alias("rows"), (units / F.count("*")).alias("weight")), "groups")
    members = held.join(sized, "label")
    small = members.where(F.col("rows") <= BLOCK_ROWS)
    total = int(sized.where(F.col("rows") <= BLOCK_ROWS).agg(F.sum("rows")).first()[0] or 0)
    together = F.pmod(F.xxhash64("label"), F.lit(max(1, total // (BLOCK_ROWS // 4))))
    found = small.withColumn("block", together).groupBy("block").applyInArrow(block, "a long, b long")
    large = members.where(F.col("rows") > BLOCK_ROWS)
    if large.isEmpty():
        return materialize(found, "links")
    spread = F.xxhash64("class", F.lit(7))
    chunk = F.pmod(spread, F.ceil(F.col("rows") / BLOCK_ROWS))
    hub = F.pmod(F.shiftright(spread, 20), F.col("rows")) < HUBS
    everywhere = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / BLOCK_ROWS) - 1)
    diagonal = large.withColumn("block", F.explode(F.when(hub, everywhere).otherwise(F.array(chunk))))
    first = materialize(found.unionByName(diagonal.groupBy("label", "block").applyInArrow(block, "a long, b long")), "links")
    joined = connected_components(first).withColumnRenamed("label", "part").withColumnRenamed("node", "class")
    state = large.select("class", "label", "weight").join(joined, "class", "left").withColumn("part", F.coalesce("part", "class"))
    state = materialize(state, "state")
    parts = state.groupBy("label", "part").agg(F.ceil(F.sum("weight")).alias("count")).groupBy("label").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("inside"))
    parts = materialize(parts.where(F.col("all") > F.col("inside")), "parts")
    open_ = large.join(state.select("class", "part"), "class").join(parts, "label").withColumn("stray", F.col("part") != F.col("main")).drop("part", "main")
    half = BLOCK_ROWS // 2
    chunks = F.ceil(F.col("all") / half)
    stray_chunks = F.ceil((F.col("all") - F.col("inside")) / half)
    i, j = F.pmod(spread, chunks), F.pmod(F.shiftright(spread, 24), stray_chunks)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_row = open_.withColumn("i", i).withColumn("j", F.explode(upto(stray_chunks)))
    as_stray = open_.where("stray").withColumn("j", j).withColumn("i", F.explode(upto(chunks)))
    rest = as_row.unionByName(as_stray).groupBy("label", "i", "j").applyInArrow(block, "a long, b long")
    return materialize(first.unionByName(rest), "links")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id for each row of df; df is read three times and nothing else of it is.

    Rows link when their sets of `width`-word shingles have a Jaccard similarity of percent/100 or more;
    component_id is the smallest id reachable by links. Texts that are null, empty or without words have
    an empty set and link with nothing, not even each other. Rows that repeat an id are rows of their own.
    A null id never becomes the id of a component with others. An empty table gives no rows.
    """
    rows, classes, seed = _classes(df, id_col, text_col, width)
    total, texts = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("class")).first()
    first = min(total, total * (100 - percent + AHEAD) // 100 + 2 * texts)
    met = _met(df, text_col, width, percent, max(16, -(-first // BUCKET_GRAMS)), seed)
    near = _near(classes, met, percent)
    found = near.agg(F.count("*").alias("rows"), F.sum(F.col("n") * F.col("copies")).alias("grams")).first()
    among = ClassFilter(near, found["rows"])
    release_table(near)
    passing = (found["grams"] or 0) + int(total * among.false_share())
    buckets = max(16, -(-passing // BUCKET_GRAMS))
    shared = _shared_grams(_packed_grams(df, text_col, width, buckets, among, seed), buckets)
    sets = materialize(_candidate_sets(_with_hot(shared, buckets), percent, buckets), "candidates")
    release_table(shared)
    groups = connected_components(_candidate_links(sets, percent))
    labels = connected_components(_links(sets, groups, percent))
    release_table(sets)
    named = materialize(classes.select("class", "least").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")), "classes")
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = materialize(named.join(least, "label").select("class", "component_id"), "classes")
    with_words = rows.where("class is not null").join(named, "class")
    out = with_words.select("id", "n_shingles", "component_id").unionByName(rows.where("class is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col)
