"""Near-duplicate vectors by lattice hashing.

Directions are projected at random to eight dimensions, in several tables, and decoded to the nearest
point of the E8 lattice; that point is the cell of the vector. A vector also probes the neighbouring
cells nearest to its projection. Pairs that meet in a cell are verified by their cosine in double
precision, so no link is wrong; a link is missed only if no table brings its vectors together.

Equal vectors are one class, looked up once. Cells of more than `block` rows are split into blocks, each
pair of blocks being one task, so that no cell is ever held whole. Tasks return the number of links of
each class and a spanning forest of them, not the pairs: a pair is counted in the first table where it
meets, which both vectors tell from the cells that they carry.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.components import Forest, connected_components
from lamella.llm.shingles import mix
from lamella.llm.storage import materialize, release_table
from lamella.llm.vectors import finite, matrix

PAIRS_AT_ONCE = 1 << 15


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of a half with evenly many minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs)
    return np.array(out)


def _nearest_even(points: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole numbers with an even sum."""
    whole = np.rint(points)
    odd = whole.sum(1).astype(np.int64) % 2 != 0
    rest = points - whole
    worst = np.argmax(np.abs(rest), 1)
    rows = np.flatnonzero(odd)
    whole[rows, worst[rows]] += np.where(rest[rows, worst[rows]] >= 0, 1.0, -1.0)
    return whole


def nearest_lattice_points(points: np.ndarray) -> np.ndarray:
    """Decodes rows of eight numbers to E8, the union of D8 and D8 moved by a half."""
    a, b = _nearest_even(points), _nearest_even(points - 0.5) + 0.5
    closer = ((points - b) ** 2).sum(1) < ((points - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


class Lattice:
    """Cells and probes of directions of one dimension."""

    def __init__(self, dimension: int, tables: int, probes: int, width: float, seed: int = 8):
        random = np.random.default_rng([seed, dimension])
        self.turns = random.standard_normal((tables, dimension, 8)) / width
        self.shifts = random.random((tables, 8))
        self.near, self.probes = minimal_vectors(), probes

    @staticmethod
    def _keys(points: np.ndarray) -> np.ndarray:
        doubled = np.rint(points * 2).astype(np.int64).astype(np.uint64)
        key = np.full(len(points), np.uint64(0x9E3779B9))
        with np.errstate(over="ignore"):
            for k in range(8):
                key = mix(key * np.uint64(31) + doubled[:, k])
        return (key >> np.uint64(32)).astype(np.uint32)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """For each row, table and place: its own cell first, then the probed neighbours."""
        out = np.empty((len(units), len(self.turns), self.probes + 1), np.uint32)
        for t, (turn, shift) in enumerate(zip(self.turns, self.shifts, strict=True)):
            points = units @ turn + shift
            own = nearest_lattice_points(points)
            out[:, t, 0] = self._keys(own)
            if self.probes:
                gain = (points - own) @ self.near.T - (self.near**2).sum(1) / 2
                best = np.argpartition(-gain, self.probes - 1, 1)[:, : self.probes]
                for p in range(self.probes):
                    out[:, t, p + 1] = self._keys(own + self.near[best[:, p]])
        return out


_lattices: dict[tuple, Lattice] = {}


def _lattice(*key) -> Lattice:
    if key not in _lattices:
        _lattices[key] = Lattice(*key)
    return _lattices[key]


ROW = "cell long, probe boolean, id long, size long, raw binary, cells binary"
FOUND = "a long, b long, n long"
#: What a row does in its cell: is compared with and asks; is compared with; asks as an own row; asks as a probing row.
BOTH, INDEX, OWN_ASKS, PROBE_ASKS = range(4)


def _units(raw: np.ndarray) -> np.ndarray:
    values = raw.astype(np.float64)
    values /= np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values**2).sum(1, keepdims=True))


def _placed(classes: DataFrame, tables: int, probes: int, width: float, kind: str) -> DataFrame:
    """A row for each class, table and own or probed cell, with what verifying needs."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * (probes + 1)
        probing = np.tile(np.arange(probes + 1) > 0, tables)
        table = np.repeat(np.arange(tables, dtype=np.int64), probes + 1) << 32
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2)])
            for d in np.unique(lengths).tolist():
                some = np.flatnonzero(lengths == d)
                for i in range(0, len(some), 1024):
                    part = batch.take(pa.array(some[i : i + 1024]))
                    raw = matrix(part.column(2), kind)
                    cells = _lattice(d, tables, probes, width).cells(_units(raw))
                    n = len(raw)
                    keys = cells.reshape(n, each).astype(np.int64) + table
                    repeat = pa.array(np.repeat(np.arange(n), each))
                    packed = [pa.array([x.tobytes() for x in y], pa.binary()).take(repeat) for y in (raw, cells)]
                    columns = [pa.array(keys.ravel()), pa.array(np.tile(probing, n)), part.column(0).take(repeat), part.column(1).take(repeat), *packed]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROW.split(", ")])

    return classes.select("id", "size", "v").mapInArrow(place, ROW)


class _Verifier:
    """Links among rows of the same cell and block; the rows come sorted by these."""

    def __init__(self, tables: int, probes: int, threshold: float, kind: str):
        self.shape, self.threshold, self.kind = (tables, probes + 1), threshold, kind

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 14:
                table = pa.Table.from_batches(held)
                starts = self._starts(table)
                if len(starts) > 1:
                    yield self.settle(table.slice(0, int(starts[-1])))
                    table = table.slice(int(starts[-1]))
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield self.settle(pa.Table.from_batches(held))

    @staticmethod
    def _starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for name in ("cell", "a", "b"):
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def settle(self, table: pa.Table) -> pa.RecordBatch:
        cell, role, ids, sizes = (table.column(k).to_numpy() for k in ("cell", "role", "id", "size"))
        raw = table.column("raw").to_pylist()
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint32).reshape(len(raw), *self.shape)
        lengths = np.array([len(x) for x in raw])
        forest, counts = Forest(), {}
        starts = self._starts(table)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)], strict=True):
            if end - start < 2:
                continue
            for length in np.unique(lengths[start:end]).tolist():
                rows = start + np.flatnonzero(lengths[start:end] == length)
                index = rows[(role[rows] == BOTH) | (role[rows] == INDEX)]
                asking = rows[role[rows] != INDEX]
                if not len(index) or not len(asking):
                    continue
                units = _units(np.frombuffer(b"".join(raw[i] for i in asking), self.kind).reshape(len(asking), -1))
                for k in range(0, len(index), 1024):
                    some = index[k : k + 1024]
                    mine = _units(np.frombuffer(b"".join(raw[i] for i in some), self.kind).reshape(len(some), -1))
                    near = mine @ units.T >= self.threshold - 1e-9
                    near &= np.where((role[asking] == PROBE_ASKS)[None, :], ids[some][:, None] != ids[asking][None, :], ids[some][:, None] < ids[asking][None, :])
                    x, y = np.nonzero(near)
                    for i in range(0, len(x), PAIRS_AT_ONCE):
                        p, q = x[i : i + PAIRS_AT_ONCE], y[i : i + PAIRS_AT_ONCE]
                        good = np.einsum("ij,ij->i", mine[p], units[q]) >= self.threshold
                        self._count(some[p[good]], asking[q[good]], cell, ids, sizes, cells, forest, counts)
        pairs = list(forest.stars())
        columns = [[x for x, _ in pairs] + list(counts), [y for _, y in pairs] + [None] * len(counts), [None] * len(pairs) + list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    def _count(self, x, y, cell, ids, sizes, cells, forest, counts) -> None:
        """Adds links of index rows x and asking rows y; counts those that meet here first."""
        first_is_low = ids[x] < ids[y]
        low, high = np.where(first_is_low, x, y), np.where(first_is_low, y, x)
        meets = np.stack([(cells[high] == cells[low][:, :, :1]).any(2), (cells[low] == cells[high][:, :, :1]).any(2)], 2).reshape(len(x), -1)
        fresh = np.argmax(meets, 1) == 2 * (cell[x] >> 32) + ~first_is_low
        for u, v, su, sv, new in zip(ids[x].tolist(), ids[y].tolist(), sizes[x].tolist(), sizes[y].tolist(), fresh.tolist(), strict=True):
            forest.join(u, v)
            if new:
                counts[u] = counts.get(u, 0) + sv
                counts[v] = counts.get(v, 0) + su


def near_duplicates(df: DataFrame, threshold: float = 0.9, tables: int = 7, probes: int = 4, width: float = 1.3, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept for each row of df.

    n_links counts the other rows whose vectors were found with a cosine of at least threshold, equal
    vectors included; component_id is the smallest id reachable by links, kept tells whether that is the
    row's own. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths never link. Rows that repeat an id count each. A row with a null
    id is returned, without links. An empty table gives no rows.
    """
    v = F.col(vec_col)
    kind = "<f4" if "float" in df.schema[vec_col].dataType.simpleString() else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(finite(v) & F.exists(v, lambda x: x != 0), F.lit(False)).alias("ok"))
    good = rows.where("ok and id is not null").drop("ok")
    equal = materialize(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("size")), "classes")
    # rows of one id may differ: a class needs a name of its own
    classes = materialize(equal.withColumn("id", F.monotonically_increasing_id()), "classes")
    placed = _placed(classes, tables, probes, width, kind)
    crowds = placed.groupBy("cell").agg(F.count_if(~F.col("probe")).alias("own"), F.count("*").alias("asks")).where(F.col("asks") > block)
    known = placed.join(materialize(crowds, "crowds"), "cell", "left")
    columns = ["cell", "a", "b", "role", "id", "size", "raw", "cells"]
    zero = F.lit(0)
    plain = known.where("asks is null").select("cell", zero.alias("a"), zero.alias("b"), F.when(F.col("probe"), PROBE_ASKS).otherwise(BOTH).alias("role"), "id", "size", "raw", "cells")
    crowded = known.where("asks is not null").withColumn("as", F.ceil(F.greatest("own", F.lit(1)) / block).cast("int")).withColumn("bs", F.ceil(F.col("asks") / block).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    compared = crowded.where("not probe").withColumn("a", place(F.col("as"))).withColumn("b", each(F.col("bs"))).withColumn("role", F.lit(INDEX))
    asking = crowded.withColumn("b", place(F.col("bs"))).withColumn("a", each(F.col("as"))).withColumn("role", F.when(F.col("probe"), PROBE_ASKS).otherwise(OWN_ASKS))
    cells = plain.unionByName(compared.select(*columns)).unionByName(asking.select(*columns))
    found = cells.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "id", "role").mapInArrow(_Verifier(tables, probes, threshold, kind), FOUND)
    found = materialize(found, "found")
    labels = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    links = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    counted = classes.join(labels, "id", "left").join(links, "id", "left").withColumn("label", F.coalesce("label", "id"))
    counted = materialize(counted.select("v", "least", "label", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "counted")
    least = materialize(counted.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    known = materialize(counted.join(least, "label").select("v", "n_links", "component_id"), "known")
    release_table(found)
    linked = good.join(known, "v").select("id", "n_links", "component_id")
    alone = rows.where("not ok or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
