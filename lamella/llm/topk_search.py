"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse to fine. With the mean m and the spread s (root of the summed
squared deviations) of each segment of length l, the inner product of two vectors lies below
sum(l * m_x * m_q + s_x * s_q) by the inequality of Cauchy and Schwarz; equivalently, their squared
distance |x|^2 + |q|^2 - 2 x.q has a lower bound. At each resolution the bound discards the candidates
that cannot reach the k-th best score known so far. Of those that the finest leaves, the most promising
get exact scores first, which raises the k-th best; then the others that still can reach it do. No other
pair is ever multiplied.

Queries and candidates are dealt into blocks by a hash of their ids; each pair of blocks is one task of
bounded size. The k-th best score of each query among SEEDS candidates, found first, is known to all of
its tasks. Each returns at most k rows for a query; a last aggregation ranks those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.vectors import finite, matrix

#: Segments of each resolution, for vectors of at least so many components.
RESOLUTIONS = (2, 8, 32, 48)
STRIDE = 1024
#: How many candidates of a stride are scored first for a query.
FIRST = 4
#: Candidates, chosen by a hash of the id, that seed the k-th best scores. It changes the work, not the result.
SEEDS = 4096
PAIRS_AT_ONCE = 1 << 15
EXACT_FLOATS = 1 << 53


def segment_statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose inner products bound those of the rows from above: scaled means, then spreads."""
    parts = np.array_split(np.arange(rows.shape[1]), min(segments, max(rows.shape[1], 1)))
    means, spreads = [], []
    for part in parts:
        values = rows[:, part]
        mean = values.mean(1) if len(part) else np.zeros(len(rows))
        means.append(mean * np.sqrt(len(part)))
        spreads.append(np.sqrt(np.maximum(((values - mean[:, None]) ** 2).sum(1), 0)))
    return np.stack([*means, *spreads], 1)


class TopK:
    """The k best (score, then smaller id) of the candidates shown so far, for each query of a block."""

    def __init__(self, rows: np.ndarray, k: int, least: np.ndarray):
        self.k, self.rows = k, rows
        self.stats = [segment_statistics(rows, r) for r in RESOLUTIONS]
        self.scores = np.full((len(rows), k), -np.inf)
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.least = least.astype(np.float64)  # k rows of at least this score are known to exist
        self.pairs = self.scored = 0

    def show(self, ids: np.ndarray, rows: np.ndarray, alive: np.ndarray) -> None:
        """Candidates in any order, and which of them each query is compared with."""
        self.pairs += int(alive.sum())
        bound = np.zeros(alive.shape)
        for resolution, mine in zip(RESOLUTIONS, self.stats, strict=True):
            bound = mine @ segment_statistics(rows, resolution).T
            bound += np.abs(bound) * 2e-9 + 1e-6
            alive = alive & (bound >= self.least[:, None])
            if not alive.any():
                return
        some = min(FIRST, len(ids))
        order = np.argpartition(-np.where(alive, bound, -np.inf), some - 1, 1)[:, :some]
        first = np.zeros_like(alive)
        np.put_along_axis(first, order, True, 1)
        first &= alive
        self._score(ids, rows, first)
        self._score(ids, rows, alive & ~first & (bound >= self.least[:, None]))

    def _score(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
        """Exact scores of these pairs."""
        q, c = np.nonzero(which)
        self.scored += len(q)
        scores = np.empty(len(q))
        for i in range(0, len(q), PAIRS_AT_ONCE):
            part = slice(i, i + PAIRS_AT_ONCE)
            scores[part] = np.einsum("ij,ij->i", self.rows[q[part]], rows[c[part]])
        reach = scores >= self.least[q]
        q, c, scores = q[reach], c[reach], scores[reach]
        asked = np.unique(q)
        held = np.repeat(asked, self.k)
        q, found, scores = np.concatenate([held, q]), np.concatenate([self.found[asked].ravel(), ids[c]]), np.concatenate([self.scores[asked].ravel(), scores])
        order = np.lexsort((found, -scores, q))
        q, found, scores = q[order], found[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.scores[q[best], place[best]] = scores[best]
        self.found[q[best], place[best]] = found[best]
        self.least = np.maximum(self.least, self.scores[:, -1])


def _exact_objects(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, compared: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Place of the query, id, score: the same for numbers too large for floating point, with whole numbers
    of any size. Scores beyond 64 bits fail when they are returned.
    """
    out = []
    whole = [[int(x) for x in row] for row in rows]
    for place, query in enumerate(queries):
        mine = [int(x) for x in query]
        scores = sorted((-sum(a * b for a, b in zip(mine, whole[c], strict=True)), int(ids[c])) for c in np.flatnonzero(compared[place]))
        out += [(place, i, -s) for s, i in scores[:k]]
    return out


def _searcher(k: int, scale: float):
    """Of a block of queries and candidates: query_id, id, score of the best, and own for rows with the
    query's id (null for others, else whether it is an equal vector), which are all returned.
    """

    def search(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        values = np.floor(matrix(table.column("v"), np.float64) * scale)
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        least = table.column("least").to_numpy(zero_copy_only=False).astype(np.float64)[mine]
        queries, names = values[mine], ids[mine]
        largest = float(np.abs(values).max(initial=0))
        columns: list[list] = [[], [], [], []]
        best = TopK(queries, k, np.where(np.isnan(least), -np.inf, least))
        exact = largest * largest * max(values.shape[1], 1) < EXACT_FLOATS

        def add(query, found, score, own) -> None:
            for column, values in zip(columns, (query, found, score, own), strict=True):
                column.extend(values)

        objects: list[tuple[int, int, int]] = []
        for i in range(0, len(theirs) if len(mine) else 0, STRIDE):
            part = theirs[i : i + STRIDE]
            same = ids[part][None, :] == names[:, None]
            if exact:
                best.show(ids[part], values[part], ~same)
            else:
                both = [*objects, *_exact_objects(queries, ids[part], values[part], ~same, k)]
                both.sort(key=lambda x: (x[0], -x[2], x[1]))
                objects, count = [], {}
                for x in both:
                    count[x[0]] = count.get(x[0], 0) + 1
                    if count[x[0]] <= k:
                        objects.append(x)
            for q, c in zip(*np.nonzero(same), strict=True):
                score = sum(int(a) * int(b) for a, b in zip(queries[q], values[part[c]], strict=True))
                add([int(names[q])], [int(names[q])], [score], [bool((queries[q] == values[part[c]]).all())])
        if exact:
            held = np.isfinite(best.scores)
            n = int(held.sum())
            add(np.broadcast_to(names[:, None], held.shape)[held].tolist(), best.found[held].tolist(), [int(x) for x in best.scores[held]], [None] * n)
        else:
            add([int(names[q]) for q, _, _ in objects], [x for _, x, _ in objects], [x for _, _, x in objects], [None] * len(objects))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "id", "score", "own"])

    return search


FOUND = "query_id long, id long, score long, own boolean"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the best k, without one row for the query itself."""
    # one of the rows that equal the query is the query; where none does, the query met none of its own
    copies = F.row_number().over(Window.partitionBy("query_id", "own").orderBy("score"))
    others = found.where("own").withColumn("copy", copies).where("copy > 1").drop("copy").unionByName(found.where("own is null or not own"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_search(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 2048, candidate_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k candidates with the highest inner product for each
    row of df where is_query holds, ties to the smaller id; all candidates where fewer than k exist.

    Each component x counts as floor(scale * x), x as double; scores are exact integers (beyond 64 bits
    the query fails rather than round). Vectors that are null or hold null or non-finite components take
    no part, nor rows without an id. Only vectors of the same length are compared. Every row is a candidate
    but the query's own; of rows that repeat the id of a query the one with the least vector asks, and the
    others are candidates. An empty table gives no rows.
    """
    rows = df.where(F.col(id_col).isNotNull() & finite(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    across, down = max(1, -(-asking // query_block)), max(1, -(-n // candidate_block))
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    none = F.lit(None).cast("double")
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("asks", F.lit(True)).withColumn("q", dealt(across))
    candidates = rows.withColumn("asks", F.lit(False)).withColumn("least", none)
    spread = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    seeds = candidates.where(spread < int((1 << 30) * min(1.0, SEEDS / max(n, 1)))).withColumn("q", upto(across)).withColumn("c", F.lit(0))
    search = _searcher(k, float(scale))
    first = queries.withColumn("c", F.lit(0)).withColumn("least", none).unionByName(seeds).withColumn("d", F.size("v"))
    known = _ranked(first.groupBy("d", "q", "c").applyInArrow(search, FOUND), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    asked = queries.join(known, "id", "left").withColumn("c", upto(down))
    cells = asked.unionByName(candidates.withColumn("c", dealt(down)).withColumn("q", upto(across))).withColumn("d", F.size("v"))
    found = _ranked(cells.groupBy("d", "q", "c").applyInArrow(search, FOUND), k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
