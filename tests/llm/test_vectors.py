import numpy as np
import pytest

from lamella.llm.queries import op4_topk_search, op8_vector_dedup
from lamella.llm.topk_search import RESOLUTIONS, TopK, segment_statistics, top_k_search
from lamella.llm.vector_dedup import near_duplicates, nearest_lattice_points
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>"


def best(ids, rows, queries, k=5):
    whole = np.floor(256 * rows).astype(np.int64)
    out = []
    for i in queries:
        scores = whole @ whole[i]
        order = sorted((-int(s), int(j)) for j, s in zip(ids, scores, strict=True) if j != ids[i])[:k]
        out += [(int(ids[i]), rank + 1, j, -s) for rank, (s, j) in enumerate(order)]
    return sorted(out)


def table(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def test_topk_query_against_brute_force(spark, sf_dir):
    ids, rows = table(spark, sf_dir)
    got = sorted(map(tuple, op4_topk_search(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == best(ids, rows, np.flatnonzero(ids % 50 == 0))


def test_topk_with_ties_in_many_blocks(spark):
    random = np.random.default_rng(1)
    rows = random.integers(-2, 3, (400, 6)) / 4.0
    rows[100:250] = rows[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], VECTORS)
    got = top_k_search(df, F.col("vec_id") % 7 == 0, query_block=16, candidate_block=64)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == best(np.arange(400), rows, range(0, 400, 7))


def test_topk_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (100, [1.0, 0.0, 0.0]), (None, [9.0, 9.0]), (1, [0.5, 0.5]), (0, [1.0, 0.0]), (150, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in top_k_search(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    # the row that repeats a query's id is a candidate, the query's own row is none
    assert got == [(0, 1, 0, 256 * 256), (0, 2, 1, 256 * 128), (0, 3, 1, 256 * 128)]
    assert top_k_search(df.limit(0), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 2.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in top_k_search(huge, F.lit(True), scale=1).collect()] == [10**16 + 2] * 2


def test_topk_of_rows_that_repeat_ids(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in top_k_search(df, F.lit(True), scale=1).select("query_id", "rank", "vec_id", "score").collect())
    # of id 0 the least vector (1, 1) asks
    assert got == [(0, 1, 1, 3), (0, 2, 0, 2), (0, 3, 0, 2), (1, 1, 0, 6), (1, 2, 0, 3), (1, 3, 0, 3)]


def test_scores_beyond_64_bits_fail(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [4e16, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|out of bounds|convert"):
        top_k_search(df, F.lit(True)).collect()
    big = spark.createDataFrame([(i, [3e8, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in top_k_search(big, F.col("vec_id") == 0, k=3, scale=1).collect()) == [(0, 1), (0, 2), (0, 3)]


def test_only_survivors_are_scored(spark):
    """Bounds from the statistics discard nearly all pairs of the table, and what is left is exact."""
    ids, rows = table(spark, "/root/testdata/sf0.1")
    whole = np.floor(256 * rows)
    asked = np.flatnonzero(ids % 50 == 0)
    least = np.full(len(asked), -np.inf)
    for _ in range(2):  # the first pass is over the seeds: here all rows
        best_ = TopK(whole[asked], 5, least)
        for i in range(0, len(ids), 256):
            part = slice(i, i + 256)
            best_.show(ids[part], whole[part], ids[part][None, :] != ids[asked][:, None])
        least = best_.scores[:, -1]
    scores = whole @ whole[asked].T
    scores[asked, np.arange(len(asked))] = -np.inf
    assert np.array_equal(best_.scores, -np.sort(-scores.T, 1)[:, :5])
    assert best_.pairs == len(asked) * (len(ids) - 1) and best_.scored < 0.06 * best_.pairs


def test_bounds_hold():
    random = np.random.default_rng(2)
    a, b = random.standard_normal((50, 96)), random.standard_normal((60, 96))
    exact = a @ b.T
    last = np.full_like(exact, np.inf)
    for r in RESOLUTIONS:
        bound = segment_statistics(a, r) @ segment_statistics(b, r).T
        assert (bound >= exact - 1e-9).all() and bound.mean() <= last.mean()
        last = bound


def brute_links(ids, rows, threshold=0.9):
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = units @ units.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], *label[near[i]], label[i]) for i in range(len(ids))])
        if (new == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}
        label = new


def test_lattice_points_are_nearest():
    random = np.random.default_rng(3)
    points = random.standard_normal((200, 8)) * 3
    found = nearest_lattice_points(points)
    doubled = np.rint(found * 2).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(1) & (doubled.sum(1) % 4 == 0)).all()
    assert (((points - found) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius of E8


@pytest.mark.parametrize("block", [4096, 40])
def test_dedup_recall_and_counts(spark, block):
    random = np.random.default_rng(4)
    centres = random.standard_normal((150, 64))
    rows = np.repeat(centres, 4, 0) + 0.2 * random.standard_normal((600, 64))
    rows[300:420] = rows[0] + 0.1 * random.standard_normal((120, 64))
    rows[420:500] = rows[1]
    rows = rows.astype(np.float32).astype(float)
    ids = random.permutation(600)
    want = brute_links(ids, rows)
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows, strict=True)], VECTORS)
    got = {r.vec_id: r for r in near_duplicates(df, block=block).collect()}
    assert len(got) == 600 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[k].n_links <= n for k, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[k].component_id == c for k, (_, c) in want.items()]) > 0.95


def test_dedup_query_against_brute_force(spark, sf_dir):
    ids, rows = table(spark, sf_dir)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op8_vector_dedup(spark, sf_dir).collect()}
    want = brute_links(ids, rows)
    assert got.keys() == want.keys()
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_dedup_edge_rows(spark):
    rows = [(9, [1.0, 0.0]), (4, [2.0, 0.0]), (7, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0, 0.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("size", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    want = [(9, 3, 4, False), (9, 3, 4, False), (4, 3, 4, True), (7, 3, 4, False), *((k, 0, k, True) for k in (1, 2, 3, 5, 6, 8)), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).count() == 0
