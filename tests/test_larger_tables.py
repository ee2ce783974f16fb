"""What shows only in tables of several tasks, row groups or files."""

import pytest
from pyspark.sql import functions as F

from lamella.functions import convert
from lamella.operators.arrow_sink import write_arrow
from lamella.operators.compaction import compact, in_order, merge
from lamella.operators.dataset import write_dataset
from lamella.operators.sink import WriteOptions, write_table
from lamella.plans.contract import column, contract
from lamella.plans.pruning import All, Any, Test, bloom_lookup, bloom_report, count_held
from lamella.queries import QUERIES
from lamella.sources.relations import relation


def test_a_first_task_without_rows_writes_no_file(spark, tmp_path):
    df = spark.range(0, 4000, 1, 4).where("id >= 2000")  # the first two tasks have none
    files = write_arrow(df, str(tmp_path / "t"))
    assert sorted(r.rows for r in files.collect()) == [1000, 1000]
    assert relation(spark, "page_headers", str(tmp_path / "t")).where("page_type like 'DATA%'").agg(F.sum("values")).first()[0] == 2000


def test_chunks_without_values_have_no_pages(spark, tmp_path):
    write_arrow(spark.range(0, 4000, 1, 4).where("id < 0"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
    assert relation(spark, "files", str(tmp_path / "t")).count() == 1
    assert relation(spark, "page_headers", str(tmp_path / "t")).count() == 0
    assert relation(spark, "pages", str(tmp_path / "t")).count() == 0


def test_keys_are_not_found_where_a_filter_errs(spark, tmp_path):
    path = str(tmp_path / "full")
    wanted = contract(column("id", "long?", bloom=True, bloom_ndv=100, encodings=("PLAIN",)))
    write_table(spark.range(0, 20_000, 1, 2), path, WriteOptions(), wanted)
    assert bloom_report(spark, "id", -1, path).agg(F.bool_or("might_contain")).first()[0]
    assert sorted(r.id for r in bloom_lookup(spark, "id", (-1, 7, 19_999, 20_000), path).collect()) == [7, 19_999]


def test_bloom_probe_of_more_keys_than_its_filters_are_for(spark, tmp_path):
    orders = spark.range(0, 2_000_000, 1, 2).selectExpr("id as o_orderkey", "1.5D as o_totalprice")
    orders.unionByName(orders.where("o_orderkey = 3")).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r.key, r.found) for r in QUERIES["bloom_probe"](spark, str(tmp_path)).collect())
    assert got == [(-1, False), (1, True), (3, True), (3, True), (5, True)]


def test_intervals_beyond_32_bits(spark, tmp_path):
    ids = [0, 1, 4_294_967, 4_294_968, 5_999_999, 4_294_967_296, 2**53]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.months, r.days, r.millis, r.half) for r in QUERIES["convert_interval_and_half"](spark, str(tmp_path)).collect()}
    assert got == {i: (i % 100, i % 31, i * 1000, i % 2048 / 16) for i in ids}


def test_one_interval_holds_32_bits_of_each_part(spark):
    x = F.col("x")
    df = spark.createDataFrame([(0,), (2**32 - 1,), (None,)], "x long")
    packed = df.select(convert.interval_bytes(F.lit(1), F.lit(258), x).alias("b")).select(F.hex("b").alias("h"), convert.interval_parts(F.col("b")).alias("p")).collect()
    assert [r.h for r in packed] == ["010000000201000000000000", "0100000002010000FFFFFFFF", None]
    assert [r.p and tuple(r.p) for r in packed] == [(1, 258, 0), (1, 258, 2**32 - 1), None]
    for bad in (-1, 2**32):
        with pytest.raises(Exception, match="32 bits"):
            spark.createDataFrame([(bad,)], "x long").select(convert.interval_bytes(F.lit(1), F.lit(2), x)).collect()
    with pytest.raises(Exception, match="32 bits"):
        spark.createDataFrame([(-1,)], "x long").select(convert.wide_interval(F.lit(1), F.lit(2), x)).collect()


MIXED = [
    "id",
    "cast(id as string) as s",
    "cast(id / 8 as decimal(12,3)) as d",
    "timestamp_micros(id) as t",
    "cast(timestamp '2020-01-02 03:04:05' as timestamp_ntz) as n",
    "array(id, null) as l",
    "map('k', id) as m",
    "struct(id as a, if(id % 3 = 0, null, 'x') as b) as g",
    "cast('y' as binary) as y",
    "date_from_unix_date(cast(id % 9999 as int)) as day",
]


def test_rewriting_into_few_files_sorts_and_shuffles_nothing(spark, tmp_path):
    from lamella.operators.compaction import _streamed

    paths = [str(tmp_path / f"p{k}") for k in range(2)]
    for k, p in enumerate(paths):
        write_table(spark.range(k * 3000, k * 3000 + 3000).selectExpr(*MIXED).repartition(3), p, WriteOptions(row_group_bytes=1 << 12))
    want = in_order(spark, *paths).orderBy("source", "file_path", "row_index").drop("source", "file_path", "row_index").collect()
    for files in (1, 4):
        path = str(tmp_path / f"whole{files}")
        merge(spark, paths, path, files=files)
        back = in_order(spark, path)
        assert back.select("file_path").distinct().count() == files
        assert back.orderBy("file_path", "row_index").drop("source", "file_path", "row_index").collect() == want
    compact(spark, path, files=1)
    assert in_order(spark, path).orderBy("row_index").drop("source", "file_path", "row_index").collect() == want
    plan = _streamed(spark, paths, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_rows_meet_kept_pages_by_blocks(spark, sf_dir, tmp_path):
    plan = QUERIES["prune_types"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "block" in plan  # each file is read once for all tests
    path = str(tmp_path / "t")
    df = spark.range(0, 20_000, 1, 2).selectExpr("id", "(id * 7919) % 1000 as x", "if(id % 10 = 0, null, id % 77) as y")
    write_table(df, path, WriteOptions(row_group_bytes=1 << 14, page_rows=100))
    tests = {"all": All((Test("id", ">=", 4090), Test("id", "<", 9001), Test("x", "<", 7))), "any": Any((Test("y", "is null"), Test("id", "in", (1, 8191, 8192)))), "none": Test("id", "<", 0)}
    got = {r.test: r.matching for r in count_held(spark, tests, spark.read.parquet(path), path).collect()}
    assert got == {name: df.where(t.rows()).count() for name, t in tests.items()} and got["all"] > 0

    class Lossy:  # skips pages that hold matches
        columns = {"id"}
        rows = staticmethod(lambda: F.col("id") >= 0)
        may_match = staticmethod(lambda known: int.from_bytes(known["id"].low, "little") % 3 != 1)

    assert 0 < count_held(spark, {"lossy": Lossy()}, spark.read.parquet(path), path).first()["matching"] < 20_000


def test_files_of_a_route_are_full_and_dealt_over_tasks(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(0, 9000, 1, 4).selectExpr("id", "if(id % 9 = 0, 'rare', 'hot') as r")
    write_dataset(rows, path, F.col("r"), order=("id",), max_rows=300)
    found = spark.read.parquet(path).select("part", "r", "id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    assert sorted(x.id for x in found) == list(range(9000)) and all(x.part == x.r for x in found)
    files = {f: [x.id for x in sorted((x for x in found if x.f == f), key=lambda x: x.i)] for f in {x.f for x in found}}
    assert sorted(map(len, files.values())) == [100, 200] + [300] * 29 and all(v == sorted(v) for v in files.values())
    hot = {f.rpartition("/")[2].split("-")[1] for f in files if "part=hot" in f}
    assert len(hot) > 1  # tasks
