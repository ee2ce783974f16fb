"""Scans, metadata relations, pruning and writers against files on disk."""

import datetime
import os
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamella.errors import ContractError, CorruptFileError, UnsupportedError
from lamella.operators.compaction import append, compact, in_order, merge, merge_metadata, tail_files
from lamella.operators.arrow_sink import ArrowOptions, write_arrow
from lamella.operators.dataset import rows_in, write_dataset
from lamella.operators.sink import WriteOptions, options_of, refuse, write_table
from lamella.plans.contract import Column, column, contract
from lamella.plans.evolution import Evolution
from lamella.plans.pruning import All, Any, Bounds, Test, bloom_report, page_report, row_group_report
from lamella.sources.footer import ParquetFile
from lamella.sources.relations import page_bounds, page_rows, relation
from lamella.sources.scan import file_schemas, needs_row_reader, scan

REQUIRED = lambda name, kind: pa.field(name, kind, nullable=False)


def put(path, table, **options):
    pq.write_table(table, path, **options)
    return str(path)


@pytest.fixture
def numbers(tmp_path):
    schema = pa.schema([REQUIRED("id", pa.int32()), pa.field("maybe", pa.int32()), REQUIRED("name", pa.string())])
    table = pa.table({"id": [1, 2, 3, 4, 5, 6], "maybe": [1, None, 3, None, None, None], "name": list("abcdef")}, schema)
    return put(tmp_path / "n.parquet", table, row_group_size=2, write_page_index=True)


def test_strict_scan_sees_what_spark_hides(spark, numbers):
    wanted = contract(column("id", "int"), column("maybe", "int?"))
    assert [tuple(r) for r in scan(spark, wanted, numbers).orderBy("id").collect()] == [(1, 1), (2, None), (3, 3), (4, None), (5, None), (6, None)]
    for wrong, code in ((column("maybe", "int"), "EVOLVE003"), (column("id", "long"), "EVOLVE002"), (column("gone", "int"), "EVOLVE001")):
        with pytest.raises(ContractError) as failed:
            scan(spark, contract(wrong), numbers)
        assert failed.value.code == code
    assert scan(spark, wanted, numbers, projection=["maybe"]).columns == ["maybe"]


def test_missing_columns_by_file(spark, tmp_path):
    os.mkdir(tmp_path / "t")
    put(tmp_path / "t/a.parquet", pa.table({"id": [1]}, pa.schema([REQUIRED("id", pa.int32())])))
    put(tmp_path / "t/b.parquet", pa.table({"id": [2], "added": [7], "note": ["x"]}, pa.schema([REQUIRED("id", pa.int32()), REQUIRED("added", pa.int32()), pa.field("note", pa.string())])))
    wanted = contract(column("id", "int"), column("added", "int"), column("note", "string?"), column("day", "date"))
    rows = scan(spark, wanted, str(tmp_path / "t"), mode="rows", evolution=Evolution(missing="default")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, None, datetime.date(1970, 1, 1)), (2, 7, "x", datetime.date(1970, 1, 1))]
    with pytest.raises(ContractError):
        scan(spark, wanted, str(tmp_path / "t"), mode="rows")
    assert len(file_schemas(spark, str(tmp_path / "t"))) == 2


def test_places_are_those_of_each_file(spark, tmp_path):
    os.mkdir(tmp_path / "t")
    put(tmp_path / "t/x.parquet", pa.table({"a": [1], "b": [2]}))
    put(tmp_path / "t/y.parquet", pa.table({"b": [1], "a": [2], "c": [9]}))
    wanted = contract(column("first", "long?"), column("second", "long?"))
    assert [tuple(r) for r in scan(spark, wanted, str(tmp_path / "t"), mode="position").collect()] == [(1, 2)] * 2
    assert [tuple(r) for r in scan(spark, wanted, str(tmp_path / "t"), mode="position", projection=["second"]).collect()] == [(2,)] * 2
    with pytest.raises(ContractError):
        scan(spark, contract(column("a", "long?", field_id=4)), str(tmp_path / "t"), mode="field_id")


def test_position_mode(spark, numbers):
    wanted = contract(column("first", "int"), column("second", "int?"))
    assert scan(spark, wanted, numbers, mode="position").columns == ["first", "second"]
    with pytest.raises(ContractError):
        scan(spark, contract(*(column(str(i), "int") for i in range(9))), numbers, mode="position")


def test_chunks_equal_another_reader(spark, numbers):
    meta = pq.ParquetFile(numbers).metadata
    rows = {(r.row_group, r.leaf): r for r in relation(spark, "column_chunks", numbers).collect()}
    assert len(rows) == meta.num_row_groups * meta.num_columns
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            theirs, mine = meta.row_group(g).column(c), rows[g, c]
            assert (mine.column, mine.physical_type, mine.codec, mine["values"], mine.compressed_bytes, mine.bytes) == (theirs.path_in_schema, theirs.physical_type, theirs.compression, theirs.num_values, theirs.total_compressed_size, theirs.total_uncompressed_size)
            s = theirs.statistics
            assert mine.null_count == s.null_count and (mine.min_text, mine.max_text) == ((str(s.min), str(s.max)) if s.has_min_max else (None, None))
    file = relation(spark, "files", numbers).first()
    assert (file["rows"], file.row_groups, file["columns"], file.created_by) == (6, 3, 3, meta.created_by)
    assert {r.key for r in relation(spark, "key_values", numbers).collect()} == {k.decode() for k in meta.metadata}


def test_pages_with_and_without_indexes(spark, tmp_path):
    table = pa.table({"v": pa.array(range(6), pa.int32()), "n": pa.array([None] * 6, pa.int32())})
    for indexed in (True, False):
        path = put(tmp_path / f"{indexed}.parquet", table, data_page_size=1, write_batch_size=2, use_dictionary=False, write_page_index=indexed)
        pages = relation(spark, "pages", path).orderBy("column", "page").collect()
        v = [p for p in pages if p.column == "v"]
        assert [(p.first_row, p["rows"], p.min_double, p.max_double) for p in v] == [(0, 2, 0, 1), (2, 2, 2, 3), (4, 2, 4, 5)]
        assert all(p.null_page and p.min_double is None and p.null_count == p["rows"] for p in pages if p.column == "n")
        assert {p.indexed for p in pages} == {indexed}


def test_sorting_columns_and_nested_leaves(spark, tmp_path):
    table = pa.table({"a": [1, 2], "l": [[1], None], "m": pa.array([[("k", 1)], []], pa.map_(pa.string(), pa.int32()))})
    path = put(tmp_path / "s.parquet", table, sorting_columns=[pq.SortingColumn(0, True, True)])
    assert [tuple(r)[1:] for r in relation(spark, "sorting_columns", path).collect()] == [(0, 0, 0, "a", True, True)]
    leaves = {r.column: (r.max_repetition_level, r.max_definition_level) for r in relation(spark, "schema_nodes", path).where("leaf is not null").collect()}
    assert leaves == {"a": (0, 1), "l.list.element": (1, 3), "m.key_value.key": (1, 2), "m.key_value.value": (1, 3)}


def test_corrupt_files(spark, tmp_path, numbers):
    data = open(numbers, "rb").read()
    for i, bad in enumerate((b"", b"PAR1", data[:-1], data[:-8] + b"\xff\xff\xff\x7fPAR1", b"PAR1" + b"\x00" * 40 + data[-20:])):
        path = tmp_path / f"bad{i}"
        path.write_bytes(bad)
        with pytest.raises(CorruptFileError):
            ParquetFile(f"file://{path}")


def test_pruning_is_conservative(spark, tmp_path):
    random = np.random.default_rng(7)
    x = np.sort(random.integers(0, 100, 600)).tolist()
    y = [None if random.random() < 0.2 or 200 <= i < 260 else float(random.integers(0, 50)) for i in range(600)]
    s = [f"k{v:03d}" for v in x]
    path = put(tmp_path / "p.parquet", pa.table({"x": pa.array(x, pa.int32()), "y": pa.array(y, pa.float64()), "s": s}), row_group_size=100, data_page_size=1, write_batch_size=20, use_dictionary=False, write_page_index=True)
    tests = [Test("x", "=", 50), Test("x", "<", 10), Test("x", "<=", 10), Test("x", ">", 90), Test("x", ">=", 90), Test("x", "in", (3, 97)), Test("y", "is null"), Test("y", "is not null"), Test("y", ">", 48.0), Test("s", "=", "k050"), All((Test("x", ">", 20), Test("x", "<", 30))), Any((Test("x", "<", 3), Test("x", ">", 98))), Any((Test("x", "<", 3), Test("y", ">", 48.0)))]
    rows = spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("i"))
    skipped = 0
    for test in tests:
        matching = {r.i for r in rows.where(test.rows()).collect()}
        for page in page_report(spark, test, path).collect():
            inside = range(page.row_group * 100 + page.first_row, page.row_group * 100 + page.first_row + page["rows"])
            skipped += not page.kept
            assert page.kept or not matching & set(inside)
        for group in row_group_report(spark, test, path).collect():
            assert group.kept or not matching & set(range(group.row_group * 100, group.row_group * 100 + 100))
    assert skipped > 100


def test_pruning_loses_no_row_of_any_type(spark, tmp_path):
    n, random = 400, np.random.default_rng(3)
    x = np.sort(random.integers(-500, 500, n))
    base = datetime.datetime(2001, 2, 3)
    table = pa.table({
        "dec": pa.array([Decimal(int(v)).scaleb(-2) for v in x], pa.decimal128(10, 2)), "wide": pa.array([Decimal(int(v)).scaleb(-30) for v in x], pa.decimal128(38, 30)),
        "big": pa.array([int(v) + (1 << 53) for v in x], pa.int64()), "small": pa.array([int(v) % 100 for v in x], pa.uint8()),
        "day": pa.array([base.date() + datetime.timedelta(int(v)) for v in x]), "at": pa.array([base + datetime.timedelta(microseconds=int(v)) for v in x], pa.timestamp("us")),
        "ms": pa.array([base + datetime.timedelta(milliseconds=int(v)) for v in x], pa.timestamp("ms", "UTC")), "bin": pa.array([bytes([128 + int(v) % 100, 7]) for v in x], pa.binary()),
        "real": pa.array([float("nan") if i % 40 == 3 else v / 3 for i, v in enumerate(x)], pa.float64()), "half": pa.array([None if i % 7 == 0 else np.float32(v / 3) for i, v in enumerate(x)], pa.float32()),
        "flag": pa.array([v > 0 for v in x]), "s": pa.array([f"é{int(v):+05d}" for v in x]), "st": pa.array([{"dec": 1} for _ in x]),
    })
    path = put(tmp_path / "t.parquet", table, row_group_size=100, data_page_size=1, write_batch_size=20, use_dictionary=False, write_page_index=True)
    values = {
        "dec": [Decimal("0.05"), Decimal("-1.2345"), 0, 3, 0.05, 5.0, None], "wide": [Decimal("1e-29"), 0, 1e-29], "big": [(1 << 53) + 1, float(1 << 53), Decimal((1 << 53) + 1), 0], "small": [7, 99.0],
        "day": [base.date(), datetime.datetime(2001, 2, 3)], "at": [base, base + datetime.timedelta(microseconds=7)], "ms": [base, base.replace(tzinfo=datetime.timezone.utc)], "bin": [b"\x90", b"\xff", b""],
        "real": [1.0, 100.0, 0, float("nan"), float("inf")], "half": [1.0, 16777217, 0.1], "flag": [True, False], "s": ["é+0001", "é", "z"],
    }
    rows = spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("i"))
    skipped = 0
    for column, some in values.items():
        tests = [Test(column, op, v) for v in some for op in ("=", "<", "<=", ">", ">=")] + [Test(column, "in", tuple(some)), Any((Test(column, "=", some[0]), Test("flag", "=", True)))]
        hits = rows.select("i", *(F.coalesce(t.rows(), F.lit(False)).alias(f"t{k}") for k, t in enumerate(tests))).collect()
        with ParquetFile(f"file://{path}") as f:
            bounds, starts = list(zip(page_rows(f), page_bounds(f), strict=True)), [100 * i for i in range(4)]
            for k, t in enumerate(tests):
                matching = {r.i for r in hits if r[f"t{k}"]}
                for row, (node, low, high, count, nulls) in bounds:
                    if node.name == column and len(node.path) == 1:
                        kept = t.may_match({column: Bounds(node, low, high, count, nulls)})
                        first = starts[row[1]] + row[7]
                        skipped += not kept
                        assert kept or not matching & set(range(first, first + count)), (t, first)
        for t in tests[::4]:
            matching = {r.i for r in hits if r[f"t{tests.index(t)}"]}
            for g in row_group_report(spark, t, path).collect():
                assert g.kept or not matching & set(range(g.row_group * 100, g.row_group * 100 + 100)), t
    assert skipped > 500


def test_filters_are_pushed_down(spark, numbers):
    plan = spark.read.parquet(numbers).where(All((Test("id", ">=", 4),)).rows()).select("name")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,4)" in plan and "ReadSchema: struct<id:int,name:string>" in plan


def test_bloom_filters_have_no_false_negatives(spark, tmp_path):
    path = str(tmp_path / "b")
    values = [(i * 7919, f"name-{i}") for i in range(3000)]
    wanted = contract(column("k", "long?", bloom=True, bloom_ndv=3000, encodings=("PLAIN",)), column("s", "string?", bloom=True, bloom_ndv=3000, encodings=("PLAIN",)))
    write_table(spark.createDataFrame(values, "k long, s string").coalesce(1), path, wanted=wanted)
    with ParquetFile(relation(spark, "files", path).first().path) as f:
        from lamella.sources.footer import might_contain, plain_bytes

        filters = [f.bloom_filter(c) for c in f.chunks(f.row_groups()[0])]
    assert all(might_contain(filters[0], plain_bytes("INT64", k)) and might_contain(filters[1], plain_bytes("BYTE_ARRAY", s)) for k, s in values)
    absent = sum(might_contain(filters[0], plain_bytes("INT64", k * 7919 + 1)) for k in range(3000))
    assert absent < 150
    report = bloom_report(spark, "s", "name-5", path).first()
    assert report.has_filter and report.might_contain


@pytest.mark.parametrize("options", [WriteOptions(codec=c, page_version=v, dictionary=d) for c in ("none", "snappy", "gzip", "zstd", "lz4_raw") for v, d in ((1, "maybe"), (2, "off")) if (c, v) != ("none", 2)])
def test_what_is_written_is_read(spark, tmp_path, options):
    rows = [(1, "a", [1.5, None], {"k": 1}, (1, "x"), b"\x00\xff", datetime.date(1969, 1, 1)), (2, None, None, None, None, None, None), (3, "", [], {}, (None, None), b"", datetime.date(2100, 1, 1))]
    schema = "id int, s string, l array<double>, m map<string,int>, t struct<a:int,b:string>, b binary, d date"
    df = spark.createDataFrame(rows, schema)
    write_table(df, str(tmp_path / "w"), options)
    assert sorted(map(str, spark.read.schema(schema).parquet(str(tmp_path / "w")).collect())) == sorted(map(str, df.collect()))
    codecs = {r.codec for r in relation(spark, "column_chunks", str(tmp_path / "w")).collect()}
    assert codecs == {{"none": "UNCOMPRESSED", "lz4_raw": "LZ4_RAW"}.get(options.codec, options.codec.upper())}


def test_checksums_find_flipped_bytes(spark, tmp_path):
    path = str(tmp_path / "c")
    write_table(spark.range(1000).coalesce(1), path, WriteOptions(codec="none", dictionary="off", page_checksums=True))
    header = relation(spark, "page_headers", path).where("page_type like 'DATA%'").first()
    assert header.crc is not None
    name = relation(spark, "files", path).first().path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[header.offset + header.header_bytes + 100] ^= 1
    open(name, "wb").write(data)
    crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        scan(spark, contract(column("id", "long")), path, verify_checksums=True, mode="position").agg(F.sum("id")).collect()


def test_files_for_the_row_reader(spark, tmp_path):
    table = pa.table({"x": [1.5, 2.5], "s": ["a", "b"]})
    split = put(tmp_path / "split.parquet", table, use_dictionary=False, column_encoding={"x": "BYTE_STREAM_SPLIT", "s": "PLAIN"})
    delta = put(tmp_path / "delta.parquet", table, use_dictionary=False, compression="none", column_encoding={"x": "PLAIN", "s": "DELTA_BYTE_ARRAY"})
    plain = put(tmp_path / "plain.parquet", table)
    assert [needs_row_reader(spark, p) for p in (split, delta, plain)] == [True, True, False]
    wanted = contract(column("x", "double?"), column("s", "string?"))
    for path in (split, delta):
        assert sorted(map(tuple, scan(spark, wanted, path, row_reader=True).collect())) == [(1.5, "a"), (2.5, "b")]
    assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"


def test_writer_refusals():
    for bad in ({"codec": "zip"}, {"codec": "zstd", "codec_level": 50}, {"codec": "snappy", "codec_level": 1}, {"page_version": 3}, {"page_bytes": 0}):
        with pytest.raises(ContractError):
            WriteOptions(**bad)
    for bad in ({"codec": "brotli"}, {"dictionary": "forced"}, {"codec": "none", "page_version": 2}):
        with pytest.raises(UnsupportedError):
            WriteOptions(**bad)
    for c in (Column("x", "DOUBLE", encodings=("ALP",)), Column("x", "DOUBLE", encodings=("BYTE_STREAM_SPLIT",)), Column("x", "INT32", codec="gzip")):
        with pytest.raises(UnsupportedError):
            options_of(WriteOptions(), contract(c))
    with pytest.raises(UnsupportedError):
        refuse("append in place")


ARROW = "id int, s string, l array<double>, m map<string,int>, t struct<a:int,b:string>, b binary, d date, n decimal(20,3), ts timestamp, nt timestamp_ntz"


@pytest.mark.parametrize("options", [ArrowOptions(codec=c, page_version=v, dictionary=d) for c, v, d in (("none", 1, "off"), ("gzip", 2, "maybe"), ("brotli", 1, "forced"), ("zstd", 2, "off"), ("lz4_raw", 1, "maybe"))])
def test_arrow_writer_round_trip(spark, tmp_path, options):
    now = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)
    rows = [(1, "a", [1.5, None], {"k": 1}, (1, "x"), b"\x00\xff", datetime.date(1969, 1, 1), Decimal("-1.125"), now, now), (2, *[None] * 9), (3, "", [], {}, (None, None), b"", datetime.date(2100, 1, 1), Decimal(0), now, now)]
    df = spark.createDataFrame(rows, ARROW).repartition(2)
    path = str(tmp_path / "w")
    written = write_arrow(df, path, options, mode="append")
    assert written.agg(F.sum("rows")).first()[0] == 3 and not [n for n in os.listdir(path) if n.startswith("_temporary")]
    if options.codec == "brotli":  # no codec of Spark's
        assert sorted(pq.read_table(path)["id"].to_pylist()) == [1, 2, 3]
    else:
        assert sorted(map(str, spark.read.schema(ARROW).parquet(path).collect())) == sorted(map(str, df.collect()))
    assert {r.codec for r in relation(spark, "column_chunks", path).collect()} == {{"none": "UNCOMPRESSED", "lz4_raw": "LZ4_RAW"}.get(options.codec, options.codec.upper())}
    encodings = {e for r in relation(spark, "column_chunks", path).where("column = 's'").collect() for e in r.encodings}
    assert ("RLE_DICTIONARY" in encodings or "PLAIN_DICTIONARY" in encodings) == (options.dictionary != "off")


def test_arrow_writer_sizes_orders_and_empty_tables(spark, tmp_path):
    df = spark.range(40000).selectExpr("id", "sha2(cast(id as string), 256) as s").repartition(3)
    path = str(tmp_path / "r")
    files = write_arrow(df, path, ArrowOptions(codec="none", dictionary="off", file_bytes=200_000, page_indexes=False, sorting=(("id", True, False),))).collect()
    assert sum(f.rows for f in files) == 40000 and len(files) > 10 and max(f.bytes for f in files) < 320_000
    assert {f.name: f.bytes for f in files} == {n: os.path.getsize(f"{path}/{n}") for n in os.listdir(path) if n.endswith(".parquet")}
    assert not relation(spark, "pages", path).where("indexed").count() and relation(spark, "sorting_columns", path).where("descending").count() >= len(files)
    for f in files[:3]:
        ids = pq.read_table(f"{path}/{f.name}")["id"].to_pylist()
        assert ids == sorted(ids, reverse=True)
    with pytest.raises(ContractError):
        write_arrow(df, path)
    write_arrow(df.limit(0), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="(?i)null"):
        write_arrow(spark.createDataFrame([(None,)], "x int"), str(tmp_path / "q"), wanted=contract(column("x", "int")))


def test_arrow_writer_refusals():
    for bad in ({"codec": "zip"}, {"codec": "snappy", "codec_level": 1}, {"dictionary": "some"}, {"page_version": 3}, {"file_bytes": 0}, {"key_values": (("", "x"),)}, {"key_values": (("a", "x"), ("a", "y"))}):
        with pytest.raises(ContractError):
            ArrowOptions(**bad)


def test_rows_in_counts_bytes(spark):
    df = spark.createDataFrame([("a", "x" * 996, [1, 2], None), ("b", "y" * 96, None, {"k": 1.0})], "r string, s string, l array<int>, m map<string,double>")
    assert rows_in(df.where("r = 'a'"), 100_000, "r") == 100_000 // 1008
    assert rows_in(df, 100_000, "r") == 100_000 // 1008  # the route with the widest rows
    assert rows_in(df.limit(0), 10) == 10


def test_merge_copies_files_byte_for_byte(spark, tmp_path):
    parts = [str(tmp_path / f"c{k}") for k in range(2)]
    for k, p in enumerate(parts):
        write_table(spark.range(k * 10, k * 10 + 10).repartition(2), p, WriteOptions(codec="gzip"))
    merge(spark, parts, str(tmp_path / "whole"))
    sizes = lambda p: sorted(r.file_bytes for r in relation(spark, "files", p).collect())
    assert sizes(str(tmp_path / "whole")) == sorted(sizes(parts[0]) + sizes(parts[1]))
    ids = [r.id for r in in_order(spark, str(tmp_path / "whole")).orderBy("file_path", "row_index").collect()]
    assert ids == [r.id for r in in_order(spark, *parts).orderBy("source", "file_path", "row_index").collect()]
    with pytest.raises(ContractError):
        merge(spark, parts, str(tmp_path / "whole"))


def test_dataset_routes_orders_and_rolls(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [(i, f"r{i % 3}" if i % 10 else "rare") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, r string").repartition(4)
    write_dataset(df, path, F.col("r"), order=("i",), max_rows=60)
    write_dataset(df.where("i < 20"), path, F.col("r"), order=("i",))
    back = spark.read.parquet(path)
    assert back.where("part <> r").isEmpty() and back.count() == 520
    found = back.select("part", "i", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("n")).collect()
    for file in {r.f for r in found}:
        values = [r.i for r in sorted((r for r in found if r.f == file), key=lambda r: r.n)]
        assert values == sorted(values) and len(values) <= 60
    hot = str(tmp_path / "hot")
    write_dataset(df, hot, F.lit("one"), order=("i",), spread=4)
    assert len({r.f for r in spark.read.parquet(hot).select(F.col("_metadata.file_path").alias("f")).collect()}) > 1
    for bad in (F.lit(None).cast("string"), F.lit("")):
        with pytest.raises(Exception, match="no route"):
            write_dataset(df, str(tmp_path / "bad"), bad)
    with pytest.raises(ContractError):
        write_dataset(df.withColumn("part", F.lit(1)), path, F.col("r"))


def test_append_refuses_other_schemas(spark, tmp_path):
    path = str(tmp_path / "a")
    write_table(spark.createDataFrame([(1, "x")], "i int, s string"), path)
    append(spark.createDataFrame([("y", 2)], "s string, i int"), path)
    files = relation(spark, "files", path).count()
    for bad in ("i long, s string", "i int", "i int, s string, t int"):
        with pytest.raises(ContractError):
            append(spark.createDataFrame([], bad), path)
    assert relation(spark, "files", path).count() == files
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "y")]


def test_merge_keeps_order_and_compact_swaps(spark, tmp_path, monkeypatch):
    parts = []
    for k in range(3):
        parts.append(str(tmp_path / f"m{k}"))
        write_table(spark.range(k * 100, k * 100 + 100).selectExpr("(id * 37) % 300 as v", "id").sortWithinPartitions("v").coalesce(1), parts[-1])
    whole = str(tmp_path / "whole")
    merge(spark, parts, whole, files=4)
    expected = [r.id for r in in_order(spark, *parts).orderBy("source", "file_path", "row_index").collect()]
    assert [r.id for r in in_order(spark, whole).orderBy("file_path", "row_index").collect()] == expected
    with pytest.raises(ContractError):
        merge(spark, [whole], whole)
    with pytest.raises(ContractError):
        in_order(spark, whole, put(tmp_path / "o.parquet", pa.table({"z": [1]})))
    assert tail_files(spark, whole, 1 << 20).count() >= 2
    from lamella.operators import compaction

    def broken(*_, **__):
        raise RuntimeError("no space")

    with monkeypatch.context() as m:
        m.setattr(compaction, "merge", broken)
        with pytest.raises(RuntimeError):
            compact(spark, whole)
    assert spark.read.parquet(whole).count() == 300
    compact(spark, whole)
    assert relation(spark, "files", whole).count() == 1
    assert [r.id for r in in_order(spark, whole).orderBy("row_index").collect()] == expected
    assert not [n for n in os.listdir(tmp_path) if ".new-" in n or ".old-" in n]


def test_metadata_policies(spark):
    first = spark.createDataFrame([(0, "a", "1"), (1, "b", None)], "ordinal int, key string, value string")
    other = spark.createDataFrame([(0, "a", "2")], first.schema)
    assert [tuple(r) for r in merge_metadata(first, other).collect()] == [(0, "a", "1"), (1, "b", None), (2, "a", "2")]
    assert [tuple(r) for r in merge_metadata(first, other, keep_first=False).collect()] == [(0, "a", "2")]
    with pytest.raises(Exception, match="empty key"):
        merge_metadata(first, spark.createDataFrame([(0, "", "x")], first.schema)).collect()
