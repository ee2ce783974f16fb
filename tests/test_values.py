"""Statistics, conversions, nesting and converters on small fixtures."""

import datetime
import decimal
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella.errors import ContractError
from lamella.functions import convert
from lamella.functions.statistics import column_statistics
from lamella.operators.converters import Converter, apply_converters
from lamella.operators.nested import assemble, key_set, leaf_levels, map_from_pairs, shred
from lamella.streaming.ingest import stream_dataset


def stats(spark, values, kind):
    return column_statistics(spark.createDataFrame([(v,) for v in values], f"x {kind}"), "x").first()


def sign(text):
    return math.copysign(1, float(text))


def test_bounds_skip_nan_and_know_the_sign_of_zero(spark):
    nan = float("nan")
    for kind in ("double", "float", "array<double>"):
        wrap = (lambda v: [v]) if kind.startswith("array") else (lambda v: v)
        make = lambda *v: stats(spark, [wrap(x) for x in v], kind)  # noqa: B023, E731
        r = make(nan, 2.0, None, -1.0)
        assert (r.min_double, r.max_double, r.nan_count, r.null_count, r.distinct_count) == (-1.0, 2.0, 1, 1, None)
        r = make(nan, nan)
        assert (r.min_double, r.max_double, r.exact, r.nan_count) == (None, None, False, 2)
        for zeros in ((0.0, -0.0), (-0.0, 0.0)):
            r = make(*zeros)
            assert (sign(r.min_text), sign(r.max_text)) == (-1, 1)
        assert sign(make(0.0, 1.0).min_text) == 1 and sign(make(-0.0, -1.0).max_text) == -1
        assert make(4.0, 4.0).distinct_count == 1 and make(4.0, nan).distinct_count is None


def test_counts_of_lists_and_empty_tables(spark):
    r = stats(spark, [[5, 7], [], [1, 9]], "array<int>")
    assert (r["values"], r.null_count, r.min_double, r.max_double) == (5, 1, 1, 9)
    r = stats(spark, [None, [None, 3], []], "array<int>")
    assert (r["values"], r.null_count, r.distinct_count) == (4, 3, 1)
    r = stats(spark, [], "int")
    assert (r["values"], r.null_count, r.min_double, r.all_null) == (0, 0, None, True)
    assert stats(spark, [None, None], "string").all_null


def test_order_of_text_and_bytes(spark):
    r = stats(spark, ["b", "Z", "é", "a"], "string")
    assert (r.min_text, r.max_text) == ("Z", "é")
    r = stats(spark, [b"\x7f", b"\xff", b"\x00\x01"], "binary")
    assert (r.min_text, r.max_text) == ("0001", "FF")
    r = stats(spark, [decimal.Decimal("-1.50"), decimal.Decimal("10.25")], "decimal(10,2)")
    assert (r.min_text, r.max_text) == ("-1.50", "10.25")
    r = stats(spark, [True, False], "boolean")
    assert (r.min_double, r.max_double) == (0, 1)


def value(spark, expression, *given):
    df = spark.createDataFrame([tuple(v for v, _ in given)], ", ".join(f"c{i} {k}" for i, (_, k) in enumerate(given)))
    return df.select(expression(*(F.col(f"c{i}") for i in range(len(given)))).alias("x")).first().x


def test_epochs_before_1970(spark):
    t = datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    for unit, n in (("millis", -1), ("micros", -1), ("nanos", -1000)):
        assert value(spark, lambda x, u=unit: convert.local_to_epoch(x, u), (t, "timestamp_ntz")) == n
    assert value(spark, lambda x: convert.epoch_to_local(x, "nanos"), (-1999, "long")) == t
    assert value(spark, lambda x: convert.epoch_to_local(x, "millis"), (-1, "long")) == datetime.datetime(1969, 12, 31, 23, 59, 59, 999_000)
    with pytest.raises(Exception, match="(?i)overflow"):
        value(spark, lambda x: convert.to_epoch(x, "nanos"), (1 << 62, "long"))


def test_local_times_ignore_the_time_zone(spark):
    t = datetime.datetime(2024, 3, 31, 2, 30)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            n = value(spark, lambda x: convert.local_to_epoch(x, "micros"), (t, "timestamp_ntz"))
            assert n == 1711852200000000
            assert value(spark, lambda x: convert.epoch_to_local(x, "micros"), (n, "long")) == t
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(min_value=-(10**30), max_value=10**30, places=4, allow_nan=False), min_size=1, max_size=20))
def test_decimal_bytes(spark, numbers):
    with decimal.localcontext(prec=60):
        df = spark.createDataFrame([(n,) for n in numbers], "x decimal(38,4)")
        stored = df.select("x", convert.decimal_to_bytes(F.col("x"), 4).alias("b"))
        rows = stored.select("x", "b", convert.bytes_to_decimal(F.col("b"), 38, 4).alias("y")).collect()
        for r in rows:
            assert int.from_bytes(r.b, "big", signed=True) == int(r.x.scaleb(4)) and r.y == r.x


def test_decimals_are_not_rounded(spark):
    assert value(spark, lambda x: convert.exact_decimal(x, 5, 2), (1.25, "double")) == decimal.Decimal("1.25")
    for wrong in (1.255, 12345.0):
        with pytest.raises(Exception, match="is no decimal"):
            value(spark, lambda x: convert.exact_decimal(x, 5, 2), (wrong, "double"))
    assert value(spark, lambda x: convert.exact_decimal(x, 5, 2), (None, "double")) is None


def test_binary_values(spark):
    assert value(spark, convert.bytes_to_uuid, (bytes(range(16)), "binary")) == "00010203-0405-0607-0809-0a0b0c0d0e0f"
    with pytest.raises(Exception, match="16 bytes"):
        value(spark, convert.bytes_to_uuid, (b"x", "binary"))
    assert value(spark, convert.utf8_to_text, ("é".encode(), "binary")) == "é"
    with pytest.raises(Exception, match="(?i)utf-?8"):
        value(spark, convert.utf8_to_text, (b"\xff\xfe", "binary"))
    halves = np.arange(0, 1 << 16, 257, dtype=np.uint16)
    df = spark.createDataFrame([(h.tobytes(),) for h in halves], "b binary")
    for r, h in zip(df.select(convert.float16_to_float(F.col("b")).alias("f")).collect(), halves.view(np.float16), strict=True):
        assert r.f == float(h) or (math.isnan(r.f) and np.isnan(h))
    parts = value(spark, convert.interval_parts, (struct.pack("<III", 1, 2, 4_000_000_000), "binary"))
    assert tuple(parts) == (1, 2, 4_000_000_000)
    assert value(spark, convert.unsigned_32, (-1, "int")) == (1 << 32) - 1
    assert value(spark, convert.unsigned_64, (-1, "long")) == (1 << 64) - 1
    assert value(spark, lambda x: convert.time_of_day(x, "millis"), (86_399_999_999, "long")) == 86_399_999
    with pytest.raises(Exception, match="outside the day"):
        value(spark, lambda x: convert.time_of_day(x, "millis"), (86_400_000_000, "long"))


LISTS = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=4))


@settings(max_examples=12, deadline=None)
@given(st.lists(LISTS, min_size=1, max_size=12), st.lists(st.one_of(st.none(), st.lists(LISTS, max_size=3)), min_size=1, max_size=8))
def test_shred_and_assemble(spark, flat, deep):
    for values, kind, depth in ((flat, "array<int>", 1), (deep, "array<array<int>>", 2)):
        df = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
        back = {r.k: r.v for r in assemble(shred(df, "k", "v"), "k", depth, "v").collect()}
        assert back == dict(enumerate(values))


def test_levels(spark):
    df = spark.createDataFrame([(1, [[1, None], []]), (2, None), (3, []), (4, [None, [2]])], "k int, v array<array<int>>")
    got = sorted(((r.k, r.places, r.rep, r["def"], r.value) for r in shred(df, "k", "v").collect()), key=str)
    want = [(1, [0, 0], 0, 5, 1), (1, [0, 1], 2, 4, None), (1, [1], 1, 3, None), (2, [], 0, 0, None), (3, [], 0, 1, None), (4, [0], 0, 2, None), (4, [1, 0], 1, 5, 2)]
    assert got == sorted(want, key=str)
    schema = spark.createDataFrame([], "a struct<b:array<int>>, m map<string,int>").schema
    assert leaf_levels(schema) == [(("a", "b", "list", "element"), 1, 4), (("m", "key_value", "key"), 1, 2), (("m", "key_value", "value"), 1, 3)]


def test_maps(spark):
    assert value(spark, map_from_pairs, (["a", "b"], "array<string>"), ([1, None], "array<int>")) == {"a": 1, "b": None}
    with pytest.raises(Exception):
        value(spark, map_from_pairs, (["a", "b"], "array<string>"), ([1], "array<int>"))
    assert value(spark, key_set, ({"b": True, "a": True}, "map<string,boolean>")) == ["a", "b"]


def test_converters(spark):
    native = Converter("long", "double", lambda x: F.round(x * 100), lambda x: x / 100)
    batch = Converter("int", "int", lambda s: s + 1, lambda s: s - 1, vectorized=True)
    df = spark.createDataFrame([(1.25, 5), (None, None)], "a double, b int")
    stored = apply_converters(df, {"a": native, "b": batch}, storing=True)
    assert [tuple(r) for r in stored.collect()] == [(125, 6), (None, None)]
    assert [tuple(r) for r in apply_converters(stored, {"a": native, "b": batch}, storing=False).collect()] == [(1.25, 5), (None, None)]
    with pytest.raises(ContractError):
        apply_converters(spark.createDataFrame([([1],)], "a array<int>"), {"a": native}, storing=True)


def test_stream_is_written_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, r string")
    rows.write.parquet(source)
    for _ in range(2):
        stream_dataset(spark.readStream.schema(rows.schema).parquet(source), out, F.col("r"), progress).awaitTermination()
    assert sorted((r.i, r.part) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "a")]
    rows.where("i = 2").write.mode("append").parquet(source)
    stream_dataset(spark.readStream.schema(rows.schema).parquet(source), out, F.col("r"), progress).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_bounds_of_local_times(spark):
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.5' t union all select timestamp_ntz'1970-01-01 00:00:01'")
    row = column_statistics(df, "t").first()
    assert (row.min_double, row.max_double) == (-500000.0, 1000000.0)
