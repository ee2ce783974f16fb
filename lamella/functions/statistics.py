"""Statistics of columns as Parquet files state them, in one aggregation over all columns.

Bounds skip nulls and NaN; a column of only those has none. Of zeros, the smallest is -0.0 if there is
one, the largest +0.0. Text and binary values compare by unsigned bytes, decimals by value. A list counts
an entry for each element and one for a null or empty list; nulls among them are null and empty lists and
null elements. The distinct count is stated only where it is 1 for certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.convert import local_micros

FLOATS = (T.FloatType, T.DoubleType)


def _zero_signs(x: Column) -> tuple[Column, Column]:
    text = x.cast("string")
    return F.bool_or(text == "-0.0"), F.bool_or(text == "0.0")


def _signed(low: Column, high: Column, negative: Column, positive: Column) -> tuple[Column, Column]:
    """Bounds with the signs that their zeros must have. The zeros are computed: the optimizer takes
    literals of 0.0 and -0.0 for equal and would merge the branches.
    """
    low = F.when((low == 0) & negative, -F.abs(low)).when(low == 0, F.abs(low)).otherwise(low)
    return low, F.when((high == 0) & positive, F.abs(high)).when(high == 0, -F.abs(high)).otherwise(high)


def bounds(x: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Smallest and largest value of a flat column."""
    if not isinstance(kind, FLOATS):
        return F.min(x), F.max(x)
    real = F.when(~F.isnan(x), x)
    negative, positive = _zero_signs(real)
    return _signed(F.min(real), F.max(real), negative, positive)


def _number(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return x.cast("double")
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return local_micros(x).cast("double")
    if isinstance(kind, T.TimeType):
        return (F.hour(x) * 3600 + F.minute(x) * 60 + F.extract(F.lit("SECOND"), x)).cast("double") * 1e6
    return F.lit(None).cast("double")


def _text(x: Column, kind: T.DataType) -> Column:
    return F.hex(x) if isinstance(kind, T.BinaryType) else x.cast("string")


def _of_column(name: str, kind: T.DataType) -> Column:
    """The statistics of one column as a struct."""
    x = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        if isinstance(element, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"{name}: statistics are of flat columns and lists of flat values")
        nothing = x.isNull() | (F.size(x) == 0)
        values = F.sum(F.when(nothing, 1).otherwise(F.size(x)))
        nulls = F.sum(F.when(nothing, 1).otherwise(F.size(F.filter(x, lambda v: v.isNull()))))
        real = F.filter(x, lambda v: v.isNotNull() & (~F.isnan(v) if isinstance(element, FLOATS) else F.lit(True)))
        nans = F.sum(F.size(F.filter(x, lambda v: F.isnan(v)))) if isinstance(element, FLOATS) else F.lit(None)
        if isinstance(element, FLOATS):
            has = lambda sign: F.bool_or(F.exists(real, lambda v: v.cast("string") == sign))
            low, high = _signed(F.min(F.array_min(real)), F.max(F.array_max(real)), has("-0.0"), has("0.0"))
        else:
            low, high = F.min(F.array_min(real)), F.max(F.array_max(real))
        kind = element
    else:
        values, nulls = F.count(F.lit(1)), F.count_if(x.isNull())
        nans = F.count_if(F.isnan(x)) if isinstance(kind, FLOATS) else F.lit(None)
        low, high = bounds(x, kind)
    one = low.isNotNull() & (low == high) & (F.coalesce(nans, F.lit(0)) == 0)
    return F.struct(
        F.lit(name).alias("column"),
        F.coalesce(values, F.lit(0)).cast("long").alias("values"),
        F.coalesce(nulls, F.lit(0)).cast("long").alias("null_count"),
        nans.cast("long").alias("nan_count"),
        F.when(one, 1).cast("long").alias("distinct_count"),
        _number(low, kind).alias("min_double"),
        _number(high, kind).alias("max_double"),
        _text(low, kind).alias("min_text"),
        _text(high, kind).alias("max_text"),
        (low.isNotNull() & F.lit(True)).alias("exact"),
        (F.coalesce(values, F.lit(0)) == F.coalesce(nulls, F.lit(0))).alias("all_null"),
    )


def column_statistics(df: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each column (all, if none is named), and for each group if `by` names columns."""
    wanted = columns or tuple(c for c in df.columns if c not in by)
    structs = [_of_column(c, df.schema[c].dataType) for c in wanted]
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(F.array(*structs).alias("__all")).select(*by, F.explode("__all").alias("__one")).select(*by, "__one.*")


def totals(chunks: DataFrame) -> DataFrame:
    """Of the relation of column chunks: rows, row groups, values, and bytes plain and compressed, by file."""
    first = chunks.where("leaf = 0").groupBy("path").agg(F.sum("rows").alias("rows"), F.count("*").alias("row_groups"))
    sums = chunks.groupBy("path").agg(F.sum("values").alias("values"), F.sum("bytes").alias("bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    return first.join(sums, "path")
