"""Datasets: rows routed to folders by an expression, files rolled over by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.errors import ContractError
from lamella.operators.sink import WriteOptions, writer
from lamella.sources.relations import relation
from lamella.storage import materialize, release_table

ROLLOVER = 512 << 20


def _bytes_of(x: Column, kind: T.DataType) -> Column:
    """Bytes of a value as it stands plain in a page; none for a null."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)).cast("long") + 4
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + _bytes_of(v, kind.elementType)), F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return _bytes_of(F.map_keys(x), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(x), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        out = F.lit(0).cast("long")
        for f in kind.fields:
            out = out + _bytes_of(x.getField(f.name), f.dataType)
        return out
    return F.lit({"boolean": 1, "tinyint": 4, "smallint": 4, "int": 4, "date": 4, "float": 4}.get(kind.simpleString(), 16 if isinstance(kind, T.DecimalType) and kind.precision > 18 else 8)).cast("long")


def rows_in(df: DataFrame, target_bytes: int, route: str | None = None) -> int:
    """How many rows fill target_bytes before encoding and compression, in the route with the widest rows.
    One aggregation counts the bytes of all rows.
    """
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if f.name != route:
            size = size + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    grouped = df.groupBy(route) if route else df
    widest = grouped.agg(F.avg(size).alias("bytes")).agg(F.max("bytes")).first()[0]
    return max(1, int(target_bytes / max(widest or 1, 1)))


def _numbered(routed: DataFrame, part: str, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """A table to release later, and routed, written once in the order of part and order, with _place: the row's number in its route, from 0.

    Rows are sorted by ranges and numbered within a task; only how many rows of a route each task has is added up.
    """
    placed = routed.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    table = materialize(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rows = table.withColumn("_task", F.shiftright("_id", 33))
    pieces = rows.groupBy(part, "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(part).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = rows.join(pieces, [part, "_task"]).withColumn("_place", F.col("_id") - F.col("_first") + F.col("_before"))
    return table, numbered.select(*routed.columns, "_place")


def write_dataset(df: DataFrame, path: str, route: Column, order: tuple[str, ...] = (), part: str = "part", mode: str = "append", options: WriteOptions = WriteOptions(), max_rows: int | None = None, target_bytes: int = ROLLOVER, spread: int = 1) -> None:
    """Writes each row below path/part=<route>, creating or appending.

    Rows of a route keep the order of `order` within a file, and files of a task follow each other in it.
    With max_rows every file of a route but its last has so many rows, and files are dealt over all tasks; the
    rows are written once more for that, to number them. Without it, or with `spread`, a route meets in one
    task, unless it has so many rows that adaptive execution splits it into several of the advised size, or
    `spread` says into how many; a task writes one file at a time, and a new one after max_rows, or as many
    as fill about target_bytes before encoding (see rows_in; write_arrow rolls by the bytes of the file). A
    null or empty route is refused.
    """
    if part in df.columns:
        raise ContractError("DATASET001", f"the table has a column {part!r}; name the part otherwise")
    text = route.cast("string")
    checked = F.when(text.isNull() | (text == ""), F.raise_error(F.lit("a row has no route")).cast("string")).otherwise(text)
    routed = df.withColumn(part, checked)
    table = None
    if max_rows and spread == 1:
        table, numbered = _numbered(routed, part, order)
        file = F.floor(F.col("_place") / F.lit(max_rows)).cast("long")
        # a stated number, as many small files are much work for few bytes
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed = numbered.repartition(tasks, F.col(part), file).sortWithinPartitions(part, "_place").select(*routed.columns)
    elif spread > 1:
        salt = F.pmod(F.xxhash64(*(order or df.columns)), F.lit(spread))
        # a stated number keeps adaptive execution from putting the parts together again
        placed = routed.repartition(max(spread, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col(part), salt)
    else:
        placed = routed.hint("rebalance", F.col(part))
    if table is None:
        placed = placed.sortWithinPartitions(part, *order)
    limit = max_rows or rows_in(routed, target_bytes, part)
    writer(placed, options).option("maxRecordsPerFile", limit).mode(mode).partitionBy(part).parquet(path)
    if table is not None:
        release_table(table)


def dataset_files(spark, path: str) -> DataFrame:
    """Files of a dataset with their rows and bytes."""
    return relation(spark, "files", path)
