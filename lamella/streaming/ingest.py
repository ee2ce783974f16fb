"""A dataset written from a stream of rows: the routed writer of operators.dataset, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamella.operators.sink import WriteOptions, options_of


def stream_dataset(rows: DataFrame, path: str, route: Column, checkpoint: str, part: str = "part", options: WriteOptions = WriteOptions(), max_rows: int | None = None) -> StreamingQuery:
    """Starts writing the rows of a stream below path/part=<route>, each once. It ends when the stream has
    given what is there now; started again with its checkpoint it goes on from there.
    """
    text = route.cast("string")
    checked = F.when(text.isNull() | (text == ""), F.raise_error(F.lit("a row has no route")).cast("string")).otherwise(text)
    writer = rows.withColumn(part, checked).writeStream.format("parquet").partitionBy(part).options(**options_of(options))
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def observed_rows(df: DataFrame, name: str | Observation = "written") -> DataFrame:
    """df that reports how many rows pass, to a listener of that name or to an Observation."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
