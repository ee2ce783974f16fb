"""Appending to and merging tables. New files are written aside and put in place by renaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.errors import ContractError
from lamella.operators.dataset import ROLLOVER
from lamella.operators.sink import WriteOptions, writer
from lamella.plans.contract import Contract
from lamella.plans.evolution import check_strict
from lamella.sources.relations import relation
from lamella.sources.scan import file_schemas, with_positions
from lamella.storage import materialize


#: Rows of a batch that is read for rewriting.
BATCH = 8192


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def append(df: DataFrame, path: str, wanted: Contract | None = None, options: WriteOptions = WriteOptions()) -> None:
    """Adds rows as new files. A schema that differs from the table's is refused before anything is written."""
    spark = df.sparkSession
    there = spark.read.parquet(path).schema
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in there.fields:
        if have.pop(f.name, None) != f.dataType:
            raise ContractError("APPEND001", f"{f.name} is {f.dataType.simpleString()} in the table")
    if have:
        raise ContractError("APPEND001", f"not in the table: {', '.join(sorted(have))}")
    if wanted:
        for leaves in file_schemas(spark, path):
            check_strict(wanted, leaves)
    writer(df.select(*(f"`{f.name}`" for f in there.fields)), options).mode("append").parquet(path)


def in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of several tables with source (which of them), file_path and row_index: their order."""
    parts = [with_positions(spark.read.parquet(p)).withColumn("source", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        if [(f.name, f.dataType) for f in p.schema.fields] != [(f.name, f.dataType) for f in out.schema.fields]:
            raise ContractError("MERGE001", "the tables differ in their columns")
        out = out.unionByName(p)
    return out


def _copied(spark: SparkSession, sources: list[str], path: str) -> None:
    """Copies all files byte for byte, on the executors, under names that follow the order of the rows."""
    schemas = [[(f.name, f.dataType) for f in spark.read.parquet(s).schema.fields] for s in sources]
    if any(s != schemas[0] for s in schemas):
        raise ContractError("MERGE001", "the tables differ in their columns")
    fs, at = _fs(spark, path)
    if fs.exists(at):
        raise ContractError("MERGE003", f"{path} is there already")
    fs.mkdirs(at)
    uri = fs.makeQualified(at).toString().rstrip("/")
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    files = [f for s in sources for f in sorted(spark.read.parquet(s).inputFiles())]
    rows = [(f, f"part-{i:08d}.parquet") for i, f in enumerate(files)]
    plan = spark.createDataFrame(rows, "source string, name string").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism * 8)))

    def copy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, copy_files

        target, folder = FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                origin, file = FileSystem.from_uri(r["source"])
                temporary = f"{folder}/_{uuid.uuid4().hex}"
                copy_files(file, temporary, source_filesystem=origin, destination_filesystem=target)
                target.move(temporary, f"{folder}/{r['name']}")
            yield batch

    materialize(plan.mapInArrow(copy, "source string, name string"), "copied")


def _streamed(spark: SparkSession, sources: list[str], files: int) -> DataFrame | None:
    """The rows of all files in order, as so many tasks, each with a run of them that it reads batch by batch:
    nothing is shuffled, sorted or held. None if a column's type can't pass through Arrow.
    """
    tables = [spark.read.parquet(s) for s in sources]
    if any([(f.name, f.dataType) for f in t.schema.fields] != [(f.name, f.dataType) for f in tables[0].schema.fields] for t in tables):
        raise ContractError("MERGE001", "the tables differ in their columns")
    try:
        schema = to_arrow_schema(tables[0].schema)
    except Exception:  # the kind of error depends on the type
        return None
    counts = [{r.path: r.rows for r in relation(spark, "files", s).select("path", "rows").collect()} for s in sources]
    runs, total = [], 0
    for table, rows in zip(tables, counts, strict=True):
        for path in sorted(table.inputFiles()):
            runs.append((path, total))
            total += rows[path]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for task in (k for batch in batches for k in batch.column(0).to_pylist()):
            low, high = task * total // files, (task + 1) * total // files
            for (path, first), (_, end) in zip(runs, [*runs[1:], (None, total)], strict=True):
                if end <= low or first >= high:
                    continue
                fs, name = FileSystem.from_uri(path)
                with fs.open_input_file(name) as stream, pq.ParquetFile(stream, buffer_size=1 << 20, pre_buffer=False, coerce_int96_timestamp_unit="us") as f:
                    at = first
                    for group in range(f.metadata.num_row_groups):
                        start, at = at, at + f.metadata.row_group(group).num_rows
                        if at <= low or start >= high:
                            continue
                        for batch in f.iter_batches(BATCH, row_groups=[group], use_threads=False):
                            here = batch.slice(max(0, low - start), max(0, min(high, start + batch.num_rows) - max(low, start)))
                            start += batch.num_rows
                            if here.num_rows:
                                columns = [here.column(k.name).cast(k.type) if k.name in here.schema.names else pa.nulls(here.num_rows, k.type) for k in schema]
                                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spark.range(0, files, 1, files).mapInArrow(read, tables[0].schema)


def merge(spark: SparkSession, sources: list[str], path: str, options: WriteOptions | None = None, files: int | None = None) -> None:
    """Writes the rows of all sources to path, in order within and across files, so that file names follow
    row order. path must be none of the sources.

    Without options or a number of files, files are copied as they are: nothing is decoded or shuffled, and
    encodings, statistics and Bloom filters stay. With either, and for routed datasets, rows are written
    anew; Bloom filters are made anew by the options. With a number of files one task writes each, reading
    its rows in order; otherwise, for routed datasets and types that Arrow has not, rows are range-sorted.
    """
    if any(s.rstrip("/") == path.rstrip("/") for s in sources):
        raise ContractError("MERGE002", "a table can't be merged into itself; use compact")
    routed = any("=" in f.rpartition("/")[0].rpartition("/")[2] for s in sources for f in spark.read.parquet(s).inputFiles())
    if options is None and files is None and not routed:
        _copied(spark, sources, path)
        return
    streamed = _streamed(spark, sources, files) if files and not routed else None
    if streamed is not None:
        writer(streamed, options or WriteOptions()).mode("errorifexists").parquet(path)
        return
    rows = in_order(spark, *sources)
    order = ["source", "file_path", "row_index"]
    placed = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    writer(placed.sortWithinPartitions(*order).drop(*order), options or WriteOptions()).mode("errorifexists").parquet(path)


def compact(spark: SparkSession, path: str, options: WriteOptions = WriteOptions(), files: int | None = None, target_bytes: int = ROLLOVER) -> None:
    """Rewrites a table in place as so many files, or as many as hold target_bytes each now. The old files stay until the new ones are complete: the
    new table is written aside, the old one set aside, the new one renamed; if that fails the old returns.
    """
    aside, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if files is None:
        files = max(1, -(-(relation(spark, "files", path).agg(F.sum("file_bytes")).first()[0] or 0) // target_bytes))
    try:
        merge(spark, [path], aside, options, files)
    except Exception:
        fs.delete(hadoop(aside), True)
        raise
    if not fs.rename(at, hadoop(old)):
        fs.delete(hadoop(aside), True)
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(hadoop(aside), at):
        fs.rename(hadoop(old), at)
        raise OSError(f"{aside} can't be put in place")
    fs.delete(hadoop(old), True)
    spark.catalog.refreshByPath(path)


def merge_metadata(first: DataFrame, other: DataFrame, keep_first: bool = True) -> DataFrame:
    """ordinal, key, value of two lists of file metadata: the first then the other, repeated keys too, or
    the other alone. An empty key is refused.
    """
    own = first.select(F.lit(0).alias("part"), "ordinal", "key", "value")
    new = other.select(F.lit(1).alias("part"), "ordinal", "key", "value")
    both = own.unionByName(new) if keep_first else new
    key = F.when(F.coalesce(F.col("key"), F.lit("")) == "", F.raise_error(F.lit("metadata has an empty key")).cast("string")).otherwise(F.col("key"))
    place = F.struct("part", "ordinal")
    gathered = both.groupBy().agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), key.alias("key"), "value"))).alias("all"))
    return gathered.select(F.posexplode("all").alias("ordinal", "x")).select("ordinal", "x.key", "x.value")


def tail_files(spark: SparkSession, path: str, smaller_than: int) -> DataFrame:
    """Files of a table that are worth compacting: those below a size."""
    return relation(spark, "files", path).where(F.col("file_bytes") < smaller_than)
