"""Scans against a contract. Columns are pruned and filters pushed down by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.errors import ContractError
from lamella.plans.contract import Column, Contract
from lamella.plans.evolution import MISSING, Evolution, check_strict, missing_rows
from lamella.sources.relations import leaf_columns, relation
from lamella.storage import new_path

#: More distinct schemas among the files of one scan than this are refused, rather than gathered.
SCHEMAS = 1000


def file_schemas(spark: SparkSession, *paths: str) -> list[list[Column]]:
    """The distinct lists of leaf columns among the files, compared on the executors."""
    leaf = F.struct("leaf", "column", "physical_type", "logical_type", "repetition", "type_length", "field_id", "max_repetition_level")
    lists = leaf_columns(spark, *paths).groupBy("path").agg(F.sort_array(F.collect_list(leaf)).alias("leaves")).select("leaves").distinct().limit(SCHEMAS + 1).collect()
    if len(lists) > SCHEMAS:
        raise ContractError("SCAN001", f"more than {SCHEMAS} different schemas")
    out = []
    for row in lists:
        columns = []
        for x in row.leaves:
            path = tuple(x.column.split("."))
            nested = x.max_repetition_level > 0 and x.repetition != "REPEATED"
            columns.append(_file_column(x, path, "REPEATED" if nested and len(path) == 1 else x.repetition))
        out.append(columns)
    return out


def _file_column(x, path: tuple[str, ...], repetition: str) -> Column:
    try:
        return Column(x.column, x.physical_type, x.logical_type, repetition, x.type_length, field_id=x.field_id, path=path)
    except ContractError:  # a logical type that this package has no rule for is compared as it stands
        made = Column(x.column, "BYTE_ARRAY", None, repetition, path=path)
        for k, v in (("physical", x.physical_type), ("logical", x.logical_type), ("type_length", x.type_length), ("field_id", x.field_id)):
            object.__setattr__(made, k, v)
        return made


#: What a missing column that can't be null becomes.
def default_of(kind: T.DataType) -> Expression:
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast("date").cast(kind)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)  # values that are references have null as their default


def _top_level(spark: SparkSession, *paths: str) -> dict[tuple, list[str] | None]:
    """Files by their lists of (name, field id) of top-level columns; None for the files if all have one list."""
    column = F.struct("ordinal", "name", "field_id")
    nodes = relation(spark, "schema_nodes", *paths).where("parent = 0").groupBy("path").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    nodes = nodes.select("path", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["field_id"].alias("field_id"))).alias("columns"))
    lists = nodes.select("columns").distinct().limit(SCHEMAS + 1).collect()
    if len(lists) > SCHEMAS:
        raise ContractError("SCAN001", f"more than {SCHEMAS} different schemas")
    key = lambda columns: tuple((c.name, c.field_id) for c in columns)
    if len(lists) == 1:
        return {key(lists[0].columns): None}
    groups: dict[tuple, list[str]] = {}
    for row in nodes.collect():  # the driver lists the files of a scan in any case
        groups.setdefault(key(row.columns), []).append(row.path)
    return groups


def _bound(read, spark: SparkSession, wanted: Contract, kept: Contract, mode: str, *paths: str) -> DataFrame:
    """Columns taken by place or by field id, in each file for itself."""
    out = None
    for columns, files in sorted(_top_level(spark, *paths).items(), key=str):
        if mode == "position":
            if len(columns) < len(wanted.columns):
                raise ContractError(MISSING, f"a file has {len(columns)} columns, {len(wanted.columns)} are wanted")
            places = {c.name: i for i, c in enumerate(wanted.columns)}
        else:
            ids = {field_id: i for i, (_, field_id) in enumerate(columns) if field_id is not None}
            unknown = [c.name for c in kept.columns if c.field_id not in ids]
            if unknown:
                raise ContractError(MISSING, f"a file has no field ids for {', '.join(unknown)}")
            places = {c.name: ids[c.field_id] for c in kept.columns}
        part = read().parquet(*(sorted(files) if files else paths)).select(*(F.col(f"`{name}`") for name, _ in columns))
        part = part.toDF(*(str(i) for i in range(len(columns)))).select(*(F.col(str(places[c.name])).alias(c.name) for c in kept.columns))
        out = part if out is None else out.unionByName(part)
    return out


def scan(spark: SparkSession, wanted: Contract, *paths: str, projection: list[str] | None = None, mode: str = "strict", evolution: Evolution | None = None, verify_checksums: bool = False, row_reader: bool = False) -> DataFrame:
    """Rows of the files below paths.

    mode "strict" checks every file against the contract by column path; "position" takes the columns by
    their places in each file, "field_id" by the ids of the contract, both without a check of types; "rows"
    applies the evolution rules and fills missing columns with defaults. projection names columns, in any
    order; the result has them in that of the contract.

    verify_checksums makes reading fail where a page's checksum is wrong. row_reader reads files that need
    it (see needs_row_reader) by Spark's row reader, which is a setting of a session: a session of its own
    copies the columns to the shared folder, and the result reads the copy.
    """
    if row_reader:
        other = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                other.conf.set(name, value)
        other.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
        rows = scan(other, wanted, *paths, projection=projection, mode=mode, evolution=evolution, verify_checksums=verify_checksums)
        path = new_path(spark, "rows")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    kept = wanted.only(*projection) if projection is not None else wanted
    read = lambda: spark.read.option("parquet.page.verify-checksum.enabled", str(verify_checksums).lower())
    if mode in ("position", "field_id"):
        return _bound(read, spark, wanted, kept, mode, *paths)
    missing: set[str] = set()
    for leaves in file_schemas(spark, *paths):
        if mode == "strict":
            check_strict(kept, leaves)
        elif mode == "rows":
            missing |= set(missing_rows(wanted, leaves, evolution or Evolution(), [c.name for c in kept.columns]))
        else:
            raise ContractError("SCAN002", f"no mode {mode!r}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in kept.schema().fields])
    df = read().schema(schema).parquet(*paths)
    # elsewhere a required column holds no null, so filling nulls fills exactly what was missing
    filled = [F.coalesce(F.col(f"`{c.name}`"), default_of(c.spark_type())).alias(c.name) if c.name in missing and not c.optional else F.col(f"`{c.name}`") for c in kept.columns]
    return df.select(*filled)


def needs_row_reader(spark: SparkSession, *paths: str) -> bool:
    """Whether some file holds what Spark's vectorized reader refuses (BYTE_STREAM_SPLIT) or misreads (text
    in uncompressed delta encodings). scan() reads such files with row_reader.
    """
    chunks = relation(spark, "column_chunks", *paths)
    has = lambda e: F.array_contains("encodings", e)
    delta = (F.col("codec") == "UNCOMPRESSED") & (has("DELTA_BYTE_ARRAY") | has("DELTA_LENGTH_BYTE_ARRAY"))
    return not chunks.where(has("BYTE_STREAM_SPLIT") | delta).isEmpty()


def with_positions(df: DataFrame) -> DataFrame:
    """df of a file scan with file_path, as the metadata relations name files, and row_index: they order
    and identify its rows.
    """
    return df.withColumns({"file_path": F.regexp_replace("_metadata.file_path", "^file:/(?!/)", "file:///"), "row_index": F.col("_metadata.row_index")})
