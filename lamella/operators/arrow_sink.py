"""A Parquet writer on the executors for what Spark's own can't be told.

Codecs and encodings by column, BYTE_STREAM_SPLIT and DELTA_LENGTH_BYTE_ARRAY, forced dictionaries, brotli
(which Spark's readers don't read), footer keys, declared sorting columns, page indexes on or off, and files that roll over at their bytes.
Each task writes Arrow batches to files under temporary names and returns these as rows of a manifest;
Spark commits the manifest, so of several attempts at a task one counts. A second job gives the files of the
manifest their names; it may run again. What lost attempts wrote goes with the temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.errors import ContractError, UnsupportedError
from lamella.operators.dataset import ROLLOVER
from lamella.operators.sink import MIB, sorted_rows
from lamella.plans.contract import ENCODING_TYPES, Contract
from lamella.storage import materialize, release

CODECS = {"none": None, "snappy": None, "gzip": range(1, 10), "brotli": range(0, 12), "zstd": range(1, 23), "lz4_raw": None}
DICTIONARIES = {"maybe", "off", "forced"}
#: Dictionaries of up to so many bytes are kept when they are forced.
FORCED_BYTES = 1 << 30
MANIFEST = "temporary string, name string, rows long, bytes long"


@dataclass(frozen=True)
class ArrowOptions:
    """Sizes in bytes; file_bytes are of the file as written, overrun by less than a row group. Codecs and
    encodings of single columns come from the contract.
    """

    codec: str = "snappy"
    codec_level: int | None = None
    row_group_bytes: int = 128 * MIB
    page_bytes: int = MIB
    page_rows: int | None = None
    dictionary: str = "maybe"
    page_version: int = 1
    page_checksums: bool = False
    page_indexes: bool = True
    file_bytes: int = ROLLOVER
    sorting: tuple[tuple[str, bool, bool], ...] = ()
    key_values: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        check_codec(self.codec, self.codec_level)
        if self.dictionary not in DICTIONARIES:
            raise ContractError("WRITE005", f"dictionaries are {', '.join(sorted(DICTIONARIES))}")
        if self.page_version not in (1, 2):
            raise ContractError("WRITE003", f"no page version {self.page_version}")
        if min(self.row_group_bytes, self.page_bytes, self.file_bytes, self.page_rows or 1) <= 0:
            raise ContractError("WRITE004", "sizes are positive")
        keys = [k for k, _ in self.key_values]
        if not all(keys) or len(set(keys)) < len(keys):
            raise ContractError("WRITE006", "footer keys are not empty and each is given once")


def check_codec(codec: str, level: int | None) -> None:
    if codec not in CODECS:
        raise ContractError("WRITE001", f"no codec {codec!r}")
    if level is not None and (CODECS[codec] is None or level not in CODECS[codec]):
        raise ContractError("WRITE002", f"{codec} has no level {level}")


def _leaves(schema: pa.Schema) -> dict[str, list[str]]:
    """Paths of the leaf columns below each column, as the Arrow writer names them."""
    import pyarrow.parquet as pq

    sink = pa.BufferOutputStream()
    pq.write_table(schema.empty_table(), sink)
    found = pq.ParquetFile(pa.BufferReader(sink.getvalue())).schema
    paths = [found.column(i).path for i in range(len(found))]
    return {name: [p for p in paths if p == name or p.startswith(f"{name}.")] for name in schema.names}


def _parquet_options(options: ArrowOptions, wanted: Contract | None, schema: pa.Schema) -> dict:
    """Arguments of the Arrow writer."""
    name = lambda codec: {"none": "NONE", "lz4_raw": "lz4"}.get(codec, codec)
    leaves = _leaves(schema)
    every = [p for paths in leaves.values() for p in paths]
    codecs, levels, encodings = dict.fromkeys(every, name(options.codec)), {}, {}
    if options.codec_level is not None:
        levels = dict.fromkeys(every, options.codec_level)
    for c in wanted.columns if wanted else ():
        if c.bloom:
            raise UnsupportedError("Bloom filters are written by Spark's own writer")
        if c.codec:
            check_codec(c.codec, c.codec_level)
        for p in leaves[c.name]:
            if c.codec:
                codecs[p] = name(c.codec)
                levels.pop(p, None)
                if c.codec_level is not None:
                    levels[p] = c.codec_level
            for e in c.encodings[:1]:
                if e == "ALP":
                    raise UnsupportedError("ALP: no such encoding")
                if ENCODING_TYPES[e] is not None or e == "PLAIN":
                    encodings[p] = e
    dictionary = [] if options.dictionary == "off" else [p for p in every if p not in encodings]
    out = {"compression": codecs, "data_page_size": options.page_bytes, "data_page_version": f"{options.page_version}.0", "write_page_index": options.page_indexes, "write_page_checksum": options.page_checksums, "use_dictionary": dictionary, "store_schema": False}
    if levels:
        out["compression_level"] = levels
    if encodings:
        out["column_encoding"] = encodings
    if options.page_rows:
        out |= {"max_rows_per_page": options.page_rows, "write_batch_size": options.page_rows}
    if options.dictionary == "forced":
        out["dictionary_pagesize_limit"] = FORCED_BYTES
    return out


def _arrow_schema(df: DataFrame, wanted: Contract | None) -> pa.Schema:
    """With field ids and what may not be null."""
    declared = {c.name: c for c in wanted.columns} if wanted else {}
    fields = []
    for f in to_arrow_schema(df.schema):
        c = declared.get(f.name)
        if c is not None:
            f = f.with_nullable(c.optional)
            if c.field_id is not None:
                f = f.with_metadata({b"PARQUET:field_id": str(c.field_id).encode()})
        fields.append(f)
    return pa.schema(fields)


def write_arrow(df: DataFrame, path: str, options: ArrowOptions = ArrowOptions(), wanted: Contract | None = None, mode: str = "errorifexists") -> DataFrame:
    """Writes df to path; returns name, rows and bytes of the files written. mode may also be "append".

    Rows are sorted within tasks if the options say how, and the footers say so. A task without rows writes
    no file; an empty table gives one file without rows. Null in a required column is an error.
    """
    spark = df.sparkSession
    if wanted:
        df = df.select(*(f"`{c}`" for c in wanted.names))
    df = sorted_rows(df, options.sorting)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode not in ("errorifexists", "append") or (mode == "errorifexists" and fs.exists(jvm_path)):
        raise ContractError("WRITE007", f"{path} is there already" if mode == "errorifexists" else f"no mode {mode!r}")
    uri = fs.makeQualified(jvm_path).toString().rstrip("/")
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    job = uuid.uuid4().hex[:12]
    aside, schema = f"_temporary-{job}", _arrow_schema(df, wanted)
    arguments = _parquet_options(options, wanted, schema)
    held_bytes = max(1, min(options.row_group_bytes, options.file_bytes // 4))
    order = [(schema.names.index(n), d, f) for n, d, f in options.sorting]

    def write(batches: Iterable[pa.RecordBatch], empty: bool = False) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        files, folder = FileSystem.from_uri(uri)
        files.create_dir(f"{folder}/{aside}", recursive=True)
        part, done, held, size = TaskContext.get().partitionId(), [], [], 0
        writer = stream = name = None
        rows = 0

        def put(table: pa.Table) -> None:
            nonlocal writer, stream, name, rows
            if writer is None:
                name = f"{uuid.uuid4().hex}.parquet"
                stream = files.open_output_stream(f"{folder}/{aside}/{name}", compression=None)
                columns = [pq.SortingColumn(i, d, f) for i, d, f in order] or None
                writer = pq.ParquetWriter(stream, schema, sorting_columns=columns, **arguments)
                if options.key_values:
                    writer.add_key_value_metadata(dict(options.key_values))
                rows = 0
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            rows += table.num_rows

        def close() -> None:
            nonlocal writer
            writer.close()
            size_now = stream.tell()
            stream.close()
            done.append((name, f"part-{part:06d}-{len(done):04d}-{job}.parquet", rows, size_now))
            writer = None

        for batch in batches:
            at = 0
            step = max(1, int(batch.num_rows * held_bytes / max(batch.nbytes, 1)))
            while at < batch.num_rows:
                piece = batch.slice(at, step)
                at += piece.num_rows
                held.append(piece)
                size += piece.nbytes
                if size >= held_bytes:
                    put(pa.Table.from_batches(held).cast(schema))
                    held, size = [], 0
                    if stream.tell() >= options.file_bytes:
                        close()
        if held or empty:
            put(pa.Table.from_batches(held).cast(schema) if held else schema.empty_table())
        if writer is not None:
            close()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["temporary", "name", "rows", "bytes"])

    def give_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        files, folder = FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                before, after = f"{folder}/{aside}/{r['temporary']}", f"{folder}/{r['name']}"
                # an attempt before this one may have moved the file
                if files.get_file_info(before).type != FileType.NotFound:
                    files.move(before, after)
                elif files.get_file_info(after).type == FileType.NotFound:
                    raise FileNotFoundError(after)
            yield batch.select(["name", "rows", "bytes"])

    manifest = materialize(df.mapInArrow(write, MANIFEST), "manifest")
    if manifest.isEmpty():  # no task had rows; which of them has is known only now
        manifest = materialize(spark.range(1).coalesce(1).mapInArrow(lambda batches: write(iter(()), True), MANIFEST), "manifest")
    moved = materialize(manifest.repartition(max(1, min(manifest.count(), 64))).mapInArrow(give_names, "name string, rows long, bytes long"), "files")
    release(spark, f"{uri}/{aside}")
    spark.catalog.refreshByPath(path)
    return moved.select("name", F.col("rows"), F.col("bytes"))
