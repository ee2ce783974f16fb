"""What a Parquet writer can be told, as options of Spark's writer. What it can't be told is refused here;
operators.arrow_sink can do more of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter

from lamella.errors import ContractError, UnsupportedError
from lamella.plans.contract import Contract

CODECS = {"none": (), "snappy": (), "gzip": range(0, 10), "zstd": range(1, 23), "lz4": (), "lz4_raw": ()}
#: Names of gzip levels 0 to 9 in the writer's configuration.
GZIP_LEVELS = "NO_COMPRESSION BEST_SPEED TWO THREE FOUR FIVE SIX SEVEN EIGHT BEST_COMPRESSION".split()
MIB = 1 << 20


@dataclass(frozen=True)
class WriteOptions:
    """Sizes in bytes. dictionary: "maybe" leaves the choice to the writer, "off" never makes one."""

    codec: str = "snappy"
    codec_level: int | None = None
    row_group_bytes: int = 128 * MIB
    page_bytes: int = MIB
    page_rows: int | None = None
    dictionary: str = "maybe"
    page_version: int = 1
    page_checksums: bool = False
    sorting: tuple[tuple[str, bool, bool], ...] = ()

    def __post_init__(self):
        if self.codec in ("brotli", "lzo"):
            raise UnsupportedError(f"Spark has no codec {self.codec}")
        if self.codec not in CODECS:
            raise ContractError("WRITE001", f"no codec {self.codec!r}")
        if self.codec_level is not None and self.codec_level not in CODECS[self.codec]:
            raise ContractError("WRITE002", f"{self.codec} has no level {self.codec_level}")
        if self.dictionary not in ("maybe", "off"):
            raise UnsupportedError(f"the writer decides on dictionaries itself: {self.dictionary!r}")
        if self.page_version not in (1, 2):
            raise ContractError("WRITE003", f"no page version {self.page_version}")
        if self.page_version == 2 and self.codec == "none":
            raise UnsupportedError("Spark's vectorized reader misreads text in uncompressed pages of version 2")
        if min(self.row_group_bytes, self.page_bytes, self.page_rows or 1) <= 0:
            raise ContractError("WRITE004", "sizes are positive")


def refuse(feature: str) -> None:
    """Features of the format that Spark's writer can't be asked for."""
    reasons = {
        "ALP": "no such encoding",
        "BYTE_STREAM_SPLIT": "the writer has no option for it",
        "DELTA_LENGTH_BYTE_ARRAY": "the writer takes DELTA_BYTE_ARRAY for text instead",
        "BIT_PACKED": "it is no encoding of data pages",
        "column codec": "one codec holds for the file",
        "key_value_metadata": "the footer's keys are the writer's own",
        "sorting_columns": "rows are sorted, but the footer doesn't say so",
        "append in place": "files are never changed",
        "page strategy": "pages are cut by size and rows only",
    }
    raise UnsupportedError(f"{feature}: {reasons[feature]}")


def options_of(options: WriteOptions, wanted: Contract | None = None) -> dict[str, str]:
    out = {"compression": options.codec, "parquet.block.size": options.row_group_bytes, "parquet.page.size": options.page_bytes, "parquet.writer.version": f"v{options.page_version}", "parquet.page.write-checksum.enabled": options.page_checksums, "parquet.enable.dictionary": options.dictionary == "maybe"}
    if options.page_rows:
        out["parquet.page.row.count.limit"] = options.page_rows
    if options.codec_level is not None:
        if options.codec == "zstd":
            out["parquet.compression.codec.zstd.level"] = options.codec_level
        else:
            out["zlib.compress.level"] = GZIP_LEVELS[options.codec_level]
    for c in wanted.columns if wanted else ():
        if c.codec and c.codec != options.codec:
            refuse("column codec")
        for encoding in c.encodings:
            if encoding in ("ALP", "BYTE_STREAM_SPLIT", "DELTA_LENGTH_BYTE_ARRAY"):
                refuse(encoding)
            if encoding in ("PLAIN", "DELTA_BINARY_PACKED", "DELTA_BYTE_ARRAY", "RLE"):
                out[f"parquet.enable.dictionary#{c.name}"] = False
        if c.bloom:
            out[f"parquet.bloom.filter.enabled#{c.name}"] = True
            out[f"parquet.bloom.filter.fpp#{c.name}"] = c.bloom_fpp
            if c.bloom_ndv:
                out[f"parquet.bloom.filter.expected.ndv#{c.name}"] = c.bloom_ndv
            if c.bloom_max_bytes:
                out["parquet.bloom.filter.max.bytes"] = c.bloom_max_bytes
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in out.items()}


def sorted_rows(df: DataFrame, sorting: tuple[tuple[str, bool, bool], ...]) -> DataFrame:
    """df sorted within its tasks by (column, descending, nulls first)."""
    order = []
    for name, descending, nulls_first in sorting:
        x = df[f"`{name}`"]
        order.append((x.desc_nulls_first() if nulls_first else x.desc_nulls_last()) if descending else (x.asc_nulls_first() if nulls_first else x.asc_nulls_last()))
    return df.sortWithinPartitions(*order) if order else df


def writer(df: DataFrame, options: WriteOptions = WriteOptions(), wanted: Contract | None = None) -> DataFrameWriter:
    """A writer of df; rows are sorted within their tasks if the options say how, and columns follow the contract."""
    if wanted:  # field ids are written from the columns' metadata
        df = df.select(*(df[f"`{c.name}`"].alias(c.name, metadata={**df.schema[c.name].metadata, "parquet.field.id": c.field_id}) if c.field_id is not None else df[f"`{c.name}`"] for c in wanted.columns))
    return sorted_rows(df, options.sorting).write.options(**options_of(options, wanted))


def write_table(df: DataFrame, path: str, options: WriteOptions = WriteOptions(), wanted: Contract | None = None, mode: str = "errorifexists") -> None:
    writer(df, options, wanted).mode(mode).parquet(path)
