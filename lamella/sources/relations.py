"""Metadata of files as DataFrames.

The list of files is the only thing that passes the driver; executors read the footers, indexes and
headers, never the data pages. A bound of the statistics is given as it stands in the file, and to look at
as a double (numbers, booleans; days or units since the epoch) and as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.sources.footer import CODECS, ENCODINGS, ORDERS, PAGES, Node, ParquetFile, decode_bound, name

FILES = "path string, version int, footer_offset long, footer_length long, file_bytes long, created_by string, rows long, row_groups int, columns int"
NODES = "path string, ordinal int, parent int, name string, column string, kind string, repetition string, physical_type string, type_length int, logical_type string, children int, field_id int, max_repetition_level int, max_definition_level int, leaf int"
ROW_GROUPS = "path string, row_group int, first_row long, rows long, columns int, bytes long, compressed_bytes long, file_offset long, sorting_columns int"
_BOUNDS = "min_double double, max_double double, min_text string, max_text string, min_bytes binary, max_bytes binary"
CHUNKS = f"path string, row_group int, leaf int, column string, physical_type string, logical_type string, codec string, encodings array<string>, values long, rows long, null_count long, nan_count long, distinct_count long, {_BOUNDS}, min_exact boolean, max_exact boolean, data_offset long, dictionary_offset long, compressed_bytes long, bytes long, has_column_index boolean, has_offset_index boolean, has_bloom_filter boolean, bloom_offset long, bloom_length int"
DATA_PAGES = f"path string, row_group int, leaf int, column string, page int, offset long, compressed_bytes long, first_row long, rows long, null_page boolean, null_count long, {_BOUNDS}, boundary_order string, indexed boolean"
PAGE_HEADERS = "path string, row_group int, leaf int, column string, page int, page_type string, offset long, header_bytes int, compressed_bytes long, bytes long, values long, encoding string, crc int"
KEY_VALUES = "path string, ordinal int, key string, value string"
SORTING = "path string, row_group int, position int, leaf int, column string, descending boolean, nulls_first boolean"


def _bounds(node: Node, low: bytes | None, high: bytes | None) -> tuple:
    values = [decode_bound(node, x) for x in (low, high)]
    numbers = [float(v) if isinstance(v, (int, float, bool, Decimal)) else None for v in values]
    texts = [v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(v) for v in values]
    return (*numbers, *texts, low, high)


def files_rows(f: ParquetFile) -> Iterator[tuple]:
    x = f.footer.fields
    yield f.uri, x.get(1), f.footer.offset, f.footer.length, f.size, (x.get(6) or b"").decode() or None, x.get(3), len(f.row_groups()), len(f.footer.leaves)


def node_rows(f: ParquetFile) -> Iterator[tuple]:
    for n in f.footer.nodes:
        kind = "leaf" if n.leaf is not None else "list" if n.logical == "list" else "map" if n.logical == "map" else "group"
        yield f.uri, n.ordinal, n.parent, n.name, ".".join(n.path), kind, n.repetition, n.physical, n.type_length, n.logical, n.children, n.field_id, n.repetition_level, n.definition_level, n.leaf


def row_group_rows(f: ParquetFile) -> Iterator[tuple]:
    first = 0
    for i, g in enumerate(f.row_groups()):
        yield f.uri, i, first, g.get(3), len(g.get(1) or []), g.get(2), g.get(6), g.get(5), len(g.get(4) or [])
        first += g.get(3) or 0


def chunk_bounds(f: ParquetFile) -> Iterator[tuple]:
    """Column, raw bounds, rows, nulls and NaNs of each chunk, in the order of chunk_rows()."""
    for g in f.row_groups():
        for n, c in zip(f.footer.leaves, f.chunks(g), strict=True):
            s = c.get(12) or {}
            # the older bounds are in signed order: right for neither text nor unsigned numbers
            old = n.physical not in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY", "INT96") and "unsigned" not in (n.logical or "")
            low, high = s.get(6, s.get(2) if old else None), s.get(5, s.get(1) if old else None)
            yield n, low, high, g.get(3), s.get(3), s.get(9)


def chunk_rows(f: ParquetFile) -> Iterator[tuple]:
    bounds = chunk_bounds(f)
    for i, g in enumerate(f.row_groups()):
        for c in f.chunks(g):
            n, low, high, rows, nulls, nans = next(bounds)
            s = c.get(12) or {}
            encodings = [name(ENCODINGS, e) for e in c.get(2) or []]
            chunk = c["chunk"]
            yield (f.uri, i, n.leaf, ".".join(n.path), n.physical, n.logical, name(CODECS, c.get(4)), encodings, c.get(5), rows, nulls, nans, s.get(4), *_bounds(n, low, high), s.get(8), s.get(7), c.get(9), c.get(11), c.get(7), c.get(6), bool(chunk.get(6)), bool(chunk.get(4)), bool(c.get(14)), c.get(14), c.get(15))


def page_bounds(f: ParquetFile) -> Iterator[tuple]:
    """Column, raw bounds, rows and nulls of each page, in the order of page_rows()."""
    at = {x.partition(" ")[0]: i for i, x in enumerate(DATA_PAGES.split(", "))}
    for row in page_rows(f):
        yield f.footer.leaves[row[at["leaf"]]], row[at["min_bytes"]], row[at["max_bytes"]], row[at["rows"]], row[at["null_count"]]


def page_rows(f: ParquetFile, columns: set[str] | None = None) -> Iterator[tuple]:
    """From the page indexes; without them, from the page headers. columns are the names of columns without
    a parent that are not repeated, if only their pages are wanted.
    """
    for i, g in enumerate(f.row_groups()):
        for n, c in zip(f.footer.leaves, f.chunks(g), strict=True):
            if columns is not None and not (len(n.path) == 1 and n.repetition_level == 0 and n.name in columns):
                continue
            offsets, index = f.offset_index(c), f.column_index(c)
            column = (f.uri, i, n.leaf, ".".join(n.path))
            if offsets:
                places = offsets.get(1) or []
                starts = [p.get(3, 0) for p in places] + [g.get(3) or 0]
                for k, p in enumerate(places):
                    rows = starts[k + 1] - starts[k]
                    if index:
                        empty = index[1][k]
                        nulls = index[5][k] if 5 in index else None
                        bounds = (None,) * 6 if empty else _bounds(n, index[2][k], index[3][k])
                        yield (*column, k, p[1], p[2], starts[k], rows, empty, nulls, *bounds, name(ORDERS, index.get(4)), True)
                    else:
                        yield (*column, k, p[1], p[2], starts[k], rows, None, None, *(None,) * 6, None, True)
                continue
            first, k = 0, 0
            for at, h, length in f.page_headers(c):
                d = h.get(5) or h.get(8)
                if d is None:
                    continue
                rows = d.get(3) if 8 in h else d.get(1) if n.repetition_level == 0 else None
                s = d.get(5 if 5 in h else 8) or {}
                nulls = d.get(2) if 8 in h else s.get(3)
                yield (*column, k, at, length + h[3], first, rows, nulls == d.get(1) if nulls is not None else None, nulls, *_bounds(n, s.get(6), s.get(5)), None, False)
                first = None if rows is None or first is None else first + rows
                k += 1


def page_header_rows(f: ParquetFile) -> Iterator[tuple]:
    for i, g in enumerate(f.row_groups()):
        for n, c in zip(f.footer.leaves, f.chunks(g), strict=True):
            for k, (at, h, length) in enumerate(f.page_headers(c)):
                d = h.get(5) or h.get(7) or h.get(8) or {}
                encoding = d.get(4) if 8 in h else d.get(2)
                yield f.uri, i, n.leaf, ".".join(n.path), k, name(PAGES, h.get(1)), at, length, h.get(3), h.get(2), d.get(1), name(ENCODINGS, encoding), h.get(4)


def key_value_rows(f: ParquetFile) -> Iterator[tuple]:
    for i, x in enumerate(f.footer.fields.get(5) or []):
        yield f.uri, i, x.get(1, b"").decode(), x[2].decode() if 2 in x else None


def sorting_rows(f: ParquetFile) -> Iterator[tuple]:
    for i, g in enumerate(f.row_groups()):
        for k, s in enumerate(g.get(4) or []):
            yield f.uri, i, k, s.get(1), ".".join(f.footer.leaves[s.get(1, 0)].path), bool(s.get(2)), bool(s.get(3))


RELATIONS: dict[str, tuple[str, Callable]] = {
    "files": (FILES, files_rows),
    "schema_nodes": (NODES, node_rows),
    "row_groups": (ROW_GROUPS, row_group_rows),
    "column_chunks": (CHUNKS, chunk_rows),
    "pages": (DATA_PAGES, page_rows),
    "page_headers": (PAGE_HEADERS, page_header_rows),
    "key_values": (KEY_VALUES, key_value_rows),
    "sorting_columns": (SORTING, sorting_rows),
}


def file_list(spark: SparkSession, *paths: str) -> DataFrame:
    """path of each file below the given paths, as Spark lists them, spread over tasks."""
    files = sorted(spark.read.parquet(*paths).inputFiles())
    tasks = max(1, min(len(files), spark.sparkContext.defaultParallelism * 8))
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks)


def from_files(files: DataFrame, schema: str, rows: Callable[[ParquetFile], Iterator[tuple]]) -> DataFrame:
    """A relation of what rows() gives for each file, read on the executors."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    names = kinds.names

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with ParquetFile(path) as f:
                    found = list(rows(f))
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path").mapInArrow(read, schema)


def relation(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """One of RELATIONS for all files below the given paths."""
    schema, rows = RELATIONS[kind]
    return from_files(file_list(spark, *paths), schema, rows)


def leaf_columns(spark: SparkSession, *paths: str) -> DataFrame:
    return relation(spark, "schema_nodes", *paths).where("leaf is not null")
