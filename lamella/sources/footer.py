"""What Parquet files say about themselves: footers, page indexes, page headers and Bloom filters.

Field numbers and enumerations follow the public definition of the format.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np

from lamella.errors import CorruptFileError
from lamella.sources.thrift import CompactReader

#: Fixed values of the format, in order.
TYPES = ["BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"]
REPETITIONS = ["REQUIRED", "OPTIONAL", "REPEATED"]
ENCODINGS = ["PLAIN", "GROUP_VAR_INT", "PLAIN_DICTIONARY", "RLE", "BIT_PACKED", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "RLE_DICTIONARY", "BYTE_STREAM_SPLIT", "ALP"]
CODECS = ["UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW"]
PAGES = ["DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2"]
ORDERS = ["UNORDERED", "ASCENDING", "DESCENDING"]
UNITS = {1: "millis", 2: "micros", 3: "nanos"}
CONVERTED = "string map map_key_value list enum decimal date time(millis,utc) time(micros,utc) timestamp(millis,utc) timestamp(micros,utc) int(8,unsigned) int(16,unsigned) int(32,unsigned) int(64,unsigned) int(8,signed) int(16,signed) int(32,signed) int(64,signed) json bson interval".split()
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
MAGIC = b"PAR1"


def name(values: list[str], number: int | None) -> str | None:
    if number is None:
        return None
    return values[number] if 0 <= number < len(values) else str(number)


def logical_type(node: dict) -> str | None:
    """The logical type of a schema element as text, from the newer or the older annotation."""
    if 10 in node and node[10]:
        kind, inner = next(iter(node[10].items()))
        if kind in (1, 2, 3, 4, 6, 11, 12, 13, 14, 15):
            return {1: "string", 2: "map", 3: "list", 4: "enum", 6: "date", 11: "unknown", 12: "json", 13: "bson", 14: "uuid", 15: "float16"}[kind]
        if kind == 5:
            return f"decimal({inner.get(2)},{inner.get(1, 0)})"
        if kind in (7, 8):
            unit = UNITS[next(iter(inner.get(2, {2: {}})))]
            return f"{'time' if kind == 7 else 'timestamp'}({unit},{'utc' if inner.get(1) else 'local'})"
        if kind == 10:
            return f"int({inner.get(1)},{'signed' if inner.get(2) else 'unsigned'})"
        return {16: "variant", 17: "geometry", 18: "geography"}.get(kind, f"logical{kind}")
    if 6 in node:
        found = name(CONVERTED, node[6])
        return f"decimal({node.get(8)},{node.get(7, 0)})" if found == "decimal" else found
    return None


@dataclass
class Node:
    """An element of the schema tree. Levels and path count from below the root."""

    ordinal: int
    parent: int | None
    name: str
    path: tuple[str, ...]
    repetition: str | None
    physical: str | None
    type_length: int | None
    logical: str | None
    children: int
    field_id: int | None
    repetition_level: int
    definition_level: int
    leaf: int | None = None


@dataclass
class Footer:
    path: str
    size: int
    offset: int
    length: int
    fields: dict
    nodes: list[Node] = field(default_factory=list)

    @property
    def leaves(self) -> list[Node]:
        return [n for n in self.nodes if n.leaf is not None]


def parse_footer(path: str, size: int, tail: bytes, body: bytes) -> Footer:
    fields = CompactReader(body).structure()
    footer = Footer(path, size, size - 8 - len(body), len(body), fields)
    elements, at, leaves = fields.get(2) or [], 0, 0

    def walk(parent: int | None, path: tuple[str, ...], repetition: int, definition: int) -> None:
        nonlocal at, leaves
        if at >= len(elements):
            raise CorruptFileError(f"{footer.path}: the schema ends early")
        e, ordinal = elements[at], at
        at += 1
        kind = None if parent is None else name(REPETITIONS, e.get(3, 0))
        here = () if parent is None else (*path, e.get(4, b"").decode())
        repetition += kind == "REPEATED"
        definition += kind in ("REPEATED", "OPTIONAL")
        node = Node(ordinal, parent, e.get(4, b"").decode(), here, kind, name(TYPES, e.get(1)), e.get(2), logical_type(e), e.get(5, 0) or 0, e.get(9), repetition, definition)
        footer.nodes.append(node)
        if not node.children and parent is not None:
            node.leaf = leaves
            leaves += 1
        for _ in range(node.children):
            walk(ordinal, here, repetition, definition)

    walk(None, (), 0, 0)
    if at != len(elements):
        raise CorruptFileError(f"{path}: schema elements without a parent")
    return footer


class ParquetFile:
    """A file of any file system that pyarrow knows, by URI."""

    def __init__(self, uri: str):
        from pyarrow.fs import FileSystem

        self.uri = uri
        fs, path = FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        if self.size < 12 or self.read(0, 4) != MAGIC:
            raise CorruptFileError(f"{uri}: no Parquet file")
        tail = self.read(self.size - 8, 8)
        length = struct.unpack("<I", tail[:4])[0]
        if tail[4:] != MAGIC or length + 12 > self.size:
            raise CorruptFileError(f"{uri}: no Parquet footer")
        self.footer = parse_footer(uri, self.size, tail, self.read(self.size - 8 - length, length))

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise CorruptFileError(f"{self.uri}: bytes {offset}+{length} lie outside the file")
        return self.file.read_at(length, offset)

    def __enter__(self) -> ParquetFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def row_groups(self) -> list[dict]:
        return self.footer.fields.get(4) or []

    def chunks(self, group: dict) -> list[dict]:
        """Metadata of the column chunks of a row group, the chunk's own fields under 'chunk'."""
        out = []
        for chunk in group.get(1) or []:
            if 3 not in chunk:
                raise CorruptFileError(f"{self.uri}: a column chunk without metadata")
            out.append(chunk[3] | {"chunk": chunk})
        if len(out) != len(self.footer.leaves):
            raise CorruptFileError(f"{self.uri}: a row group with {len(out)} chunks for {len(self.footer.leaves)} columns")
        return out

    def column_index(self, chunk: dict) -> dict | None:
        c = chunk["chunk"]
        return CompactReader(self.read(c[6], c[7])).structure() if c.get(6) and c.get(7) else None

    def offset_index(self, chunk: dict) -> dict | None:
        c = chunk["chunk"]
        return CompactReader(self.read(c[4], c[5])).structure() if c.get(4) and c.get(5) else None

    def page_headers(self, chunk: dict):
        """(offset, header, header length) of all pages of a chunk; payloads are not read. A chunk without
        values may have no pages and no offsets.
        """
        if not chunk[5]:
            return
        at = min(x for x in (chunk.get(9), chunk.get(11)) if x)
        end = at + chunk[7]
        values = 0
        while at < end and values < chunk[5]:
            for guess in (1 << 10, 1 << 16, 1 << 24):
                data = self.read(at, min(guess, self.size - at))
                reader = CompactReader(data)
                try:
                    header = reader.structure()
                    break
                except CorruptFileError:
                    if len(data) < guess:
                        raise
            else:
                raise CorruptFileError(f"{self.uri}: a page header is too long")
            yield at, header, reader.at
            values += (header.get(5) or header.get(8) or {}).get(1, 0)
            at += reader.at + header[3]

    def bloom_filter(self, chunk: dict) -> np.ndarray | None:
        """Blocks of eight words, or None."""
        if not chunk.get(14):
            return None
        length = min(chunk.get(15) or 64, self.size - chunk[14])
        reader = CompactReader(self.read(chunk[14], max(length, min(64, self.size - chunk[14]))))
        header = reader.structure()
        size = header.get(1, 0)
        if size <= 0 or size % 32:
            raise CorruptFileError(f"{self.uri}: a Bloom filter of {size} bytes")
        return np.frombuffer(self.read(chunk[14] + reader.at, size), "<u4").reshape(-1, 8)


def _scaled(unscaled: int, logical: str) -> Decimal:
    """The decimal of a whole number and the scale of its type, exactly."""
    sign, digits = (1, -unscaled) if unscaled < 0 else (0, unscaled)
    return Decimal((sign, tuple(map(int, str(digits))), -int(logical.rpartition(",")[2][:-1])))


def decode_bound(node: Node, data: bytes | None):
    """A bound of the statistics as a number, decimal or bytes; None where it has no order that is known."""
    if data is None:
        return None
    physical, logical = node.physical, node.logical or ""
    if physical == "BOOLEAN":
        return bool(data[0]) if data else None
    if physical in ("INT32", "INT64"):
        value = int.from_bytes(data, "little", signed="unsigned" not in logical)
        return _scaled(value, logical) if logical.startswith("decimal") else value
    if physical == "FLOAT":
        return struct.unpack("<f", data)[0]
    if physical == "DOUBLE":
        return struct.unpack("<d", data)[0]
    if physical == "INT96":
        return None
    if logical.startswith("decimal"):
        return _scaled(int.from_bytes(data, "big", signed=True), logical)
    return data


def plain_bytes(physical: str, value) -> bytes:
    """A value as it stands in a plain page, for Bloom filters; floats by their bits."""
    if physical == "INT32":
        return struct.pack("<i", value if value < 1 << 31 else value - (1 << 32))
    if physical == "INT64":
        return struct.pack("<q", value if value < 1 << 63 else value - (1 << 64))
    if physical == "FLOAT":
        return struct.pack("<f", value)
    if physical == "DOUBLE":
        return struct.pack("<d", value)
    if physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        return value.encode() if isinstance(value, str) else bytes(value)
    raise ValueError(f"no Bloom filter for {physical}")


def might_contain(blocks: np.ndarray, data: bytes) -> bool:
    """False only if the value is in no row that the filter covers."""
    import xxhash

    digest = xxhash.xxh64(data, seed=0).intdigest()
    block = blocks[((digest >> 32) * len(blocks)) >> 32]
    with np.errstate(over="ignore"):
        bits = (np.uint32(digest & 0xFFFFFFFF) * SALTS) >> np.uint32(27)
    return bool(((block >> bits) & np.uint32(1)).all())
