"""Table contracts: columns with physical and logical types, checked when they are declared."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from lamella.errors import ContractError

PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
#: Which physical types an encoding can hold; None stands for all. Fixed values of the format.
ENCODING_TYPES = {
    "PLAIN": None,
    "PLAIN_DICTIONARY": None,
    "RLE_DICTIONARY": None,
    "RLE": ("BOOLEAN",),
    "BIT_PACKED": (),
    "DELTA_BINARY_PACKED": ("INT32", "INT64"),
    "DELTA_LENGTH_BYTE_ARRAY": ("BYTE_ARRAY",),
    "DELTA_BYTE_ARRAY": ("BYTE_ARRAY",),
    "BYTE_STREAM_SPLIT": ("INT32", "INT64", "FLOAT", "DOUBLE", "FIXED_LEN_BYTE_ARRAY"),
    "ALP": ("FLOAT", "DOUBLE"),
}
#: Error codes of declarations.
NESTED, KIND, INITIALIZER, HINT, DUPLICATE, PHYSICAL_TYPE, REPETITION, NO_DATE, NO_TIME, NO_TIMESTAMP, LOGICAL_PHYSICAL, LOGICAL_VALUE, UNIT, DECIMAL, DECIMAL_PHYSICAL, ALLOCATING, ENCODING = (f"CONTRACT{i:03d}" for i in range(1, 18))
#: Value types and what they stand for without further declaration: physical type, logical type, length.
DEFAULTS = {
    "bool": ("BOOLEAN", None, None),
    "byte": ("INT32", "int(8,unsigned)", None),
    "ushort": ("INT32", "int(16,unsigned)", None),
    "int": ("INT32", None, None),
    "uint": ("INT32", "int(32,unsigned)", None),
    "long": ("INT64", None, None),
    "ulong": ("INT64", "int(64,unsigned)", None),
    "float": ("FLOAT", None, None),
    "double": ("DOUBLE", None, None),
    "decimal": ("FIXED_LEN_BYTE_ARRAY", "decimal(29,0)", 13),
    "string": ("BYTE_ARRAY", "string", None),
    "bytes": ("BYTE_ARRAY", None, None),
    "date": ("INT32", "date", None),
    "time": ("INT64", "time(micros,local)", None),
    "datetime": ("INT64", "timestamp(micros,utc)", None),
    "localdatetime": ("INT64", "timestamp(micros,local)", None),
    "uuid": ("FIXED_LEN_BYTE_ARRAY", "uuid", 16),
}
ALLOCATING_KINDS = ("string", "bytes")


def parse_logical(logical: str) -> tuple[str, list[str]]:
    found = re.fullmatch(r"(\w+)(?:\(([^)]*)\))?", logical)
    if not found:
        raise ContractError(LOGICAL_PHYSICAL, f"no logical type: {logical!r}")
    return found[1], found[2].split(",") if found[2] else []


def largest_precision(length: int) -> int:
    """Decimal digits that every number of so many bytes, with a sign bit, can hold."""
    return math.floor((8 * length - 1) * math.log10(2)) if length else 0


@dataclass(frozen=True)
class Column:
    """A leaf column. path has more than one segment for nested leaves; a segment may hold dots."""

    name: str
    physical: str
    logical: str | None = None
    repetition: str = "REQUIRED"
    type_length: int | None = None
    encodings: tuple[str, ...] = ()
    codec: str | None = None
    codec_level: int | None = None
    field_id: int | None = None
    bloom: bool = False
    bloom_fpp: float = 0.01
    bloom_ndv: int | None = None
    bloom_max_bytes: int | None = None
    path: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.name:
            raise ContractError(KIND, "a column needs a name")
        if not self.path:
            object.__setattr__(self, "path", (self.name,))
        if self.physical not in PHYSICAL:
            raise ContractError(PHYSICAL_TYPE, f"{self.name}: no physical type {self.physical!r}")
        if self.repetition not in REPETITIONS:
            raise ContractError(REPETITION, f"{self.name}: no repetition {self.repetition!r}")
        if self.physical == "FIXED_LEN_BYTE_ARRAY" and not (self.type_length or 0) > 0:
            raise ContractError(PHYSICAL_TYPE, f"{self.name}: a fixed length is needed")
        if self.logical:
            self._check_logical()
        for encoding in self.encodings:
            allowed = ENCODING_TYPES.get(encoding, ())
            if allowed is not None and self.physical not in allowed:
                raise ContractError(ENCODING, f"{self.name}: {encoding} can't hold {self.physical}")
        self._check_bloom()

    def _wrong(self, code: str, what: str) -> ContractError:
        return ContractError(code, f"{self.name}: {self.logical} {what}")

    def _check_logical(self) -> None:
        kind, options = parse_logical(self.logical)
        needs = {"date": ("INT32",), "enum": ("BYTE_ARRAY",), "bson": ("BYTE_ARRAY",), "geometry": ("BYTE_ARRAY",), "geography": ("BYTE_ARRAY",)}
        if kind in needs and self.physical not in needs[kind]:
            raise self._wrong(LOGICAL_PHYSICAL, f"needs {needs[kind][0]}, not {self.physical}")
        lengths = {"float16": 2, "interval": 12, "uuid": 16}
        if kind in lengths and (self.physical != "FIXED_LEN_BYTE_ARRAY" or self.type_length != lengths[kind]):
            raise self._wrong(LOGICAL_PHYSICAL, f"needs {lengths[kind]} bytes of fixed length")
        if kind == "variant":
            raise self._wrong(LOGICAL_PHYSICAL, "needs a group")
        if kind == "unknown" and self.repetition != "OPTIONAL":
            raise self._wrong(REPETITION, "needs an optional column: all values are null")
        if kind in ("time", "timestamp"):
            if not options or options[0] not in ("millis", "micros", "nanos"):
                raise self._wrong(UNIT, "has no such unit")
            wanted = "INT32" if kind == "time" and options[0] == "millis" else "INT64"
            if self.physical != wanted:
                raise self._wrong(LOGICAL_PHYSICAL, f"needs {wanted}")
        if kind == "int":
            width, sign = (int(options[0]), options[1]) if len(options) == 2 and options[0].isdigit() else (0, "")
            if width not in (8, 16, 32, 64) or sign not in ("signed", "unsigned"):
                raise self._wrong(LOGICAL_PHYSICAL, "has no such width")
            if self.physical != ("INT64" if width == 64 else "INT32"):
                raise self._wrong(LOGICAL_PHYSICAL, f"doesn't fit {self.physical}")
        if kind == "decimal":
            precision, scale = int(options[0]), int(options[1])
            if precision <= 0 or not 0 <= scale <= precision:
                raise self._wrong(DECIMAL, "needs 0 <= scale <= precision and a positive precision")
            most = {"INT32": 9, "INT64": 18, "BYTE_ARRAY": math.inf, "FIXED_LEN_BYTE_ARRAY": largest_precision(self.type_length or 0)}
            if self.physical not in most:
                raise self._wrong(DECIMAL_PHYSICAL, f"doesn't fit {self.physical}")
            if precision > most[self.physical]:
                raise self._wrong(DECIMAL_PHYSICAL, f"has more than {most[self.physical]} digits")

    def _check_bloom(self) -> None:
        if self.bloom and self.physical == "BOOLEAN":
            raise ContractError(HINT, f"{self.name}: no Bloom filter for booleans")
        if not 0 < self.bloom_fpp < 1:
            raise ContractError(HINT, f"{self.name}: the false positive rate lies between 0 and 1")
        if self.bloom_ndv is not None and self.bloom_ndv <= 0:
            raise ContractError(HINT, f"{self.name}: the number of distinct values is positive")
        most = self.bloom_max_bytes
        if most is not None and (most & (most - 1) or not 32 <= most <= 128 << 20):
            raise ContractError(HINT, f"{self.name}: the largest filter is a power of two from 32 bytes to 128 MiB")

    @property
    def optional(self) -> bool:
        return self.repetition == "OPTIONAL"

    def spark_type(self) -> T.DataType:
        """The type that Spark's reader gives the column, or that it is converted to."""
        kind, options = parse_logical(self.logical) if self.logical else ("", [])
        if kind == "int":
            return {"8signed": T.ByteType(), "16signed": T.ShortType(), "32signed": T.IntegerType(), "64signed": T.LongType(), "8unsigned": T.ShortType(), "16unsigned": T.IntegerType(), "32unsigned": T.LongType(), "64unsigned": T.DecimalType(20, 0)}["".join(options)]
        if kind == "decimal":
            return T.DecimalType(int(options[0]), int(options[1]))
        if kind == "timestamp":
            return T.TimestampType() if options[1] == "utc" else T.TimestampNTZType()
        by_kind = {"string": T.StringType(), "enum": T.StringType(), "json": T.StringType(), "date": T.DateType(), "time": T.LongType(), "unknown": T.NullType(), "float16": T.FloatType(), "uuid": T.StringType()}
        if kind in by_kind:
            return by_kind[kind]
        return {"BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "INT96": T.TimestampType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType()}.get(self.physical, T.BinaryType())


@dataclass(frozen=True)
class Contract:
    """Columns in order, each path once."""

    columns: tuple[Column, ...]

    def __post_init__(self):
        seen = set()
        for c in self.columns:
            if c.path in seen:
                raise ContractError(DUPLICATE, f"{c.name} is declared twice")
            seen.add(c.path)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def only(self, *names: str) -> Contract:
        """The columns of these names, in the order of the contract."""
        unknown = set(names) - set(self.names)
        if unknown:
            raise ContractError(KIND, f"no such columns: {', '.join(sorted(unknown))}")
        return Contract(tuple(c for c in self.columns if c.name in names))

    def schema(self) -> T.StructType:
        """Of a table of flat columns; field ids become metadata."""
        fields = []
        for c in self.columns:
            kind = T.ArrayType(c.spark_type(), False) if c.repetition == "REPEATED" else c.spark_type()
            fields.append(T.StructField(c.name, kind, c.optional, {"parquet.field.id": c.field_id} if c.field_id is not None else None))
        return T.StructType(fields)


def column(name: str, kind: str, *, allow_allocating: bool = True, **options) -> Column:
    """A column by value type, with `?` for one that may be null: column("id", "long"), column("note", "string?")."""
    base = kind.removesuffix("?")
    if base not in DEFAULTS:
        raise ContractError(KIND, f"{name}: no value type {kind!r}")
    if base in ALLOCATING_KINDS and not allow_allocating:
        raise ContractError(ALLOCATING, f"{name}: {base} values are allocated; allow that in the contract")
    physical, logical, length = DEFAULTS[base]
    given = {"physical": physical, "logical": logical, "type_length": length, "repetition": "OPTIONAL" if kind.endswith("?") else "REQUIRED"} | options
    made = Column(name, **given)
    logical_kind = parse_logical(made.logical)[0] if made.logical else None
    for value, code, needed in (("date", NO_DATE, "date"), ("time", NO_TIME, "time"), ("datetime", NO_TIMESTAMP, "timestamp"), ("localdatetime", NO_TIMESTAMP, "timestamp")):
        if base == value and logical_kind != needed:
            raise ContractError(code, f"{name}: {base} needs a logical type {needed}")
    if base in ("int", "long", "bool", "float", "double") and logical_kind in ("string", "date", "uuid", "decimal") and (base, logical_kind) not in (("int", "decimal"), ("long", "decimal")):
        raise ContractError(LOGICAL_VALUE, f"{name}: {made.logical} doesn't describe {base}")
    return made


def contract(*columns: Column) -> Contract:
    return Contract(tuple(columns))
