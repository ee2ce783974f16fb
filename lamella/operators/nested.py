"""Lists and maps as levels, and back.

A value of a list column becomes a row for each entry, with its repetition level (the depth at which it
continues a list, 0 for a new row) and its definition level (how much of its path is there). A null list,
an empty list and a null element differ by their definition levels, so nothing is lost on the way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def depth_of(kind: T.DataType) -> int:
    return 1 + depth_of(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def leaf_levels(schema: T.StructType) -> list[tuple[tuple[str, ...], int, int]]:
    """Path, largest repetition and definition level of each leaf of a schema."""
    out: list[tuple[tuple[str, ...], int, int]] = []

    def walk(path: tuple[str, ...], kind: T.DataType, nullable: bool, rep: int, definition: int) -> None:
        definition += nullable
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk((*path, f.name), f.dataType, f.nullable, rep, definition)
        elif isinstance(kind, T.ArrayType):
            walk((*path, "list", "element"), kind.elementType, kind.containsNull, rep + 1, definition + 1)
        elif isinstance(kind, T.MapType):
            walk((*path, "key_value", "key"), kind.keyType, False, rep + 1, definition + 1)
            walk((*path, "key_value", "value"), kind.valueType, kind.valueContainsNull, rep + 1, definition + 1)
        else:
            out.append((path, rep, definition))

    for f in schema.fields:
        walk((f.name,), f.dataType, f.nullable, 0, 0)
    return out


def shred(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, places (position at each depth), rep, def, value for each entry of a list of any depth.

    All lists and elements count as optional. Rows of df give at least one row each.
    """
    rows = df.select(F.col(key), F.array().cast("array<int>").alias("places"), F.lit(0).alias("rep"), F.lit(0).alias("def"), F.lit(True).alias("open"), F.col(column).alias("value"))
    kind, level = df.schema[column].dataType, 0
    while isinstance(kind, T.ArrayType):
        level += 1
        there, full = F.col("open") & F.col("value").isNotNull(), F.col("open") & (F.size("value") > 0)
        rows = rows.select(
            key,
            "places",
            "rep",
            F.when(full, F.col("def") + 2).when(there, F.col("def") + 1).otherwise(F.col("def")).alias("def"),
            F.coalesce(full, F.lit(False)).alias("open"),
            F.posexplode_outer("value").alias("pos", "value"),
        )
        place = F.when(F.col("open"), F.concat("places", F.array("pos"))).otherwise(F.col("places"))
        rows = rows.select(key, place.alias("places"), F.when(F.col("pos") > 0, level).otherwise(F.col("rep")).alias("rep"), "def", "open", "value")
        kind = kind.elementType
    whole = F.when(F.col("open") & F.col("value").isNotNull(), F.col("def") + 1).otherwise(F.col("def"))
    return rows.select(key, "places", "rep", whole.alias("def"), "value")


def assemble(levels: DataFrame, key: str, depth: int = 1, column: str = "value") -> DataFrame:
    """key and column: the lists of which levels are the entries, as shred() gives them."""
    kind = levels.schema["value"].dataType
    # `def` reached 2 * depth inside all lists; what stopped before is a null or an empty list there
    rows = levels.select(key, "places", F.col("def").alias("d"), F.col("value").alias("v"))
    for level in range(depth, 0, -1):
        prefix = F.slice("places", 1, level - 1)
        inside = F.col("d") >= 2 * level
        entry = F.when(inside, F.struct(F.get("places", F.lit(level - 1)).alias("p"), F.col("v").alias("v")))
        merged = rows.select(key, prefix.alias("places"), F.col("d"), entry.alias("e")).groupBy(key, "places").agg(F.max("d").alias("d"), F.sort_array(F.collect_list("e")).alias("es"))
        kind = T.ArrayType(kind)
        full = F.transform("es", lambda e: e["v"])
        lists = F.when(F.col("d") >= 2 * level, full).when(F.col("d") == 2 * level - 1, F.array().cast(kind))
        rows = merged.select(key, "places", F.col("d"), lists.alias("v"))
    return rows.select(key, F.col("v").alias(column))


def map_from_pairs(keys: Column, values: Column) -> Column:
    """A map of two lists, null if either is; fails where they differ in length or a key is null."""
    return F.map_from_arrays(keys, values)


def map_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, entry_key, entry_value for each entry; nothing for null and empty maps."""
    return df.select(key, F.explode(column).alias("entry_key", "entry_value"))


def key_set(column: Column) -> Column:
    """A map without values is a set: its keys, sorted."""
    return F.array_sort(F.map_keys(column))
