"""Converters between an application's values and stored ones, as pairs of expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.errors import ContractError


@dataclass(frozen=True)
class Converter:
    """to_physical and from_physical take a value and give one; null passes by them.

    With `vectorized` they are functions of pandas Series instead, run in batches.
    """

    physical: str
    logical: str
    to_physical: Callable
    from_physical: Callable
    vectorized: bool = False

    def _apply(self, x: Column, function: Callable, kind: str) -> Column:
        if self.vectorized:
            import pandas as pd

            def batch(values: pd.Series) -> pd.Series:
                there = values.notna()
                out = pd.Series([None] * len(values), dtype=object)
                out[there.to_numpy()] = list(function(values[there]))
                return out

            batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
            return F.when(x.isNotNull(), F.pandas_udf(batch, kind)(x))
        return F.when(x.isNotNull(), function(x).cast(kind))

    def store(self, x: Column) -> Column:
        return self._apply(x, self.to_physical, self.physical)

    def load(self, x: Column) -> Column:
        return self._apply(x, self.from_physical, self.logical)


def apply_converters(df: DataFrame, converters: dict[str, Converter], storing: bool) -> DataFrame:
    """df with its named columns converted. A list column can't be converted."""
    for name in converters:
        if isinstance(df.schema[name].dataType, T.ArrayType):
            raise ContractError("CONVERT001", f"{name} is a list")
    return df.withColumns({n: c.store(F.col(f"`{n}`")) if storing else c.load(F.col(f"`{n}`")) for n, c in converters.items()})
