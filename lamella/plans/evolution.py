"""Which file schemas a contract accepts, and what missing columns become."""

from __future__ import annotations

from dataclasses import dataclass

from lamella.errors import ContractError, CorruptFileError
from lamella.plans.contract import Column, Contract

MISSING, TYPE, REPETITION, LENGTH, LOGICAL = "EVOLVE001", "EVOLVE002", "EVOLVE003", "EVOLVE004", "EVOLVE005"


@dataclass(frozen=True)
class Evolution:
    """What may differ. A changed physical type, and an optional column that is required, never may."""

    missing: str = "reject"
    logical: str = "reject"
    required_to_optional: bool = False

    def __post_init__(self):
        if self.missing not in ("reject", "default") or self.logical not in ("reject", "compatible"):
            raise ContractError("EVOLVE000", f"no such rule: {self}")


def plain_integer(wanted: Column, logical: str | None) -> bool:
    """No logical type is wanted, and the file names the signed integer that the physical type is anyway."""
    return wanted.logical is None and (wanted.physical, logical) in (("INT32", "int(32,signed)"), ("INT64", "int(64,signed)"))


def by_path(leaves: list[Column]) -> dict[tuple[str, ...], Column]:
    found: dict[tuple[str, ...], Column] = {}
    for leaf in leaves:
        if leaf.path in found:
            raise CorruptFileError(f"the file has the column {'.'.join(leaf.path)} twice")
        found[leaf.path] = leaf
    return found


def check_strict(wanted: Contract, leaves: list[Column]) -> None:
    """Of a columnar reader: columns by path segments; an optional column may be wanted of a required one."""
    there = by_path(leaves)
    for c in wanted.columns:
        have = there.get(c.path)
        if have is None:
            raise ContractError(MISSING, f"{c.name} is not in the file")
        if have.physical != c.physical:
            raise ContractError(TYPE, f"{c.name} is {have.physical} in the file, not {c.physical}")
        if have.repetition == "OPTIONAL" and c.repetition == "REQUIRED":
            raise ContractError(REPETITION, f"{c.name} is wanted without nulls, but optional in the file")
        if "REPEATED" in (have.repetition, c.repetition) and have.repetition != c.repetition:
            raise ContractError(REPETITION, f"{c.name} is {have.repetition} in the file, not {c.repetition}")
        if c.physical == "FIXED_LEN_BYTE_ARRAY" and have.type_length != c.type_length:
            raise ContractError(LENGTH, f"{c.name} has {have.type_length} bytes in the file, not {c.type_length}")
        if have.logical != c.logical and not plain_integer(c, have.logical):
            raise ContractError(LOGICAL, f"{c.name} is {have.logical or 'plain'} in the file, not {c.logical or 'plain'}")


def missing_rows(wanted: Contract, leaves: list[Column], rules: Evolution, projection: list[str] | None = None) -> list[str]:
    """Of a row reader: columns by dotted name; the names that must be filled with defaults.

    Columns outside the projection may be missing, but are checked where they are there.
    """
    there = {".".join(x.path): x for x in reversed(leaves)}
    missing = []
    for c in wanted.columns:
        have = there.get(".".join(c.path))
        if have is None:
            if projection is not None and c.name not in projection:
                continue
            if rules.missing != "default":
                raise ContractError(MISSING, f"{c.name} is not in the file")
            missing.append(c.name)
            continue
        if have.physical != c.physical:
            raise ContractError(TYPE, f"{c.name} is {have.physical} in the file, not {c.physical}")
        if have.logical != c.logical and not (rules.logical == "compatible" and plain_integer(c, have.logical)):
            raise ContractError(LOGICAL, f"{c.name} has another logical type in the file: {have.logical or 'none'}")
        widened = have.repetition == "REQUIRED" and c.repetition == "OPTIONAL" and rules.required_to_optional
        if have.repetition != c.repetition and not widened:
            raise ContractError(REPETITION, f"{c.name} is {have.repetition} in the file, not {c.repetition}")
    return missing
