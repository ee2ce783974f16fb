import itertools

import pytest
from pyspark.sql import types as T

from lamella.errors import ContractError, CorruptFileError
from lamella.plans.contract import ENCODING_TYPES, PHYSICAL, Column, column, contract, largest_precision
from lamella.plans.evolution import Evolution, check_strict, missing_rows


def code(make):
    with pytest.raises(ContractError) as failed:
        make()
    return failed.value.code


def test_defaults_by_value_type():
    kinds = {"byte": T.ShortType(), "ushort": T.IntegerType(), "uint": T.LongType(), "ulong": T.DecimalType(20, 0), "date": T.DateType(), "datetime": T.TimestampType(), "localdatetime": T.TimestampNTZType(), "string?": T.StringType(), "uuid": T.StringType(), "decimal": T.DecimalType(29, 0), "bytes": T.BinaryType(), "bool": T.BooleanType()}
    for kind, spark_type in kinds.items():
        assert column("x", kind).spark_type() == spark_type
    assert column("x", "string?").optional and not column("x", "string").optional


def test_every_encoding_and_type():
    for encoding, physical in itertools.product(ENCODING_TYPES, PHYSICAL):
        allowed = ENCODING_TYPES[encoding]
        make = lambda: Column("x", physical, encodings=(encoding,), type_length=4)  # noqa: B023, E731
        if allowed is None or physical in allowed:
            make()
        else:
            assert code(make) == "CONTRACT017"


@pytest.mark.parametrize(
    "physical, logical, options, failure",
    [
        ("INT64", "date", {}, "CONTRACT011"), ("INT32", "bson", {}, "CONTRACT011"), ("FIXED_LEN_BYTE_ARRAY", "float16", {"type_length": 4}, "CONTRACT011"),
        ("FIXED_LEN_BYTE_ARRAY", "interval", {"type_length": 8}, "CONTRACT011"), ("FIXED_LEN_BYTE_ARRAY", "uuid", {"type_length": 15}, "CONTRACT011"), ("BYTE_ARRAY", "variant", {}, "CONTRACT011"),
        ("INT32", "unknown", {}, "CONTRACT007"), ("INT64", "timestamp(weeks,utc)", {}, "CONTRACT013"), ("INT32", "timestamp(micros,utc)", {}, "CONTRACT011"), ("INT64", "time(millis,utc)", {}, "CONTRACT011"),
        ("INT32", "int(64,signed)", {}, "CONTRACT011"), ("INT32", "int(7,signed)", {}, "CONTRACT011"), ("INT32", "decimal(10,2)", {}, "CONTRACT015"), ("INT64", "decimal(19,2)", {}, "CONTRACT015"),
        ("FLOAT", "decimal(5,2)", {}, "CONTRACT015"), ("INT32", "decimal(5,6)", {}, "CONTRACT014"), ("INT32", "decimal(0,0)", {}, "CONTRACT014"), ("FIXED_LEN_BYTE_ARRAY", "decimal(10,0)", {"type_length": 4}, "CONTRACT015"),
        ("BLOB", None, {}, "CONTRACT006"), ("FIXED_LEN_BYTE_ARRAY", None, {}, "CONTRACT006"), ("INT32", None, {"repetition": "SOMETIMES"}, "CONTRACT007"), ("BOOLEAN", None, {"bloom": True}, "CONTRACT004"),
        ("INT32", None, {"bloom_fpp": 1.0}, "CONTRACT004"), ("INT32", None, {"bloom_max_bytes": 48}, "CONTRACT004"), ("INT32", None, {"bloom_ndv": 0}, "CONTRACT004"),
    ],
)
def test_refused_declarations(physical, logical, options, failure):
    assert code(lambda: Column("x", physical, logical, **options)) == failure


def test_other_refusals():
    assert code(lambda: column("x", "texture")) == "CONTRACT002"
    assert code(lambda: column("x", "string", allow_allocating=False)) == "CONTRACT016"
    assert code(lambda: column("d", "date", logical=None)) == "CONTRACT008"
    assert code(lambda: column("t", "time", logical=None)) == "CONTRACT009"
    assert code(lambda: column("t", "datetime", logical=None)) == "CONTRACT010"
    assert code(lambda: column("i", "int", logical="date")) == "CONTRACT012"
    assert code(lambda: contract(column("x", "int"), column("x", "long"))) == "CONTRACT005"
    assert code(lambda: contract(column("x", "int")).only("y")) == "CONTRACT002"


def test_precision_that_fits():
    for length in range(1, 17):
        digits = largest_precision(length)
        assert 10**digits - 1 <= 2 ** (8 * length - 1) - 1 < 10 ** (digits + 1) - 1


def leaf(name="x", physical="INT32", logical=None, repetition="REQUIRED", length=None, path=()):
    return Column(name, physical, logical, repetition, length, path=path)


STRICT = [
    (leaf(), leaf(), None), (leaf(), leaf("y"), "EVOLVE001"), (leaf(), leaf(physical="INT64"), "EVOLVE002"), (leaf(), leaf(repetition="OPTIONAL"), "EVOLVE003"),
    (leaf(repetition="OPTIONAL"), leaf(), None), (leaf(repetition="REPEATED"), leaf(), "EVOLVE003"), (leaf(), leaf(repetition="REPEATED"), "EVOLVE003"),
    (leaf(physical="FIXED_LEN_BYTE_ARRAY", length=4), leaf(physical="FIXED_LEN_BYTE_ARRAY", length=8), "EVOLVE004"),
    (leaf(), leaf(logical="int(32,signed)"), None), (leaf(physical="INT64"), leaf(physical="INT64", logical="int(64,signed)"), None),
    (leaf(), leaf(logical="int(32,unsigned)"), "EVOLVE005"), (leaf(logical="int(32,signed)"), leaf(), "EVOLVE005"), (leaf(), leaf(logical="date"), "EVOLVE005"),
]


@pytest.mark.parametrize("wanted, have, failure", STRICT)
def test_strict_rules(wanted, have, failure):
    if failure:
        assert code(lambda: check_strict(contract(wanted), [have])) == failure
    else:
        check_strict(contract(wanted), [have])


def test_strict_compares_path_segments():
    dotted, nested = leaf("a.b", path=("a.b",)), leaf("a.b", path=("a", "b"))
    check_strict(contract(dotted), [dotted])
    assert code(lambda: check_strict(contract(dotted), [nested])) == "EVOLVE001"
    assert missing_rows(contract(dotted), [nested], Evolution()) == []
    with pytest.raises(CorruptFileError):
        check_strict(contract(leaf()), [leaf(), leaf()])


EVERY = [Evolution(missing=m, logical=g, required_to_optional=w) for m in ("reject", "default") for g in ("reject", "compatible") for w in (False, True)]


@pytest.mark.parametrize("rules", EVERY)
def test_row_rules(rules):
    def outcome(wanted, have):
        try:
            return missing_rows(contract(wanted), have, rules)
        except ContractError as e:
            return e.code

    assert outcome(leaf(), [leaf("y")]) == (["x"] if rules.missing == "default" else "EVOLVE001")
    assert outcome(leaf(repetition="OPTIONAL"), [leaf()]) == ([] if rules.required_to_optional else "EVOLVE003")
    assert outcome(leaf(), [leaf(logical="int(32,signed)")]) == ([] if rules.logical == "compatible" else "EVOLVE005")
    # whatever the rules
    assert outcome(leaf(), [leaf(repetition="OPTIONAL")]) == "EVOLVE003"
    assert outcome(leaf(), [leaf(physical="INT64")]) == "EVOLVE002"
    assert outcome(leaf(logical="int(32,signed)"), [leaf()]) == "EVOLVE005"
    assert outcome(leaf(), [leaf(logical="int(32,unsigned)")]) == "EVOLVE005"


def test_projection_excuses_missing_columns_only():
    both = contract(leaf(), leaf("y"))
    assert missing_rows(both, [leaf()], Evolution(), ["x"]) == []
    assert code(lambda: missing_rows(both, [leaf(), leaf("y", physical="INT64")], Evolution(), ["x"])) == "EVOLVE002"
    assert code(lambda: Evolution(missing="guess")) == "EVOLVE000"
