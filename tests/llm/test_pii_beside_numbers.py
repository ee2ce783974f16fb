"""Cards, and other entities, beside numbers that are no part of them."""

import re

import pytest
from test_pii import luhn, one

CARD = "4845168114407329"


@pytest.mark.parametrize("form", ["4845168114407329", "4845 1681 1440 7329", "4845-1681-1440-7329"])
def test_card_beside_a_number(spark, form):
    shapes = ["{} 123", "{} 12/27", "42 {}", "42 {} 123", "12 345 {}", "{}-123", "2024-01-02 {}", "no {}", "{} {}", "{} 97.51.17.173", "{} 988-555-2485", "123-45-6789 {}"]
    texts = [s.replace("{}", form) for s in shapes]
    alone, *got = one(spark, form, *texts)
    assert luhn(re.sub(r"\D", "", alone)) and alone != form and re.sub(r"\d", "9", alone) == re.sub(r"\d", "9", form)
    for shape, text in zip(shapes, got, strict=True):
        assert form not in text
        assert text.count(alone) == shape.count("{}")
        if not re.search(r"97\.51|988-|123-45", shape):
            assert text == shape.replace("{}", alone)
        assert not re.search(r"97\.51\.17\.173|988-555-2485|123-45-6789", text)


def test_others_in_a_run_that_is_no_card(spark):
    texts = ["4845168114407328 97.51.17.173", "1234 988-555-2485", "12 34 123-45-6789"]
    got = one(spark, *texts)
    assert not luhn("12349885552485") and not luhn("1234123456789")
    assert not any(x in " ".join(got) for x in ("97.51.17.173", "988-555-2485", "123-45-6789"))
    assert got[0].startswith("4845168114407328 ") and got[1].startswith("1234 ") and got[2].startswith("12 34 ")


def test_other_groupings_and_numbers_stay_as_they_were(spark):
    clean = ["4845168114407328", "4845168114407328 123 4", "total 1 234 567 890 124", "1234567890124.50 0"]
    spread, *rest = one(spark, "4 8 4 5 1 6 8 1 1 4 4 0 7 3 2 9", *clean)
    assert spread != "4 8 4 5 1 6 8 1 1 4 4 0 7 3 2 9" and luhn(spread.replace(" ", ""))
    assert rest[:3] == clean[:3]
