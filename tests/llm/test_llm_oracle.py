import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import oracle, rows_of  # noqa: E402

from lamella.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf_dir)
    columns, want = oracle(ORACLE_SQL[name], sf_dir)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, df.collect()) == want


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
