import random

import pytest

from lamella.llm import components
from lamella.llm.components import Forest, connected_components


@pytest.mark.parametrize("batch", [1 << 16, 3])
def test_against_union_find(spark, monkeypatch, batch):
    monkeypatch.setattr(components, "BATCH", batch)
    r = random.Random(6)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000), (7, 6), (-9, 5), (-9, 5)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long").repartition(5)
    assert {x.node: x.label for x in connected_components(df).collect()} == {n: forest.find(n) for pair in links for n in pair}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
