import numpy as np
import pytest

from lamella.llm import mixing
from lamella.llm.mixing import learn, mix_sources, predict
from lamella.llm.queries import MIX_TARGETS, op10_mixing
from pyspark.sql import functions as F


def make(spark, n=600):
    random = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        domain = (int(random.random() < 0.5), int(random.random() < 0.2))
        words = [f"w{random.integers(300)}" for _ in range(40)] + [f"good{random.integers(5)}" if domain[0] else f"poor{random.integers(5)}"] * 3 + (["vile"] if domain[1] else [])
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, *domain))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_rates(tokens, p, targets, nearness=1e-3, steps=200000):
    """Plain projected gradient with short steps."""
    w = tokens / tokens.sum()
    r, last, pace = np.ones(len(w)), np.ones(len(w)), 0
    for i in range(steps):
        y = r + pace * (r - last)
        step = p @ (w * y @ p - targets) + nearness * (y - 1)
        last, r = r, np.maximum(0, y - 0.9 * step)
        pace = i / (i + 3)
        if np.abs(r - last).max() < 1e-10:
            break
    return r


def test_rates_against_plain_projected_gradient(spark):
    docs, labels = make(spark)
    targets = {(1, 0): 0.6, (0, 0): 0.2, (1, 1): 0.0, (0, 1): 0.2}
    rows = mix_sources(docs, labels, targets).collect()
    p, tokens, rates = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows], float), np.array([r.rate for r in rows])
    wanted = np.array([targets[d] for d in learn(docs, labels).domains])
    best = brute_rates(tokens, p, wanted)
    cost = lambda r: ((r * tokens @ p / tokens.sum() - wanted) ** 2).sum() + 1e-3 * (tokens / tokens.sum() * (r - 1) ** 2).sum()
    assert (rates >= 0).all() and cost(rates) <= cost(best) * 1.01 + 1e-7
    assert np.abs(rates * tokens @ p / tokens.sum() - wanted).max() < 0.05


def test_classifier_on_held_out_labels(spark):  # the sample must be large enough for evidence
    docs, labels = make(spark, 2400)
    known = labels.where(F.col("doc_id") % 4 == 1)
    classifier = learn(docs, known)
    rows = predict(docs, classifier).join(labels.where(F.col("doc_id") % 4 == 3), "doc_id").collect()
    assert np.mean([classifier.domains[int(np.argmax(r.posterior))] == (r.quality, r.toxic) for r in rows]) > 0.9
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)


def test_query_meets_its_targets(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op10_mixing(spark, sf_dir).collect()
    assert len(rows) == 1000 and all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    p, tokens, rates = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows], float), np.array([r.rate for r in rows])
    shares = rates * tokens @ p / tokens.sum()
    domains = sorted({(r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()})
    wanted = np.array([MIX_TARGETS[d] for d in domains])
    assert np.abs(shares - wanted).max() < np.abs(tokens @ p / tokens.sum() - wanted).max() / 2


def test_what_is_learned_from_is_bounded(spark, monkeypatch):
    """Rows that repeat an id multiply neither the sample nor what the driver holds."""
    docs, labels = make(spark, 40)
    seen = []
    plain = mixing.materialize

    def counted(df, name):
        table = plain(df, name)
        seen.append(table.count())
        return table

    monkeypatch.setattr(mixing, "materialize", counted)
    learn(docs.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"), labels, most=10)
    assert seen == [10]


def test_tokens_may_be_given_and_the_total_may_grow(spark):
    docs, labels = make(spark, 2400)
    given = docs.withColumn("n", F.when(F.col("doc_id") % 2 == 0, 7))
    assert {r.tokens for r in mix_sources(given, labels, MIX_TARGETS, token_col="n").collect()} == {0, 7}
    before, after = (mix_sources(docs, labels, {(1, 0): 0.9, (0, 0): 0.1, (1, 1): 0.0, (0, 1): 0.0}, grow=g).where("text not like '%vile%'").collect() for g in (False, True))
    assert sum(r.copies == 0 for r in before) > 400 > 40 > sum(r.copies == 0 for r in after)


def test_a_fit_that_does_not_converge_is_an_error(spark, monkeypatch):
    docs, labels = make(spark, 200)
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="converge"):
        mix_sources(docs, labels, {(1, 0): 1.0})


def test_edge_rows(spark):
    docs, labels = make(spark, 100)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (None, "good1 good2"), (1002, "vile " * 20000), (1003, "x"), (1003, "x")], "doc_id long, text string")
    marked = labels.union(spark.createDataFrame([(5, None, 1), (None, 1, 0)], labels.schema))
    both = docs.union(extra).withColumn("rate", F.lit("old"))
    rows = mix_sources(both, marked, {(1, 0): 1.0}).collect()
    assert len(rows) == 106 and sum(r.tokens == 0 for r in rows) == 2
    assert len({(r.rate, r.copies) for r in rows if r.doc_id == 1003}) == 1
    assert mix_sources(both.limit(0), marked, {(1, 0): 1.0}).count() == 0
    unlabelled = mix_sources(both, labels.limit(0), {(1, 0): 1.0}).collect()
    assert {(r.rate, r.copies) for r in unlabelled} == {(1.0, 1)}
