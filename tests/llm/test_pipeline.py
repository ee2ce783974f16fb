import re

import corpus_pipeline
from lamella.llm.storage import materialize
from pyspark.sql import functions as F
from test_ngram_join import brute_force
from test_packing import check


def test_stages_on_a_small_corpus(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = spark.createDataFrame([(10**6, "123 !?", None, "x", 6), (10**6 + 1, "这是一段没有学过的语言的文字" * 10, None, "x", 140), (10**6 + 2, None, "en", "x", 0)], docs.schema)
    stage, kept = dict(corpus_pipeline.STAGES), docs.unionByName(foreign)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "pii", "mixing", "packing"]

    after = materialize(stage["language_id"](spark, kept, sf_dir), "t")
    ids = {r.doc_id for r in after.collect()}
    assert ids == {r.doc_id for r in docs.collect()}

    again = after.where("doc_id = 5").union(after)
    groups = brute_force({r.doc_id: r.text for r in after.collect()})
    single = materialize(stage["ngram_join"](spark, again, sf_dir), "t")
    assert sorted(r.doc_id for r in single.collect()) == sorted(k for k, (_, c) in groups.items() if k == c)

    private = materialize(stage["pii"](spark, single, sf_dir), "t")
    before = {r.doc_id: r.text for r in single.collect()}
    rows = private.collect()
    emails = {m for t in before.values() for m in re.findall(r"[\w.]+@[\w.]+\.com", t)}
    assert emails and not any(m in r.text for r in rows for m in emails)
    assert len(rows) == len(before) and all(r.n_chars == len(r.text) for r in rows)

    mixed = materialize(stage["mixing"](spark, private, sf_dir), "t")
    copies = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies) <= set(before) and mixed.count() != private.count()

    # packing takes repeated documents as they are; numbering tells them apart here
    numbered = mixed.coalesce(1).withColumn("doc_id", F.monotonically_increasing_id())
    numbered = materialize(numbered, "t")
    pieces = stage["packing"](spark, numbered, sf_dir).collect()
    assert check(pieces, {r.doc_id: r.text for r in numbered.collect()}, 1024) == 0
    for columns in (after, single, private, mixed):
        assert columns.columns == corpus_pipeline.COLUMNS


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
