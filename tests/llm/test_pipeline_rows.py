"""One row of each group of near copies stays, whatever the ids."""

import corpus_pipeline


def words(first, n=60):
    return " ".join(f"{first}{i}" for i in range(n))


def test_one_row_of_each_group_whatever_the_ids(spark):
    near = lambda first: words(first) + " more"
    texts = [
        (1, words("a")), (5, near("a")), (5, words("b")),  # a near copy of a smaller id under an id that heads another group
        (7, words("c")), (7, near("c")),  # two near copies under one id
        (None, words("d")), (None, near("d")),  # near copies without ids
        (None, near("b")), (None, words("e")), (None, words("e")),  # a near copy of an id; equal rows
        (8, ""), (8, ""), (9, ""), (None, None), (8, None),  # without words: only equal rows are one
    ]
    docs = spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    got = [(r.doc_id, r.text) for r in stage(spark, docs, "").collect()]
    plain = {(k, (t or "").split(" ")[0]) for k, t in got if t}
    assert plain == {(1, "a0"), (5, "b0"), (7, "c0"), (None, "d0"), (None, "e0")}
    assert sum(bool(t) for _, t in got) == 5
    assert sorted((k or 0, t is None) for k, t in got if not t) == [(0, True), (8, False), (8, True), (9, False)]
