import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import ngram_join
from lamella.llm.ngram_join import jaccard_components
from lamella.llm.queries import op1_ngram_join
from lamella.llm.shingles import word_hashes

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_force(texts, percent=80):
    """(id, set size, component) by comparing all that share a shingle."""
    sets = {}
    for k, t in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(LOWER))
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    component, having = {k: k for k in texts}, defaultdict(list)

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    for k, s in sorted(sets.items()):
        met = Counter(j for g in s for j in having[g])
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(j), find(k)
                component[max(a, b)] = min(a, b)
        for g in s:
            having[g].append(k)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert result(op1_ngram_join(spark, sf_dir)) == brute_force(texts)


def near_copies(seed, groups, most):
    r, texts = random.Random(seed), {}
    passage = [f"p{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 6, 12, 40, 120]))]
        for _ in range(r.randint(1, most)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts[r.randrange(10**9)] = r.choice([" ", "\n", " \t"]).join(passage * (g % 3 == 0) + words).upper() if g % 2 else " ".join(words)
    return texts


@pytest.mark.parametrize("block", [2048, 64])
def test_near_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "HUBS", 4)
    texts = near_copies(3, 60, 12) | {10**9 + i: t for i, t in enumerate(near_copies(4, 2, 300).values())}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(jaccard_components(df)) == brute_force(texts)


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "A b"), (9, "a  B"), (10, "a b c d e"), (11, "a b c d e" + " a b c d e" * 3000), (12, "A B C D E"), (None, "q r s"), (3, "é É a b c d"), (4, " x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as class", "2 as n_shingles")
    got = result(jaccard_components(df))
    assert got == brute_force({k: t for k, t in rows if k is not None}) | {None: (1, None)}
    twice = df.where("doc_id = 10").union(df.where("doc_id = 10"))
    assert [tuple(r) for r in jaccard_components(twice).collect()] == [(10, 1, 10)] * 2
    assert jaccard_components(df.limit(0)).count() == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    data = " ".join(f"word{i}" for i in range(5000)).encode() + b" " + b"y" * 5000
    whole = word_hashes(data)
    from lamella.llm import shingles

    monkeypatch.setattr(shingles, "_PIECE", 100)
    cut = word_hashes(data)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@pytest.mark.parametrize("hot", [2, 16, 10**6])
def test_shingles_of_every_document_in_any_batch(spark, monkeypatch, hot):
    """A passage that all texts share, equal texts in several tasks, and very small batches and blocks."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PACKED_GRAMS", 2000)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1 << 14)
    texts = {k: " ".join(f"common{i}" for i in range(30)) + " " + t for k, t in near_copies(11, 60, 12).items()}
    texts |= {10**10 + i: t for i, t in enumerate(list(texts.values())[::3])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert result(jaccard_components(df)) == brute_force(texts)


def test_sets_that_share_a_key_are_told_apart(spark, monkeypatch):
    """Keys of two bits coincide under the first seeds; the checks find that, and another seed is taken."""
    texts = near_copies(5, 40, 4)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    honest = ngram_join.set_table

    def short_keys(df, id_col, text_col, width, seed=0):
        found = honest(df, id_col, text_col, width, seed)
        return found.withColumn("class", F.col("class") % 4) if seed < 2 else found

    monkeypatch.setattr(ngram_join, "set_table", short_keys)
    assert ngram_join._classes(df, "doc_id", "text", 5)[2] == 2
    assert result(jaccard_components(df)) == brute_force(texts)
    monkeypatch.setattr(ngram_join, "SEEDS", 2)
    with pytest.raises(RuntimeError, match="share a key"):
        jaccard_components(df)


def shuffled_bytes(spark):
    """Bytes that all stages of the session have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_bytes_shuffled_for_a_shingle_when_buckets_are_many(spark, monkeypatch, tmp_path):
    """As in large inputs: nearly every shingle of a text is in a bucket of its own. No key goes with each of them."""
    monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", 1000)
    r = random.Random(1)
    texts = near_copies(7, 10, 4) | {10**10 + i: " ".join(f"w{r.randrange(10**5)}" for _ in range(104)) for i in range(2000)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    before = shuffled_bytes(spark)
    got = jaccard_components(df)
    after = shuffled_bytes(spark)
    assert sum(n for k, n in after.items() if k not in before) < 8 * 100 * 2000
    assert result(got) == brute_force(texts)


@pytest.mark.parametrize("percent", [100, 80, 55, 10])
def test_linked_sets_meet_in_what_they_send_ahead(percent):
    r = random.Random(percent)
    met = 0
    for _ in range(4000):
        common, of_a, of_b = r.randrange(1, 60), r.choice([0, 1, 2, 9, 40]), r.choice([0, 1, 2, 9, 40])
        grams = r.sample(range(10**6), common + of_a + of_b)
        if 100 * common >= percent * len(grams):
            a, b = sorted(grams[: common + of_a]), sorted(grams[:common] + grams[common + of_a :])
            (p, q), least = ngram_join.ahead(np.array([len(a), len(b)]), percent)
            shared = len(set(a[:p]) & set(b[:q]))
            assert shared >= max(least)
            met += 1
    assert met > 100


@pytest.mark.parametrize("size", [1, 2])
def test_bytes_cut_from_shingles_and_classes_lose_no_link(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "SHORT_BYTES", size)
    monkeypatch.setattr(ngram_join, "TAG_BYTES", size)
    monkeypatch.setattr(ngram_join, "PACKED_GRAMS", 2000)
    texts = near_copies(13, 60, 12)
    texts |= {10**10 + i: t for i, t in enumerate(list(texts.values())[::3])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert result(jaccard_components(df)) == brute_force(texts)


def test_filter_holds_every_class(spark):
    classes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 300_000)
    near = spark.createDataFrame([(int(x),) for x in classes[:100_000]], "class long")
    among = ngram_join.ClassFilter(near, 100_000)
    assert among.segments == 2
    assert among.holds(classes[:100_000]).all()
    passing = among.holds(classes[100_000:]).mean()
    assert passing < 0.01
    assert abs(passing - among.false_share()) < 0.002
