"""Mixing to target weights with soft membership.

A classifier learned from a table of labels gives each document the probabilities of its domains. Document
rates r >= 0 are then fitted so that the expected token totals of the domains, sum(r * tokens * p), match
their targets, in least squares and near to rates of 1. The fit is projected gradient descent, scaled by
the Gram matrix of the documents whose rates are positive. A rate follows from the probabilities of its
document and one number for each domain, so every step is one aggregation over all documents, and
nothing but a few numbers ever leaves it.

The classifier: words are hashed to features; a feature's weight for a domain is the log odds of its
presence, where the domain and the rest differ in it by more than EVIDENCE standard errors. A softmax regression, fitted on
the other half of the labelled sample, turns the sums of weights into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.memory import give_back, text_runs
from lamella.llm.shingles import words_of
from lamella.llm.storage import materialize, release_table

FEATURES = 1 << 15
EVIDENCE = 4.0
STEPS = 40
CLOSE = 1e-4


@dataclass
class Classifier:
    """Domains in order, a weight for each feature and domain, and the softmax over the sums."""

    domains: list[tuple]
    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    prior: np.ndarray

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        logits = sums @ self.scale + self.bias
        logits -= logits.max(1, keepdims=True)
        out = np.exp(logits)
        return out / out.sum(1, keepdims=True)


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and feature of each distinct feature of each text, and the number of words of each text."""
    words, at = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    both = np.unique(owner * FEATURES + (words % np.uint64(FEATURES)).astype(np.int64))
    return both // FEATURES, both % FEATURES, np.diff(at)


def _softmax_regression(x: np.ndarray, y: np.ndarray, k: int, steps: int = 400, shrink: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Scale and bias that minimise the cross entropy of labels y given rows x."""
    spread = np.maximum(x.std(0), 1e-6)
    z, truth = x / spread, np.eye(k)[y]
    scale, bias = np.zeros((k, k)), np.log(np.maximum(truth.mean(0), 1e-6))
    velocity = [np.zeros_like(scale), np.zeros_like(bias)]
    for _ in range(steps):
        logits = z @ scale + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        error = (p - truth) / len(z)
        for v, g, w in zip(velocity, (z.T @ error + shrink * scale, error.sum(0)), (scale, bias), strict=True):
            v *= 0.9
            v -= 0.3 * g
            w += v
    return scale / spread[:, None], bias


def learn(df: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", most: int = 20000) -> Classifier:
    """Learns from at most `most` labelled rows of df, chosen by a hash of the id. Labels with a null are
    skipped; rows that repeat an id count each, as do its labels. One half of the ids fits the weights, the
    other the softmax, whatever their number. Without any labelled document there is one domain, ().
    """
    known = labels.select(id_col, *label_cols).dropna()
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    n = known.count()
    sample = known.where(share < int((1 << 30) * min(1.0, 1.2 * most / max(n, 1)))).orderBy(share, id_col, *label_cols).limit(most)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.withColumnRenamed(id_col, "id")), "id")
    place, half = F.xxhash64("id", F.lit(2)).alias("place"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("half")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_runs(batch.column("text")):
                owner, found, _ = features_of(texts)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                packed = [found[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(b - a)]
                kept = [batch.column(c)[a:b].cast(pa.int64()) for c in (*label_cols, "place")]
                yield pa.RecordBatch.from_arrays([*kept, batch.column("half")[a:b].cast(pa.int32()), pa.array(packed, pa.binary())], names=[*label_cols, "place", "half", "features"])

    cols = ", ".join(f"`{c}` long" for c in (*label_cols, "place"))
    found = chosen.select(*label_cols, place, half, "text").mapInArrow(features, f"{cols}, half int, features binary")
    # rows that repeat an id multiply the sample, so the bound is set on what is collected
    table = materialize(found.orderBy("place", "features", *label_cols).limit(most), "labelled")
    rows = table.collect()  # at most `most` rows of distinct features
    release_table(table)
    domains = sorted({tuple(r[c] for c in label_cols) for r in rows})
    if not domains:
        return Classifier([()], np.zeros((FEATURES, 1)), np.zeros((1, 1)), np.zeros(1), np.ones(1))
    place = {d: i for i, d in enumerate(domains)}
    rows.sort(key=lambda r: (r["half"], *(r[c] for c in label_cols), r["features"]))
    k, y = len(domains), np.array([place[tuple(r[c] for c in label_cols)] for r in rows])
    lists = [np.frombuffer(r["features"], "<u4") for r in rows]
    half = np.array([r["half"] for r in rows])
    first = half == 0
    present = np.zeros((FEATURES, k))
    for i in np.flatnonzero(first):
        present[lists[i], y[i]] += 1
    sizes = np.bincount(y[first], minlength=k).astype(float)
    rest, others = present.sum(1, keepdims=True) - present, sizes.sum() - sizes
    weights = np.log((present + 0.5) / (sizes + 1)) - np.log((rest + 0.5) / (others + 1))
    share = (present + rest) / max(sizes.sum(), 1)
    differ = np.abs(present / np.maximum(sizes, 1) - rest / np.maximum(others, 1))
    weights[differ <= EVIDENCE * np.sqrt(share * (1 - share) * (1 / np.maximum(sizes, 1) + 1 / np.maximum(others, 1)))] = 0
    second = ~first
    sums = np.array([weights[f].sum(0) for f, s in zip(lists, second, strict=True) if s]).reshape(-1, k)
    prior = np.bincount(y, minlength=k) / len(y)
    scale, bias = _softmax_regression(sums, y[second], k) if second.any() else (np.zeros((k, k)), np.log(prior))
    return Classifier(domains, weights, scale, bias, prior)


def predict(df: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """df with tokens (words of the text) and posterior (probabilities of the domains in order). A text
    that is null, empty or without words has no tokens and the domains' shares among the labels.
    """
    known = df.drop("tokens", "posterior", "rate", "copies")
    index, shared = known.columns.index(text_col), df.sparkSession.sparkContext.broadcast(classifier)

    def posteriors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        k = len(learned.domains)
        for batch in batches:
            for a, b, texts in text_runs(batch.column(index)):
                owner, found, words = features_of(texts)
                weights = learned.weights[found]
                sums = np.stack([np.bincount(owner, weights[:, i], b - a) for i in range(k)], 1)
                p = np.where(words[:, None] > 0, learned.probabilities(sums), learned.prior)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * k, k, dtype=np.int32)), pa.array(p.ravel()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words), lists], names=[*part.schema.names, "tokens", "posterior"])
        give_back()

    schema = T.StructType(list(known.schema.fields)).add("tokens", "long").add("posterior", T.ArrayType(T.DoubleType()))
    return known.mapInArrow(posteriors, schema)


def _rate(pull: list[float]) -> Column:
    """A document's rate: 1, moved against the pull of the domains by its probabilities, projected to 0 or more."""
    move = F.lit(0.0)
    for i, x in enumerate(pull):
        move = move + F.get("posterior", F.lit(i)) * F.lit(x)
    return F.greatest(F.lit(0.0), F.lit(1.0) - move)


def fit_rates(predicted: DataFrame, targets: list[float], nearness: float = 1e-3) -> list[float]:
    """The pull of each domain under which the rates minimise |domain shares - targets|^2 plus nearness
    times the token-weighted mean of (rate - 1)^2, over all rates of 0 or more. No tokens, no pull.

    Each step moves the rates along the gradient, scaled by the Gram matrix of the documents that are not
    held at 0, and projects them; it is halved until the objective falls.
    """
    k = len(targets)
    goal = np.array(targets)
    table = materialize(predicted.select(F.col("tokens").cast("double").alias("t"), "posterior").where("tokens > 0"), "posteriors")
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    total = table.agg(F.sum("t")).first()[0]

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective of the pull (the dual one), its gradient, and the Gram matrix."""
        w, r = F.col("t") / total, F.col("r")
        sums = [F.sum(w * r * x) for x in p]
        gram = [F.sum(F.when(r > 0, w * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(i + 1)]
        row = [float(x) for x in table.withColumn("r", _rate(pull.tolist())).agg(F.sum(w * r * r), *sums, *gram).first()]
        matrix, lower = np.zeros((k, k)), iter(row[k + 1 :])
        for i in range(k):
            for j in range(i + 1):
                matrix[i, j] = matrix[j, i] = next(lower)
        return row[0] / 2 + goal @ pull + nearness / 2 * pull @ pull, goal + nearness * pull - np.array(row[1 : k + 1]), matrix

    pull = np.zeros(k)
    if total:
        value, gradient, gram = look(pull)
        for _ in range(STEPS):
            if np.abs(gradient).max() < CLOSE:
                break
            step = -np.linalg.solve(gram + nearness * np.eye(k), gradient)
            pace = 1.0
            while True:
                found = np.round(pull + pace * step, 12)
                seen = look(found)
                if seen[0] <= value + 1e-4 * pace * (gradient @ step):
                    break
                pace /= 2
                if pace < 1e-3:
                    raise RuntimeError(f"the rates do not converge: no descent from a gradient of {np.abs(gradient).max():.3g}")
            pull, (value, gradient, gram) = found, seen
        else:
            raise RuntimeError(f"the rates do not converge in {STEPS} steps: the gradient is {np.abs(gradient).max():.3g}")
    release_table(table)
    return pull.tolist()


def largest_shrink(predicted: DataFrame, shares: list[float]) -> float:
    """By how much the total must grow so that no domain with a positive share ends below its present tokens."""
    sums = [F.sum(F.col("tokens") * F.get("posterior", F.lit(i))) for i in range(len(shares))]
    row = predicted.agg(F.sum("tokens"), *sums).first()
    return max([1.0, *(have / row[0] / share for have, share in zip(row[1:], shares, strict=True) if share > 0)]) if row[0] else 1.0


def mix_sources(df: DataFrame, labels: DataFrame, targets: dict[tuple, float], label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 20000, seed: int = 1, token_col: str | None = None, grow: bool = False) -> DataFrame:
    """df with tokens, posterior, rate (how often the document should be seen) and copies: the rate rounded
    up or down by a hash of id and text, so that the mean of copies is the rate.

    targets give shares of the token total to domains, the tuples of label_cols; they are scaled to 1
    over the domains that the labels know, and a domain without a target keeps what is left in proportion
    to its present share if the given ones sum to less than 1, else gets nothing. The total is that of df;
    with grow it is so much larger that no domain with a positive share loses tokens, so that documents go
    only where their domain is unwanted. Tokens are words unless token_col names a column of df with their
    number (null: none). Null and empty texts
    have no tokens; they get the rate that their posterior implies. Repeated rows get equal copies. An
    empty table stays empty; without labels all rates are 1. Columns of df with the new names are
    replaced. Texts stay in their partitions.
    """
    classifier = learn(df, labels, label_cols, id_col, text_col, most_labelled)
    predicted = predict(df, classifier, text_col)
    if token_col:
        predicted = predicted.withColumn("tokens", F.coalesce(F.col(token_col).cast("long"), F.lit(0)))
    wanted = [targets.get(d) for d in classifier.domains]
    left = max(0.0, 1 - sum(w for w in wanted if w is not None))
    open_share = sum(p for w, p in zip(wanted, classifier.prior, strict=True) if w is None)
    shares = [left * p / open_share if w is None else w for w, p in zip(wanted, classifier.prior, strict=True)]
    pull = []
    if sum(shares) > 0 and len(shares) > 1:
        goal = [s / sum(shares) for s in shares]
        size = largest_shrink(predicted, goal) if grow else 1.0
        pull = fit_rates(predicted, [g * size for g in goal])
    chance = F.pmod(F.xxhash64(id_col, text_col, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    rated = predicted.withColumn("rate", _rate(pull))
    return rated.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
