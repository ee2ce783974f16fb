"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.language_id import UNDETERMINED, identify, sample_labelled
from lamella.llm.mixing import mix_sources
from lamella.llm.ngram_join import jaccard_components
from lamella.llm.packing import pack
from lamella.llm.pii import replace_pii
from lamella.llm.queries import MIX_TARGETS, PII_KEY, table, tokenizer
from lamella.llm.storage import materialize, release_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is in no learned language if its parse costs more than MOST_BITS for each symbol (letters and the
#: boundaries between words), and SLACK_BITS more in all: about eight phrases, which any short text may need.
#: Of documents in learned languages none of over 40 symbols cost 6.5 bits; letters that no sample holds cost 15.
MOST_BITS, SLACK_BITS = 8.0, 120.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents without letters or in no learned language go."""
    known = identify(docs.select(*COLUMNS), sample_labelled(docs))
    foreign = F.col("bits") * F.col("symbols") > MOST_BITS * F.col("symbols") + SLACK_BITS
    kept = known.where((F.col("lang_pred") != UNDETERMINED) & ~F.coalesce(foreign, F.lit(False)))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest id; a row without an id only if no other has one.

    Groups are of rows, whatever their ids: rows that repeat an id or have none are grouped by their texts
    like all others. Equal rows are one. Texts without words are near copies of nothing. Rows are told apart
    by a 64-bit hash: if two share one, both stay where one of them does.
    """
    columns = [F.col(c) for c in COLUMNS]
    rows = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*columns, *(c.isNull() for c in columns)))
    groups = jaccard_components(rows, id_col="row_key", width=5, percent=80).select("row_key", "component_id").distinct()
    named = rows.select("row_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    stay = materialize(groups.join(named, "row_key").groupBy("component_id").agg(first).select("first.row_key").distinct(), "stay")
    # the join leaves equal keys together, so equal rows are found without another exchange
    return rows.join(stay, "row_key", "left_semi").dropDuplicates(["row_key", *COLUMNS]).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    return replace_pii(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as its rate says. The total grows until no wanted domain loses tokens:
    shares are met by repeating documents, and only those of unwanted domains go.
    """
    mixed = mix_sources(docs, table(spark, sf_dir, "labels"), MIX_TARGETS, grow=True)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), size=1024, end_id=0, keep_ids=False)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: Classifiers, tokens and keyed surrogates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release_table(before)  # the stage that read it is written
        before = docs
    return docs
