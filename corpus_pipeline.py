"""The corpus pipeline: toxic documents go, one document of each group of near-duplicates stays,
repeated passages are cut, benchmark copies go, and the rest is sampled to a target mix.

Each stage takes (spark, docs, sf_dir) and returns documents; run() writes what a stage returns
and gives the next stage what was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, queries, shingle_dedup, substring_dedup, toxicity
from tessera.llm.storage import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, doesn't predict as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.fold_of() != 0)
    return toxicity.predict(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of texts linked by Jaccard similarity 0.8 or more of
    five-word shingles; repeated rows count as copies. A row without an id gets one below zero from
    its text for the comparison. Rows go by id and text, so different texts of one id both stay."""
    unnamed = F.lit(-1) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    keyed = docs.select(F.coalesce("doc_id", unnamed).alias("_key"), *COLUMNS).withColumn("_row", F.xxhash64("_key", "text"))
    linked = stash(shingle_dedup.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")), "near-duplicates")
    ids = keyed.select(F.col("_row").alias("doc_id"), "_key").distinct()
    first = linked.join(ids, "doc_id").groupBy("root").agg(F.min(F.struct("_key", "doc_id")).alias("first"))
    stay = stash(first.select(F.col("first.doc_id").alias("_row")).distinct(), "near-duplicates-kept")
    kept = keyed.join(stay, "_row", "left_semi")
    return kept.dropDuplicates(["_row"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat; documents that lose every word go."""
    cut = substring_dedup.remove_repeats(docs, ("lang", "source"))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with no benchmark item."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents at the target mix, with each one's topic, weight and probability. Null
    sources and languages, and texts without a topic, keep their part; rows of one doc_id are drawn alike."""
    own = queries.with_topics(docs.select(*COLUMNS), COLUMNS)
    own = own.withColumns({"_lang": F.col("lang"), "_source": F.col("source")})
    keep = ("text", "n_chars", "_lang", "_source")
    counted = stash(mixing.token_counts(own, keep), "token-counts")
    drawn = mixing.mix(counted, queries.mix_targets(counted), share=queries.MIX_SHARE, keep=keep).where("sampled")
    return drawn.select("doc_id", "text", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_chars", "topic", "n_tokens", "weight", "probability")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
