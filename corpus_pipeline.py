"""From raw documents to token ids: five stages, each over all rows that the one before kept."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_bpe, decontaminate, near_dups, ordinal, quality_rules
from granary.session import durable

#: Ids up to this many are broadcast to take rows out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """The stage with columns other than doc_id and text under numbered names, so that no name of theirs can disturb it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        numbered = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, numbered, sf_dir).toDF(*docs.columns)

    return run


@any_columns
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects."""
    return quality_rules.keep_good(docs)


@any_columns
def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are good with enough probability; all rows if nothing is rated."""
    model = ordinal.fit(docs, ordinal.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rated = ordinal.rate(docs, model)
    return rated.filter(ordinal.keeps(F.col("__tail"))).select(*docs.columns)


@any_columns
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Of rows with one doc_id the first one stays, in the order of all columns as JSON. Rows without doc_id are documents like
    others: they come after all that have one, in an order that their text decides, and count as one if their texts are equal.
    Rows without words are not compared; of several with one doc_id, or with none and one text, one stays.
    """
    known = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    # ids for rows without one: above all others if there is room for 2 ** 62 there, else below
    low = -(1 << 63) if known[1] is not None and known[1] >= 1 << 62 else 1 << 62
    if low < 0 and known[0] < -(1 << 62):
        raise ValueError("no room for ids of rows without one")
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    named = docs.withColumn("node", F.coalesce("doc_id", text_hash + F.lit(low)))
    found = durable(near_dups.near_duplicates(named, k=5, threshold=0.8, id_column="node"), "near-dups")
    gone = durable(found.filter(~F.col("kept")).select(F.col("doc_id").alias("node")).distinct(), "gone")
    kept = named.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "node", "left_anti").select(*named.columns)
    twice = found.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("node"))
    twice = durable(twice, "twice")
    if not twice.limit(1).count():
        return kept.drop("node")
    row = F.struct(*docs.columns)
    one = (kept.join(twice, "node", "left_semi").groupBy("node").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*"))
    return kept.join(twice, "node", "left_anti").select(*docs.columns).union(one)


@any_columns
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark window."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), named=False)
    return found.filter(F.size("__spans") == 0).select(*docs.columns)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, the number of its token ids, and digests of the ids and of the bytes they decode to."""
    ranks = os.path.join(os.path.dirname(public_tokenizers.__file__), "byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, decode=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", classifier_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", byte_bpe_stage),
]
#: The classifier cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
