"""One query per corpus operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    byte_bpe, chat, decontaminate, fill_middle, filter_audit, licenses, near_dups, ordinal, piece_counts, quality_rules, simhash,
    token_files, urls)
from granary.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Where the vocabulary files are; every executor reads them from the same place.
TOKENIZERS = os.path.dirname(public_tokenizers.__file__)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_files(spark, folder):
    """Token files of all documents, read back: where each document's ids start, how many there are, their crc."""
    place = scratch_path(spark, "tokens")
    shards = token_files.write_token_files(
        table(spark, folder, "documents"), place, f"{TOKENIZERS}/word_bpe_49k.json", end_id=1, by_space=True)
    read = token_files.read_token_files(spark, place, shards)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_byte_bpe(spark, folder):
    """Ids of all documents and the bytes they decode to, as digests."""
    ranks, pattern = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN
    encoded = byte_bpe.encode_texts(table(spark, folder, "documents"), ranks, pattern, decode=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_piece_counts(spark, folder):
    """Number of pieces of the best unigram path of every document, and its score."""
    return piece_counts.count_pieces(table(spark, folder, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query
def op4_quality_rules(spark, folder):
    """Base measures of all documents, whether they fail the base rules, and whether the cascade keeps them."""
    return quality_rules.judge(table(spark, folder, "documents"))


@query
def op8_chat(spark, folder):
    """All conversations and one made of control strings, formatted and read back from the formatted strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(
        [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], rows.schema)
    made = chat.format_chats(rows.unionByName(tricky))
    read = made.select("conv_id", chat.read_chat(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query
def op5_decontaminate(spark, folder):
    """Words of all documents inside benchmark windows, and the items these belong to."""
    found = decontaminate.contaminated(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), decontaminate.n_hit(F.col("__spans")).alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"))


@query
def op6_near_dups(spark, folder):
    """Classes of documents linked by 80 % of their two-word shingles."""
    return near_dups.near_duplicates(table(spark, folder, "documents"), k=2)


@query
def op7_licenses(spark, folder):
    """Licence phrases and templates found in all documents."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op9_ordinal(spark, folder):
    """Expected grade of all documents, the probability that they are good, and whether that is enough."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, ordinal.ratings(table(spark, folder, "labels")))
    return ordinal.rate(docs, model, keep=["doc_id"]).select(
        "doc_id", F.col("__grade").alias("grade"), F.col("__tail").alias("p_good"), ordinal.keeps(F.col("__tail")).alias("kept"))


@query
def op10_urls(spark, folder):
    """Rule and verdict of every page's url."""
    weights = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, folder, "pages"), weights)


@query
def op11_simhash(spark, folder):
    """Classes of documents linked by fingerprints at most four bits apart."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op12_filter_audit(spark, folder):
    """What five filters remove from all documents in each of their orders."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_fill_middle(spark, folder):
    """All documents cut for filling in the middle, and restored from what that gave."""
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL |= {"op12_filter_audit": filter_audit.SQL, "op13_fill_middle": fill_middle.SQL}
SQL |= {"op5_decontaminate": decontaminate.SQL, "op7_licenses": licenses.sql(), "op4_quality_rules": quality_rules.SQL, "op8_chat": chat.SQL}
