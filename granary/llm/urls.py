"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The classifier is trained by DataFrame aggregations from a small labelled table of URLs. Its weights are one array of
fixed size: the driver holds those numbers and nothing else, and scoring reads them as a literal.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import url_table
from granary.llm.common import let
from granary.session import durable


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Buckets of the hashed n-grams, lengths of the n-grams, steps and rate of the training, weight decay.
BUCKETS, GRAMS, STEPS, RATE, DECAY = 1 << 14, (3, 4, 5), 25, 1.0, 1e-6
#: A url without a rule is blocked from this probability on.
BLOCK = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first "://" up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #.
    Null or without "://": both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. A rule fits its host and all its subdomains."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of the whole host and of the path, runs of digits in it as 0."""

    def grams(text: Column, mark: str) -> Column:
        # the characters are cut once, so the work grows with the length of a url and not with its square
        def of(chars: Column) -> Column:
            def from_each(n: int) -> Column:
                starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
                return F.transform(starts, lambda i: F.pmod(
                    F.xxhash64(F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(BUCKETS)).cast("int"))

            return F.flatten(F.array(*map(from_each, GRAMS)))

        return let(F.split(F.concat(F.lit(mark), text, F.lit("$")), ""), of)

    return F.array_distinct(F.concat(grams(host, "^"), grams(F.regexp_replace(path, "[0-9]+", "0"), "/")))


def labelled_urls(spark: SparkSession, taken: Callable[[str], bool] = lambda name: True) -> DataFrame:
    """The small labelled table (url, bad) of the names that are taken."""
    return spark.createDataFrame(url_table.labelled(taken), "url string, bad int")


def margin(found: Column, weights: list[float]) -> Column:
    """Sum of the weights of the buckets found, and the intercept, which is the last weight; scaled by the number found."""
    # one string literal, which the optimizer folds to an array once, instead of thousands of literals
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(table, i))
    return total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")) + weights[-1]


def train(labelled: DataFrame, steps: int = STEPS) -> list[float]:
    """Weights by gradient descent over the whole labelled table (url, bad 0 or 1), each step one aggregation by bucket.

    Every weight has its own rate, which falls with the gradients it has met, so rare n-grams learn as fast as common ones.
    labelled has to be small: its n-grams are written once and read once per step. Null labels are left out; null urls are texts without n-grams.
    """
    host, path = split_url(F.col("url"))
    known = labelled.filter(F.col("bad").isNotNull())
    rows = durable(known.select(F.col("bad").cast("double").alias("bad"), features(host, path).alias("found")), "url-features")
    total = rows.count()
    weights = [0.0] * (BUCKETS + 1)
    met = list(weights)
    for _ in range(steps if total else 0):
        miss = rows.select(
            "found", ((1 / (1 + F.exp(-margin(F.col("found"), weights)))) - F.col("bad")).alias("miss"))
        scaled = miss.select(F.col("miss"), F.explode(F.concat(F.col("found"), F.array(F.lit(BUCKETS)))).alias("bucket"), (
            F.col("miss") / F.sqrt(F.greatest(F.size("found"), F.lit(1)).cast("double"))).alias("part"))
        value = F.when(F.col("bucket") == BUCKETS, F.col("miss")).otherwise(F.col("part"))
        gradient = scaled.groupBy("bucket").agg(F.round(F.sum(value), 9).alias("g")).collect()
        sums = {row.bucket: row.g * (0.2 if row.bucket == BUCKETS else 1.0) / total for row in gradient}
        slopes = [sums.get(k, 0.0) + DECAY * w for k, w in enumerate(weights)]
        met = [m + g * g for m, g in zip(met, slopes)]
        weights = [w - RATE * g / math.sqrt(m + 1e-12) for w, g, m in zip(weights, slopes, met)]
    return weights


def judge(
    pages: DataFrame, weights: list[float], rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url",
) -> DataFrame:
    """Per row of pages: the id, host, path, rule (null if none fits), verdict (the rule's, else the classifier's), and
    bad, the classifier's probability, computed only where no rule fits. No shuffle.

    Null and malformed urls have empty hosts and paths, fit no rule and are allowed. Repeated rows stay repeated; other
    columns are ignored.
    """
    host, path = split_url(pages[url_column])
    parts = pages.select(pages[id_column], host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("__verdict"))
    score = 1 / (1 + F.exp(-margin(features(F.col("host"), F.col("path")), weights)))
    scored = ruled.withColumn("bad", F.when(F.col("rule").isNull() & (F.col("host") != ""), F.round(score, 6)))
    judged = F.coalesce("__verdict", F.when(F.col("bad") >= BLOCK, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(id_column, "host", "path", "rule", judged.alias("verdict"), "bad")
