"""What each of five filters removes under every order of applying them.

A document's failures are a row of a mask matrix (zero where it fails a filter, infinity elsewhere), an order is a column of
the positions of the filters in it (the inverse permutation). Their min-plus product is the step at which the order removes
the document. Removals, redundancies and losses are scatter counts over these steps, weighted by how many documents share a
mask, so the matrices are as small as the number of different masks, and documents are only counted.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_texts, utf8
from granary.session import durable

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
#: POSITION[f, p]: the step at which order p applies filter f.
POSITION = np.argsort(np.array(ORDERS), axis=1).T + 1
NEVER = len(FILTERS) + 1
CAPITALS = bytes(range(65, 91))
SYMBOLS = frozenset(b"#$%&*|")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: str | None) -> int:
    """Bits 1, 2, 4, 8 for the failures A to D of a text; null is an empty text."""
    raw = utf8(text)
    words = raw.split()
    distinct = len(set(words))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < 100) | (100 * distinct < 80 * len(words)) << 1 | (100 * capitals > 10 * len(text or "")) << 2
            | any(s in raw for s in SYMBOLS) << 3)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) per document: failures A to D, and a digest that equal texts share."""

    def rows(ids, langs, texts):
        for i, lang, text in zip(ids, langs, texts):
            yield i, lang or "", failures(text), hashlib.blake2b(utf8(text), digest_size=20).digest()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return map_texts(source, ["doc_id", "lang", "text"], "doc_id long, part string, mask int, digest binary", rows)


def steps(mask: np.ndarray) -> np.ndarray:
    """Min-plus product: the step at which each order removes each mask, NEVER where it keeps it."""
    fails = mask[:, None] >> np.arange(len(FILTERS)) & 1
    at = np.full((len(mask), len(ORDERS)), NEVER)
    for f in range(len(FILTERS)):
        at = np.minimum(at, np.where(fails[:, f, None] == 1, POSITION[f], NEVER))
    return at


def audit_counts(mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS as arrays [order, step] from masks with the number of documents, good and toxic ones that have them."""
    at = steps(mask)
    order = np.broadcast_to(np.arange(len(ORDERS)), at.shape)

    def scatter(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ORDERS), NEVER + 1), np.int64)
        np.add.at(out, (order, at), weight[:, None])
        return out[:, 1:NEVER]

    removed = scatter(n)
    fails = mask[:, None] >> np.arange(len(FILTERS)) & 1
    own = np.array(ORDERS)
    failing = (n[:, None] * fails).sum(axis=0)
    alone = (n[:, None] * fails * (fails.sum(axis=1) == 1)[:, None]).sum(axis=0)
    share = np.zeros(len(FILTERS), np.int64)
    np.add.at(share, own, removed)
    return {
        "kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": failing[own] - removed,
        "unique_fails": alone[own], "good_lost": scatter(good), "toxic_lost": scatter(toxic), "shapley": share[own]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (value of lang, null as empty string), order of the five filters and step: filter_order, step and COUNTS.

    A row fails E if its text equals that of a smaller doc_id anywhere in the table; repeated rows of one doc_id are counted
    each and do not make each other fail; rows without doc_id never fail E and are never the smaller one. Null and empty texts
    are equal. A document is good (toxic) if any of its labels says so; labels without doc_id, or of other documents, count
    nowhere. No documents, no rows. Columns other than doc_id, lang, text, quality and toxic are ignored.

    Copies meet as digests, with the smallest id taken before the shuffle, so a text that a third of all rows share costs no
    task more than another.
    """
    slim = durable(masks(docs), "masks")
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rated = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    fails_e = F.col("first").isNull() & F.col("doc_id").isNotNull()
    counted = (
        slim.join(firsts, ["digest", "doc_id"], "left").join(rated, "doc_id", "left")
        .groupBy("part", (F.col("mask") + F.when(fails_e, 16).otherwise(0)).alias("mask"))
        .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))
    counts = ", ".join(f"{c} long" for c in COUNTS)

    def per_part(rows: pd.DataFrame) -> pd.DataFrame:
        made = audit_counts(*[rows[c].to_numpy(np.int64) for c in ("mask", "n", "good", "toxic")])
        return pd.DataFrame({
            "part": rows["part"].iloc[0],
            "filter_order": np.repeat(["".join(FILTERS[f] for f in o) for o in ORDERS], len(FILTERS)),
            "step": np.tile(np.arange(1, NEVER, dtype=np.int32), len(ORDERS)), **{c: made[c].ravel() for c in COUNTS}})

    return counted.groupBy("part").applyInPandas(per_part, f"part string, filter_order string, step int, {counts}")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END)
             || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
             || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
             || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
             || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails
      FROM w JOIN s USING (t) LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
x AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, fails = own AS sole,
             length(translate(fails, before, '')) < length(fails) AS gone FROM g, x),
z AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
             coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
      FROM y GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM z
"""
