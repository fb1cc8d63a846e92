"""Quality rules of texts as one cascade of expressions.

Every rule is a column expression over the text. On a bounded sample each rule is timed and its share of rejected rows
is measured; the rules then run in the order of rejections per cost, and a row that one rejects skips the others
(CASE evaluates its branches in turn). The order changes only the work: a row is rejected if any rule rejects it.

Words are runs of other characters than space and \\x09-\\x0D. Null texts count as empty.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let
from granary.session import durable

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Low bits of a packed window that hold its position.
PLACE = (1 << 24) - 1


def words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), chars, ""))


def word_chars(text: Column) -> Column:
    return without(text, SPACE).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.coalesce(F.length(text), F.lit(0)) - without(text, SYMBOLS)).cast("long")


def n_capitals(text: Column) -> Column:
    return (F.coalesce(F.length(text), F.lit(0)) - without(text, CAPITALS)).cast("long")


def worded_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _covered(places: Column) -> Column:
    """Words under 3-word windows that start at the given ascending places."""
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(
        places, start,
        lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(3), x - s["at"])).alias("n")), lambda s: s["n"])


def _twins(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Elements of a sorted array that equal a neighbour."""
    return F.filter(ordered, lambda x, i: (
        F.coalesce(same(x, F.get(ordered, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False))))


def repeated_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included, of an array of words.

    Windows are sorted by a hash packed with their place. Places whose hashes agree are compared word by word; if two
    different windows meet under one hash, or a text has more words than a place can hold, the words themselves are
    sorted instead. Both ways are exact.
    """

    def window(ws: Column, i: Column) -> Column:
        return F.struct(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))

    def by_words(ws: Column) -> Column:
        keyed = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda x, i: F.struct(window(ws, i).alias("w"), i.alias("i")))
        return let(F.array_sort(keyed), lambda s: _covered(F.array_sort(F.transform(
            _twins(s, lambda a, b: a["w"] == b["w"]), lambda x: x["i"]))))

    def by_hash(ws: Column) -> Column:
        packed = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda x, i: (
            F.xxhash64(x, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))

        def from_twins(twins: Column) -> Column:
            def place(x: Column) -> Column:
                return x.bitwiseAND(F.lit(PLACE)).cast("int")

            clash = F.exists(F.sequence(F.lit(1), F.size(twins) - 1), lambda j: (
                (F.shiftright(F.get(twins, j), 24) == F.shiftright(F.get(twins, j - 1), 24))
                & (window(ws, place(F.get(twins, j))) != window(ws, place(F.get(twins, j - 1))))))
            return (F.when(F.size(twins) == 0, F.lit(0)).when(clash, by_words(ws))
                    .otherwise(_covered(F.array_sort(F.transform(twins, place)))))

        return let(F.array_sort(packed), lambda s: let(
            _twins(s, lambda a, b: F.shiftright(a, 24) == F.shiftright(b, 24)), from_twins))

    return let(found, lambda ws: (
        F.when(F.size(ws) < 4, F.lit(0)).when(F.size(ws) > PLACE, by_words(ws)).otherwise(by_hash(ws)))).cast("long")


def n_repeat_words(text: Column) -> Column:
    return repeated_words(words(text))


class Rule(NamedTuple):
    """rejects(text) is true for texts to reject, and never null."""

    name: str
    rejects: Callable[[Column], Column]


#: Fewer words than a text worth reading; more than half of all words in repeated windows.
BASE = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("repeats", lambda t: let(words(t), lambda ws: repeated_words(ws) * 100 > F.size(ws) * 50)),
)
#: More than 30 symbols for 100 words; more than 60 % of all lines copies of earlier ones; more than half of all characters capitals.
OWN = (
    Rule("symbols", lambda t: n_symbols(t) * 100 > n_words(t) * 30),
    Rule("lines", lambda t: n_dup_lines(t) * 100 > F.size(worded_lines(t)) * 60),
    Rule("capitals", lambda t: n_capitals(t) * 2 > word_chars(t)),
)


class Estimate(NamedTuple):
    rule: Rule
    seconds: float
    rejected: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text_column: str = "text", rows: int = 2000) -> list[Estimate]:
    """Each rule's cost and rejection share on a random sample of about rows rows, the best rejection per cost first.

    The sample is written once to the shared folder; the rules run on it one after the other. Without rows in the sample
    the rules keep their order. Only one number per rule reaches the driver.
    """
    total = docs.count()
    share = min(1.0, 1.2 * rows / total) if total else 1.0
    text = F.col("__text")
    sample = durable(docs.select(docs[text_column].alias("__text")).sample(share, seed=7), "rule-sample")

    def timed(flag: Column) -> tuple[float, float]:
        begin = time.perf_counter()
        rejected = sample.agg(F.avg(flag.cast("int"))).first()[0]
        return time.perf_counter() - begin, rejected or 0.0

    timed(F.length(text) < 0)
    base = timed(F.length(text) < 0)[0]
    found = [Estimate(r, max(1e-3, seconds - base), part) for r in rules for seconds, part in [timed(r.rejects(text))]]
    return sorted(found, key=lambda e: -e.rejected / e.seconds)


def verdict(text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the text; null if none does. Later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(text), F.lit(rule.name)).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE + OWN, text_column: str = "text") -> DataFrame:
    """Rows of docs, all columns, that no rule rejects, by a cascade in estimated order. No shuffle.

    Null and empty texts have no words and go by the first base rule. Repeated rows have the same verdict.
    """
    order = [e.rule for e in estimate(docs, rules, text_column)]
    return docs.filter(verdict(docs[text_column], order).isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = OWN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: the id, the base measures, base_failed, and kept: base not failed and no rule of the cascade rejects.

    Other columns are ignored. Null ids stay null; repeated rows stay repeated.
    """
    order = [e.rule for e in estimate(docs, rules, text_column)]
    text = docs[text_column]
    measured = docs.select(
        docs[id_column], text.alias("__text"),
        let(words(text), lambda ws: F.struct(
            F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("repeats"))).alias("__w"))
    t = F.col("__text")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        measured.select(
            id_column, "__text", F.col("__w.n").alias("n_words"), word_chars(t).alias("word_chars"),
            n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"),
            F.col("__w.repeats").alias("n_repeat_words"))
        .withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(t, order).isNull()))
        .drop("__text"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 60 * n_lines OR 2 * n_capitals > word_chars) AS kept
FROM b
"""
