"""Benchmark decontamination by a prefix-filtered join on word shingles.

An item's windows are all its runs of WINDOW words, or the whole item if it is shorter. A document contains a window if
the words stand in it one after the other, so it must contain every shingle of the window, and looking for one is enough:
the rarest one, by the number of documents that hold it, counted over the whole corpus. Where a document has that
shingle, the window's place follows from the shingle's offset; it must lie within the document, and then all its words
are compared.

The words of the windows go to the tasks in blocks, one after the other, each block over all documents. A document row
carries its hits from block to block. Item ids stay in a table: windows of the same items form a class, a hit names only
the class, and the items of the classes that were hit come by joins afterwards, once for each set of classes.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import alnum_words, map_texts, with_columns
from granary.session import durable

WINDOW = 10
SHINGLE = 3
#: Windows in a block; a block is what the driver and each task hold at once.
BLOCK = 50_000
#: Blocks that a document row passes before the rows are written.
CHAIN = 4

Shingle = tuple[bytes, ...]


class Probe(NamedTuple):
    """A window behind its rarest shingle: where the shingle stands in it, its words, and its class, empty if it has no items."""

    offset: int
    words: tuple[bytes, ...]
    kind: str


def windows(benchmark: DataFrame, size: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct (window, item) of the items, window as its words with spaces between, item as a string.

    Null and wordless texts have none. Windows of items without id are windows like others, but no item is named for them.
    """

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            words = alnum_words(text)
            for at in range(max(1, len(words) - size + 1) if words else 0):
                yield b" ".join(words[at : at + size]), i

    source = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    return map_texts(source, ["item", "text"], "window binary, item string", rows).distinct()


def classes(pairs: DataFrame) -> DataFrame:
    """Distinct windows of pairs (window, item), each with its class: one string for windows of the same items, empty for none.

    A class is the number of items and 128 bits of their hashes, so that no row or task holds the items of a window.
    """
    known = pairs.groupBy("window").agg(
        F.count("item").alias("n"), *[F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64(F.lit(seed), "item"))).alias(f"h{seed}") for seed in (1, 2)])
    return known.select("window", F.when(F.col("n") > 0, F.concat_ws(":", "n", "h1", "h2")).otherwise("").alias("kind"))


def shingles_of(words: tuple[bytes, ...]) -> Iterator[tuple[int, Shingle]]:
    k = min(SHINGLE, len(words))
    return ((at, words[at : at + k]) for at in range(len(words) - k + 1))


def runs(words: list[bytes], k: int) -> Iterator[Shingle]:
    """All shingles of k words, in order."""
    return zip(*(words[j:] for j in range(k)))


def by_length(shingles) -> dict[int, set[Shingle]]:
    out: dict[int, set[Shingle]] = {}
    for s in shingles:
        out.setdefault(len(s), set()).add(s)
    return out


def count_documents(docs: DataFrame, wanted: list[Shingle], text_column: str) -> dict[int, int]:
    """In how many rows of docs each shingle of a block stands, by its place in the list; over all rows."""
    numbers = docs.sparkSession.sparkContext.broadcast({s: k for k, s in enumerate(wanted)})
    sets = docs.sparkSession.sparkContext.broadcast(by_length(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = alnum_words(text.as_py())
                for k, known in sets.value.items():
                    found.update(known.intersection(runs(words, k)))
        places = [numbers.value[s] for s in found]
        yield pa.RecordBatch.from_pydict(
            {"shingle": pa.array(places, pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "shingle long, n long")
    out = {row.shingle: row.n for row in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}
    numbers.unpersist()
    sets.unpersist()
    return out


def probes(docs: DataFrame, block: list[tuple[bytes, str]], text_column: str) -> dict[Shingle, list[Probe]]:
    """The block's windows by their rarest shingle; equally rare ones by their words."""
    split = [(tuple(bytes(w).split(b" ")), sys.intern(kind)) for w, kind in block]
    wanted = sorted({s for words, _ in split for _, s in shingles_of(words)})
    counts = count_documents(docs, wanted, text_column)
    rank = {s: (counts.get(k, 0), s) for k, s in enumerate(wanted)}
    out: dict[Shingle, list[Probe]] = {}
    for words, kind in split:
        at, shingle = min(shingles_of(words), key=lambda x: (rank[x[1]], x[0]))
        if rank[shingle][0]:  # in no document: neither is the window
            out.setdefault(shingle, []).append(Probe(at, words, kind))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, stop) with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def search(words: list[bytes], index: dict[Shingle, list[Probe]], sets: dict[int, set[Shingle]]):
    """Spans of the windows in a document's words, and the classes of these windows."""
    spans, kinds = [], set()
    for k, known in sets.items():
        here = known.intersection(runs(words, k))
        if not here:
            continue
        for at, shingle in enumerate(runs(words, k)):
            if shingle in here:
                for probe in index[shingle]:
                    start = at - probe.offset
                    stop = start + len(probe.words)
                    if start >= 0 and stop <= len(words) and tuple(words[start:stop]) == probe.words:
                        spans.append((start, stop))
                        if probe.kind:
                            kinds.add(probe.kind)
    return spans, kinds


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_column: str = "text", keep: list[str] | None = None,
    named: bool = True,
) -> DataFrame:
    """The columns of docs in keep (all by default) with __n_words, __spans (array of (start, stop), in words) and, if named,
    __items (array of item ids as sorted strings).

    Null and wordless texts have no words and no hits; repeated rows have the same hits. An empty benchmark hits nothing.
    """
    pairs = durable(windows(benchmark, size), "windows")
    table = durable(classes(pairs), "classes")
    total = table.count()
    blocks = max(1, math.ceil(total / BLOCK))
    numbered = table.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    out = docs.select("*", F.array().cast("array<struct<start:int,stop:int>>").alias("__spans"),
                      F.array().cast("array<string>").alias("__kinds"))
    kept = docs.columns if keep is None else keep
    for number in range(blocks):
        rows = numbered.filter(F.col("block") == number).select("window", "kind").collect() if total else []
        index = probes(docs, [tuple(r) for r in rows], text_column)
        out = _pass(out, index, text_column, kept if number == blocks - 1 else list(dict.fromkeys([*kept, text_column])))
        if number % CHAIN == CHAIN - 1 and number < blocks - 1:
            out = durable(out, "hits")
    return with_items(durable(out, "hits"), pairs, table) if named else out.drop("__kinds")


def with_items(found: DataFrame, pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of found with __items in place of __kinds; only rows that name classes are shuffled, each set of classes once.

    found, pairs and table are read more than once.
    """
    none = F.size("__kinds") == 0
    named = found.filter(~none).withColumn("__set", F.sha2(F.array_join("__kinds", ","), 256))
    sets = named.select("__set", "__kinds").distinct().select("__set", F.explode("__kinds").alias("kind"))
    # one window stands for its class, so that the items of a class are read once
    first = table.filter("kind <> ''").groupBy("kind").agg(F.min("window").alias("window"))
    first = first.join(sets.select("kind").distinct(), "kind", "left_semi")
    items = pairs.join(first, "window").select("kind", "item")
    listed = sets.join(items, "kind").groupBy("__set").agg(F.array_sort(F.collect_set("item")).alias("__items"))
    columns = [f"`{c}`" for c in found.columns if c != "__kinds"]
    empty = found.filter(none).select(*columns, F.array().cast("array<string>").alias("__items"))
    return empty.union(named.join(listed, "__set").select(*columns, "__items"))


def _pass(docs: DataFrame, index: dict[Shingle, list[Probe]], text_column: str, keep: list[str]) -> DataFrame:
    """One block's hits added to the rows."""
    shared = docs.sparkSession.sparkContext.broadcast((index, by_length(index)))

    def rows(texts, spans, kinds):
        index, sets = shared.value
        for text, old, named in zip(texts, spans, kinds):
            words = alnum_words(text)
            found, more = search(words, index, sets)
            old = [(s["start"], s["stop"]) for s in old]
            if found:
                old = joined(old + found)
                named = sorted({*named, *more})
            yield len(words), old, named

    found = with_columns(
        docs, [text_column, "__spans", "__kinds"],
        "__n long, __s array<struct<start:int,stop:int>>, __k array<string>", rows, keep)
    return found.withColumnsRenamed({"__n": "__n_words", "__s": "__spans", "__k": "__kinds"})


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


SQL = r"""
WITH t AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents, t),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark, t),
w AS (SELECT DISTINCT item_id, ws[i:i + 9] AS win, least(10, len(ws)) AS n
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, n WHERE len(ws) >= n),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN w ON p.n = w.n AND p.ws[p.i:p.i + p.n - 1] = w.win),
k AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM h))
      GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
