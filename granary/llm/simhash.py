"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; each is the majority of that bit over the hashes of the text's word shingles. To find all pairs
that differ in at most r bits, every bit position gets a non-zero vector of r + 1 bits, and every non-zero vector v of r + 1
bits gives a mask: the positions whose vector has an odd product with v. The vectors of at most r differing positions leave
some v orthogonal to all of them, so two such fingerprints agree under that mask and collide in its table, always. Each of
the 31 masks (r = 4) holds about half of the bits.

Only distinct fingerprints are hashed, so copies never meet in a bucket. A bucket over a size limit is not compared as it is:
its members agree on the bits of the mask, so the same construction over the bits that are left cuts it into smaller
buckets without losing a pair, again and again; with few bits left a bucket is small by itself. Within a bucket a search
from neighbour to neighbour gives a spanning forest of its links, at most one edge a member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_texts, space_words
from granary.llm.components import components
from granary.llm.near_dups import mixed
from granary.session import durable

BITS, SEED = 64, 42
#: Members above which a bucket is cut by further masks.
BUCKET = 4096
#: With this many bits left a bucket cannot hold more than BUCKET fingerprints.
FEW_BITS = 12
#: Bucket keys that are broadcast to pick members; with more of them the members are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str | None, k: int = 4) -> int:
    """Majority bits of the hashes of all k-word shingles, repeats included; of the whole text if it has fewer words."""
    words = space_words(text)
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + k - 1 : at + k - 1 + (1 << 16)].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@lru_cache(65536)
def covering(used: int, radius: int) -> np.ndarray:
    """Masks over the bits outside used; values that agree on used and differ in at most radius bits agree under one."""
    size = 1 << (radius + 1)
    vectors = [1 << i for i in range(radius + 1)] + [v for v in range(1, size) if v & (v - 1)]
    bits = [i for i in range(BITS) if not used >> i & 1]
    masks = [used] * (size - 1)
    for place, bit in enumerate(bits):
        own = vectors[place % len(vectors)]
        for v in range(1, size):
            if (own & v).bit_count() & 1:
                masks[v - 1] |= 1 << bit
    return np.array(masks, np.uint64)


def keyed(rows: DataFrame, radius: int) -> DataFrame:
    """(key, used, print) for every mask over the unused bits of the rows (used, print); one key is one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used, prints = (np.asarray(c).view(np.uint64) for c in batch.columns)
            for u in np.unique(used):
                mine = prints[used == u]
                masks = covering(int(u), radius)
                key = mixed(mixed(mine[:, None] & masks) + masks)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key.ravel().view(np.int64)),
                    "used": pa.array(np.tile(masks, len(mine)).view(np.int64)),
                    "print": pa.array(np.repeat(mine, len(masks)).view(np.int64))})

    return rows.select("used", "print").mapInArrow(run, "key long, used long, print long")


def forest(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges between prints at most radius bits apart that connect all that such links connect."""
    a, b, rest = [], [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += [x] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) inside the buckets of members (key, print), each of a bounded size."""
    dealt = members.select("key", "print").repartition("key").sortWithinPartitions("key", "print")

    def edges(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        same = key[1:] == key[:-1]
        near = np.bitwise_count(prints[1:] ^ prints[:-1]) <= radius
        chained = np.flatnonzero(same & near)
        a, b = [prints[chained]], [prints[chained + 1]]
        begins = np.flatnonzero(np.concatenate(([True], ~same)))
        for i in np.unique(np.searchsorted(begins, np.flatnonzero(same & ~near), side="right") - 1):
            end = begins[i + 1] if i + 1 < len(begins) else len(key)
            more = forest(prints[begins[i] : end], radius)
            a.append(np.array(more[0], np.uint64))
            b.append(np.array(more[1], np.uint64))
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # the last bucket of a batch waits for the rest of it
            key = np.concatenate((key, np.asarray(batch.column(0))))
            prints = np.concatenate((prints, np.asarray(batch.column(1)).view(np.uint64)))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield edges(key[:whole], prints[:whole])
                key, prints = key[whole:], prints[whole:]
        if len(key):
            yield edges(key, prints)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(prints: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct values of the column print as all pairs at most radius bits apart would."""
    rows = prints.select(F.lit(0).cast("long").alias("used"), "print")
    found = None
    while True:
        cut = keyed(rows, radius)
        shared = durable(cut.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        few = shared.count()
        if few == 0 and found is not None:
            return found
        members = durable(cut.join(F.broadcast(shared) if few <= BROADCAST_KEYS else shared, "key"), "members")
        big = (F.col("n") > bucket) & (BITS - F.bit_count("used") > FEW_BITS)
        edges = durable(bucket_links(members.filter(~big), radius), "edges")
        found = edges if found is None else found.union(edges)
        rows = durable(members.filter(big).select("used", "print"), "open")
        if not rows.limit(1).count():
            return found


def near_duplicates(
    docs: DataFrame, k: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text", bucket: int = BUCKET,
) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id that links reach) and kept.

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows with one doc_id count as one document:
    what any of them links with, all do; every row is returned. A row without doc_id links, too; its component_id is null
    only if no row of its component has an id, and it is kept only then. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            value = fingerprint(text, k)
            yield i, value - (value >> 63 << 64)

    signed = durable(map_texts(source, ["doc_id", "text"], "doc_id long, print long", rows), "prints")
    firsts = durable(signed.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z"))
    several = several.filter("a != z").select("doc_id", "a")
    own = signed.join(several, "doc_id").filter("print != a").select("a", F.col("print").alias("b")).distinct()
    groups = components(links(firsts.select("print"), radius, bucket).union(own)).withColumnRenamed("node", "print")
    groups = durable(groups.join(firsts, "print"), "groups")
    least = groups.groupBy("component").agg(F.min("first").alias("least"))
    classes = groups.join(least, "component").select("print", "least")
    classed = durable(
        firsts.join(classes, "print", "left").select("print", F.coalesce("least", "first").alias("component_id")), "classes")
    out = signed.join(classed, "print")
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept"))
