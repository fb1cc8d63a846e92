"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document's set is its distinct word shingles, as 64-bit hashes. Sorted, they fall into the registers of the sketch by
their upper bits; each register keeps its smallest hash compressed to the count of its leading zeros and ten bits behind
them. Bands of registers are bucket keys. For banding only, an empty register takes the value of the full register that
comes first in its own fixed order, so short texts have full bands, too. Two sets of Jaccard similarity s share a band of
r registers with probability s ** r; with 50 bands of 7, a pair at 0.8 is missed once in 130,000 times.

Documents with equal sets are one class from the start, and only class representatives are banded. A bucket is not
expanded to pairs: every member is compared with one pivot, the member that meets most others in all buckets. What that
leaves in different components is compared next, members outside a bucket's largest component with all the others, in
tiles of bounded size: first each one's likeliest partner, then all likely ones, so no two members of a bucket stay apart
untested. Before texts are fetched, pairs are estimated from their sketches, with the share of equal registers corrected
for accidental equality, and pairs far under the threshold go; inside the tiles 16 bits of every shingle of the smaller
sets bound the similarity from above. Links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_texts, space_words
from granary.llm.components import components
from granary.session import durable

BANDS, ROWS = 50, 7
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations that an estimate may lie below the threshold and still be verified.
SLACK = 5.0
#: Ids that are broadcast to pick texts; with more of them the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles up to which a set's prints travel with its sketch.
PRINTS = 2048
#: Probes and members of a tile, about: what a task compares at once.
TILE = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words as one if there are fewer; empty without words."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = hashes[: len(hashes) - k + 1].copy()
    for j in range(1, k):
        out = mixed(out) + hashes[j : len(hashes) - k + 1 + j]
    return np.unique(mixed(out))


def sketch(values: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 if empty, else (leading zeros + 1) << MANTISSA | the bits behind the first one."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(values):
        spread = (values >> np.uint64(32)) * np.uint64(REGISTERS)
        bucket = (spread >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        part, exponent = np.frexp((spread[first] & np.uint64(0xFFFFFFFF)).astype(np.float64))
        bits = np.clip((part * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
        out[bucket[first]] = (33 - exponent) << MANTISSA | bits
    return out


@lru_cache(1)
def orders() -> np.ndarray:
    """For every register the fixed random order in which it looks for a full one."""
    return np.random.default_rng(20240607).random((REGISTERS, REGISTERS), np.float32)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, with empty registers filled."""
    full = np.flatnonzero(registers)
    empty = np.flatnonzero(registers == 0)
    if len(empty):
        registers = registers.copy()
        registers[empty] = registers[full[np.argmin(orders()[np.ix_(empty, full)], axis=1)]]
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in registers.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


@lru_cache(4096)
def accidental(log_a: int, log_b: int) -> float:
    """Chance that two different elements' registers agree, for sets of 1.25 ** log_a and 1.25 ** log_b elements."""
    cells = 1 << MANTISSA
    total = 0.0
    for zeros in range(33):
        low = 2.0 ** -(zeros + 1)
        x = low * (1 + np.arange(cells) / cells)
        p = [np.exp(-rate * x) * -np.expm1(-rate * low / cells) / -np.expm1(-rate)
             for rate in (1.25 ** log_a / REGISTERS, 1.25 ** log_b / REGISTERS)]
        total += float((p[0] * p[1]).sum())
    return total


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, int]:
    """Jaccard similarity from two sketches, corrected for accidental equality, and the registers it rests on."""
    used = int(np.count_nonzero(a | b))
    same = int(np.count_nonzero((a == b) & (a != 0)))
    chance = accidental(*(round(np.log(max(1, n)) / np.log(1.25)) for n in (n_a, n_b)))
    return max(0.0, (same / used - chance) / (1 - chance)) if used else 0.0, used


def likely(threshold: float, a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """Whether a pair may reach the threshold: by its sizes, and by its estimate less some standard deviations."""
    if min(n_a, n_b) < threshold * max(n_a, n_b) - 1e-9:
        return False
    value, used = estimate(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), n_a, n_b)
    return value >= threshold - SLACK * (threshold * (1 - threshold) / max(1, used)) ** 0.5


def signatures(docs: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, digest of the whole set and registers; the last two null without words."""

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            values = shingles(text, k)
            if len(values):
                yield i, len(values), hashlib.blake2b(values.tobytes(), digest_size=16).digest(), sketch(values).tobytes()
            else:
                yield i, 0, None, None

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_texts(source, ["doc_id", "text"], "doc_id long, n_shingles long, digest binary, registers binary", rows)


def band_table(reps: DataFrame) -> DataFrame:
    """(key, node) for every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = [band_keys(np.frombuffer(r, np.uint16)) for r in part.column(1).to_pylist()]
                nodes = np.repeat(np.asarray(part.column(0)), BANDS)
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "node": pa.array(nodes)})

    return reps.select("node", "registers").mapInArrow(run, "key long, node long")


def sifted(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose sketches allow the threshold."""
    side = reps.select("node", "n_shingles", "registers")
    sketched = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")

    def sift(a, b, r_a, r_b, n_a, n_b):
        for row in zip(a, b, r_a, r_b, n_a, n_b):
            if likely(threshold, *row[2:]):
                yield row[:2]

    return map_texts(sketched, ["a", "b", "r_a", "r_b", "n_a", "n_b"], "a long, b long", sift, 4096)


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those that reach the threshold on their full sets, as a written table (a, b)."""

    def confirm(a, b, t_a, t_b):
        known: dict[int, np.ndarray] = {}
        for i, j, x, y in zip(a, b, t_a, t_b):
            for node, text in ((i, x), (j, y)):
                if (node, text) not in known:
                    known[node, text] = shingles(text, k)
            one, two = known[i, x], known[j, y]
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both and 100 * both >= round(100 * threshold) * (len(one) + len(two) - both):
                yield i, j

    paired = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")
    return durable(map_texts(paired, ["a", "b", "t_a", "t_b"], "a long, b long", confirm, 256).distinct(), "links")


def compared(
    probes: list[tuple], members: list[tuple], threshold: float, best: int | None,
) -> Iterator[tuple[int, int]]:
    """Pairs of nodes in different components whose sketches and prints allow the threshold; the best of each probe only.

    Both lists hold (node, component, n_shingles, registers, prints).
    """
    sides = []
    for rows in (probes, members):
        sides.append((np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]),
                      np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), REGISTERS)))
    (p, p_c, p_n, p_r), (m, m_c, m_n, m_r) = sides
    m_full = m_r != 0
    logs = np.rint(np.log(np.maximum(1, m_n)) / np.log(1.25)).astype(int)
    for i in range(len(p)):
        fits = np.flatnonzero(
            (m_c != p_c[i]) & (np.minimum(m_n, p_n[i]) >= threshold * np.maximum(m_n, p_n[i]) - 1e-9))
        if not len(fits):
            continue
        full = p_r[i] != 0
        used = np.count_nonzero(m_full[fits] | full, axis=1)
        same = np.count_nonzero((m_r[fits] == p_r[i]) & full, axis=1)
        own = round(np.log(max(1, p_n[i])) / np.log(1.25))
        chance = np.array([accidental(own, int(x)) for x in logs[fits]])
        value = (same / used - chance) / (1 - chance)
        good = np.flatnonzero(value >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / used))
        if probes[i][4] is not None and len(good):
            held = np.zeros(1 << 16, bool)
            held[np.frombuffer(probes[i][4], np.uint16)] = True
            most = np.array([PRINTS if members[j][4] is None else np.count_nonzero(held[np.frombuffer(members[j][4], np.uint16)])
                             for j in fits[good]])
            most = np.minimum(most, np.minimum(p_n[i], m_n[fits[good]]))
            good = good[most >= threshold * (p_n[i] + m_n[fits[good]] - most) - 1e-9]
        if best is not None:
            good = good[np.lexsort((m[fits[good]], -value[good]))[:best]]
        for j in fits[good]:
            yield min(int(p[i]), int(m[j])), max(int(p[i]), int(m[j]))


def with_prints(reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """reps with the prints of the sets of at most PRINTS shingles: 16 bits of each hash.

    Shingles that two sets share have equal prints, so the prints of one that stand among the other's are never fewer than
    the shared shingles, and the similarity they allow is never under the true one.
    """

    def rows(nodes, texts):
        for node, text in zip(nodes, texts):
            values = shingles(text, k)
            if len(values) <= PRINTS:
                yield node, (values & np.uint64(0xFFFF)).astype(np.uint16).tobytes()

    return reps.join(map_texts(texts, ["doc_id", "text"], "node long, prints binary", rows), "node", "left")


def across(placed: DataFrame, open_keys: DataFrame, reps: DataFrame, threshold: float, best: int | None) -> DataFrame:
    """Likely pairs (a, b) inside the open buckets, between members outside a bucket's main component and all the others.

    A bucket is cut into tiles of at most about TILE probes by TILE members, and a task holds one tile at a time: pairs
    exist only as comparisons of sketches there, and only likely ones become rows.
    """
    rows = placed.join(open_keys, "key").join(reps, "node")
    probes = F.ceil((F.col("size") - F.col("n")) / TILE).cast("int")
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    mine = F.xxhash64("node", F.lit(1))

    def tile(row, column, probe):
        return F.struct(row.cast("int").alias("row"), column.cast("int").alias("column"), F.lit(probe).alias("probe"))

    as_member = F.transform(F.sequence(F.lit(0), probes - 1), lambda i: tile(i, F.pmod(mine, blocks), 0))
    as_probe = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: tile(F.pmod(mine, probes), i, 1))
    tiles = F.when(F.col("c") == F.col("main"), as_member).otherwise(F.concat(as_member, as_probe))
    dealt = (
        rows.select("key", F.explode(tiles).alias("t"), "node", "c", "n_shingles", "registers", "prints")
        .select("key", "t.row", "t.column", "t.probe", "node", "c", "n_shingles", "registers", "prints")
        .repartition("key", "row", "column").sortWithinPartitions("key", "row", "column"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in tile_pairs(batches, threshold, best):
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return dealt.mapInArrow(run, "a long, b long").distinct()


def tile_pairs(batches: Iterator[pa.RecordBatch], threshold: float, best: int | None) -> Iterator[list[tuple[int, int]]]:
    """The likely pairs of each tile of a sorted partition."""
    here, sides = None, ([], [])
    for batch in batches:
        for key, row, column, probe, *member in zip(*[c.to_pylist() for c in batch.columns]):
            if (key, row, column) != here:
                if sides[1]:
                    yield list(compared(sides[1], sides[0], threshold, best))
                here, sides = (key, row, column), ([], [])
            sides[probe].append(tuple(member))
    if sides[1]:
        yield list(compared(sides[1], sides[0], threshold, best))


def linked(members: DataFrame, reps: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node, component) of all nodes that have a link, from the written table members (key, node) of shared buckets."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    meets = durable(members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("meets")), "meets")
    wanted = meets.select("node")
    if meets.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = durable(
        docs.join(wanted, docs["doc_id"] == wanted["node"], "left_semi").select("doc_id", "text").distinct(), "texts")
    reps = durable(with_prints(reps.join(wanted, "node", "left_semi"), texts, k), "reps")

    # every node with the one pivot that meets most, of the pivots of its buckets
    ranked = members.join(meets, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("pivot"))
    stars = (members.join(pivots, "key").groupBy("node").agg(F.max("pivot").alias("pivot"))
             .select("node", F.col("pivot.node").alias("pivot")).filter("node != pivot"))
    stars = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = verified(sifted(stars, reps, threshold), texts, k, threshold)
    groups = components(links)
    # then what is still apart: first the likeliest partners, at last all likely ones
    for best in (1, None):
        placed = durable(
            members.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "placed")
        open_keys = durable(
            placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key")
            .agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("size")).filter(F.col("m.n") < F.col("size"))
            .select("key", "size", F.col("m.n").alias("n"), F.col("m.c").alias("main")), "open")
        more = verified(across(placed, open_keys, reps, threshold, best), texts, k, threshold)
        if more.limit(1).count():
            links = links.union(more)
            groups = components(links)
    return groups


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (doc_id is that one).

    Null, empty and wordless texts have no set and no links: component_id is their own id. Rows with one doc_id count as one
    document: what any of them links with, all do; every row is returned, and repeated rows are all kept or all not.
    A row without doc_id is never kept if a document with an id has its set, and always if none has; its component_id is
    that of its set or null. An empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = durable(signatures(source, k), "signatures")
    classes = durable(signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    reps = durable(
        signed.join(classes, "digest").filter(F.col("doc_id") == F.col("node")).select("node", "n_shingles", "registers"), "reps")
    bands = band_table(reps)
    shared = (bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .filter("lo != hi").select("key"))
    members = durable(bands.join(shared, "key", "left_semi").distinct(), "members")
    groups = linked(members, reps, source, k, threshold)
    # a doc_id whose rows have different sets joins their classes, too
    own = signed.filter("digest is not null and doc_id is not null").join(classes, "digest").select("doc_id", "node")
    several = durable(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
                      .filter("a != b").select("doc_id"), "several")
    if several.limit(1).count():
        groups = components(groups.toDF("a", "b").union(own.join(several, "doc_id", "left_semi").toDF("a", "b")))
    placed = classes.join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("c"))
    component = F.coalesce("c", "doc_id")
    return signed.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & F.col("c").isNull()).alias("kept"))
