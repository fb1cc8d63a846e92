"""Fingerprints, the filter audit and fill-in-middle texts against plain versions."""

import hashlib
import itertools
import random
import re

import cases
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import fill_middle, filter_audit, simhash


# --- op11 -----------------------------------------------------------------------------------------

def plain_print(text, k=4):
    words = cases.space_words(cases.lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(keys, linked):
    """Smallest id of each row's group by all pairs; keys are (id, value) and rows of one id are linked."""
    group = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if group[i] != group[j] and (linked(keys[i][1], keys[j][1]) or (keys[i][0] is not None and keys[i][0] == keys[j][0])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for g in group:
        ids = [k[0] for k, h in zip(keys, group) if h == g and k[0] is not None]
        out.append(min(ids) if ids else None)
    return out


def test_fingerprints_equal_the_plain_ones():
    for _, text in cases.texts():
        assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("bucket", [2, simhash.BUCKET])
def test_simhash_groups_on_awkward_rows(spark, bucket):
    rows = cases.texts() + [(30 + i, cases.prose(1) + " tail" * i) for i in range(6)] + [(40, "two  WORDS"), (41, "\x0b")]
    prints = [(i, plain_print(t)) for i, t in rows]
    want = plain_classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = simhash.near_duplicates(cases.documents(spark, rows), bucket=bucket).collect()
    assert sorted([tuple(r)[:3] for r in got], key=cases.key) == sorted(
        [(i, f"{p:016x}", c) for (i, p), c in zip(prints, want)], key=cases.key)
    for row in got:
        assert row.kept == (row.doc_id == row.component_id if row.doc_id is not None else row.component_id is None)


def test_simhash_of_nothing_and_without_links(spark):
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []
    got = simhash.near_duplicates(cases.documents(spark, [(1, cases.prose(11)), (2, cases.prose(12))])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_rows_of_one_id_join_groups(spark):
    rows = [(5, cases.prose(1)), (5, cases.prose(2)), (3, cases.prose(1)), (9, cases.prose(2)), (7, cases.prose(3))]
    got = simhash.near_duplicates(cases.documents(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3), (7, 7)}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.sets(st.integers(0, 63), max_size=58))
def test_every_pair_within_the_radius_shares_a_mask(value, flipped, used_bits):
    used = sum(1 << b for b in used_bits - flipped)
    other = value ^ sum(1 << b for b in flipped)
    masks = [int(m) for m in simhash.covering(used, 4)]
    assert len(masks) == 31 and all(m & used == used for m in masks)
    assert any(value & m == other & m for m in masks)


def test_links_connect_what_all_pairs_connect_also_when_buckets_are_cut(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):
            values.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([2, 4, 5, 6])))
    for _ in range(200):  # a crowd around one value
        values.add(sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))))
    values = sorted(values)
    want = plain_classes([(v, v) for v in values], lambda a, b: (a ^ b).bit_count() <= 4)
    signed = [(v - (v >> 63 << 64),) for v in values]
    for bucket in (3, 50, simhash.BUCKET):
        edges = simhash.links(spark.createDataFrame(signed, "print long"), bucket=bucket).distinct().collect()
        pairs = {(e.a % 2**64, e.b % 2**64) for e in edges}
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        near = {p for a, b in pairs for p in ((a, b), (b, a))}
        assert plain_classes([(v, v) for v in values], lambda a, b: (a, b) in near) == want


def test_a_bucket_gives_a_forest_not_all_pairs():
    values = np.array([1 << i for i in range(64)] + [0], np.uint64)
    a, b = simhash.forest(values, 4)
    assert len(a) == len(b) == 64


# --- op12 -----------------------------------------------------------------------------------------

def plain_audit(docs, labels):
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, lang, text in docs:
        text = text or ""
        words = cases.space_words(text)
        fails = {f for f, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", re.search(r"[#$%&*|]", text)),
            ("E", i is not None and i > first[text])) if bad}
        rows.append((lang or "", fails, any(k == i and q == 1 for k, q, _ in labels if i is not None),
                     any(k == i and t == 1 for k, _, t in labels if i is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(share[f])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_the_plain_one(spark):
    long_text = cases.prose(21, 150)
    rows = cases.texts() + [(50 + i, t) for i, t in enumerate([long_text, long_text + " #", long_text.upper(), long_text, "#", "#"])]
    langs = itertools.cycle(["en", "de", None, "", "x y"])
    docs = [(i, next(langs), t) for i, t in rows]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (53, 1, None), (55, None, 1), (None, 1, 1), (999, 1, 1), (5, 1, 0)]
    table = cases.documents(spark, rows).drop("lang")
    order = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    for c in table.columns:
        if c not in order.columns:
            order = order.withColumn(c, F.lit("clash"))
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("mask", F.lit(3))
    assert sorted(map(tuple, filter_audit.audit(order, rated).collect())) == plain_audit(docs, labels)
    assert len(plain_audit(docs, labels)) == 600 * 4


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(cases.empty(spark), none).collect() == []
    docs = [(1, "en", "a"), (2, "en", None), (3, "en", "")]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, lang string, text string"), none)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, [])


def test_steps_are_the_first_failing_filter_of_each_order():
    mask = np.arange(32)
    at = filter_audit.steps(mask)
    for m, (p, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        want = next((s for s, f in enumerate(order, 1) if m >> f & 1), filter_audit.NEVER)
        assert at[m, p] == want


# --- op13 -----------------------------------------------------------------------------------------

def plain_fill(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or doc_id is None or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lines(seed, n):
    rng = random.Random(seed)
    return "".join(cases.prose(rng.random(), rng.randint(0, 30)) + "\n" * rng.randint(0, 2) for _ in range(n))


def fills():
    shared = lines(1, 300)
    return cases.texts() + [
        (60, shared), (61, "head\n" + shared), (62, shared + "tail"), (63, "\n"), (64, "\n" * 20_000), (65, "x" * 50_000),
        (66, "a <P> b\nc"), (67, "<S\n>\n<M"), (68, "<\nS>\n<P\n>"), (69, "é\n日本\r\n\x85a b\n" * 3000), (70, lines(2, 3000))]


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 20), (0, 50)])
def test_fill_in_middle_and_back(spark, rate, spm_rate):
    rows = fills()
    made = fill_middle.fill_in_middle(cases.documents(spark, rows), rate, spm_rate)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    want = [(i, *plain_fill(i, t, rate, spm_rate), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=cases.key) == sorted(want, key=cases.key)


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(cases.empty(spark)).collect() == []


def test_chunks_cover_the_text_and_follow_its_content():
    memory = {}
    text = lines(3, 2000).encode()
    whole = fill_middle.boundaries(text)
    assert whole[-1] == len(text) and all(b > a for a, b in zip(whole, whole[1:]))
    sizes = np.diff([0, *whole])
    assert sizes.max() <= fill_middle.MOST and (sizes[:-1] >= fill_middle.LEAST).all()
    fill_middle.Chunked(text, memory)
    known = len(memory)
    fill_middle.Chunked(b"another beginning " + text, memory)
    assert len(memory) - known < 5 < known


def test_a_text_longer_than_a_block_has_the_same_chunks(monkeypatch):
    text = lines(4, 3000).encode()
    want = fill_middle.boundaries(text)
    monkeypatch.setattr(fill_middle, "BLOCK", 1000)
    assert fill_middle.boundaries(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab\né日\U0001f600"), max_size=60), st.integers(0, 70), st.integers(4, 9))
def test_cuts_are_exact(text, units, most):
    saved = fill_middle.LEAST, fill_middle.MOST
    fill_middle.LEAST, fill_middle.MOST = 2, most
    try:
        chunked = fill_middle.Chunked(text.encode(), {})
    finally:
        fill_middle.LEAST, fill_middle.MOST = saved
    parts = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert chunked.n == len(parts)
    units = min(units, len(parts))
    head = "".join(parts[:units])
    assert chunked.cut(units) == (len(head.encode()), len(head))
