import random

import cases
import numpy as np
import pytest

from granary.llm import decontaminate, near_dups
from granary.llm.components import components


def shingle_set(text, k):
    words = cases.space_words(cases.lower(text))
    return frozenset(zip(*(words[j:] for j in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def classes(rows, k):
    """Smallest id of each row's group, by comparing all pairs; rows of one id count as one document."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) or same_id:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def found(spark, rows, k=2):
    return [tuple(r) for r in near_dups.near_duplicates(cases.documents(spark, rows), k).collect()]


@pytest.mark.parametrize("k", [2, 5])
def test_awkward_rows(spark, k):
    rows = cases.texts()
    got = found(spark, rows, k)
    want = classes(rows, k)
    assert sorted([r[:3] for r in got], key=cases.key) == sorted(want, key=cases.key)
    for doc, _, component, kept in got:
        assert kept == (doc == component if doc is not None else component is None)


def test_nothing_and_no_links(spark):
    assert found(spark, []) == []
    assert sorted(found(spark, [(1, "a b c d"), (2, None), (3, "x y z")])) == [(1, 3, 1, True), (2, 0, 2, True), (3, 2, 3, True)]


def test_rows_of_one_id_join_the_groups_of_their_texts(spark):
    rows = [(5, cases.prose(1)), (5, cases.prose(2)), (3, cases.prose(1)), (9, cases.prose(2)), (7, cases.prose(3))]
    assert {(r[0], r[2]) for r in found(spark, rows)} == {(5, 3), (3, 3), (9, 3), (7, 7)}


def variants(rng, words, n, share):
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, int(len(words) * share))):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("length", [4, 12, 60, 400])
def test_chains_of_copies_around_the_threshold(spark, length):
    rng = random.Random(length)
    rows = []
    for g in range(6):
        rows += variants(rng, [f"g{g}v{rng.randrange(200)}" for _ in range(length)], 14, 0.16)
    rows = [(i, t) for i, t in enumerate(rng.sample(rows, len(rows)))]
    assert sorted(r[:3] for r in found(spark, rows)) == sorted(classes(rows, 2))


def test_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "TILE", 5)
    rng = random.Random(3)
    rows = list(enumerate(variants(rng, [f"v{rng.randrange(300)}" for _ in range(80)], 50, 0.2)))
    assert sorted(r[:3] for r in found(spark, rows)) == sorted(classes(rows, 2))


def test_texts_are_joined_by_a_shuffle_if_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    rows = cases.texts()
    assert sorted([r[:3] for r in found(spark, rows)], key=cases.key) == sorted(classes(rows, 2), key=cases.key)


@pytest.mark.parametrize("size", [30, 300, 5000])
@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.8, 0.95])
def test_sketches_estimate_the_similarity(size, similarity):
    rng = np.random.default_rng(size)
    errors, shared = [], 0
    for _ in range(40):
        same = round(2 * size * similarity / (1 + similarity))
        values = rng.integers(0, 2**64, 2 * size - same, np.uint64)
        a, b = np.unique(values[:size]), np.unique(values[size - same :])
        got, used = near_dups.estimate(near_dups.sketch(a), near_dups.sketch(b), len(a), len(b))
        errors.append(got - same / len(np.union1d(a, b)))
        shared += bool(np.intersect1d(near_dups.band_keys(near_dups.sketch(a)), near_dups.band_keys(near_dups.sketch(b))).size)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.15
    assert shared == 40 if similarity >= 0.8 else shared < 40


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 1), (2, 1)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 7, **{k: 100 for k in range(100, 161)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def hits(rows, items, size=10):
    out = []
    for doc, text in rows:
        words, hit, named = cases.alnum_words(text), set(), set()
        for item, other in items:
            own = cases.alnum_words(other)
            for w in range(max(1, len(own) - size + 1) if own else 0):
                window = own[w : w + size]
                for at in range(len(words) - len(window) + 1):
                    if words[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        if item is not None:
                            named.add(str(item))
        out.append((doc, len(words), len(hit), tuple(sorted(named))))
    return sorted(out, key=cases.key)


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    words = cases.prose(1).split(" ")
    items = [(1, " ".join(words[20:50])), (2, "Same LINE, here"), (10, "one"), (3, "two"), (4, ""), (5, None),
             (6, cases.prose(9, 30)), (7, " ".join(words[20:50])), (8, "the the " * 9)]
    rows = [(i, t) for i, t in cases.texts() if i != 8] + [(30, "x the the the the the the the the the the the y " * 3),
            (31, " ".join(words[15:29])), (32, " ".join(words[20:29])), (33, "twó TWO")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    got = decontaminate.contaminated(cases.documents(spark, rows), bench)
    assert got.columns[: len(rows[0])] == ["doc_id", "text"]
    flat = [(r.doc_id, r["__n_words"], sum(s.stop - s.start for s in r["__spans"]), tuple(r["__items"])) for r in got.collect()]
    assert sorted(flat, key=cases.key) == hits(rows, items)


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination_by_items_without_id(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    words = cases.prose(1).split(" ")
    items = [(None, " ".join(words[20:50])), (2, " ".join(words[40:60])), (None, "two"), (None, None)]
    rows = [(1, cases.prose(1)), (2, " ".join(words[18:36])), (2, "x two x"), (None, "two"), (4, " ".join(words[44:60])), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(cases.documents(spark, rows), bench).collect()
    flat = [(r.doc_id, r["__n_words"], sum(s.stop - s.start for s in r["__spans"]), tuple(r["__items"])) for r in got]
    want = hits(rows, items)
    assert sorted(flat, key=cases.key) == want
    assert [(h[0], h[3]) for h in want if h[2]] == [(None, ()), (1, ("2",)), (2, ()), (2, ()), (4, ("2",))]


def test_item_ids_do_not_pass_through_the_driver(spark, monkeypatch):
    words = cases.prose(1).split(" ")
    shared, others = " ".join(words[:14]), cases.prose(2, 4000).split(" ")
    items = [(k, f"{shared} {' '.join(others[k * 12 : k * 12 + 12])}") for k in range(300)] + [(None, shared)]
    rows = [(1, cases.prose(1)), (2, items[7][1]), (3, cases.prose(5)), (4, f"x {shared}"), (4, f"{shared} y")]
    blocks, probes = [], decontaminate.probes
    monkeypatch.setattr(decontaminate, "probes", lambda docs, block, column: blocks.extend(block) or probes(docs, block, column))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(cases.documents(spark, rows), bench).collect()
    flat = [(r.doc_id, r["__n_words"], sum(s.stop - s.start for s in r["__spans"]), tuple(r["__items"])) for r in got]
    assert sorted(flat, key=cases.key) == hits(rows, items)
    assert len(blocks) > 300 and all(sum(map(len, row)) < 200 for row in blocks)


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = cases.documents(spark)
    assert decontaminate.contaminated(docs, bench).filter("size(__spans) > 0").count() == 0
    full = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.contaminated(cases.empty(spark), full).count() == 0
