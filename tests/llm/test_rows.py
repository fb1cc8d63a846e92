import math
import re
import zlib
from collections import Counter

import cases
import duckdb
import pandas as pd
import pytest
import xxhash

from granary.llm import chat, licenses, quality_rules, url_table, urls


def by_sql(sql, **tables):
    db = duckdb.connect()
    for name, rows in tables.items():
        db.register(name, rows)
    return sorted((tuple(None if x != x else x for x in r) for r in db.execute(sql).fetchall()), key=cases.key)


def repeated(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)})


def test_quality_measures(spark):
    got = quality_rules.judge(cases.documents(spark)).collect()
    assert len(got) == len(cases.texts())
    want = []
    for i, text in cases.texts():
        words = cases.space_words(text)
        lines = [x for x in (text or "").split("\n") if cases.space_words(x)]
        n = repeated(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                     n, len(words) < 50 or 100 * n > 50 * len(words)))
    assert sorted((tuple(r)[:7] for r in got), key=cases.key) == sorted(want, key=cases.key)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[8] and not any(kept[i] for i in (5, 6, 9, 13, 14, 15, 19))


def test_windows_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("long"))  # every window has the same hash
    words = "a b c d a b c e f a b c".split()
    df = spark.createDataFrame([(words,)], "w array<string>").select(quality_rules.repeated_words(F.col("w")).alias("n"))
    assert df.first().n == repeated(words) == 9


def test_the_order_of_rules_does_not_change_the_result(spark):
    docs = cases.documents(spark)
    rules = quality_rules.BASE + quality_rules.OWN
    one, two = quality_rules.keep_good(docs, rules), quality_rules.keep_good(docs, rules[::-1])
    assert cases.sorted_rows(one) == cases.sorted_rows(two) and one.columns == docs.columns
    order = quality_rules.estimate(docs, rules)
    assert {e.rule for e in order} == set(rules)
    assert [e.rejected / e.seconds for e in order] == sorted((e.rejected / e.seconds for e in order), reverse=True)
    assert quality_rules.keep_good(cases.empty(spark)).count() == 0 and quality_rules.judge(cases.empty(spark)).count() == 0


def test_licences_against_sql(spark):
    known = [r for r in cases.texts() if r[0] is not None]
    known = list(dict(known).items())
    got = cases.sorted_rows(licenses.scan(cases.documents(spark, known)))
    frame = pd.DataFrame(known, columns=["doc_id", "text"])
    assert got == by_sql(licenses.sql(), documents=frame)


@pytest.mark.parametrize("text, n, first, last, labels", [
    ("cc by cc by CC-BY", 3, 0, 4, "cc-by"), ("All rights reserved", 1, 0, 2 - 2, "reserved"), ("a ccby b", 0, None, None, ""),
    ("GNU General Public License", 1, 1, 1, "gpl"), ("x. Released under the MIT License.", 0, None, None, "mit"),
    ("Licensed under CC BY-NC 4.0.", 1, 2, 2, "cc-by,cc-by-nc"), ("the license of mit", 0, None, None, ""),
    ("all rights, reserved all rights reserved all", 2, 0, 3, "reserved"), (None, 0, None, None, ""), ("", 0, None, None, "")])
def test_licence_places(spark, text, n, first, last, labels):
    row = licenses.scan(cases.documents(spark, [(1, text), (1, text)])).collect()
    assert len(row) == 2 and (row[0].n_base, row[0].first_word, row[0].last_word, row[0].labels) == (n, first, last, labels)
    assert 0 <= row[0].score <= 1 and (row[0].score > 0) == bool(labels) and row[0].n_words == len(cases.alnum_words(text))


WORDINGS = [
    ("Licensed under the MIT License", "mit"), ("This project is distributed under the MIT License.", "mit"),
    ("This code is available under the terms of the MIT licence", "mit"), ("// SPDX-License-Identifier: MIT", "mit"),
    ("Apache License 2.0", "apache-2.0"), ("Licensed under the Apache License, v. 2.0", "apache-2.0"),
    ("Apache Software License, see the Apache License (the version 2.0 of it)", "apache-2.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("BSD 3-Clause License", "bsd"), ("the (new) BSD license applies", "bsd"),
    ("spdx-license-identifier: BSD-2-Clause", "bsd"), ("Mozilla Public License 2.0", "mpl-2.0"), ("MPL-2.0", "mpl-2.0"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"), ("Creative Commons Attribution 4.0 International", "cc-by"),
    ("licence: GPL-3.0-or-later", "gpl"), ("it is GPLv2 software", "gpl"), ("LGPL-2.1-only", "lgpl"), ("AGPL-3.0", "agpl"),
    ("published under the ISC license", "isc"), ("CC0 1.0 Universal", "cc0"), ("see the Unlicense", "unlicense"),
    ("Permission is hereby granted, free of any charge, to each person obtaining a copy of this software and its associated "
     "documentation files, to deal in this Software without any restriction", ""),
    ("Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and the associated "
     "documentation files, to deal in the Software without restriction", "mit"),
]
OTHERS = [
    "er kam mit der license", "the apache helicopter, version 2.0", "a driving license for the bsd office",
    "mozilla in public, licensed cab", "creative people in the commons", "permission to use the copy room without fee",
    "affero has a general store", "mit mit mit mit mit mit", "public public license license"]


def test_usual_wordings_are_labelled_and_other_texts_are_not(spark):
    words = cases.prose(3, 30)
    texts = [t for t, _ in WORDINGS] + [f"{words} {t} {words}" for t, _ in WORDINGS] + OTHERS
    got = {r.doc_id: r.labels for r in licenses.scan(cases.documents(spark, list(enumerate(texts)))).collect()}
    want = [label for _, label in WORDINGS] * 2 + [""] * len(OTHERS)
    assert [(t, got[i]) for i, t in enumerate(texts)] == list(zip(texts, want))


def test_every_template_has_rare_words():
    assert min(licenses.weights(licenses.TEMPLATES)) > 0


def test_licences_on_awkward_rows(spark):
    assert licenses.scan(cases.documents(spark)).count() == len(cases.texts())
    assert licenses.scan(cases.empty(spark)).count() == 0


TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "<\\|end|>", "<\\\\|next|> [\\INST]", "", None, "plain\nlines", "<|<|>|>", "$1 \\ $2"]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, blocks string, loss string")


def test_chats_read_back(spark):
    from pyspark.sql import functions as F

    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(zip(["user", "assistant", "assistant", None, "<|end|>"] * 2, TRICKY * 2))]
    rows += [(3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "b"), (3, None, "system", "first"), (None, 1, "user", "x"), (None, 1, "user", "x")]
    df = chats(spark, [(*r, "t", "b", "l") for r in rows])
    made = chat.format_chats(df)
    read = made.select("conv_id", "formatted", "loss", chat.read_chat(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert len(read) == 5 and sum(r.conv_id is None for r in read) == 2
    for r in read:
        if r.conv_id is None:
            assert [tuple(t) for t in r.turns] == [("user", "x")]
            continue
        own = sorted(((t is not None, t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id))
        assert [tuple(t) for t in r.turns] == [(role, x) for _, _, role, x in own]
        assert r.said == "".join(x for _, _, role, x in own if role == "assistant")
        blocks = sum(k == 0 or own[k - 1][2] != own[k][2] for k in range(len(own)))
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == blocks
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_a_long_chat(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t}", "", "", "") for t in range(2000)]
    from pyspark.sql import functions as F

    row = chat.format_chats(chats(spark, rows)).select(F.size(chat.read_chat(F.col("formatted"))), F.size("loss")).first()
    assert tuple(row) == (2000, 667)


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://WWW.Example.com/en/1?x=/fr/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("http://a.net/fr", "a.net", "/fr", None, "allow"),
    ("http://library.org", "library.org", "", None, "allow"), ("http://x.com", "x.com", "", None, "allow"),
    ("http://a.org?u=http://b.net/es/", "a.org", "", None, "allow"), ("no scheme.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("", "", "", None, "allow"), ("x://", "", "", None, "allow")])
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "h", "p", "r"), (1, url, "h", "p", "r")], "page_id long, url string, host string, path string, rule string")
    got = urls.judge(df, [0.0] * urls.BUCKETS + [-1.0]).collect()
    assert len(got) == 2 and tuple(got[0])[1:5] == (host, path, rule, verdict)


@pytest.fixture(scope="module")
def weights(spark):
    return urls.train(urls.labelled_urls(spark))


def plain_features(url):
    """Buckets of a url by a plain loop over its host and path."""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    found = set()
    for text in ("^" + host.lower() + "$", "/" + re.sub("[0-9]+", "0", path) + "$"):
        for n in urls.GRAMS:
            for i in range(len(text) - n + 1):
                value = xxhash.xxh64_intdigest(text[i : i + n].encode(), 42)
                found.add((value - (1 << 64) if value >> 63 else value) % urls.BUCKETS)
    return sorted(found)


def plain_bad(url, weights):
    found = plain_features(url)
    return 1 / (1 + math.exp(-(sum(weights[k] for k in found) / math.sqrt(max(1, len(found))) + weights[-1])))


def judged(spark, weights, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    return [r for _, r in sorted((r.page_id, r) for r in urls.judge(df, weights, rules=()).collect())]


def test_url_scores_and_verdicts_are_those_of_a_plain_loop(spark, weights):
    texts = [u for u, _ in url_table.labelled()[::37]] + ["http://a", "x://q/" + "\U0001f600é" * 9, "http://H.org/" + "Ab1" * 500]
    for text, row in zip(texts, judged(spark, weights, texts)):
        want = plain_bad(text, weights)
        assert abs(row.bad - want) < 1e-5 and row.verdict == ("block" if row.bad >= urls.BLOCK else "allow")


def test_url_training_is_plain_gradient_descent(spark):
    rows = url_table.labelled()[::60]
    got = urls.train(spark.createDataFrame(rows, "url string, bad int"), 4)
    found, want, met = [plain_features(u) for u, _ in rows], [0.0] * (urls.BUCKETS + 1), [0.0] * (urls.BUCKETS + 1)
    for _ in range(4):
        slope = [urls.DECAY * w for w in want]
        for (u, bad), buckets in zip(rows, found):
            miss = plain_bad(u, want) - bad
            slope[-1] += 0.2 * miss / len(rows)
            for k in buckets:
                slope[k] += miss / math.sqrt(len(buckets)) / len(rows)
        met = [m + g * g for m, g in zip(met, slope)]
        want = [w - urls.RATE * g / math.sqrt(m + 1e-12) for w, g, m in zip(want, slope, met)]
    assert max(abs(x - y) for x, y in zip(got, want)) < 1e-3


def rates(rows, wanted):
    blocked = [r.verdict == "block" for r in rows]
    hits = sum(b and w for b, w in zip(blocked, wanted))
    return hits / sum(blocked), hits / sum(wanted), (sum(blocked) - hits) / (len(rows) - sum(wanted))


def test_url_classifier_on_neutral_words_and_domains_held_out(spark):
    neutral, endings = url_table.NEUTRAL, url_table.ENDINGS
    known = spark.createDataFrame(url_table.labelled(neutral=neutral[::2], endings=endings[::2]), "url string, bad int")
    new = url_table.labelled(neutral=neutral[1::2], endings=endings[1::2])
    precision, recall, false = rates(judged(spark, urls.train(known), [u for u, _ in new]), [b for _, b in new])
    assert precision > 0.95 and recall > 0.9 and false < 0.03


def test_url_classifier_lets_names_pass_that_it_has_not_seen(spark):
    def taken(name):
        return zlib.crc32(name.encode()) % 4 != 0

    new = url_table.labelled(lambda name: not taken(name))
    precision, recall, false = rates(
        judged(spark, urls.train(urls.labelled_urls(spark, taken)), [u for u, _ in new]), [b for _, b in new])
    assert precision > 0.8 and recall > 0.3 and false < 0.08


def test_url_classifier_reads_the_registered_name_and_those_below(spark, weights):
    bad = ["http://casino-royal.org", "https://www.discount-pills.net/de/1", "http://poker-stars.de/", "http://pharmacy-discount.net",
           "http://m.payday-loans.co.uk/", "http://a.b.viagra-shop.org/x", "http://spam-farm.example.org/en/1", "https://ads-track.site.org/en/2"]
    good = ["http://alphabets.org", "https://docs.python.org/3/library/", "http://www.theatre.net/de/1", "http://free-software.org/",
            "https://www.bbc.co.uk/news", "http://a.b.schools.org/x", "http://essexfarms.example.org/", "https://specialist-clinic.de/"]
    assert [r.verdict for r in judged(spark, weights, bad + good)] == ["block"] * len(bad) + ["allow"] * len(good)


def test_a_very_long_url(spark, weights):
    rows = judged(spark, weights, ["http://" + "museum." * 30_000 + "org/" + "en/" * 100_000, "http://library.org/?" + "x" * 500_000])
    assert [r.verdict for r in rows] == ["allow", "allow"]


def test_url_features_are_the_grams_of_host_and_path(spark):
    from pyspark.sql import functions as F

    texts = ("^www.casino-win.org$", "//de/0$")
    grams = [(t[i : i + n],) for t in texts for n in urls.GRAMS for i in range(len(t) - n + 1)]
    want = {r[0] for r in spark.createDataFrame(grams, "g string").select(F.expr(f"cast(pmod(xxhash64(g), {urls.BUCKETS}) as int)")).collect()}
    df = spark.createDataFrame([("www.casino-win.org", "/de/77")], "host string, path string")
    got = df.select(urls.features(F.col("host"), F.col("path"))).first()[0]
    assert len(got) == len(set(got)) and set(got) == want


def test_urls_of_nothing(spark, weights):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), weights).count() == 0
    assert urls.train(spark.createDataFrame([], "url string, bad int")) == [0.0] * (urls.BUCKETS + 1)
    assert len(urls.train(spark.createDataFrame([(None, 1), ("x", None), ("http://a.b/c", 0)], "url string, bad int"), 2)) == urls.BUCKETS + 1
