"""Licence scan by a positional rare-token index over licence names, notices and passages of licence texts.

Every template is an array of words; the words that few licences share are its postings (word, template, position), weighted
by inverse document frequency among the licences (labels; a licence has several templates). A file looks up its own words
among them: each hit votes for (template, file position - template position). Votes for shifts in a window of SLACK words
make one aligned occurrence, each posting once, so a word more or less does not part it. A template's share is the weight of
its best occurrence over the weight of all its postings. It labels the file if that share reaches a threshold and all its
mandatory key phrases stand in the file.

Phrases that stand for themselves ("cc by", ...) are found at all places. Everything is one row expression: no shuffle.
Words are runs of [0-9a-z] and characters from U+0080 on, A-Z lower-cased.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases that have to stand in the file, each one.
    keys: tuple[str, ...]


#: Names, short identifiers, notices and passages of public licences.
TEMPLATES = (
    Template("agpl", "GNU Affero General Public License", ("affero general public license",)),
    Template("agpl", "AGPL-3.0", ("agpl 3 0",)),
    Template("apache-2.0", "Apache License 2.0", ("apache license",)),
    Template("apache-2.0", "Apache License, Version 2.0", ("apache license",)),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("apache 2 0",)),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
             "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
             ("unless required by applicable law or agreed to in writing",)),
    Template("boost", "Boost Software License 1.0", ("boost software license",)),
    Template("bsd", "BSD License", ("bsd license",)),
    Template("bsd", "BSD 2-Clause License", ("bsd 2 clause",)),
    Template("bsd", "BSD 3-Clause License", ("bsd 3 clause",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met", ("source and binary forms",)),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
             "following disclaimer", ("redistributions of source code",)),
    Template("cc-by", "Creative Commons Attribution 4.0", ("creative commons attribution 4 0",)),
    Template("cc-by", "Creative Commons Attribution License", ("creative commons attribution license",)),
    Template("cc-by-nc", "CC BY-NC", ("cc by nc",)),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "CC BY-SA", ("cc by sa",)),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike", ("creative commons attribution sharealike",)),
    Template("cc0", "CC0 1.0", ("cc0 1 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
             "to this work", ("related or neighboring rights",)),
    Template("epl", "Eclipse Public License", ("eclipse public license",)),
    Template("gpl", "GNU General Public License", ("gnu general public license",)),
    Template("gpl", "GPL-2.0", ("gpl 2 0",)),
    Template("gpl", "GPL-3.0", ("gpl 3 0",)),
    Template("gpl", "GPLv2", ("gplv2",)),
    Template("gpl", "GPLv3", ("gplv3",)),
    Template("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("isc", "ISC License", ("isc license",)),
    Template("isc", "SPDX-License-Identifier: ISC", ("identifier isc",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is "
             "hereby granted", ("with or without fee",)),
    Template("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    Template("lgpl", "LGPL-2.1", ("lgpl 2 1",)),
    Template("lgpl", "LGPL-3.0", ("lgpl 3 0",)),
    Template("mit", "MIT License", ("mit license",)),
    Template("mit", "MIT Licence", ("mit licence",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("identifier mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files, to deal in the Software without restriction",
             ("permission is hereby granted", "without restriction")),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
             "portions of the Software", ("this permission notice",)),
    Template("mpl-2.0", "Mozilla Public License", ("mozilla public license",)),
    Template("mpl-2.0", "MPL-2.0", ("mpl 2 0",)),
    Template("unlicense", "The Unlicense", ("the unlicense",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("zlib", "zlib License", ("zlib license",)),
)
#: Words that more licences than this share are no rare tokens; the share of a template's weight that must line up; words that
#: may be missing or inserted between them.
RARE, SHARE, SLACK = 3, 0.7, 2


class Posting(NamedTuple):
    word: str
    template: int
    position: int
    weight: int


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def postings(templates: tuple[Template, ...]) -> list[Posting]:
    """The rarer words of every template with their positions; weights are thousandths of the idf over the licences."""
    found = [template_words(t.text) for t in templates]
    labels = {t.label for t in templates}
    shared = Counter(w for _, w in {(t.label, w) for t, ws in zip(templates, found) for w in ws})
    return [Posting(w, k, i, round(1000 * math.log(1 + len(labels) / shared[w])))
            for k, ws in enumerate(found) for i, w in enumerate(ws) if shared[w] <= RARE]


def weights(templates: tuple[Template, ...]) -> list[int]:
    total: Counter = Counter()
    for p in postings(templates):
        total[p.template] += p.weight
    return [total[k] for k in range(len(templates))]


def spaced(text: Column) -> Column:
    """The words of a text with one space before, between and after them; one space if there are none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inner = F.btrim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def count_words(line: Column) -> Column:
    """Words of a spaced text, or of the part of it before a word."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) - 1


def phrase_places(line: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase in a spaced text: how often, and the smallest and largest word it starts at."""
    key = f" {phrase} "
    # neighbouring occurrences share a space, so they are counted with every space doubled
    doubled = F.replace(line, F.lit(" "), F.lit("  "))
    twice = " " + phrase.replace(" ", "  ") + " "
    n = F.floor((F.length(doubled) - F.length(F.replace(doubled, F.lit(twice), F.lit("")))) / len(twice))
    first = count_words(F.substring_index(line, key, 1)) + 1
    tail = F.substring_index(doubled, twice, -1)
    last = (F.length(doubled) - F.length(tail) - len(twice) - 1)
    head = F.substr(doubled, F.lit(1), last + 1)
    last = F.floor((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2)
    return F.when(F.contains(line, F.lit(key)), F.struct(
        n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last")))


def _literal(entries: list[Posting]) -> Column:
    return F.array(*[F.struct(F.lit(p.word).alias("word"), F.lit(p.template).alias("template"),
                              F.lit(p.position).alias("position"), F.lit(p.weight).alias("weight")) for p in entries])


def aligned(line: Column, templates: tuple[Template, ...]) -> Column:
    """Per template: the weight of its best aligned occurrence among the file's words (array of long)."""
    entries = postings(templates)
    vocabulary = sorted({p.word for p in entries})
    found = F.filter(
        F.transform(F.split(line, " "), lambda w, i: F.when(w.isin(vocabulary), F.struct((i - 1).alias("at"), w.alias("word")))),
        lambda x: x.isNotNull())
    zero = F.array(*[F.lit(0).cast("long") for _ in templates])

    def votes(hit: Column) -> Column:
        mine = F.filter(_literal(entries), lambda p: p["word"] == hit["word"])
        return F.flatten(F.transform(mine, lambda p: F.array(*[F.struct(
            p["template"].alias("template"), (hit["at"] - p["position"] - d).alias("shift"), p["position"].alias("position"),
            p["weight"].alias("weight")) for d in range(SLACK + 1)])))

    def add(state: Column, vote: Column) -> Column:
        same = (state["template"] == vote["template"]) & (state["shift"] == vote["shift"])
        again = same & (state["position"] == vote["position"])
        run = F.when(again, state["run"]).when(same, state["run"] + vote["weight"]).otherwise(vote["weight"].cast("long"))
        return let(run, lambda r: F.struct(
            vote["template"].alias("template"), vote["shift"].alias("shift"), vote["position"].alias("position"), r.alias("run"),
            F.transform(state["best"], lambda b, k: F.when(k == vote["template"], F.greatest(b, r)).otherwise(b)).alias("best")))

    start = F.struct(F.lit(-1).alias("template"), F.lit(0).alias("shift"), F.lit(0).alias("position"), F.lit(0).cast("long").alias("run"), zero.alias("best"))
    return let(found, lambda hits: F.when(F.size(hits) == 0, zero).otherwise(
        F.aggregate(F.array_sort(F.flatten(F.transform(hits, votes))), start, add, lambda s: s["best"])))


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row of docs: the id, n_words, n_base (all places of the phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (both distinct, sorted, comma-joined), and score.

    score is 1 with a base label, else the best share of a template that labels the file, else 0.
    Null and empty texts have no words and no labels. Repeated rows stay repeated; other columns are ignored.
    """
    line = docs.select(docs[id_column], spaced(docs[text_column]).alias("__line"))
    places = [phrase_places(F.col("__line"), p).alias(f"__p{k}") for k, p in enumerate(phrases)]
    looked = line.select(id_column, "__line", count_words(F.col("__line")).cast("long").alias("n_words"), *places,
                         aligned(F.col("__line"), templates).alias("__best"))
    seen = [F.col(f"__p{k}") for k in range(len(phrases))]
    totals = weights(templates)
    shares = []
    for k, t in enumerate(templates):
        share = F.get("__best", k) / totals[k]
        keyed = share >= SHARE
        for key in t.keys:
            keyed = keyed & F.contains("__line", F.lit(f" {key} "))
        shares.append((t.label, F.when(keyed, share)))
    base = [F.when(p.isNotNull(), F.lit(label)) for p, label in zip(seen, phrases.values())]
    own = [F.when(share.isNotNull(), F.lit(label)) for label, share in shares]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    best = F.array_max(F.array_compact(F.array(*[s for _, s in shares])))
    any_base = F.coalesce(*base).isNotNull()
    return looked.select(
        id_column, "n_words", sum((F.coalesce(p["n"], F.lit(0)) for p in seen), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array_compact(F.array(*[p["first"] for p in seen]))).alias("first_word"),
        F.array_max(F.array_compact(F.array(*[p["last"] for p in seen]))).alias("last_word"),
        joined(base).alias("base_labels"), joined(base + own).alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(F.round(F.coalesce(best, F.lit(0.0)), 6)).alias("score"))


def sql(templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """The same rows in DuckDB's SQL, from words and joins."""
    index = ", ".join(f"('{p.word}', {p.template}, {p.position}, {p.weight})" for p in postings(templates))
    rules = ", ".join(
        f"({k}, '{t.label}', {total}, {list(t.keys)!r})" for k, (t, total) in enumerate(zip(templates, weights(templates))))
    base = ", ".join(f"({p.split()!r}, '{label}')" for p, label in phrases.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w),
b AS (SELECT doc_id, i, label FROM u, (VALUES {base}) AS p(ph, label) WHERE ws[i + 1:i + len(ph)] = ph),
bd AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
idx(word, template, pos, weight) AS (VALUES {index}),
rule(template, label, total, keys) AS (VALUES {rules}),
hits AS (SELECT DISTINCT doc_id, template, i - pos - unnest(range(0, {SLACK + 1})) AS shift, pos, weight FROM u JOIN idx ON ws[i + 1] = word),
votes AS (SELECT doc_id, template, sum(weight) AS got FROM hits GROUP BY doc_id, template, shift),
best AS (SELECT doc_id, template, max(got) AS got FROM votes GROUP BY ALL),
m AS (SELECT doc_id, label, CAST(got AS DOUBLE) / total AS share FROM best JOIN rule USING (template) JOIN w USING (doc_id)
      WHERE CAST(got AS DOUBLE) / total >= {SHARE}
        AND len([k FOR k IN keys IF contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || k || ' ')]) = len(keys)),
md AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(bd.n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(array_to_string(list_sort(bd.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(bd.labels, md.labels))), ','), '') AS labels,
       CASE WHEN bd.n IS NOT NULL THEN 1.0 ELSE round(coalesce(share, 0), 6) END::DOUBLE AS score
FROM w LEFT JOIN bd USING (doc_id) LEFT JOIN md USING (doc_id)
"""
