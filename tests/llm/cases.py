"""Small tables with every awkward case, and plain versions of what the operators compute."""

import random
import re

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Columns whose names the operators use inside or give out themselves.
CLASHES = ("n_words", "ids", "key", "node", "c", "digest", "component", "kept", "start", "id", "rule", "host", "a", "b", "item",
           "grade", "block", "window", "formatted", "n", "pivot", "shard", "base", "print", "fingerprint", "first", "component_id", "least",
           "part", "mask", "step", "good", "toxic", "form", "output", "prefix_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ti", "on", "er", "the", "an", "é", "wh", "Ed"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def texts():
    base = prose(1)
    near = base.split(" ")
    near[5] = "changed"
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, prose(2, 60)), (5, None), (6, ""), (7, " \t\n\x0b "),
        (8, prose(3, 30_000)), (9, "one"), (10, "two words"), (11, "a  b \n\n c\x85d\u3000e\u00a0f  "), (12, prose(2, 60)),
        (13, "x|y ### $$$ *** " * 30), (14, "Same line here\n" * 40 + prose(4, 20)), (15, "ab " * 200),
        (16, "Licensed under CC BY-NC 4.0. " + prose(5, 20) + " All rights reserved. cc by cc by"), (17, "ÀÉ İ ẞ ﬀ \u0301x 日本語 <|endoftext|> can't"),
        (18, "\x00 \x01 nul"), (None, base), (None, None), (None, prose(6)), (-4, prose(7)), (19, prose(8).upper())]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t else None, *["clash"] * len(CLASHES)) for i, t in rows], SCHEMA)


def empty(spark):
    return documents(spark, [])


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def key(row):
    return tuple((x is not None, x) for x in row)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
