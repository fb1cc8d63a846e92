"""Fill-in-middle texts, with document cuts located by counts of content-defined chunks.

A rolling hash over the last 32 bytes ends a chunk wherever its upper bits are zero, so a passage that many texts share gives
the same chunks in each of them. What a cut needs to know of a chunk (its lines, its code points, where its lines end) is
computed once and kept in a bounded cache; a chunk is found there by its whole content, so a hit is always the same bytes.
Running sums over a text's chunk counts lead to the chunk of a cut, and the chunk's line ends to the byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Kept, utf8, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A chunk ends where this many upper bits of the rolling hash are zero (they depend on all 32 bytes): 1024 bytes on average.
CHUNK_BITS = 10
LEAST, MOST = 256, 8192
#: Chunks a worker remembers, with at most MOST bytes and as many line ends each.
MEMORY = 8192
#: Bytes hashed at once.
BLOCK = 1 << 20
GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, np.uint32)


@dataclass(frozen=True)
class Summary:
    """Code points of a chunk, where its lines end (bytes from its start), and the code points up to there."""

    points: int
    ends: np.ndarray
    points_at: np.ndarray


def summary(chunk: bytes) -> Summary:
    raw = np.frombuffer(chunk, np.uint8)
    ends = (np.flatnonzero(raw == 10) + 1).astype(np.uint16)
    first = raw & 0xC0 != 0x80
    if first.all():
        return Summary(len(raw), ends, ends)
    points = np.concatenate(([0], np.cumsum(first, dtype=np.uint16)))
    return Summary(int(points[-1]), ends, points[ends])


@lru_cache(1)
def remembered() -> dict[bytes, Summary]:
    """The summaries that this worker keeps from text to text."""
    return Kept(MEMORY)


def rolling(raw: np.ndarray) -> np.ndarray:
    """For every byte the hash of it and the 31 before it, by doubling the window five times."""
    out = GEAR[raw]
    for shift in (1, 2, 4, 8, 16):
        longer = out.copy()
        longer[shift:] += out[:-shift] << np.uint32(shift)
        out = longer
    return out


def boundaries(text: bytes) -> list[int]:
    """Ends of the text's chunks; all but the last are LEAST to MOST bytes long."""
    raw = np.frombuffer(text, np.uint8)
    cuts, at = [], 0
    for begin in range(0, len(raw), BLOCK):
        back = min(begin, 31)
        hashes = rolling(raw[begin - back : begin + BLOCK])[back:]
        for end in (np.flatnonzero(hashes >> np.uint32(32 - CHUNK_BITS) == 0) + begin + 1).tolist():
            while end - at > MOST:
                at += MOST
                cuts.append(at)
            if end - at >= LEAST:
                at = end
                cuts.append(at)
    while len(raw) - at > MOST:
        at += MOST
        cuts.append(at)
    if at < len(raw):
        cuts.append(len(raw))
    return cuts


class Chunked:
    """A text as the summaries of its chunks; memory is a dict from chunk bytes to summaries."""

    def __init__(self, text: bytes, memory: dict[bytes, Summary]):
        self.size = len(text)
        self.stops = boundaries(text)
        self.parts = []
        begin = 0
        for end in self.stops:
            chunk = text[begin:end]
            found = memory.get(chunk)
            if found is None:
                found = memory[chunk] = summary(chunk)
            self.parts.append(found)
            begin = end
        self.lines = np.cumsum([len(p.ends) for p in self.parts], dtype=np.int64)
        self.points = np.cumsum([p.points for p in self.parts], dtype=np.int64)
        closed = int(self.lines[-1]) if self.parts else 0
        self.n = closed + bool(text and not text.endswith(b"\n"))

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first units lines."""
        if units <= 0:
            return 0, 0
        if units > (self.lines[-1] if self.parts else 0):
            return self.size, int(self.points[-1]) if self.parts else 0
        c = int(np.searchsorted(self.lines, units))
        part = self.parts[c]
        i = units - 1 - (int(self.lines[c - 1]) if c else 0)
        byte, point = (self.stops[c - 1], int(self.points[c - 1])) if c else (0, 0)
        return byte + int(part.ends[i]), point + int(part.points_at[i])


def draws(doc_id: int) -> list[int]:
    """Four repeatable numbers of a document."""
    digest = hashlib.sha256(b"7:%d" % doc_id).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(
    doc_id: int | None, text: str | None, memory: dict[bytes, Summary], rate: int, spm_rate: int,
) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    raw = utf8(text)
    chunked = Chunked(raw, memory)
    plain = (chunked.n, "plain", None, None, text or "")
    if not raw or doc_id is None or any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return plain
    h1, h2, h3, h4 = draws(doc_id)
    if h3 % 100 >= rate:
        return plain
    low, high = sorted((h1 % (chunked.n + 1), h2 % (chunked.n + 1)))
    (p_byte, p_point), (m_byte, m_point) = chunked.cut(low), chunked.cut(high)
    prefix, middle, suffix = (
        raw[a:b].decode("utf-8", "surrogatepass") for a, b in ((0, p_byte), (p_byte, m_byte), (m_byte, len(raw))))
    if h4 % 100 < spm_rate:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return chunked.n, form, p_point, m_point - p_point, output


def fill_in_middle(
    docs: DataFrame, rate: int = 100, spm_rate: int = 50, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    rate percent of the documents are cut, spm_rate percent of these give the suffix first; both are drawn from the doc_id.
    Null and empty texts have no lines and stay plain, as an empty string; texts that contain a marker stay plain; rows without
    doc_id stay plain, as nothing can be drawn for them. Repeated rows give the same output each. An empty table gives no rows;
    other columns are ignored. No shuffle: rows stay in their partitions.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def rows(ids, texts) -> Iterator[tuple]:
        memory = remembered()
        for i, text in zip(ids, texts):
            yield transform(i, text, memory, rate, spm_rate)

    schema = "n long, form string, prefix_chars long, middle_chars long, output string"
    return with_columns(source, ["doc_id", "text"], schema, rows, keep=["doc_id"], step=256)


def restored(output: Column, form: Column) -> Column:
    """The exact text again, from the output and its form alone: the first of each marker is never text."""
    size = F.lit(len(PREFIX))

    def between(left: Column, right: Column) -> Column:
        return F.substr(output, left + size, right - left - size)

    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    last = F.substr(output, m + size)
    return (F.when(form == "psm", F.concat(between(p, s), last, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(output))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
             [CAST('0x' || substr(h, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS hs FROM d),
f AS (SELECT *, CASE WHEN h IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100
                     THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS lo,
             greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS hi FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m,
             array_to_string(units[hi + 1:], '') AS s FROM f)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
