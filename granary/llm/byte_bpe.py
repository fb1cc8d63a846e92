"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes exactly one token can end its encoding. A token ends the prefix of length i if the
token before it, the stored one of the shorter prefix, may stand beside it, that is, if no merge crosses their border.
Storing that last token for each prefix makes appending exact, and after an edit only the bytes from the edit to the
point where the stored tokens agree again are done anew.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from granary.llm.common import Kept

NEVER = 1 << 60
#: Bytes of texts or ids that are handled at a time, about.
MOST = 3_000_000
ONE = (1,)
STOPS = (",", ".")
#: Behind the Latin letters whose classes no Unicode version has changed.
LATIN_END = "\u0250"


class PrefixBpe:
    """Encoder of byte pieces over mergeable ranks (token bytes -> rank, which is also the id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = max(ranks.values()) + 1
        self.sizes = {r: len(t) for t, r in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-3:], set()).add(len(token))
        for end in list(lengths):  # a prefix that ends with these bytes ends with their own endings, too
            lengths[end] |= lengths.get(end[-2:], set()) | lengths.get(end[-1:], set())
        #: By the last three bytes of a prefix: how long the tokens are that can end it, the longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.pairs: Kept = Kept(500_000)
        # the automaton: its states as bytes and by number, their tokens, the known moves (state << 8 | byte)
        self.begins: set[bytes] = set()
        self.state_bytes, self.state_of, self.state_ends = [b""], {b"": 0}, [()]
        self.moves: dict[int, int] = {}
        self.spines: dict[int, tuple[list, list]] = {}

    def merged(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """Plain merging of the lowest rank first, by ranks under a bound: only used to take tokens apart."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list]:
        """The tokens that stood at the left and right edge while token grew: (bytes, made at, merged away at)."""
        if token not in self.spines:
            sides = []
            for last in (0, -1):
                edge, data, gone = [], self.bytes_of[token], NEVER
                while True:
                    rank = self.ranks[data]
                    edge.append((data, rank if len(data) > 1 else -1, gone))
                    if len(data) == 1:
                        break
                    parts = self.merged(data, rank)
                    if len(parts) != 2:  # no merge makes it; it only stands for a whole piece
                        edge = []
                        break
                    data, gone = parts[last], rank
                sides.append(edge)
            self.spines[token] = (sides[0], sides[1])
        return self.spines[token]

    def beside(self, a: int, b: int) -> bool:
        """Whether a, b stay as they are when their bytes are encoded together."""
        known = self.pairs.get(a * self.size + b)
        if known is None:
            right, left = self.edges(a)[1], self.edges(b)[0]
            known = bool(right and left)
            for x, made_x, gone_x in right:
                for y, made_y, gone_y in left:
                    rank = self.ranks.get(x + y)
                    # equal ranks merge from the left, so the left part's own merge wins a tie and the right part's loses
                    if rank is not None and rank < gone_x and rank <= gone_y and made_x < gone_y and made_y < gone_x:
                        known = False
            self.pairs[a * self.size + b] = known
        return known

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """last[i] is the token that ends the first i + 1 bytes; it is continued to the whole piece.

        Any order of trying gives the same token, as only one is right; the token before, one byte longer, is the likeliest.
        """
        ranks, pairs, lengths, size, sizes = self.ranks.get, self.pairs, self.lengths, self.size, self.sizes
        at = len(last)
        begin = at - sizes[last[-1]] if last else 0
        for end in range(at + 1, len(piece) + 1):
            token = ranks(piece[begin:end])
            if token is not None:
                if not begin:
                    last.append(token)
                    continue
                pair = last[begin - 1] * size + token
                if pairs[pair] if pair in pairs else self.beside(last[begin - 1], token):
                    last.append(token)
                    continue
            tail = piece[max(0, end - 3) : end]
            for length in lengths.get(tail) or lengths.get(tail[-2:]) or ONE:
                start = end - length
                if start < 0 or start == begin:
                    continue
                token = ranks(piece[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start - 1] * size + token
                    if not (pairs[pair] if pair in pairs else self.beside(last[start - 1], token)):
                        continue
                last.append(token)
                begin = start
                break
            else:
                raise ValueError(f"no token for byte {piece[end - 1]}")
        return last

    def moved(self, state: int, byte: int) -> int:
        """The state behind a byte. A state stands for the longest end of the bytes so far that begins a token."""
        if not self.begins:
            self.begins = {t[:n] for t in self.ranks for n in range(len(t) + 1)}
        data = self.state_bytes[state] + bytes([byte])
        while data not in self.begins:
            data = data[1:]
        if data not in self.state_of:
            self.state_of[data] = len(self.state_bytes)
            self.state_bytes.append(data)
            ends = [data[at:] for at in range(len(data))]
            self.state_ends.append(tuple((len(t), self.ranks[t]) for t in ends if t in self.ranks))
        self.moves[state << 8 | byte] = self.state_of[data]
        return self.state_of[data]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Encodings of many pieces, as by extend. In ascending order each continues the prefix it shares with the one
        before; an automaton, built as far as it is needed, names the tokens that end at a byte, the longest first."""
        moves, ends, known, size, sizes = self.moves, self.state_ends, self.pairs.get, self.size, self.sizes
        found: dict[bytes, list[int]] = {}
        before, last, states = b"", [], []
        for piece in sorted(pieces):
            same = 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                same += 1
            del last[same:], states[same:]
            before, state = piece, states[-1] if same else 0
            for at in range(same, len(piece)):
                next_state = moves.get(state << 8 | piece[at])
                state = self.moved(state, piece[at]) if next_state is None else next_state
                states.append(state)
                for length, token in ends[state]:
                    if length <= at:
                        left = last[at - length]
                        good = known(left * size + token)
                        if not (self.beside(left, token) if good is None else good):
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError(f"no token for byte {piece[at]}")
            if piece in self.ranks:
                found[piece] = [self.ranks[piece]]
                continue
            tokens, at = [], len(piece)
            while at:
                token = last[at - 1]
                tokens.append(token)
                at -= sizes[token]
            tokens.reverse()
            found[piece] = tokens
        return [found[p] for p in pieces]

    def tokens(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.extend(piece, []))

    def edit(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """piece with [start, stop) replaced by new, and its prefix tokens; stops where the old ones hold again."""
        out = piece[:start] + new + piece[stop:]
        shift = len(out) - len(piece)
        fresh = last[:start]
        agree = 0
        while len(fresh) < len(out):
            self.extend(out[: len(fresh) + 1], fresh)
            at = len(fresh) - 1
            old = at - shift
            agree = agree + 1 if old >= stop and last[old] == fresh[at] else 0
            if agree >= self.longest:
                return out, fresh + last[old + 1 :]
        return out, fresh


class TextBpe:
    """Texts: each match of a pattern is a piece of its own, as in tiktoken. Ids come as little-endian 32-bit integers."""

    WORDS = 500_000

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = PrefixBpe(ranks)
        # the Unicode white space of the pattern's own engine
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        #: Ids by word, meant with a space before it; None for what white space touches, which depends on its surroundings.
        self.words: dict[str, bytes | None] = {}
        #: Whether letters with a space before them are one piece.
        self.letters = self.pattern.findall(" abé Xy") == [" abé", " Xy"]
        #: Whether a space between two other characters always starts a piece; only then texts are cut there.
        self.cuts = self.pattern.findall("a b, c's 1 2.") == ["a", " b", ",", " c", "'s", " 1", " 2", "."]

    def split(self, text: str) -> list[str]:
        return [m.group() for m in self.pattern.finditer(text)]

    def one_piece(self, word: str) -> bool:
        """Whether the word with a space before it needs no matching: only Latin letters."""
        return self.letters and word.isalpha() and (word.isascii() or max(word) < LATIN_END)

    def each(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that each start where a piece starts; pieces they share are encoded once."""
        split = [self.split(t) for t in texts]
        pieces = list({p for ps in split for p in ps})
        found = self.bpe.encode_all([p.encode("utf-8", "replace") for p in pieces])
        known = {p: array("i", ids).tobytes() for p, ids in zip(pieces, found)}
        return [b"".join(map(known.__getitem__, ps)) for ps in split]

    def learn(self, words: set[str]) -> None:
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.WORDS:
            self.words = {w: known[w] for w in words if w in known}  # what is in use stays
        cut, plain, mixed = [], set(), set()
        for word in new:
            if not word or word[0].isspace() or word[-1].isspace():
                self.words[word] = None
            elif word[-1] in STOPS and word[-2:-1].isalnum():
                # the stop behind a letter or digit is a piece of its own, so the word without it is enough
                cut.append(word)
                word = word[:-1]
                if word not in self.words:
                    (plain if self.one_piece(word) else mixed).add(word)
            else:
                (plain if self.one_piece(word) else mixed).add(word)
        letters, other = list(plain), list(mixed)
        found = self.bpe.encode_all([f" {w}".encode() for w in letters])
        self.words.update(zip(letters, [array("i", ids).tobytes() for ids in found]))
        self.words.update(zip(other, self.each([" " + w for w in other])))
        stops = dict(zip(STOPS, self.each(list(STOPS))))
        self.words.update({w: self.words[w[:-1]] + stops[w[-1]] for w in cut})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts. Words seen before are looked up; texts with runs of white space are matched as they are."""
        texts = [t or "" for t in texts]
        if not self.cuts:
            return self.each(texts)
        split = [t.split(" ") for t in texts]
        heads = [ws.pop(0) for ws in split]
        self.learn(set(chain.from_iterable(split)))
        out: list[bytes | None] = []
        for head, ids, words in zip(heads, self.each(heads), split):
            try:
                if words and (not head or head[-1].isspace()):
                    raise TypeError
                out.append(ids + b"".join(map(self.words.__getitem__, words)))
            except TypeError:  # a None among them
                out.append(None)
        whole = iter(self.each([t for t, ids in zip(texts, out) if ids is None]))
        return [next(whole) if ids is None else ids for ids in out]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its pieces and their prefix tokens, which can be appended to and edited exactly."""

    def __init__(self, coder: TextBpe, text: str = ""):
        self.coder, self.text = coder, text
        self.parts = [(p, coder.bpe.extend(p.encode(), [])) for p in coder.split(text)]

    def ids(self) -> list[int]:
        bpe = self.coder.bpe
        return [i for p, last in self.parts
                for i in ([bpe.ranks[p.encode()]] if p.encode() in bpe.ranks else bpe.tokens(last))]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters [start, stop). Pieces well before the edit stay, and so do those behind it from the first
        place where old and new pieces begin together; a piece that only grew is continued from its stored tokens."""
        text = self.text[:start] + new + self.text[stop:]
        shift = len(text) - len(self.text)
        keep, at, spans = [], 0, []
        for part in self.parts:
            spans.append((at, part))
            at += len(part[0])
        for begin, part in spans:
            if begin + len(part[0]) >= start:  # a match is decided by at most one character behind it
                break
            keep.append(part)
        begin = sum(len(p) for p, _ in keep)
        rest = {b + shift: k for k, (b, _) in enumerate(spans) if b >= stop}
        before = self.parts[len(keep)] if len(keep) < len(self.parts) else None
        for match in self.coder.pattern.finditer(text, begin):
            if match.start() > start + len(new) and match.start() in rest:
                keep += [part for _, part in spans[rest[match.start()] :]]
                break
            piece = match.group().encode()
            if before and match.start() == begin and piece.startswith(old := before[0].encode()):
                keep.append((match.group(), self.coder.bpe.extend(piece, before[1][: len(old)])))
            else:
                keep.append((match.group(), self.coder.bpe.extend(piece, [])))
        self.text, self.parts = text, keep


@lru_cache(2)
def coder(path: str, pattern: str) -> TextBpe:
    return TextBpe(path, pattern)


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None,
    decode: bool = False,
) -> DataFrame:
    """One row per row of docs: the id column, the columns in keep, and ids array<int> of the whole text.

    decode=True adds decoded, the bytes that the ids stand for, without sending the ids to another worker first.
    No shuffle; rows stay in their partitions. Null and empty texts have no ids. Repeated rows stay repeated. Other
    columns are ignored. path is a rank file that every executor can open.
    """
    made = {"ids": "array<int>"} | ({"decoded": "binary"} if decode else {})
    return _mapped(docs, [id_column, *(keep or [])], text_column, made, lambda texts: encoded(coder(path, pattern), texts, decode))


def decode_ids(
    encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids", keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of encoded: the id column, the columns in keep, and decoded (bytes). Null ids give no bytes."""
    return _mapped(encoded, [id_column, *(keep or [])], ids_column, {"decoded": "binary"},
                   lambda ids: [decoded(coder(path, pattern), ids)])


def encoded(code: TextBpe, texts: pa.Array, decode: bool) -> list[pa.Array]:
    data = code.encode(texts.to_pylist())
    ends = np.cumsum([0, *(len(d) // 4 for d in data)], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
    return [ids, decoded(code, ids)] if decode else [ids]


def decoded(code: TextBpe, ids: pa.Array) -> pa.Array:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([code.decode(values[a:b].tolist()) if k else b"" for a, b, k in zip(ends, ends[1:], known)], pa.binary())


def _mapped(df: DataFrame, keep: list[str], column: str, made: dict[str, str], make) -> DataFrame:
    """keep and new columns made from another one, some megabytes at a time."""
    source = df.select(*keep, df[column].alias("__in"))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {kind}" for c, kind in made.items())])
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * MOST / max(MOST, batch.columns[-1].nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.columns[-1])], names)

    return source.mapInArrow(run, schema)
