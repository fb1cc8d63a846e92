"""Token counts of a unigram vocabulary by a Viterbi pass that carries only the best score and the number of pieces.

An Aho-Corasick automaton names every vocabulary piece that ends at a character; the longest comes first. A later, shorter
one replaces it only by a strictly better score, which is the tie rule of the unigram tokenizers. A character that is no
piece of its own costs the lowest score less 10. With byte fallback it counts as its UTF-8 bytes, else a run of such
characters counts once. Spaces become U+2581 and a text starts with one.

If no piece of the vocabulary has U+2581 behind another character, no piece crosses the border before a word, so the best
path is the best paths of the words, one after the other, and words seen before are looked up.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from granary.llm.common import Kept, map_texts

SPACE = "▁"
UNKNOWN = 10.0


class PieceCounter:
    WORDS = 300_000

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.byte_fallback = byte_fallback
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.known: Kept = Kept(self.WORDS)

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces; characters are the positions."""
        score: list[float] = [0.0]
        count = [0]
        fused = [False]
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, found in self.automaton.iter(text):
            ends.setdefault(end, []).append(found)
        for at, char in enumerate(text):
            best, pieces, from_unknown, single = None, 0, False, False
            for length, value in ends.get(at, ()):
                start = at + 1 - length
                single = single or length == 1
                new = score[start] + value
                if best is None or new > best:
                    best, pieces = new, count[start] + 1
            if not single:
                new = score[at] + self.unknown
                if best is None or new > best:
                    best, from_unknown = new, True
                    size = len(char.encode("utf-8", "replace")) if self.byte_fallback else int(not fused[at])
                    pieces = count[at] + size
            score.append(best)
            count.append(pieces)
            fused.append(from_unknown)
        return score[-1], count[-1]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.viterbi(text)
        score, pieces, known = 0.0, 0, self.known
        for word in self.word.findall(text):
            got = known.get(word)
            if got is None:
                got = known[word] = self.viterbi(word)
            score += got[0]
            pieces += got[1]
        return score, pieces


@lru_cache(2)
def counter(path: str, byte_fallback: bool) -> PieceCounter:
    """The pieces of a sentencepiece model with their scores; control and byte pieces cannot be matched as text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return PieceCounter(
        [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
         if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))], byte_fallback)


def count_pieces(
    docs: DataFrame, path: str, byte_fallback: bool = True, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per row of docs: the id, n_pieces long and best_score double of the whole text. No shuffle.

    Null and empty texts have no pieces and score 0. Repeated rows stay repeated; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_column]

    def rows(ids, texts):
        count = counter(path, byte_fallback).count
        for i, text in zip(ids, texts):
            score, pieces = count(text)
            yield i, pieces, score

    return map_texts(docs, [id_column, text_column], f"`{id_column}` {kind}, n_pieces long, best_score double", rows)
