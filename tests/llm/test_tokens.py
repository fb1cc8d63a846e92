import random
import tempfile
import tracemalloc
import zlib

import cases
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from granary.llm import byte_bpe, piece_counts, token_files
from granary.session import scratch_path


@pytest.fixture(scope="module")
def code():
    return byte_bpe.coder(cases.RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(code):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.bpe.ranks, special_tokens={})


@pytest.mark.parametrize("values", [
    [], [0], [5, 5, 5], [0, 1, 2, 3], list(range(0, 400_000, 37)), [10**12, 10**15], [0] * 5000 + [2**62], [7] * 300 + list(range(9, 9000))])
def test_elias_fano_gives_back_and_selects(values):
    made = token_files.EliasFano.of(np.array(values, np.int64))
    read = token_files.EliasFano.from_bytes(made.to_bytes())
    assert [read.select(i) for i in range(len(values))] == values
    for i in range(0, len(values), 97):
        for n in (1, 96, 256, 700):
            assert read.span(i, min(i + n, len(values))).tolist() == values[i : i + n]
    assert read.span(0, len(values)).tolist() == values


def test_elias_fano_of_ids_from_end_to_end_of_their_range():
    values = [-(1 << 63), -5, 0, 0, (1 << 63) - 1]
    read = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.int64), values[0]).to_bytes())
    assert [int(v) + values[0] for v in read.span(0, 5)] == values


def test_elias_fano_packs_in_pieces():
    values = np.arange(0, 40_000_000, 40)
    tracemalloc.start()
    code = token_files.EliasFano.of(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(code.to_bytes()) + 8_000_000


def test_shards_follow_from_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)] + [(-1, None)], "doc_id long, text string")
    size = 100 * 1000 + 101 * token_files.ROW
    monkeypatch.setattr(token_files, "SHARD", 10_000)
    assert token_files.shard_count(docs, "text") == -(-size // 10_000)
    monkeypatch.setattr(token_files, "FILES", 3)
    assert token_files.shard_count(docs, "text") == 3
    monkeypatch.setattr(token_files, "SHARD_MOST", 20_000)
    assert token_files.shard_count(docs, "text") == -(-size // 20_000)
    assert token_files.shard_count(docs.limit(0), "text") == 1


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(0).integers(0, 5_000_000, 10_000))
    assert len(token_files.EliasFano.of(values).to_bytes()) * 8 < 10_000 * (3 + np.log2(500)) + 4000


@pytest.mark.parametrize("shards", [1, 5])
@pytest.mark.parametrize("by_space", [True, False])
def test_token_files_hold_whole_texts_in_order(spark, shards, by_space):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(cases.WORDS)
    tokenizer.encode_special_tokens = True
    place = scratch_path(spark, "tokens")
    table = token_files.write_token_files(cases.documents(spark), place, cases.WORDS, 1, by_space, shards)
    got = token_files.read_token_files(spark, place, table, block=100).orderBy("start").collect()
    rows = sorted(cases.texts(), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    want, at = [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    file = token_files.ShardFile(token_files.shard_uri(place, 0))
    spans = [file.bounds(k, k + 1) for k in range(file.n_docs)]
    assert [zlib.crc32(file.tokens(*s).astype("<u4").tobytes()) for s in spans] == [zlib.crc32(w[3]) for w in want[: len(spans)]]


def test_token_files_of_nothing(spark):
    place = scratch_path(spark, "tokens")
    table = token_files.write_token_files(cases.empty(spark), place, cases.WORDS, 1, True, 3)
    assert token_files.read_token_files(spark, place, table).collect() == []


def test_a_tokenizer_that_merges_over_spaces_is_refused(spark):
    place = scratch_path(spark, "tokens")
    with pytest.raises(Exception, match="word by word"):
        token_files.write_token_files(cases.documents(spark), place, public_tokenizers.path("byte_bpe_50k.json"), 1, True, 2)


def test_words_are_compared_over_the_whole_task(monkeypatch):
    cache = token_files.WordCache(cases.WORDS, True)
    seen, whole = [], cache.whole
    monkeypatch.setattr(cache, "whole", lambda texts: seen.extend(texts) or whole(texts))
    monkeypatch.setattr(token_files, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {
        "partitionId": lambda self: 0, "taskAttemptId": lambda self: 0})())}))
    texts = [f"plain{k}" for k in range(1024)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(1024)), "text": texts})
    with tempfile.TemporaryDirectory() as folder:
        list(token_files.write_shard(iter([batch]), folder, cache, 1))
    assert {texts.index(t) // 256 for t in seen if t in texts} == {0, 1, 2, 3}


def test_byte_bpe_is_the_library_s(spark, library):
    encoded = byte_bpe.encode_texts(cases.documents(spark), cases.RANKS, public_tokenizers.PATTERN, keep=["source"])
    decoded = byte_bpe.decode_ids(encoded, cases.RANKS, public_tokenizers.PATTERN, keep=["ids", "source"])
    want = sorted(((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in cases.texts()), key=cases.key)
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in decoded.collect()), key=cases.key)
    assert got == want and decoded.columns == ["doc_id", "ids", "source", "decoded"]
    both = byte_bpe.encode_texts(cases.documents(spark), cases.RANKS, public_tokenizers.PATTERN, decode=True)
    assert sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both.collect()), key=cases.key) == want
    assert byte_bpe.encode_texts(cases.empty(spark), cases.RANKS, public_tokenizers.PATTERN).count() == 0


def test_random_texts(code, library):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab \n\t'sé1日\u3000,.The") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    for text, ids in zip(made, code.encode(made)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(code, library):
    rng = random.Random(6)
    for _ in range(60):
        text = byte_bpe.EncodedText(code, "".join(rng.choice("ab c\n'sé1tion the ") for _ in range(rng.randint(0, 80))))
        for _ in range(4):
            start = rng.randint(0, len(text.text))
            text.edit(start, rng.randint(start, min(len(text.text), start + 9)), "".join(rng.choice("ab c\n'sé1") for _ in range(5)))
            text.append(rng.choice(["", " the", "tion"]))
            assert text.ids() == library.encode_ordinary(text.text)


def test_a_long_piece_is_redone_only_near_the_edit(code):
    piece = b"thetionanderingly" * 40
    last = code.bpe.extend(piece, [])
    text, fresh = code.bpe.edit(piece, last, 100, 103, b"xyz")
    assert fresh == code.bpe.extend(text, [])


def test_piece_counts_follow_the_unigram_tokenizer(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=cases.PIECES)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    unigram = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    got = piece_counts.count_pieces(cases.documents(spark), cases.PIECES)
    want = [(i, len(unigram.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in cases.texts()]
    assert sorted([(r.doc_id, r.n_pieces) for r in got.collect()], key=cases.key) == sorted(want, key=cases.key)
    assert piece_counts.count_pieces(cases.empty(spark), cases.PIECES).count() == 0


def test_ties_prefer_the_longest_last_piece():
    counter = piece_counts.PieceCounter([("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abb", -3.0)], False)
    assert counter.count("abb") == (-3.0, 2)
    assert counter.count("??a") == (counter.unknown * 2 - 1.0, 3)  # the space, one run of unknown characters, a
