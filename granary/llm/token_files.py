"""Token-id files: one concatenated id array per shard, document boundaries as Elias-Fano codes.

A shard file holds, little-endian: 8 bytes of magic; the ids of its documents, one after the other, 16 bits wide if the
vocabulary allows it, else 32; the Elias-Fano code of the document ids; that of the ends of the documents in the id
array; and a footer of fixed size. An Elias-Fano code of n values below u takes about n * (2 + log2(u / n)) bits and
answers "value i" from a sampled select structure, so no table of 64-bit offsets is stored.

Shards follow ascending doc_id, so the offset of a document among all documents is its shard's base plus its offset there.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import utf8

MAGIC = b"EFTOKEN1"
#: Documents, without id, with negative-safe smallest id, ids, their width in bytes, bytes of the two codes.
FOOTER = struct.Struct("<QQqQIQQ8s")
#: Every how many values the place of an upper bit is stored; values packed at a time, a multiple of it and of 8.
SAMPLE, PACK = 256, 4096
#: Shards hold this many bytes of text up to FILES of them, then more, at most SHARD_MOST; a document counts ROW bytes more.
SHARD, SHARD_MOST, FILES, ROW = 32 << 20, 1 << 30, 10_000, 256
STOPS = (b",", b".")
MARK = b"\x01"


class EliasFano:
    """Values in ascending order (repeats allowed) in near-minimal space, with select."""

    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, width: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.lower, self.upper, self.samples = n, width, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray, least: int = 0) -> EliasFano:
        """Code of values - least, where values are 64-bit integers; PACK values at a time, so nothing but the code grows."""
        n, base = len(values), np.uint64(least % (1 << 64))
        last = int(values[-1]) - least if n else 0
        width = min(63, max(0, ((last + 1) // n).bit_length() - 1)) if n else 0
        lower = []
        upper = np.zeros(((last >> width) + n - 1) // 8 + 1 if n else 0, np.uint8)
        samples = np.zeros(-(-n // SAMPLE), np.uint32)
        for at in range(0, n, PACK):
            part = values[at : at + PACK].astype(np.uint64) - base
            bits = (part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            lower.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
            ones = (part >> np.uint64(width)).astype(np.int64) + np.arange(at, at + len(part))
            np.bitwise_or.at(upper, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
            samples[at // SAMPLE : at // SAMPLE + -(-len(part) // SAMPLE)] = ones[::SAMPLE]
        return cls(n, width, np.concatenate(lower) if lower else np.zeros(0, np.uint8), upper, samples)

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.width, len(self.lower), len(self.upper))
        return head + self.lower.tobytes() + self.upper.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, low, up = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        lower = np.frombuffer(data, np.uint8, low, at)
        upper = np.frombuffer(data, np.uint8, up, at + low)
        return cls(n, width, lower, upper, np.frombuffer(data, "<u4", offset=at + low + up))

    def place(self, i: int) -> int:
        """Place of one number i among the upper bits, counted from the nearest sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.upper[byte]) & (0xFF << (at % 8))
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """Value i, without decoding the rest."""
        return int(self.span(i, i + 1)[0])

    def span(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: both ends are selected among the upper bits and only what lies between them is decoded."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = self.place(i) // 8, self.place(j - 1) // 8
        ones = np.flatnonzero(np.unpackbits(self.upper[first : last + 1], bitorder="little")) + first * 8
        skip = int(np.searchsorted(ones, self.place(i)))
        high = (ones[skip : skip + j - i] - np.arange(i, j)).astype(np.uint64) << np.uint64(self.width)
        low = i * self.width
        bits = np.unpackbits(self.lower[low // 8 : -(-j * self.width // 8)], bitorder="little")[low % 8 :]
        bits = bits[: (j - i) * self.width].reshape(j - i, self.width).astype(np.uint64)
        return high | (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class WordCache:
    """Ids of texts by a tokenizer file of the tokenizers library, each text's as little-endian bytes.

    by_space=False hands whole texts to the library. by_space=True hands it each distinct word between ASCII white space
    once, A-Z lower-cased, and joins the results. That is exact for tokenizers that lower-case, drop white space and never
    merge across it; one text of every 256 of a task is encoded both ways, and a difference stops the job.
    Strings that look like special tokens are ordinary text.
    """

    WORDS = 1_000_000

    def __init__(self, path: str, by_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.by_space = by_space
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.type).tobytes() for x in got]

    def each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; the words go to the library as one text with a mark of one token between them."""
        if self.mark is None or any(MARK in w for w in words):
            return self.whole([w.decode("utf-8", "surrogatepass") for w in words])
        ids = self.whole([(b" " + MARK + b" ").join([*words, b""]).decode("utf-8", "surrogatepass")])[0]
        ends = np.flatnonzero(np.frombuffer(ids, self.type) == self.mark) * self.width
        return [ids[a:b] for a, b in zip([0, *(ends[:-1] + self.width)], ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_space:
            return self.whole([t or "" for t in texts])
        words = [utf8(t).lower().split() for t in texts]
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(words)))
        if len(self.known) + len(new) > self.WORDS:
            self.known, new = {}, set(chain.from_iterable(words))
        # a comma or full stop behind a letter or digit is a piece of its own, so the word without it is enough
        cut = [w for w in new if w[-1:] in STOPS and w[-2:-1].isalnum()]
        order = [w for w in {*new, *(w[:-1] for w in cut), *STOPS}.difference(cut) if w not in self.known]
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            self.known.update(zip(part, self.each(part)))
        self.known.update({w: self.known[w[:-1]] + self.known[w[-1:]] for w in cut})
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


@lru_cache(4)
def word_cache(path: str, by_space: bool) -> WordCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCache(path, by_space)


class Shard(NamedTuple):
    shard: int
    n_docs: int
    n_tokens: int


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.bin"


def write_shard(
    batches: Iterator[pa.RecordBatch], folder: str, cache: WordCache, end_id: int,
) -> Iterator[pa.RecordBatch]:
    """Stream the ids of a partition to its shard; gives the shard's number and sizes."""
    context = TaskContext.get()
    shard, uri = context.partitionId(), shard_uri(folder, context.partitionId())
    end = np.array([end_id], cache.type).tobytes()
    ids, ends = array("q"), array("q")
    n_tokens = nulls = seen = 0
    files, path = place(uri)
    files.create_dir(path.rpartition("/")[0])
    own = f"{path}.{context.taskAttemptId()}"
    with files.open_output_stream(own) as out:
        out.write(MAGIC)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                got = cache.encode(texts)
                # another place in every slice, so that what is compared is spread over the task
                k = seen * 101 % len(texts)
                if cache.by_space and cache.whole([texts[k] or ""])[0] != got[k]:
                    raise ValueError("this tokenizer does not encode word by word; use by_space=False")
                seen += 1
                for i, data in zip(part.column(0).to_pylist(), got):
                    if i is None:
                        nulls += 1
                    else:
                        ids.append(i)
                    n_tokens += len(data) // cache.width + 1
                    ends.append(n_tokens)
                    out.write(data + end)
        least = ids[0] if ids else 0
        codes = [EliasFano.of(np.asarray(ids), least).to_bytes(), EliasFano.of(np.asarray(ends)).to_bytes()]
        for code in codes:
            out.write(code)
        out.write(FOOTER.pack(len(ends), nulls, least, n_tokens, cache.width, *map(len, codes), MAGIC))
    if files.get_file_info(path).type != pafs.FileType.NotFound:
        files.delete_file(path)
    files.move(own, path)
    yield pa.RecordBatch.from_pydict(
        {"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(ends)], pa.int64()),
         "n_tokens": pa.array([n_tokens], pa.int64())})


def shard_count(docs: DataFrame, text_column: str) -> int:
    """Shards for these texts by their size in bytes, whatever the number of shuffle partitions."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)) + ROW)).first()[0] or 0
    return max(1, -(-size // SHARD_MOST), min(-(-size // SHARD), FILES))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_space: bool = False, shards: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode every whole text, append end_id, and write shards in ascending id order; gives (shard, base, n_docs, n_tokens).

    folder is a URI that all executors can write (see scratch_path). The rows are dealt by ranges of the id, so no task
    depends on how sources or copies are spread; a task streams its ids to a file of its own attempt and renames it, so
    a lost executor costs only its tasks. The driver gets three numbers per shard. Without shards their number follows from
    the bytes of the texts, so that a task's work and the 16 bytes it keeps of each document are bounded.
    Null texts are empty documents (only end_id). Rows without an id come first. Equal ids are ordered by text.
    An empty table gives no documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or shard_count(docs, text_column)
    dealt = (
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .repartitionByRange(shards, F.col("id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return write_shard(batches, folder, word_cache(tokenizer, by_space), end_id)

    done = dealt.mapInArrow(write, "shard long, n_docs long, n_tokens long").collect()
    table, base = [], 0
    for row in sorted(done):
        table.append((row.shard, base, row.n_docs, row.n_tokens))
        base += row.n_tokens
    return spark.createDataFrame(table, "shard long, base long, n_docs long, n_tokens long")


class ShardFile:
    """Random access to one shard."""

    def __init__(self, uri: str):
        files, path = place(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(FOOTER.size, size - FOOTER.size)
        self.n_docs, self.nulls, self.least, self.n_tokens, self.width, a, b, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        at = size - FOOTER.size - a - b
        self.ids = EliasFano.from_bytes(self.file.read_at(a, at))
        self.ends = EliasFano.from_bytes(self.file.read_at(b, at + a))

    def bounds(self, i: int, j: int) -> np.ndarray:
        """The position where document i starts in the shard's id array, and those where documents i to j - 1 end."""
        start = [self.ends.select(i - 1)] if i else [0]
        return np.concatenate([np.array(start, np.int64), self.ends.span(i, j).astype(np.int64)])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        data = self.file.read_at((stop - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Ids of documents i to j - 1; those without id come first."""
        known = self.ids.span(max(i - self.nulls, 0), max(j - self.nulls, 0))
        return [None] * (min(j, self.nulls) - min(i, self.nulls)) + [int(v) + self.least for v in known]


def read_shards(batches: Iterator[pa.RecordBatch], folder: str, block: int) -> Iterator[pa.RecordBatch]:
    """Documents of the shards named in the batches, about block ids at a time; offsets come from select, a sample's documents
    at once."""
    for batch in batches:
        for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = ShardFile(shard_uri(folder, shard))
            for at in range(0, file.n_docs, SAMPLE):
                n = min(SAMPLE, file.n_docs - at)
                ids, cuts = file.doc_ids(at, at + n), file.bounds(at, at + n)
                i = 0
                while i < n:
                    j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + block, "right")) - 1)
                    tokens = file.tokens(int(cuts[i]), int(cuts[j])).astype("<u4")
                    own = [tokens[a:b].tobytes() for a, b in zip(cuts[i:j] - cuts[i], cuts[i + 1 : j + 1] - cuts[i])]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(ids[i:j], pa.int64()), "start": pa.array(cuts[i:j] + base, pa.int64()),
                         "n_tokens": pa.array(np.diff(cuts[i : j + 1]), pa.int64()), "ids": pa.array(own, pa.binary())})
                    i = j


def read_token_files(spark: SparkSession, folder: str, table: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Documents of the shards in table: (doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers).

    start counts the ids of all documents before it. About block ids are in a task's memory at once, or one document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_shards(batches, folder, block)

    shards = table.select("shard", "base").repartition(max(1, min(table.count(), 10_000)))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
