"""Token-ID files: documents encoded by a public tokenizer, kept as Parquet list columns.

Layout of a token table: `part int, doc_id long, offset long, n_tokens int, tokens array<int>`. Files hold disjoint
ascending ranges of doc_id and rows ascend inside them, so that row-group statistics and page indexes on doc_id prune
point and range reads. Token ids are dictionary encoded with a bit-packed index (plain beyond the dictionary's size),
the other columns are delta encoded. Metadata can be read without touching the token column. `offset` counts the ids before
a document in its part; the part table (one row per file) turns it into a place in the whole sequence.

Nulls: a null text encodes as an empty one (the end id alone), a null doc_id sorts first. Repeated rows are kept, equal
doc_ids in an order fixed by their texts. Empty tables give empty files. Further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.words import Words, ragged, text_blocks, words_of
from tidewire.workspace import checkpoint_root

SCHEMA = "part int, doc_id long, offset long, n_tokens int, tokens array<int>"
#: distinct pieces whose ids a worker process remembers; the cache starts anew beyond that
CACHE_PIECES = 400_000
#: bytes of text encoded at a time
STEP_BYTES = 4 << 20

_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!?;:#*$%&|")] = True
_ASCII_ALNUM = np.zeros(256, bool)
_ASCII_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def pieces_of(words: Words) -> tuple[pa.Array, np.ndarray]:
    """Pieces of words that the tokenizer treats one by one, and the n+1 offsets of the rows in them.

    The tokenizer drops white space and never joins over it, lower-cases, and keeps runs of letters apart from runs of
    other marks. A plain word (ASCII and Latin-1 letters, without "<") is therefore lower-cased and parted before a
    tail of ASCII marks that follows a letter or digit; this only makes equal pieces meet. All other words stay as they are.
    """
    raw, starts, ends = words.raw.copy(), words.starts, words.ends
    n = len(raw)
    odd = np.zeros(n + 1, np.int32)
    np.cumsum(((raw >= 0xC0) & (raw != 0xC3)) | (raw == 0x3C), out=odd[1:])
    plain = odd[starts] == odd[ends]
    inside = np.repeat(plain, ends - starts)
    at = ragged(starts, ends - starts)
    raw = raw[at]
    after_lead = np.zeros(len(raw), bool)
    after_lead[1:] = raw[:-1] == 0xC3
    upper = inside & ((raw >= 65) & (raw <= 90) | after_lead & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))
    raw[upper] += 32
    bounds = np.append(0, np.cumsum(ends - starts))
    # the tail: marks up to the word's end, after a letter or digit
    letter = _ASCII_ALNUM[raw] | after_lead & (raw >= 0xA0) & (raw != 0xB7)
    mark = np.zeros(len(raw) + 1, np.int64)
    mark[1:] = np.where(_TAIL[raw], 0, np.arange(1, len(raw) + 1))
    cut = np.maximum.accumulate(mark)[bounds[1:]]  # after the last byte that is no mark
    parted = plain & (cut > bounds[:-1]) & (cut < bounds[1:])
    parted[parted] = letter[cut[parted] - 1]
    count = 1 + parted
    first = np.append(0, np.cumsum(count))
    offsets = np.empty(first[-1] + 1, np.int64)
    offsets[first] = bounds
    offsets[first[:-1][parted] + 1] = cut[parted]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pieces, first[words.first]


class PieceIds:
    """Ids of pieces, remembered by the worker process."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # a run of lower-case letters needs the merges only; other tokenizers take the whole way for every piece
        marks = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [*range(0xDF, 0xF7), *range(0xF8, 0x100)]
        self.marks = {0xC3: marks.pre_tokenize_str("ß")[0][0][0]}
        self.marks |= {chr(c).encode()[1]: marks.pre_tokenize_str(chr(c))[0][0][1] for c in letters}
        probe = "aßéz"
        same = self.tokenizer.encode(f"{probe} {probe.capitalize()}").ids == 2 * self._merged(probe.encode())
        self.letters = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+" if same else rb"(?!)")
        self.clear()

    def _merged(self, word: bytes) -> list[int]:
        text = word.decode("latin-1")
        return [t.id for t in self.tokenizer.model.tokenize(text if word.isascii() else text.translate(self.marks))]

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)

    def lookup(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start in self.flat and length of each piece's ids."""
        fresh = [p for p in pieces if p not in self.place]
        if len(self.place) + len(fresh) > CACHE_PIECES and self.place:
            self.clear()
            fresh = pieces
        place = self.place
        known = len(place)
        place.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        ids: list[list[int]] = [[]] * len(fresh)
        simple = [i for i, p in enumerate(fresh) if self.letters.fullmatch(p)]
        for i in simple:
            ids[i] = self._merged(fresh[i])
        other = sorted(set(range(len(fresh))).difference(simple))
        for lo in range(0, len(other), 20_000):
            some = other[lo : lo + 20_000]
            encoded = self.tokenizer.encode_batch_fast([fresh[i].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, encoded, strict=True):
                ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        used = int(self.starts[known])
        while len(self.starts) <= len(place):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.starts[known + 1 : len(place) + 1] = used + np.cumsum(lengths)
        while len(self.flat) < used + int(lengths.sum()):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + int(lengths.sum())] = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        return self.starts[at], self.starts[at + 1] - self.starts[at]


_caches: dict[str, PieceIds] = {}


def piece_ids(tokenizer_file: str) -> PieceIds:
    if tokenizer_file not in _caches:
        _caches[tokenizer_file] = PieceIds(tokenizer_file)
    return _caches[tokenizer_file]


def _encoder(tokenizer_file: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, base = piece_ids(tokenizer_file), TaskContext.get().partitionId(), 0
        for lo, hi, raw, offsets, batch in ((*b, x) for x in batches for b in text_blocks(x.column(1), STEP_BYTES)):
            pieces, rows = pieces_of(words_of(raw, offsets))
            coded = pieces.dictionary_encode()
            index = np.asarray(coded.indices)
            starts, lengths = ids.lookup(coded.dictionary.to_pylist())
            per_word = lengths[index]
            before = np.concatenate([[0], np.cumsum(per_word)])[rows]
            counts = np.diff(before) + 1
            ends = np.cumsum(counts)
            flat = np.empty(int(ends[-1]), np.int32)
            own = np.ones(len(flat), bool)
            own[ends - 1] = False
            flat[ends - 1] = end_id
            flat[own] = ids.flat[ragged(starts[index], per_word)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(base + ends - counts),
                    pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat)),
                ],
                ["part", "doc_id", "offset", "n_tokens", "tokens"],
            )
            base += int(ends[-1])

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 2,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode docs(doc_id, text) and write them in ascending doc_id order below `path`.

    One shuffle of the texts, by ranges of (doc_id, hash of the text, row): repeated ids spread over several files.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).withColumns({"_h": F.xxhash64("text"), "_r": F.monotonically_increasing_id()})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartitionByRange(parts, "doc_id", "_h", "_r")
        .sortWithinPartitions("doc_id", "_h", "_r")
        .select("doc_id", "text")
        .mapInArrow(_encoder(tokenizer_file, end_id), SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", 20000)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None, tokens: bool = True) -> DataFrame:
    """Documents of a token table with `start`, the number of ids before them in the whole sequence.

    ids: only these documents (pruned by statistics and page indexes). tokens: whether the token column is read.
    """
    table = spark.read.schema(SCHEMA).parquet(path)
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    # one row of two numbers per file, so its size is bound by the number of shuffle partitions
    bases = F.broadcast(
        sizes.select(
            F.col("part").alias("_part"),
            (F.sum("_size").over(W.orderBy("part")) - F.col("_size")).alias("_base"),
        )
    )
    wanted = table if ids is None else table.filter(F.col("doc_id").isin([int(i) for i in ids]))
    columns = ["doc_id", "start", "n_tokens"] + ["tokens"] * tokens
    joined = wanted.join(bases, F.col("part") == F.col("_part"))
    return joined.withColumn("start", F.col("_base") + F.col("offset")).select(*columns)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        bounds = np.asarray(lists.offsets)
        raw = memoryview(np.ascontiguousarray(np.asarray(lists.values).astype("<u4"))).cast("B")
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(2).cast(pa.int64()),
                pa.array(crcs, pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: start, n_tokens and the CRC-32 of its little-endian 32-bit ids."""
    rows = read_tokens(spark, path)
    return rows.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_path(spark: SparkSession, name: str = "token-files") -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
