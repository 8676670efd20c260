"""Benchmark decontamination with spaced seeds.

A seed is a short window of which a mask reads some positions only, so that a replaced word under a gap does not
matter. The masks follow from the rule below and lose nothing: every end part of a best stretch has a positive sum, so its last
run of equal words, if shorter than 9, has r >= 5 words, one difference before it and at least 9 - r equal words before that.
Seeds start at every word up to the last that fits. The hashes of all benchmark seeds are joined with those of every window of every document; the table of benchmark
hashes is broadcast in blocks of at most BLOCK_SEEDS entries, each block in a pass of its own over the documents. Around every
hit the item is laid on the document along the hit's diagonal and the words are compared one by one. The best stretch
(a match counts 1, a difference -4) is a leak if it holds at least min(LEAST, words of the item) equal words.

Words are compared with A-Z in lower case. Items shorter than LEAST words must match as a whole and are looked for as a whole. Nulls: null texts on
either side hold no words; an item without words is found nowhere; null ids are reported as they are. Repeated rows
give their rows again, repeated item ids count as one item with several texts; of equal stretches the first one counts. Texts are
read whole. Empty tables give no rows. Further columns are ignored by `leaks` and kept by `without_leaks`, which drops documents
only for LEAST matched words or more: a shorter item is reported, but its words may stand in any clean document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import mix64, word_runs, words_of
from tidewire.workspace import Rounds

#: the positions that each mask reads: 9 words in a row, or 9 - r and r words around one difference (follows from DIFFERENCE)
MASKS = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8),
    (0, 2, 3, 4, 5, 6, 7, 8, 9),
    (0, 1, 3, 4, 5, 6, 7, 8, 9),
    (0, 1, 2, 4, 5, 6, 7, 8, 9),
    (0, 1, 2, 3, 5, 6, 7, 8, 9),
)
LEAST = 10
DIFFERENCE = -4
#: benchmark seeds that are broadcast at a time
BLOCK_SEEDS = 2_000_000

SCHEMA = "doc_id long, item_id long, n_matched int, n_item_words int, doc_word int, item_word int, length int"


def _masked(hashes: np.ndarray, positions, n: int, salt: int) -> np.ndarray:
    weights = mix64(np.arange(1, len(positions) + 1, dtype=np.uint64) + np.uint64(7_000_003 * (salt + 1))) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for p, w in zip(positions, weights, strict=True):
        total += hashes[p : p + n] * w
    return mix64(total)


class Seeds:
    """The benchmark's seeds by mask: sorted hashes and where they stand; a bit table answers most lookups."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items, table = [], {}
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes = words_of(raw, np.array([0, len(raw)], np.int64)).hashes(lower=True)
            if not len(hashes):
                continue
            self.items.append((item_id, hashes))
            if len(hashes) < LEAST:
                shapes = [(len(hashes), tuple(range(len(hashes))), 100 + len(hashes))]
            else:
                shapes = [(mask[-1] + 1, mask, i) for i, mask in enumerate(MASKS)]
            for span, mask, salt in shapes:
                n = len(hashes) - span + 1
                keys, at = table.setdefault((span, mask, salt), ([], []))
                keys.append(_masked(hashes, mask, n, salt))
                at.append(np.stack([np.full(n, len(self.items) - 1), np.arange(n)], axis=1))
        self.shapes = []
        for shape, (keys, at) in table.items():
            keys, at = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = max(16, int(len(keys)).bit_length() + 5)
            bloom = np.zeros(1 << bits, bool)
            bloom[keys >> np.uint64(64 - bits)] = True
            self.shapes.append((*shape, keys, at[order], bloom, np.uint64(64 - bits)))


def _best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Bounds of the stretch with the largest sum, the first and longest of equals."""
    sums = np.append(0, np.cumsum(np.where(equal, 1, DIFFERENCE)))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def _first_of_best(stretch: tuple[int, int, int, int, int]):
    """The order of stretches of one document and item: most words matched, then the shorter item, then the first place."""
    matched, n, word, item_word, length = stretch
    return matched, -n, -word, -item_word, length


def _hits(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_out = []
            ids = batch.column(0).to_pylist()
            keys_of_rows = batch.column(2).to_pylist()
            for words in word_runs(batch.column(1)):
                hashes = words.hashes(lower=True)
                diagonals = set()
                for span, mask, salt, keys, at, bloom, shift in seeds.shapes:
                    n = len(hashes) - span + 1
                    if n <= 0:
                        continue
                    found = _masked(hashes, mask, n, salt)
                    maybe = np.flatnonzero(bloom[found >> shift])
                    maybe = maybe[keys[np.minimum(np.searchsorted(keys, found[maybe]), len(keys) - 1)] == found[maybe]]
                    row = np.searchsorted(words.first, maybe, side="right") - 1
                    inside = maybe + span <= words.first[row + 1]
                    maybe, row = maybe[inside], row[inside]
                    lo, hi = np.searchsorted(keys, found[maybe]), np.searchsorted(keys, found[maybe], side="right")
                    for p, r, a, b in zip(maybe.tolist(), row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        diagonals.update((r, item, p - offset) for item, offset in at[a:b].tolist())
                best = {}
                for r, item, shift_ in sorted(diagonals):
                    item_id, own = seeds.items[item]
                    a, b = max(shift_, int(words.first[r])), min(shift_ + len(own), int(words.first[r + 1]))
                    equal = hashes[a:b] == own[a - shift_ : b - shift_]
                    x, y = _best_stretch(equal)
                    matched = int(equal[x:y].sum())
                    if matched >= min(LEAST, len(own)):
                        word = a + x - int(words.first[r])
                        stretch = (matched, len(own), word, a + x - shift_, y - x)
                        best[r, item_id] = max(stretch, best.get((r, item_id), stretch), key=_first_of_best)
                rows_out += [(ids[words.row + r], item_id, *v, keys_of_rows[words.row + r]) for (r, item_id), v in best.items()]
            names = ["doc_id", "item_id", "n_matched", "n_item_words", "doc_word", "item_word", "length", "text_key"]
            kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 5 + [pa.int64()]
            columns = zip(*rows_out, strict=True) if rows_out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text) x benchmark(item_id, text): one row per document and item that it holds (see SCHEMA)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("text is not null")
    seeds = F.size(F.split("text", "[\\x20\\x09-\\x0D]+")) * len(MASKS)
    total = items.agg(F.sum(seeds)).first()[0] or 0
    blocks = -(-total // BLOCK_SEEDS)
    shape = f"{SCHEMA}, text_key long"
    rounds = Rounds(docs.sparkSession, "leaks")
    found = docs.sparkSession.createDataFrame([], shape)
    for block in range(blocks):
        # the text is part of the deal, so that one id with many texts is spread as well
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r[0], r[1]) for r in some.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        hits = texts.mapInArrow(_hits(Seeds(rows)), shape)
        # a pass is written before the next block's seeds are built
        found = found.unionByName(rounds.save(hits, "hits") if blocks > 1 else hits)
    if blocks > 1:
        stretch = [f.split()[0] for f in SCHEMA.split(", ")[2:]]
        row = ["doc_id", "text_key", "item_id"]
        # texts of one item may lie in several blocks; equal documents give as many rows as they are
        copies = found.groupBy(*row, *stretch).agg(F.count(F.lit(1)).alias("copies"))
        order = F.struct("n_matched", -F.col("n_item_words"), -F.col("doc_word"), -F.col("item_word"), "length")
        best = copies.groupBy(*row).agg(F.max_by(F.struct("copies", *stretch), order).alias("b")).select(*row, "b.*")
        found = best.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(*[f.split()[0] for f in SCHEMA.split(", ")])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a passage of LEAST words or more of the benchmark; rows with a null doc_id stay."""
    bad = leaks(docs, benchmark).filter(F.col("n_matched") >= LEAST).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
