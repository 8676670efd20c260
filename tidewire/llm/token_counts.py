"""Token counts of a unigram vocabulary without building the tokens: count-only Viterbi.

Texts fall into words at ASCII white space, each word with the word mark in front, as a white-space split followed by the
metaspace step of public tokenizers does. An Aho-Corasick automaton lists all vocabulary matches of a word by their end,
longest first; dynamic programming keeps the best score and the piece count of each prefix. Tie rule: of equal scores the
match that begins first stays, a later one must be strictly better. A character without a piece of its own is an unknown
piece of score min - 10; neighbouring unknown pieces count as one. Words are counted once per batch.

Nulls: a null text has 0 tokens. Repeated rows and equal ids are counted row by row, empty tables give no rows, further columns
of the input are ignored. Texts are used whole; a word of any length is one run of the same program.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import distinct_words

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: words whose counts a worker process remembers
CACHE_WORDS = 200_000

SCHEMA = "doc_id long, n_tokens long, n_words long, score double"


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def count(self, text: str) -> tuple[int, float]:
        """Pieces of the best segmentation of a non-empty text, and its score."""
        size = len(text)
        score = [0.0] + [None] * size
        count = [0] * (size + 1)
        open_ = [False] * (size + 1)  # the best path to here ends in an unknown piece
        unknown, done = self.unknown, 0

        def step(upto: int) -> None:
            # positions whose own character is no piece take the unknown one, if that is better
            for end in range(done + 1, upto + 1):
                if end not in single:
                    other = score[end - 1] + unknown
                    if score[end] is None or other > score[end]:
                        score[end], count[end], open_[end] = other, count[end - 1] + (not open_[end - 1]), True

        single: set[int] = set()
        for last, (length, own) in self.automaton.iter(text):
            end = last + 1
            if end - 1 > done:
                step(end - 1)
                done = end - 1
            start = end - length
            other = score[start] + own
            if length == 1:
                single.add(end)
            if score[end] is None or other > score[end]:
                score[end], count[end], open_[end] = other, count[start] + 1, False
        step(size)
        return count[size], score[size]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS and self.known:
            self.known.clear()
            fresh = words
        for w in fresh:
            self.known[w] = self.count(MARK + w) if w else (0, 0.0)
        found = [self.known[w] for w in words]
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.float64)


_counters: dict[str, Counter] = {}


def _counts(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _counters:
            _counters[model_file] = Counter(unigram_vocabulary(model_file))
        counter = _counters[model_file]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                words, index, rows = distinct_words(batch.column(1))
                pieces, scores = counter.words(words)
                filled = np.array([bool(w) for w in words], np.int64)
                sums = [np.append(0, np.cumsum(v[index]))[rows] for v in (pieces, filled)]
                # each row's sum for itself: a running sum of floats would carry rounding over rows
                score = [float(scores[index[a:b]].sum()) for a, b in zip(rows[:-1], rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(np.diff(s)) for s in sums], pa.array(score, pa.float64())],
                    ["doc_id", "n_tokens", "n_words", "score"],
                )

    return run


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, n_words, score (sum of the best scores of its words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counts(model_file), SCHEMA)
