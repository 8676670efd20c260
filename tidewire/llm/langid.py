"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; one binary classifier per bit predicts that bit from hashed byte trigrams. The
classifiers are naive Bayes: their weights are log ratios of feature counts, which one aggregation over all training
rows gives. Decoding takes the codeword of least loss exp(-margin) summed over the bits, each bit weighted by how well
it separates the training counts; a small lead over the second codeword flags the prediction as ambiguous.

Only rows with a non-null lang and crc32(doc_id as text) mod 4 != 2 are learned from; a prediction reads the text alone. Nulls: a
null text or one without a letter is `und` with score 0. A null doc_id is never learned from. Repeated rows are learned
and predicted as often as they come. Without any learnable row every prediction is `und`. Ties of the loss go to the
language that sorts first. Further columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import LOWER, SPACE, text_blocks

#: buckets of the hashed features
BUCKETS = 1 << 15
FOLDS, HELD_OUT = 4, 2
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def feature_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bucket of the trigram that begins at each byte; -1 over the end of a text)."""
    for lo, hi, raw, offsets in text_blocks(column):
        code = LOWER[raw].astype(np.uint32)
        code[SPACE[raw]] = 32
        n = len(code)
        grams = np.full(n, -1, np.int32)
        if n >= 3:
            packed = code[:-2] | (code[1:-1] << np.uint32(8)) | (code[2:] << np.uint32(16))
            grams[:-2] = ((packed * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)
        ends = offsets[1:][offsets[1:] > offsets[:-1]]
        grams[ends - 1] = -1
        two = ends - 2
        grams[two[two >= 0]] = -1
        yield lo, hi, offsets, grams


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts by language, as sparse rows, of a task's training rows."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, offsets, grams in feature_blocks(batch.column(1)):
            row_lang = langs[lo:hi]
            for lang in set(row_lang):
                own = np.repeat(row_lang == lang, np.diff(offsets)) & (grams >= 0)
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(grams[own], minlength=BUCKETS)
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "bucket", "n"]
        )


def codewords(n: int) -> np.ndarray:
    """n rows of bits: the exhaustive code for up to 6 languages, seeded random columns beyond."""
    if n <= 6:
        columns = [[(j >> i) & 1 for i in range(n)] for j in range(1, 1 << max(n - 1, 1))]
        return np.array(columns, np.int8).T.reshape(n, -1)
    length = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(np.arange(n) % 2) for _ in range(length)], axis=1).astype(np.int8)


class Model:
    """Bits: `weights[bucket, bit]`, positive for bit 1; `trust[bit]`, the weight of its loss."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.codes = codewords(len(self.langs)) if self.langs else np.zeros((0, 1), np.int8)
        bits = self.codes.shape[1]
        self.weights, self.trust = np.zeros((BUCKETS + 1, bits), np.float32), np.zeros(bits)
        # languages count alike, however many rows they have
        share = {k: (c + 0.5) / (c.sum() + 0.5 * BUCKETS) for k, c in counts.items()}
        for b in range(bits):
            sides = [np.mean([share[k] for k, code in zip(self.langs, self.codes[:, b], strict=True) if code == s] or [np.full(BUCKETS, 1 / BUCKETS)], axis=0) for s in (0, 1)]
            self.weights[:-1, b] = np.log(sides[1] / sides[0])
            # Jensen-Shannon divergence of the two sides: 0 for a bit that separates nothing
            middle = (sides[0] + sides[1]) / 2
            self.trust[b] = 0.5 * sum((s * np.log(s / middle)).sum() for s in sides)
        self.trust /= max(self.trust.sum(), 1e-12)

    def predict(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and ambiguity of documents with these summed bit margins over n features."""
        signs = 2 * self.codes.astype(np.float64) - 1
        margin = sums / np.sqrt(np.maximum(n, 1))[:, None]
        loss = np.stack([(self.trust * np.exp(-np.clip(margin * s, -30, 30))).sum(axis=1) for s in signs], axis=1)
        # the loss as a log, so that clear cases stay apart
        level = -np.log(np.maximum(loss, 1e-13)) / 4
        chance = np.exp(level - level.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        ranked = np.sort(chance, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if chance.shape[1] > 1 else 0)
        return np.argmin(loss, axis=1), ranked[:, -1], lead < AMBIGUOUS


def fit(docs: DataFrame) -> Model:
    """docs(doc_id, text, lang); the counts are at most BUCKETS rows per language, for a bounded set of languages."""
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("doc_id")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(~held_out(F.col("doc_id"), FOLDS, HELD_OUT)).select("lang", "text")
    sums = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    counts: dict[str, np.ndarray] = {}
    langs = np.array(table.column("lang").to_pylist(), object)
    for lang in set(langs):
        own = langs == lang
        counts[lang] = np.zeros(BUCKETS, np.int64)
        counts[lang][np.asarray(table.column("bucket"))[own]] = np.asarray(table.column("n"))[own]
    return Model(counts)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2)
            for lo, hi, offsets, grams in feature_blocks(texts):
                sums = np.zeros((hi - lo, model.weights.shape[1]))
                n = np.zeros(hi - lo, np.int64)
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    found = np.bincount(grams[a:b] + 1, minlength=1) if b - a > 20_000 else None
                    if found is None:
                        own = grams[a:b]
                        own = own[own >= 0]
                        sums[i], n[i] = model.weights[own].sum(axis=0, dtype=np.float64), len(own)
                    else:
                        at = np.flatnonzero(found[1:])
                        sums[i], n[i] = found[1:][at] @ model.weights[at].astype(np.float64), found[1:].sum()
                letters = np.array([t is not None and bool(_LETTER.search(t)) for t in texts.slice(lo, hi - lo).to_pylist()], bool)
                if model.langs:
                    best, score, unsure = model.predict(sums, n)
                else:
                    best, score, unsure = np.zeros(hi - lo, int), np.zeros(hi - lo), np.ones(hi - lo, bool)
                    letters[:] = False
                names = [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(names, pa.string()),
                        pa.array(np.where(letters, score, 0.0)),
                        pa.array(unsure | ~letters),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return run


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs(doc_id, text[, lang]): doc_id, held_out, lang_pred, score, ambiguous."""
    model = model or fit(docs)
    # BUCKETS x bits floats
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(_predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
