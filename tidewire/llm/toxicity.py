"""Toxicity of texts that may be disguised: noisy-channel restoration, then a score of the restored text.

1. Language model: counts of character trigrams over all documents (bytes in 64 classes, so the table is bounded).
2. Channel: a token with digits or signs among letters, signs between letters or letters repeated three times or more, and a
   run of SINGLES or more single characters, is a segment. Its lattice has, for each character or run, the letters it may
   stand for (LOOKALIKES), once or twice, or itself; a gap may be a word boundary or noise. The Viterbi path under trigram
   model and channel costs is the restored text. Other tokens have one path, themselves.
3. Score: features are byte 5-grams of restored words, each at one to LEVELS occurrences; evidence is the log of a lower bound of a
   feature's rate in toxic training texts over an upper bound of its rate in others. The strongest evidence of a document, and
   its length, give the probability by a logistic layer that is fitted on the training texts.

Learned from at most TRAIN_ROWS labelled rows of each label, chosen by hash among those with crc32(doc_id as text) mod 4 != 2; the
language model from all texts. A score reads the text alone. Nulls: a null text is an empty one and has the score of no evidence;
null ids or labels are never learned from. Ties between paths go to the first option listed. An id with several labels is learned with
each; repeated rows are scored alike. Without both labels there is no evidence, and the score is 0.1. Empty tables give no rows.
Further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.langid import held_out
from tidewire.llm.words import LOWER, SPACE, Words, text_blocks, words_of

FOLDS, HELD_OUT = 4, 2
TRAIN_ROWS = 4000
CUT = 0.3
#: single characters in a row that may be a spaced-out word
SINGLES = 3
#: standard errors by which a rate is lowered or raised
ERRORS = 2.0
#: letters that a sign may stand for
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
#: costs of the channel, in nats: a letter written as a sign, repeated, or doubled; a sign that is meant as one, and one before letters; a
#: gap within a word, and, between single characters, a gap that is a boundary
SUBSTITUTED, REPEATED, DOUBLED, ITSELF, INSIDE, JOINED, APART = 1.0, 0.5, 5.0, 1.5, 6.0, 1.5, 3.0
GRAM = 5
#: so many occurrences of a gram in a text are told apart
LEVELS = 4
RIDGE = 1.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKES if not c.isdigit()]] = True
#: class of a byte in the language model; 0 is a word boundary
CODES = np.zeros(256, np.int32)
CODES[97:123] = CODES[65:91] = np.arange(1, 27)
CODES[128:] = 27 + np.arange(128) % 37
CLASSES = 64
#: word bytes in lower case, others as a space
_PLAIN = np.where(_LETTER, LOWER, 32).astype(np.uint8)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of (before, before, class); a class after a boundary has no further context."""
    inner = offsets[1:-1]
    code = np.insert(CODES[raw], inner, 0)
    code = np.concatenate([[0, 0], code, [0]]).astype(np.int32)
    first, second, third = code[:-2], code[1:-1], code[2:]
    open_ = (second > 0) | (third > 0)
    key = np.where(second > 0, first, 0) * CLASSES**2 + second * CLASSES + third
    return np.bincount(key[open_], minlength=CLASSES**3)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for _, _, raw, offsets in text_blocks(batch.column(0)):
            total += trigram_counts(raw, offsets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


class LanguageModel:
    """Cost of a class after two others, interpolated over three orders."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        rate = lambda c: c / np.maximum(c.sum(axis=-1, keepdims=True), 1)
        mixed = 0.85 * rate(three) + 0.12 * rate(two)[None] + 0.03 * rate(one)[None, None] + 1e-6
        self.cost = (-np.log(mixed)).ravel().tolist()


def fit_language_model(docs: DataFrame) -> LanguageModel:
    """Trigram counts over the texts of all rows; at most CLASSES^3 of them come to the driver."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "gram long, n long")
    table = sums.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES**3, np.int64)
    counts[np.asarray(table.column("gram"))] = np.asarray(table.column("n"))
    return LanguageModel(counts)


def _options(sign: str, count: int) -> list[tuple[str, float]]:
    """(letters, cost) of a run of one letter or look-alike."""
    letters = LOOKALIKES.get(sign)
    if letters is None:
        if count == 1:
            return [(sign, 0.0)]
        return [(sign * 2, 0.0), (sign, DOUBLED)] if count == 2 else [(sign, REPEATED), (sign * 2, REPEATED)]
    found = [(x, SUBSTITUTED) for x in letters]
    if count > 1:
        found += [(x * 2, SUBSTITUTED + (REPEATED if count > 2 else 0)) for x in letters]
    return found


def decoded(segment: bytes, model: LanguageModel) -> bytes:
    """The best path through the lattice of a segment, in lower case."""
    # bytes as characters, so that each byte is one step; only ASCII is ever substituted
    text = bytes(LOWER[np.frombuffer(segment, np.uint8)]).decode("latin-1")
    codes, cost = _CODE_LIST, model.cost
    # (two last classes) -> (cost, restored)
    states = {0: (0.0, "")}
    i, n = 0, len(text)
    # by stretch without gaps, the place of its last letter
    piece, last_letter = 0, [-1]
    for at, sign in enumerate(text):
        if not _solid(sign):
            last_letter.append(-1)
        elif sign not in LOOKALIKES:
            last_letter[-1] = at
    while i < n:
        sign, j = text[i], i + 1
        while j < n and text[j] == sign:
            j += 1
        run, word = text[i:j], _solid(sign)
        if sign >= "\x80":
            options = [(run, 0.0)]
        elif word:
            options = _options(sign, j - i)
        else:
            piece += j - i
            # between single characters a gap is more likely noise than a boundary
            spelled = (i == 1 or not _solid(text[i - 2])) and (j == n - 1 or not _solid(text[j + 1 : j + 2]))
            options = [("", 0.0 if spelled else JOINED)]
        itself = not word or sign in LOOKALIKES
        alone = (INSIDE if i < last_letter[piece] else ITSELF) if word else APART if spelled else 0.0
        i, after = j, {}
        for state, (so_far, out) in states.items():
            for letters, extra in options:
                at, total = state, so_far + extra
                for x in letters:
                    code = codes[ord(x)]
                    total += cost[at * CLASSES + code]
                    at = at % CLASSES * CLASSES + code
                old = after.get(at)
                if old is None or total < old[0]:
                    after[at] = (total, out + letters)
            if itself:
                total = so_far + alone + (cost[state * CLASSES] if state else 0.0)
                old = after.get(0)
                if old is None or total < old[0]:
                    after[0] = (total, out + run)
        states = after
    best = min(states.items(), key=lambda s: s[1][0] + (cost[s[0] * CLASSES] if s[0] else 0.0))
    return best[1][1].encode("latin-1")


_CODE_LIST = CODES.tolist()


def _solid(sign: str) -> bool:
    return sign >= "\x80" or sign.isalpha() or sign in LOOKALIKES


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the segments among a run's tokens, in order."""
    raw, starts, ends = words.raw, words.starts, words.ends
    n = len(raw)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    letter, digit, sign = _LETTER[raw], _DIGIT[raw], _SIGN[raw]
    solid = letter | digit | sign
    # neighbours within the token
    inner = np.zeros(n + 1, bool)
    inner[1:n] = ~SPACE[raw[1:]] & ~SPACE[raw[:-1]]
    inner[words.offsets] = False
    before = lambda of: np.append(False, of[:-1]) & inner[:-1]
    after = lambda of: np.append(of[1:], False) & inner[1:]
    known = letter | digit
    odd = (digit & (before(letter) | after(letter))) | (sign & (after(letter) | (before(letter) & after(digit))))
    odd |= ~solid & before(known) & (after(known) | after(sign & after(known)))
    low = LOWER[raw]
    same = np.append(letter[:-1] & (raw[:-1] < 128) & (low[:-1] == low[1:]), False) & inner[1:]
    odd |= same & after(same)
    sums = np.concatenate([[0], np.cumsum(odd)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    marked = (sums[ends] > sums[starts]) & (letters[ends] > letters[starts])
    row = np.searchsorted(words.first, np.arange(len(starts)), side="right") - 1
    size = ends - starts
    lead = raw[starts]
    single = solid[starts] & ((size == 1) | ((size == 2) & (lead >= 0xC3) & (lead < 0xE0)))
    # runs of single characters one space apart
    linked = np.zeros(len(starts), bool)
    linked[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (row[1:] == row[:-1])
    head = single & ~linked
    run = np.cumsum(head)
    length = np.bincount(run[single], minlength=run[-1] + 1)
    with_letter = np.bincount(run[single], weights=letters[ends[single]] > letters[starts[single]], minlength=run[-1] + 1)
    spaced = single & (length[run] >= SINGLES) & (with_letter[run] > 0)
    lone = marked & ~spaced
    begin = np.flatnonzero(lone | (spaced & head))
    last = begin.copy()
    of_run = spaced[begin]
    last[of_run] += length[run[begin[of_run]]] - 1
    return row[begin], starts[begin], ends[last]


class Restorer:
    """Restored segments, each distinct one decoded once while the store lasts."""

    STORE = 200_000

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known: dict[bytes, bytes] = {}

    def __call__(self, segment: bytes) -> bytes:
        found = self.known.get(segment)
        if found is None:
            if len(self.known) >= self.STORE:
                self.known.clear()
            found = self.known[segment] = decoded(segment, self.model)
        return found


def gram_keys(plain: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each position as one integer; 0 where they are not of one word, its edges included."""
    n = len(plain) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = plain != 32
    ok = word[1 : n + 1].copy()
    for j in range(2, GRAM - 1):
        ok &= word[j : n + j]
    key = np.zeros(n, np.uint64)
    for j in range(GRAM):
        key = (key << np.uint64(8)) | plain[j : n + j]
    key[~ok] = 0
    return key


def restored_grams(raw: np.ndarray, offsets: np.ndarray, restore: Restorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram) of the restored texts, and the number of changed segments by row."""
    words = words_of(raw, offsets)
    row, start, end = segments(words)
    plain = _PLAIN[raw]
    rows, changed, fixed = [], np.zeros(len(words), np.int64), []
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
        segment = raw[a:b].tobytes()
        found = restore(segment)
        changed[r] += found != segment.lower()
        plain[a:b] = 32
        fixed.append(found)
        rows.append(r)
    # spaces before each text and segment, and after the last
    sizes = np.diff(offsets) + 2
    plain, owner = np.insert(plain, np.repeat(offsets[:-1], 2), 32), np.repeat(np.arange(len(words)), sizes)
    if fixed:
        joined = np.frombuffer(b"".join(b"  " + f for f in fixed), np.uint8)
        plain = np.concatenate([plain, _PLAIN[joined]])
        owner = np.concatenate([owner, np.repeat(np.array(rows), [len(f) + 2 for f in fixed])])
    plain = np.append(plain, np.uint8(32))
    keys = gram_keys(plain)
    at = np.flatnonzero(keys)
    return owner[at], keys[at], changed


def features(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): a gram that a row has n times gives one feature for each level up to n."""
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    nth = np.arange(len(gram)) - np.repeat(at, np.diff(np.append(at, len(gram))))
    some = nth < LEVELS
    return row[some], gram[some] | (nth[some].astype(np.uint64) << np.uint64(8 * GRAM))


def _training_grams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            labels = np.asarray(batch.column(0))
            for lo, hi, raw, offsets in text_blocks(batch.column(1)):
                row, gram, _ = restored_grams(raw, offsets, restore)
                row, feature = features(row, gram)
                own = labels[lo:hi][row]
                for label in (0, 1):
                    grams, n = np.unique(feature[own == label], return_counts=True)
                    columns = [pa.array(grams.astype(np.int64)), pa.array(np.full(len(n), label, np.int32)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "label", "n"])

    return run


class Evidence:
    """Features with their log odds, ascending, and the logistic layer over (1, strongest evidence, length)."""

    def __init__(self, found: np.ndarray, weight: np.ndarray):
        order = np.argsort(found)
        self.features, self.weight = found[order].astype(np.uint64), weight[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self._bucket(self.features)] = True
        self.layer = np.array([math.log(0.1 / 0.9), 0.0, 0.0])

    @staticmethod
    def _bucket(found: np.ndarray) -> np.ndarray:
        gram = found & np.uint64((1 << (8 * GRAM)) - 1)
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def strongest(self, rows: int, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
        best = np.zeros(rows)
        if len(self.features):
            some = self.seen[self._bucket(gram)]
            row, found = features(row[some], gram[some])
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            hit = self.features[at] == found
            np.maximum.at(best, row[hit], self.weight[at[hit]])
        return best

    @staticmethod
    def inputs(best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(best)), best, np.log1p(sizes) / 10], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.layer, -30, 30)))

    def fit_layer(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps on the weighted logistic loss with a small ridge."""
        self.layer = np.zeros(x.shape[1])
        for _ in range(30):
            p = self.probability(x)
            slope = x.T @ (weight * (p - label)) + RIDGE * self.layer
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
            self.layer = self.layer - np.clip(np.linalg.solve(curve, slope), -2, 2)


def fit_evidence(docs: DataFrame, labels: DataFrame, shared) -> Evidence:
    """docs(doc_id, text), labels(doc_id, toxic), shared: broadcast language model."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    known = known.filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"), FOLDS, HELD_OUT)).distinct()
    tally = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    chosen = None
    for label in (0, 1):
        own = known.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the chosen ids are bound by 2 x TRAIN_ROWS
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_label", "text")
    grams = found.mapInArrow(_training_grams(shared), "gram long, label int, n long").groupBy("gram")
    counts = grams.agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("a"), F.sum(F.expr("if(label = 0, n, 0)")).alias("b"))
    sizes = [max(1, min(tally.get(k, 0), TRAIN_ROWS)) for k in (0, 1)]
    lower = (F.col("a") - ERRORS * F.sqrt("a")) / sizes[1]
    upper = (F.col("b") + ERRORS * F.sqrt(F.col("b") + 1)) / sizes[0]
    weighed = counts.filter(F.col("a") > ERRORS**2).select("gram", F.log(lower / upper).alias("weight")).filter("weight > 0").toArrow()
    evidence = Evidence(np.asarray(weighed.column(0)).astype(np.uint64), np.asarray(weighed.column(1)))
    if tally.get(0) and tally.get(1):
        # three numbers for each of at most 2 x TRAIN_ROWS texts
        table = found.mapInArrow(_training_inputs(shared, evidence), "label int, best double, size long").toArrow()
        label = np.asarray(table.column("label"))
        if len(label) and label.min() != label.max():
            weight = np.where(label == 1, tally[1] / sizes[1], tally[0] / sizes[0])
            x = evidence.inputs(np.asarray(table.column("best")), np.asarray(table.column("size")))
            evidence.fit_layer(x, label, weight)
    return evidence


def _training_inputs(shared, evidence: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(1)):
                row, gram, _ = restored_grams(raw, offsets, restore)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(evidence.strongest(hi - lo, row, gram)), pa.array(np.diff(offsets))]
                yield pa.RecordBatch.from_arrays(columns, ["label", "best", "size"])

    return run


def _scored(model, evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.value)
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(2)):
                row, gram, changed = restored_grams(raw, offsets, restore)
                best = evidence.value.strongest(hi - lo, row, gram)
                score = evidence.value.probability(evidence.value.inputs(best, np.diff(offsets)))
                own = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(changed)],
                    ["doc_id", "held_out", "score", "predicted", "n_restored"],
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted (score >= CUT), n_restored. labels(doc_id, toxic)."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(fit_language_model(docs))
    # grams that are significant in at most 2 x TRAIN_ROWS texts
    evidence = context.broadcast(fit_evidence(docs, labels, model))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    shape = "doc_id long, held_out boolean, score double, predicted int, n_restored long"
    return rows.mapInArrow(_scored(model, evidence), shape)


def restored_text(text: str | None, restore: Restorer) -> str | None:
    """The text with its segments restored; a segment that restoring only lower-cases stays as it is."""
    if not text:
        return text
    raw = np.frombuffer(text.encode(), np.uint8)
    out, done = [], 0
    for _, a, b in zip(*segments(words_of(raw, np.array([0, len(raw)]))), strict=True):
        segment = raw[a:b].tobytes()
        found = restore(segment)
        out += [raw[done:a].tobytes(), segment if found == segment.lower() else found]
        done = b
    return b"".join([*out, raw[done:].tobytes()]).decode("utf-8", "replace")


def restored(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with its segments restored."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_language_model(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            texts = pa.array([restored_text(t, restore) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")
