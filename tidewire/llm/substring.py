"""Removal of repeated substrings by compaction of a de Bruijn graph of word k-mers.

Every window of k words is an edge of the graph. Along a text, edges whose smallest (k - span + 1)-mer stands in the same place form
an unbranched stretch with that m-mer as its anchor; equal windows always have equal anchors. Stretches (anchor hash, doc_id, place,
one 64-bit print per edge) are dealt by anchor instead of single edges, which makes about an eighth of the rows.

1. In a task: equal edges of a run of documents keep their smallest doc_id only; all others are known to be repeats.
2. By anchor, sorted, so that a task holds a lot of MATCH_EDGES edges at a time: equal edges (anchor, print) of different documents; those
   beyond the smallest doc_id are repeats of it. A hot passage arrives once per run of documents, not once per document.
3. Neighbouring repeated edges of one document with the same owner on the same diagonal compact into one span, and
   the spans are joined to their document by coordinates. The words at the owner's coordinates are fetched for the spans
   found, and only windows whose 13 words are the same there are removed (verify=False skips that).

Two windows are candidates if two 64-bit hashes agree. The anchor's covers only 6 of the words, so windows that share it are
told apart by the other 64 bits. Nulls: a null text has no words; a row with a null doc_id is
returned unchanged and owns nothing. Repeated rows and rows with equal doc_ids are one document's texts: they never
remove words of each other. Empty tables give no rows; further columns of the input are ignored. Windows never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.words import Words, ragged, starts_in_rows, text_buffer, window_hashes, word_runs, words_of
from tidewire.workspace import Rounds

#: words of the anchor m-mer; a window of k words holds k - ANCHOR + 1 of them
ANCHOR = 6
#: bytes of text whose edges a task compares among themselves
RUN_BYTES = 8 << 20
#: edges that are matched at a time, beyond which the next anchor begins a new lot
MATCH_EDGES = 1_000_000
#: parts in which a passage is handed to the documents that repeat it
PASSAGE_PARTS = 64

_STRETCH = "anchor long, doc_id long, word int, prints binary"
_SPAN = "doc_id long, word int, length int, owner long, owner_word int"


def _edges(words: Words, k: int) -> tuple[np.ndarray, ...]:
    """(start among all words of the run, row, anchor hash, offset of the anchor in the window, print) of each window."""
    hashes = words.hashes()
    starts, rows = starts_in_rows(words.first, k)
    if not len(starts):
        return starts, rows, np.zeros(0, np.uint64), starts, np.zeros(0, np.uint64)
    mers = window_hashes(hashes, ANCHOR)
    width = k - ANCHOR + 1
    best, place = mers[: len(mers) - width + 1].copy(), np.zeros(len(mers) - width + 1, np.int64)
    for j in range(1, width):
        other = mers[j : j + len(best)]
        less = other < best
        best[less] = other[less]
        place[less] = j
    prints = window_hashes(hashes, k, salt=7)
    return starts, rows, best[starts], place[starts], prints[starts]


def _spans(doc, word, owner, owner_word) -> pa.RecordBatch:
    """Repeats in ascending (doc, word) order, neighbours on one diagonal as one span."""
    if len(doc):
        new = (np.diff(doc) != 0) | (np.diff(word) != 1) | (np.diff(owner) != 0) | (np.diff(owner_word) != 1)
        begin = np.flatnonzero(np.append(True, new))
    else:
        begin = np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(doc)))
    columns = [doc[begin], word[begin].astype(np.int32), length.astype(np.int32), owner[begin], owner_word[begin].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "word", "length", "owner", "owner_word"])


def _owners(key: np.ndarray, part: np.ndarray, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each edge the index of the first edge equal to it, by (doc, word), and the order used."""
    order = np.lexsort((word, doc, part, key))
    same = np.append(False, (key[order][1:] == key[order][:-1]) & (part[order][1:] == part[order][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    owner = np.empty(len(order), np.int64)
    owner[order] = order[head]
    return owner, order


def _stretches(k: int):
    """Per run of documents: repeats known inside it (anchor null), and stretches of edges for step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc_id", "word", "prints", "span", "owner", "owner_word"]
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            starts, docs, best, place, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            owner, _ = _owners(best, prints, docs, starts)
            repeat = docs[owner] != docs
            order = np.flatnonzero(repeat)
            order = order[np.lexsort((starts[order], docs[order]))]
            spans = _spans(docs[order], starts[order], docs[owner[order]], starts[owner[order]])
            m = spans.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(m, pa.int64()),
                    spans.column(0),
                    spans.column(1),
                    pa.nulls(m, pa.binary()),
                    spans.column(2),
                    spans.column(3),
                    spans.column(4),
                ],
                names,
            )
            mine = ~repeat
            starts, docs, best, place, prints = starts[mine], docs[mine], best[mine], place[mine], prints[mine]
            # edges of one anchor occurrence follow each other, with gaps where a repeat was taken out
            at = starts + place
            new = np.append(True, (docs[1:] != docs[:-1]) | (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) if len(docs) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(docs)))
            bounds = np.append(0, np.cumsum(8 * length)).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(prints))]
            )
            n = len(begin)
            for lo in range(0, n, 50_000):
                some = slice(lo, min(n, lo + 50_000))
                count = some.stop - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(best[begin[some]].view(np.int64)),
                        pa.array(docs[begin[some]]),
                        pa.array(starts[begin[some]].astype(np.int32)),
                        packed.slice(lo, count),
                        pa.nulls(count, pa.int32()),
                        pa.nulls(count, pa.int64()),
                        pa.nulls(count, pa.int32()),
                    ],
                    names,
                )

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for words in word_runs(batch.column(1)):
                starts, rows, best, place, prints = _edges(words, k)
                held.append((starts - words.first[:-1][rows], ids[words.row + rows], best, place, prints))
                size += len(words.raw)
                if size >= RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Stretches in ascending order of anchor, cut between anchors into tables of about `most` edges."""
    held, edges, limit = [], 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        edges += (pc.sum(pc.binary_length(batch.column("prints"))).as_py() or 0) // 8
        if edges < limit:
            continue
        last = batch.column("anchor")[batch.num_rows - 1].as_py()
        whole = pa.Table.from_batches(held)
        cut = int(np.searchsorted(np.asarray(whole.column("anchor")), last))
        if not cut:
            # one anchor so far: it is looked for again after as many edges more
            limit = edges + most
            continue
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        edges = sum((pc.sum(pc.binary_length(b.column("prints"))).as_py() or 0) // 8 for b in held)
        limit = max(most, edges + most // 2)
    if held:
        yield pa.Table.from_batches(held)


def _matched(table: pa.Table) -> pa.RecordBatch:
    """Repeats among the stretches of some anchors."""
    table = table.combine_chunks()
    packed = table.column("prints").chunk(0)
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    raw = np.frombuffer(packed.buffers()[2], np.uint8)
    length = np.diff(bounds) // 8
    rows = np.repeat(np.arange(len(length)), length)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
    prints = raw[bounds[0] : bounds[-1]].copy().view(np.uint64)
    anchor = np.asarray(table.column("anchor")).view(np.uint64)[rows]
    doc = np.asarray(table.column("doc_id"))[rows]
    word = np.asarray(table.column("word")).astype(np.int64)[rows] + inner
    del table, packed, raw
    owner, _ = _owners(anchor, prints, doc, word)
    repeat = np.flatnonzero(doc[owner] != doc)
    repeat = repeat[np.lexsort((word[repeat], doc[repeat]))]
    return _spans(doc[repeat], word[repeat], doc[owner[repeat]], word[owner[repeat]])


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, word, length, owner, owner_word): `length` windows of k words from `word` on stand in `owner` from `owner_word` on.

    The owner of a window is the smallest doc_id that holds it; spans are compacted along diagonals.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "anchor long, doc_id long, word int, prints binary, span int, owner long, owner_word int"
    rounds = Rounds(docs.sparkSession, "substring")
    found = texts.filter("doc_id is not null").mapInArrow(_stretches(k), schema)
    # a run's own repeats pass through the same deal, so that the texts are read and hashed once
    dealt = found.withColumn("_deal", F.coalesce("anchor", F.xxhash64("doc_id", "word")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    most = MATCH_EDGES

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []

        def open_() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = np.asarray(batch.column(0).is_null())
                if known.any():
                    local = batch.filter(pa.array(known))
                    ready.append(
                        pa.RecordBatch.from_arrays(
                            [local.column(i) for i in (1, 2, 4, 5, 6)], ["doc_id", "word", "length", "owner", "owner_word"]
                        )
                    )
                yield batch.filter(pa.array(~known)).select(["anchor", "doc_id", "word", "prints"])

        for lot in _lots(open_(), most):
            yield from ready
            ready.clear()
            yield _matched(lot)
        yield from ready

    columns = ["anchor", "doc_id", "word", "prints", "span", "owner", "owner_word"]
    spans = dealt.repartition(parts, "_deal").sortWithinPartitions("_deal").select(*columns).mapInArrow(both, _SPAN)
    return rounds.save(_compacted(spans), "spans")


def _compacted(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap on one diagonal (doc, owner, distance) as one."""
    diagonal = ["doc_id", "owner", "_by"]
    lines = spans.withColumn("_by", F.col("owner_word") - F.col("word"))
    before = W.partitionBy(*diagonal).orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.col("word") + F.col("length")).over(before)
    lines = lines.withColumn("_new", F.when(F.col("word") <= reach, 0).otherwise(1))
    lines = lines.withColumn("_path", F.sum("_new").over(W.partitionBy(*diagonal).orderBy("word", "length")))
    return lines.groupBy(*diagonal, "_path").agg(
        F.min("word").alias("word"),
        (F.max(F.col("word") + F.col("length")) - F.min("word")).cast("int").alias("length"),
        F.min("owner_word").alias("owner_word"),
    ).select("doc_id", "word", "length", "owner", "owner_word")


def _joined(own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Some words of a text, joined by one space."""
    body = own[ragged(starts, ends - starts)]
    text = np.full(len(body) + max(0, len(starts) - 1), 32, np.uint8)
    at = np.arange(len(body)) + np.repeat(np.arange(len(starts)), ends - starts)
    text[at] = body
    return text.tobytes()


def _same_windows(mine: bytes, theirs: bytes, k: int) -> np.ndarray:
    """Where k words in a row are the same in both passages."""
    equal = np.array([x == y for x, y in zip(mine.split(b" "), theirs.split(b" "), strict=False)], bool)
    sums = np.append(0, np.cumsum(equal))
    return np.flatnonzero(sums[k:] - sums[:-k] == k)


def _without(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = batch.column(0), batch.column(1), batch.column(2)
            raw, offsets = text_buffer(texts)
            span_bounds = np.asarray(spans.offsets).astype(np.int64)
            begin = np.asarray(spans.values.field(0))
            length = np.asarray(spans.values.field(1))
            passages = spans.values.field(2)
            filled = np.asarray(spans.is_valid())
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                words = words_of(own, np.array([0, len(own)], np.int64))
                count = len(words.starts)
                gone = np.zeros(count + 1, np.int64)
                for j in range(span_bounds[i], span_bounds[i + 1]) if filled[i] else ():
                    first, last = int(begin[j]), min(int(begin[j]) + int(length[j]) + k - 1, count)
                    theirs = passages[j].as_py()
                    if theirs is None:
                        same = np.arange(max(0, last - first - k + 1))
                    else:
                        mine, theirs = _joined(own, words.starts[first:last], words.ends[first:last]), theirs.encode()
                        same = np.arange(last - first - k + 1) if mine == theirs else _same_windows(mine, theirs, k)
                    np.add.at(gone, first + same, 1)
                    np.add.at(gone, first + same + k, -1)
                kept = np.cumsum(gone)[:count] == 0
                text = _joined(own, words.starts[kept], words.ends[kept])
                n_words.append(count)
                n_removed.append(count - int(kept.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(kept_texts, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _passages(k: int):
    """The words of an owner at the places asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_owner", "_owner_word", "_length", "_part", "passage"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, (owner, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = raw[offsets[i] : offsets[i + 1]]
                words = words_of(own, np.array([0, len(own)], np.int64))
                for place in places:
                    at = slice(place["owner_word"], place["owner_word"] + place["length"] + k - 1)
                    passage = _joined(own, words.starts[at], words.ends[at]).decode()
                    rows.append((owner, place["owner_word"], place["length"], place["_part"], passage))
                    size += len(passage)
                    if size >= 4 << 20:
                        yield flush()
                        size = 0
        yield flush()

    return run


def _with_passages(docs: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """Spans with the words that stand at the owner's coordinates; a passage of many documents is handed out in parts."""
    spans = spans.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PASSAGE_PARTS)).cast("int"))
    places = spans.select("owner", "owner_word", "length", "_part").distinct()
    places = places.groupBy("owner").agg(F.collect_list(F.struct("owner_word", "length", "_part")).alias("_places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    asked = texts.join(places, F.col("_id") == F.col("owner")).select("owner", "text", "_places")
    schema = "_owner long, _owner_word int, _length int, _part int, passage string"
    found = asked.mapInArrow(_passages(k), schema).withColumnRenamed("_part", "_of_part")
    same = [F.col("owner") == F.col("_owner"), F.col("owner_word") == F.col("_owner_word"), F.col("length") == F.col("_length"), F.col("_part") == F.col("_of_part")]
    return spans.join(found, same).select("doc_id", "word", "length", "passage")


def without_repeats(docs: DataFrame, k: int = 13, verify: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space)."""
    spans = repeated_spans(docs, k)
    spans = _with_passages(docs, spans, k) if verify else spans.withColumn("passage", F.lit(None).cast("string"))
    # spans of one document are bound by its own length
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("word", "length", "passage")).alias("_spans"))
    lists = lists.withColumnRenamed("doc_id", "_of")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(lists, F.col("doc_id") == F.col("_of"), "left").select("doc_id", "text", "_spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_without(k), schema)
