import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose, words_of
from tidewire.llm import substring
from tidewire.llm.substring import repeated_spans, without_repeats
from tidewire.llm.words import words_of as split_words


def brute(rows, k=13):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - k + 1):
            if doc is not None and first[tuple(w[i : i + k])] < doc:
                gone.update(range(i, i + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, rng.choice([12, 13, 14, 30, 80])) for _ in range(6)]
    texts = []
    for _ in range(n):
        words = prose(rng, rng.choice([0, 5, 30, 120]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        texts.append((" " if rng.random() < 0.5 else " \n").join(words))
    return texts + [None, "", "a " * 60, "a " * 40, "é " * 20, texts[3]]


def rows(df):
    return sorted((tuple(r) for r in df.drop("kept_text").collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    texts = passages(1)
    ids = random.Random(2).sample(range(1000), len(texts))
    df = frame(spark, texts, ids).repartition(5)
    want = brute(list(zip(ids, texts, strict=True)))
    assert rows(without_repeats(df)) == want
    assert sum(r[2] for r in want) > 300
    # runs of a few texts: matches are found across tasks instead of inside them; checked against the owners' texts
    monkeypatch.setattr(substring, "RUN_BYTES", 1)
    assert rows(without_repeats(df, verify=True)) == want


def test_a_task_matches_a_bounded_number_of_edges(spark, monkeypatch):
    """A partition's stretches come in lots of whole anchors; an anchor wider than a lot stays whole."""
    rng = random.Random(7)
    anchors = sorted(rng.choice([-5, 0, 1, 3, *range(10, 200)]) for _ in range(900)) + [500] * 80 + [501]
    prints = pa.array([bytes(8 * rng.randrange(1, 8)) for _ in anchors], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), prints], ["anchor", "prints"])
    lots = list(substring._lots((batch.slice(i, 20) for i in range(0, len(anchors), 20)), 100))
    assert [a for lot in lots for a in lot.column("anchor").to_pylist()] == anchors
    kinds = [set(lot.column("anchor").to_pylist()) for lot in lots]
    assert all(not x & y for x, y in zip(kinds, kinds[1:]))
    assert max(sum(len(p) // 8 for p in lot.column("prints").to_pylist()) for lot, k in zip(lots, kinds) if 500 not in k) < 500
    texts = passages(3)
    monkeypatch.setattr(substring, "MATCH_EDGES", 50)
    monkeypatch.setattr(substring, "RUN_BYTES", 1)
    assert rows(without_repeats(frame(spark, texts).repartition(3))) == brute(list(enumerate(texts)))


def test_spans_compact_and_edge_cases(spark):
    text = " ".join(prose(random.Random(4), 200))
    df = frame(spark, [text, text, text, None, text], [1, 5, 5, 6, None]).withColumns({"anchor": F.lit(1), "_spans": F.lit("x")})
    spans = [tuple(r) for r in repeated_spans(df).collect()]
    assert spans == [(5, 0, 188, 1, 0)]
    assert rows(without_repeats(df)) == brute([(1, text), (5, text), (5, text), (6, None), (None, text)])
    assert rows(without_repeats(frame(spark, []))) == []


def test_windows_that_share_an_anchor_and_half_a_print_differ(spark):
    """Two different windows on one anchor whose prints agree in their upper 32 bits: no repeat."""
    rng = random.Random(5)
    heads = [" ".join(f"h{rng.randrange(10**6)}" for _ in range(6)) for _ in range(300)]

    def edges(texts):
        raw = "".join(texts).encode()
        return substring._edges(split_words(np.frombuffer(raw, np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))), 13)

    mers = [int(substring.window_hashes(split_words(np.frombuffer(h.encode(), np.uint8), np.array([0, len(h)])).hashes(), 6)[0]) for h in heads]
    head = heads[int(np.argmin(mers))]
    texts = [head + "".join(f" t{rng.randrange(10**5)}" for _ in range(7)) for _ in range(300_000)]
    _, rows_, anchors, _, prints = edges(texts)
    upper = (prints >> np.uint64(32)) if prints.dtype == np.uint64 else prints
    seen, pair = {}, None
    for row, anchor, half in zip(rows_.tolist(), anchors.tolist(), upper.tolist(), strict=True):
        other = seen.setdefault((anchor, half), row)
        if other != row and texts[other] != texts[row]:
            pair = [texts[other], texts[row]]
            break
    assert pair
    for verify in (False, True):
        assert [r[2] for r in rows(without_repeats(frame(spark, pair), verify=verify))] == [0, 0]


def test_only_windows_equal_at_the_owner_are_removed():
    text = [f"w{i}" for i in range(40)]
    other = text[:20] + ["x"] + text[21:]
    span = [{"word": 0, "length": 28, "passage": " ".join(other)}]
    kind = pa.list_(pa.struct([("word", pa.int32()), ("length", pa.int32()), ("passage", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([2]), pa.array([" ".join(text)]), pa.array([span], kind)], ["doc_id", "text", "_spans"])
    assert next(substring._without(13)(iter([batch]))).column(4).to_pylist() == ["w20"]
