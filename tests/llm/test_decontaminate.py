import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose, words_of
from tidewire.llm import decontaminate
from tidewire.llm.decontaminate import DIFFERENCE, LEAST, _best_stretch, leaks, without_leaks


def brute(docs, items):
    """All diagonals of all pairs, without seeds."""
    out = set()
    for d, text in docs:
        w = words_of((text or "").lower())
        for i, item in items:
            v = words_of((item or "").lower())
            for shift in range(-len(v) + 1, len(w)):
                best, run, matched = 0, 0, 0
                for j in range(max(shift, 0), min(shift + len(v), len(w))):
                    same = w[j] == v[j - shift]
                    run, matched = (run + 1, matched + 1) if same else (run + DIFFERENCE, matched)
                    if run <= 0:
                        run, matched = 0, 0
                    best = max(best, matched if same else 0)
                if v and best >= min(LEAST, len(v)):
                    out.add((d, i))
    return out


def test_substituted_passages_are_found(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(f"{x}q{rng.randrange(30)}" for x in prose(rng, n))) for i, n in enumerate([15, 20, 37, 59, 25, 6])]
    docs = []
    for d in range(80):
        words = prose(rng, 60)
        if d % 2:
            passage = words_of(items[d % 6][1])
            for _ in range(len(passage) // 18):
                passage[rng.randrange(len(passage))] = "other"
            words[20:20] = passage
        docs.append((d, " ".join(words).title() if d % 3 == 0 else "\n".join(words)))
    df = frame(spark, [t for _, t in docs]).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()}
    want = brute(docs, items)
    assert {g for g in got if g[1] is not None} == want
    assert {d for d, _ in want} == {d for d, _ in docs if d % 2}
    assert {d for d, i in got if i is None} == {d for d, i in got if i == 0}
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 150)
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == got
    kept = without_leaks(df, bench)
    # a passage of six words is reported, but no reason to drop a document
    long = {d for d, i in got if i is not None and i < 5}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - long
    assert long == {d for d, _ in docs if d % 2 and d % 6 < 5}


def test_repeated_rows_in_one_and_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i % 5, " ".join(f"i{i}w{rng.randrange(9)}" for _ in range(20))) for i in range(12)]
    texts = [f"a b {items[0][1]} c {items[5][1]}"] * 3 + [items[1][1], items[1][1], f"{items[2][1]} x", "none", None]
    df = frame(spark, texts, [1, 1, None, None, None, 6, 7, 8])
    bench = spark.createDataFrame([*items, items[0], (None, items[0][1])], "item_id long, text string")
    one = sorted(map(tuple, leaks(df, bench).collect()), key=repr)
    assert len([r for r in one if r[:2] == (1, 0)]) == 2 and len([r for r in one if r[:2] == (None, 1)]) == 2
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 120)
    assert sorted(map(tuple, leaks(df, bench).collect()), key=repr) == one


def test_short_items_long_texts_and_clashing_columns(spark):
    passage = [f"w{j}" for j in range(40)]
    bench = spark.createDataFrame([(1, "Yes."), (2, " ".join(passage)), (3, "")], "item_id long, text string")
    long = "filler words " * 60_000
    df = frame(spark, ["yes. it is", long + " ".join(passage[:30]), long, "", None], [1, 2, 3, 4, None])
    df = df.withColumns({"_leak": F.lit(7), "text_key": F.lit("k"), "n_matched": F.lit(0), "copies": F.lit(1)})
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == {(1, 1), (2, 2)}
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((tuple(r) for r in df.collect() if r.doc_id != 2), key=repr)


def test_nulls_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    df = frame(spark, ["zero One two three FOUR five six", None, "", "one two"], [None, 2, 3, 4])
    assert [tuple(r)[:3] for r in leaks(df, bench).collect()] == [(None, 1, 5)]
    assert without_leaks(df, bench).count() == 4
    assert leaks(frame(spark, []), bench).collect() == [] and leaks(df, bench.limit(0)).collect() == []


def accepted(equal):
    """The operator's rule on one diagonal."""
    a, b = _best_stretch(np.array(equal))
    return sum(equal[a:b]) >= min(LEAST, len(equal))


def test_all_changes_of_one_to_three_words(spark):
    """Documents are a changed item alone, so its ends are the document's."""
    items = [(n, [f"i{n}w{j}" for j in range(n)]) for n in range(10, 21)]
    texts, want = [], set()
    for n, words in items:
        for c in range(4):
            for gone in itertools.combinations(range(n), c):
                if accepted([j not in gone for j in range(n)]):
                    want.add((len(texts), n))
                texts.append(" ".join("other" if j in gone else w for j, w in enumerate(words)))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(frame(spark, texts), bench).collect()} == want


def test_overlaps_at_the_ends(spark):
    item = [f"w{j}" for j in range(30)]
    texts = [" ".join(x) for x in (["a"] * 20 + item[:10], item[-10:] + ["a"] * 20, ["a"] * 20 + item[:11], ["a"] + item[-11:], item[:9])]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in leaks(frame(spark, texts), bench).collect()} == {0, 1, 2, 3}
