"""Relations of two title tables against all pairs; no pair is shuffled, and only what can be the best relation is matched."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from helpers import DAY, random_titles
from pyspark.sql import functions as F

from tests.test_edition_moves import shuffled_rows
from tidewire.functions import tokens as K
from tidewire.functions.text import normalize_title_search
from tidewire.operators import token_links as L
from tidewire.operators.evidence import find_cluster_match
from tidewire.operators.similarity import best_related, related_titles
from tidewire.workspace import save_once


def drawn(seed, count):
    """Titles that share words, with near copies, forms that differ by signs only, and titles without tokens."""
    rng = random.Random(seed)
    words = [f"word{i:02d}{'x' * (i % 3)}" for i in range(20)]
    out = [" ".join(rng.sample(words, rng.choice([3, 4, 5, 8]))) for _ in range(count)]
    return out + [t + "!" for t in out[:5]] + random_titles(seed, count // 2) + ["", "the", "!"]


def frame(spark, titles):
    return spark.createDataFrame([(DAY, t) for t in titles], "edition date, title string")


def relations(spark, left, right):
    """All relations by the definition."""
    rows = frame(spark, sorted({*left, *right}))
    rows = rows.select("title", normalize_title_search("title").alias("norm"), K.story_tokens("title").alias("tokens")).collect()
    known, out = {r.title: r for r in rows}, {}
    for a, b in itertools.product(sorted(set(left)), sorted(set(right))):
        x, y = known[a], known[b]
        shared = sorted({*x.tokens} & {*y.tokens})
        smaller = min(len(x.tokens), len(y.tokens))
        overlap = round(len(shared) / smaller, 4) if smaller else 0.0
        ratio = round(SequenceMatcher(None, x.norm, y.norm).ratio(), 4)
        kind = "near_duplicate" if ratio >= 0.82 else "story_cluster" if len(shared) >= 3 and overlap >= 0.35 else None
        if kind:
            weight = sum(1.5 if len(t) >= 6 or any(c.isdigit() for c in t) else 1.0 if len(t) >= 5 else 0.5 for t in shared)
            out[a, b] = (kind, weight, len(shared), ratio, overlap, shared)
    return out


def found(df):
    rows = df.collect()
    out = {(r.left_title, r.right_title): (r.relation_type, r.shared_weight, len(r.shared_tokens), r.title_similarity, r.overlap_ratio, list(r.shared_tokens)) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("block", "spread"), [(16_000, 500), (16_000, 10), (9, 500)])
def test_relations_equal_all_pairs(spark, monkeypatch, block, spread):
    monkeypatch.setattr(L, "PAIRED", block)
    monkeypatch.setattr(L, "SPREAD", spread)
    left, right = drawn(1, 40), drawn(1, 25) + drawn(2, 20)
    want = relations(spark, left, right)
    assert {v[0] for v in want.values()} == {"near_duplicate", "story_cluster"}
    assert found(related_titles(frame(spark, left), frame(spark, right))) == want
    both = found(related_titles(frame(spark, left), frame(spark, left), ascending=True))
    assert both == {k: v for k, v in relations(spark, left, left).items() if k[0] < k[1]}


@pytest.mark.parametrize("block", [16_000, 9])
def test_best_relations_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(L, "PAIRED", block)
    monkeypatch.setattr(L, "EMITTED", 1 if block == 9 else 50_000)
    left, right = drawn(1, 40), drawn(3, 25) + drawn(2, 20)
    want = {}
    for (a, b), v in relations(spark, left, right).items():
        score = (v[0] == "near_duplicate", *v[1:4], -right.index(b))
        want[a] = max(want.get(a, (score, b)), (score, b))
    accepted = spark.createDataFrame([(DAY, t, i) for i, t in enumerate(right)], "edition date, title string, order int")
    got = find_cluster_match(frame(spark, left), accepted)
    assert {r.title: r.matched_title for r in got.collect()} == {a: b for a, (_, b) in want.items()}
    matched = best_related(frame(spark, left), frame(spark, right)).filter("relation_type = 'story_cluster'")
    assert matched.count() < sum(v[0] == "story_cluster" for v in relations(spark, left, right).values()) / 4


def test_no_pairs_are_shuffled(spark):
    """Every two titles are linked: four times the titles are sixteen times the pairs."""
    def titles(count):
        rows = [(DAY, f"{i * 7919 % 9973:05d}{i} alpha bravo charlie {'xyzuvw'[i % 6] * (i % 29)}") for i in range(count)]
        return save_once(spark.createDataFrame(rows, "edition date, title string"), "titles")

    small, large = titles(60), titles(240)
    for run in (lambda t: related_titles(t, t, ascending=True), lambda t: find_cluster_match(t, t.withColumn("order", F.lit(1)).limit(20))):
        moved = [shuffled_rows(spark, lambda t=t: run(t).count()) for t in (small, large)]
        assert moved[1] < 8 * moved[0]
