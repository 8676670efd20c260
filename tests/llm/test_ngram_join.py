import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, jaccard_components, near_copies, prose
from tidewire.llm import ngram_join
from tidewire.llm.ngram_join import ngram_components, one_of_each


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_components_equal_brute_force(spark, n, num, den):
    texts = near_copies(n) + [None, "", " \n", "one", "one", "ONE", "a b"]
    want = jaccard_components(list(enumerate(texts)), n, num, den)
    assert rows(ngram_components(frame(spark, texts), n, num, den)) == want
    assert len({c for _, _, c in want}) < len(want) - 10


def test_large_groups_are_split_over_blocks(spark, monkeypatch):
    """Near copies around the threshold, so that many are not linked to the first; blocks of a few texts."""
    rng = random.Random(3)
    base, texts = prose(rng, 80), []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(80)] = f"y{rng.randrange(40)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 500)
    got = rows(ngram_components(frame(spark, texts), 3, 90, 100))
    assert got == jaccard_components(list(enumerate(texts)), 3, 90, 100)
    assert 1 < len({c for _, _, c in got}) < 80


def test_links_between_levels_of_a_wide_group(spark, monkeypatch):
    """A chain of growing texts, a block a level: those linked to the first node are met by the apart ones above them."""
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words[:k]) for k in range(40, 130, 3)]
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 1200)
    got = rows(ngram_components(frame(spark, texts), 3, 90, 100))
    assert got == jaccard_components(list(enumerate(texts)), 3, 90, 100)
    assert {c for _, _, c in got} == {0}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    base = " ".join(prose(random.Random(5), 50))
    df = frame(spark, [base, base, base, base, "other text here now"], [7, 7, 3, None, 9])
    df = df.withColumns({"node": F.lit(1), "key": F.lit("k"), "root": F.lit(2), "_head": F.lit(0)})
    got = ngram_components(df, 3, 90, 100)
    assert [r[2] for r in rows(got)] == [3, 3, 3, 9, None]
    kept = one_of_each(df, 3, 90, 100)
    assert sorted(kept.select("doc_id").collect(), key=repr) == [(3,), (9,), (None,)]
    assert kept.columns == df.columns


def test_empty_table(spark):
    assert rows(ngram_components(frame(spark, []), 3, 90, 100)) == []


def test_a_group_held_together_by_chance_falls_apart(spark, monkeypatch):
    """Texts with a fifth in common share keys, but need more than that in common; near copies among them stay together."""
    rng = random.Random(11)
    common = prose(rng, 60)
    texts = []
    for i in range(40):
        texts.append(" ".join(common + [f"x{i}y{j}" for j in range(rng.randrange(200, 260))]))
    texts += [f"{t} z" for t in texts[:5]]
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 2000)
    # every n-gram a key, so that all texts are one candidate group
    monkeypatch.setattr(ngram_join, "_fillable", lambda *_: False)
    monkeypatch.setattr(ngram_join, "segment_keys", lambda grams, *_: ngram_join.mix64(grams).view("int64"))
    pieces = []
    monkeypatch.setattr(ngram_join, "_placed", lambda nodes, *a, real=ngram_join._placed: pieces.append(nodes.collect()) or real(nodes, *a))
    df = frame(spark, texts)
    got = rows(ngram_components(df, 3, 80, 100))
    assert got == jaccard_components(list(enumerate(texts)), 3, 80, 100)
    # only the copied texts and their copies are compared at all
    assert {r.doc_id for r in pieces[0]} == {*range(5), *range(40, 45)}
