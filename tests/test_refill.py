"""Refill rounds against a model that looks at one result after the other, and how far they look."""

import datetime as dt
import random
from difflib import SequenceMatcher

from helpers import CATALOG
from pyspark.sql import functions as F

from tidewire.functions import tokens as K
from tidewire.functions.text import normalize_title_search
from tidewire.operators import evidence as Ev
from tidewire.operators import similarity as Sm
from tidewire.settings import EnrichSettings

DAYS = [dt.date(2026, 7, 1), dt.date(2026, 7, 2)]
RESULTS = "edition date, round int, rank int, title string, url string, published_date string, reference_ts timestamp"
KNOWN = "edition date, title string, url string"


def title(rng):
    subject, verb, place = rng.choice(["OpenLab", "Mega AI", "ChipCo", "A robot", "Orca"]), rng.choice(["launches", "raises", "sues"]), rng.choice(["Ohio", "Berlin", "Kyoto", "Lima"])
    return f"{subject} {verb} {rng.choice(['battery', 'silicon', 'harvest', 'weather', 'orbital'])} {rng.choice(['plant', 'museum', 'ledger', 'bridge'])} {place} {rng.choice(['', 'x', 'again'])}".strip()


def tables(spark, seed, count):
    rng = random.Random(seed)
    results = []
    for day in DAYS:
        for number in (1, 2):
            for rank in range(1, count + 1):
                at = dt.datetime(day.year, day.month, day.day, 1) - dt.timedelta(hours=rng.choice([3, 9, 200]))
                results.append((day, number, rank, title(rng), f"https://h.com/{rng.randrange(60)}", at.strftime("%Y-%m-%dT%H:%M:%SZ"), dt.datetime(day.year, day.month, day.day, 1)))
    base, prior = ([(d, title(rng), f"https://h.com/{rng.randrange(200)}") for d in DAYS for _ in range(3)] for _ in range(2))
    return spark.createDataFrame(results, RESULTS), spark.createDataFrame(base, KNOWN), spark.createDataFrame(prior, KNOWN)


def forms(spark, *frames):
    out = {}
    for df in frames:
        for r in df.select("title", normalize_title_search("title").alias("n"), K.story_tokens("title").alias("t")).distinct().collect():
            out[r.title] = (r.n, set(r.t))
    return out


def relation(forms, a, b):
    (na, ta), (nb, tb) = forms[a], forms[b]
    if round(SequenceMatcher(None, na, nb).ratio(), 4) >= 0.82:
        return "near"
    shared = len(ta & tb)
    return "cluster" if shared >= 3 and round(shared / min(len(ta), len(tb)), 4) >= 0.35 else None


def model(rows, prior, needed, forms):
    """(edition, round, rank) -> (accepted, near, cluster), by the flags that the rows carry."""
    out = {}
    for day, slots in needed.items():
        known = [r.title for r in prior if r.edition == day]
        for number in (1, 2):
            if slots <= 0:
                break
            for r in sorted((r for r in rows if r.edition == day and r.round == number), key=lambda r: r.rank):
                found = {relation(forms, r.title, t) for t in known}
                good = r.within_strict and r.ai_title_relevant and not r.duplicate_existing and not r.duplicate_within_results
                taken = bool(good and found <= {None})
                out[day, number, r.rank] = (taken, "near" in found, "near" not in found and "cluster" in found)
                if taken:
                    known.append(r.title)
                    slots -= 1
                    if slots == 0:
                        break
    return out


def test_rounds_equal_one_result_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(Ev, "LOT", 3)
    monkeypatch.setattr(Sm, "SIDE", 4)
    monkeypatch.setattr(Sm, "FACING", 5)
    results, base, prior = tables(spark, 5, 30)
    needed = spark.createDataFrame([(DAYS[0], 4), (DAYS[1], 100)], "edition date, needed int")
    got = Ev.accept_refill(results, base, prior, needed, CATALOG, EnrichSettings(max_refill_rounds=2, strict_hours=72)).collect()
    want = model(got, prior.collect(), {DAYS[0]: 4, DAYS[1]: 100}, forms(spark, results, prior))
    assert {(r.edition, r.round, r.rank): (r.accepted, r.near_duplicate_existing, r.story_cluster_existing) for r in got} == want
    assert len(want) == len(got) and {v for v in want.values()} == {(True, False, False), (False, True, False), (False, False, True), (False, False, False)}
    # an edition whose slots stay open is looked at to the end, the other one up to its last slot
    assert sum(r.edition == DAYS[1] for r in got) == 60 and sum(r.accepted for r in got if r.edition == DAYS[0]) == 4


def test_titles_are_not_compared_beyond_the_lot_of_the_last_slot(spark, monkeypatch):
    monkeypatch.setattr(Ev, "LOT", 8)
    compared = []
    across = Ev.facing_relations
    monkeypatch.setattr(Ev, "facing_relations", lambda left, right: compared.append(left.count()) or across(left, right))
    results, base, prior = tables(spark, 6, 200)
    needed = results.select("edition").distinct().withColumn("needed", F.lit(1))
    Ev.accept_refill(results, base, prior, needed, CATALOG, EnrichSettings(max_refill_rounds=2, strict_hours=72)).collect()
    assert compared and sum(compared) <= 64


def test_sides_equal_all_pairs(spark):
    rng = random.Random(7)
    names = [title(rng) for _ in range(40)] + ["", "ab", "abc", "abcd", "é", "...", None, "long words " * 40, "long words " * 39 + "other"]
    left = spark.createDataFrame([(DAYS[0], t) for t in names[::2] + names[-9:]], "edition date, title string")
    right = spark.createDataFrame([(DAYS[0], t) for t in names[1::2] + names[-9:]], "edition date, title string")
    sides = Sm.facing_titles(right)
    rows = Sm.facing_relations(Sm.facing_titles(left), sides.withColumn("known", F.lit(False))).collect()
    known = Sm.facing_relations(Sm.facing_titles(left), sides.withColumn("known", F.lit(True))).collect()
    shapes = {r.id: (r.norm, set(r.tokens)) for r in Sm.facing_titles(left.union(right)).collect()}
    lefts, rights = ({r.id for r in Sm.facing_titles(df).collect()} for df in (left, right))
    want = {(a, b): relation(shapes, a, b) for a in lefts for b in rights}
    assert {(r.left_id, r.right_id): "near" if r.near else "cluster" for r in rows} == {k: v for k, v in want.items() if v}
    best = {a: {v for (x, _), v in want.items() if x == a} - {None} for a in lefts}
    assert {(r.left_id, r.near) for r in known} == {(a, "near" in v) for a, v in best.items() if v} and len(known) == len({r.left_id for r in known})
