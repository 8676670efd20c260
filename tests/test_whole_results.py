"""Nothing is cut in silence: unions, short titles, dated links, caps given by the caller, catalog checks."""

import datetime as dt

import pytest
from helpers import CATALOG, DAY, article, frame

from tidewire.operators.catalog import catalog_problems, load_catalog
from tidewire.operators.ranking import admission_split
from tidewire.operators.similarity import near_duplicate_pairs
from tidewire.sources.pages import parse_homepage_links
from tidewire.sources.registry import beyond_caps, union_sources


def test_union_of_many_sources_keeps_all_rows(spark):
    rows = frame(spark, [article(i, f"headline number {i}") for i in range(14)])
    sources = {f"s{i}": rows for i in range(80)}
    every, runs = union_sources(rows.select("edition"), sources, dict.fromkeys(sources, True))
    assert every.count() == 80 * 14 == runs.groupBy().sum("accepted_count").first()[0]
    assert every.select("pos").distinct().count() == 80 * 14
    capped, _ = union_sources(rows.select("edition"), {"s0": rows}, {"s0": True}, {"s0": 5})
    over = beyond_caps({"s0": rows}, {"s0": True}, {"s0": 5})
    assert capped.count() == 5 and over.count() == 9 and {r.reason for r in over.collect()} == {"source_cap"}


def test_titles_of_three_and_four_characters(spark):
    import difflib

    titles = ["华为发", "华为发布", "华为", "abc", "abcd", "axbc", "bcda", "dabc", "abca", "aab", "abaa", "abcde"]
    df = spark.createDataFrame([(DAY, t) for t in titles], "edition date, norm string")
    got = {frozenset((r["left"], r["right"])) for r in near_duplicate_pairs(df).collect()}
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
    want = {frozenset((a, b)) for a in titles for b in titles if a != b and max(ratio(a, b), ratio(b, a)) >= 0.82}
    assert got == want and frozenset(("华为发", "华为发布")) in got
    with pytest.raises(ValueError):
        near_duplicate_pairs(df, 0.7)


def test_dated_links_of_any_year_and_caps_of_the_caller(spark):
    stamp = dt.datetime(2031, 5, 2, 12)
    links = [(DAY, i, f"https://a.test/{y}/05/02/x{i}", "A headline of some length", stamp) for i, y in enumerate(["2031", "1999", "tag"])]
    df = spark.createDataFrame(links, "edition date, ordinal int, href string, label string, reference_ts timestamp")
    assert {r.pos for r in parse_homepage_links(df, "https://a.test", "a.test").collect()} == {0, 1}
    rows = frame(spark, [article(i, f"OpenLab launches model {i}") for i in range(45)])
    from tidewire.operators.catalog import analyze_articles

    admitted, dropped = admission_split(analyze_articles(rows, CATALOG), cap=40)
    assert (admitted.count(), dropped.count()) == (40, 5)


def test_catalog_reports_all_problems_at_once():
    spec = {
        "core_ai_terms": ["AI", " ai "],
        "actions": {"x": "no list"},
        "entities": [{"id": "a"}, {"id": "a", "models": [{"id": "m"}, {"aliases": []}]}, {"id": ""}],
    }
    problems = catalog_problems(spec)
    assert len(problems) == 5, problems
    with pytest.raises(ValueError, match="entity id 'a' stands 2 times"):
        load_catalog(spec)
    assert load_catalog({"entities": [{"id": " b ", "name": None}]}).entities[0].name == "b"
