"""Links in public text against containment of strings."""

import random
import re

from tidewire.operators.validate import leak_check

PUBLIC = "edition string, page string, body string"
ARTICLES = "edition string, link string"


def model(public, links):
    """By the definition: every place of every link's text in every body."""
    rows = set()
    for edition, page, body in public:
        for link in {(url or "").strip() for day, url in links if day == edition}:
            if link and not re.search(r"\s", link):
                places = [m.start() for m in re.finditer(f"(?={re.escape(link)})", body or "")]
                if any(i == 0 or not re.match("[A-Za-z0-9]", body[i - 1]) or re.match("https?://", body[i:]) for i in places):
                    rows.add((edition, page, "source_url", link))
    return rows


def found(spark, public, links):
    got = leak_check(spark.createDataFrame(public, PUBLIC), spark.createDataFrame(links, ARTICLES)).collect()
    rows = [(r.edition, r.subject_id, r.rule, r.detail) for r in got if r.rule == "source_url"]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_links_equal_containment(spark):
    rng = random.Random(5)
    parts = ["https://", "http://", "ftp://", "a.de", "b.com", "/", "/1", "/12", "?q=1", "#x", "-", "é", "z"]
    link = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
    days = ["d1", "d2", "d3"]
    links = [(rng.choice(days), link()) for _ in range(60)] + [("d1", None), ("d1", " "), ("d1", "a b"), ("d2", " a.de/1 "), ("d2", "a.de/1")]
    public = [(rng.choice(days), str(i), rng.choice(["", " ", ",", "x"]).join(link() for _ in range(rng.randint(1, 12)))) for i in range(120)]
    public += [("d1", "null", None), ("d1", "empty", ""), ("d9", "nolinks", "https://a.de/1")]
    want = model(public, links)
    assert len(want) > 100 and found(spark, public, links) == want


def test_links_without_scheme_and_partial_words(spark):
    links = [("d", "example.com/a"), ("d", "https://x.org/1"), ("d", "//cdn.net/p"), ("d", "token")]
    public = [
        ("d", "1", "see (example.com/a) now"),
        ("d", "2", "read https://x.org/12/more and //cdn.net/path"),
        ("d", "3", "myexample.com/a"),
        ("d", "4", "a token, tokens and xhttps://x.org/1"),
        ("d", "5", "broken"),
    ]
    want = {("1", "example.com/a"), ("2", "https://x.org/1"), ("2", "//cdn.net/p"), ("4", "token"), ("4", "https://x.org/1")}
    assert {(p, d) for _, p, _, d in found(spark, public, links)} == want


def test_long_unbroken_text_and_empty_tables(spark):
    """A body of half a million signs without a space takes time in step with its length."""
    body = "/".join(["q1"] * 200_000) + "https://x.org/1"
    assert found(spark, [("d", "p", body)], [("d", "https://x.org/1"), ("d", "https://x.org/2")]) == {("d", "p", "source_url", "https://x.org/1")}
    assert found(spark, [], [("d", "https://x.org/1")]) == set() == found(spark, [("d", "p", "x")], [])


def test_bodies_of_an_edition_are_not_brought_together(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(50).selectExpr("date'2026-07-01' as edition", "string(id) as page", "concat('see https://h.com/', id, '/more') as body")
        links = spark.range(50).selectExpr("date'2026-07-01' as edition", "concat('https://h.com/', id) as link")
        found = leak_check(pages, links)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(SortMergeJoin|ShuffledHashJoin)\S* \[edition#\d+\]", plan)
        # with one digit and with two
        assert found.filter("rule = 'source_url'").count() == 10 + 40 * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
