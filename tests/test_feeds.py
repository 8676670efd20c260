import datetime as dt
import json

from helpers import CATALOG, article, frame
from pyspark.sql import functions as F

from tidewire.functions.text import html_text
from tidewire.operators import dedupe as Dd
from tidewire.operators import evidence as Ev
from tidewire.operators import validate as Vd
from tidewire.settings import EnrichSettings
from tidewire.sinks import editions as Sk
from tidewire.sources import editions as Se
from tidewire.sources import feeds as Fd
from tidewire.sources import pages as Pg
from tidewire.sources.registry import SourceRegistry
from tidewire.streaming import feed as St

DAY = dt.date(2026, 7, 16)

HOSTS = ("news.site.test",)
HEAD = '<feed xmlns="http://www.w3.org/2005/Atom">'


def entry(title, *links, published="2026-07-16T10:30:00Z", summary=None):
    body = f"<title>{title}</title>" + "".join(f"<link {x}/>" for x in links)
    body += f"<published>{published}</published>" if published else ""
    return f"<entry>{body}{'' if summary is None else f'<summary>{summary}</summary>'}</entry>"


def test_atom_feed_payloads_ties_and_rejects(spark):
    url = "https://news.site.test/robots/{}"
    plain = lambda n: f'href="{url.format(n)}"'
    first = HEAD + entry("Rover maps a frozen lake", plain(1), summary="<![CDATA[<i>Two</i> passes &amp; done]]>")
    first += entry("Nine chars", plain(2), summary="kept, ten characters") + entry("Too short", plain(3))
    first += entry("A reply page is no article", f'rel="replies" href="{url.format(4)}"')
    first += entry("The article follows its replies", f'rel="replies" href="{url.format(5)}"', f'rel="alternate" {plain(6)}')
    first += entry("Without any link at all") + entry("Without a date of its own", plain(7), published="")
    first += entry("Somebody else wrote this one", 'href="https://other.test/robots/8"') + entry("The front page itself", 'href="https://news.site.test/"') + "</feed>"
    second = HEAD + entry("Same place in a second payload", plain(9)) + entry("Later copy of the lake", plain(1)) + "</feed>"
    raw = spark.createDataFrame([(DAY, first), (DAY, second), (DAY, HEAD + "</feed>"), (DAY, None)], "edition date, payload string")
    got = {r.link: r for r in Fd.parse_atom_feed(raw, hosts=HOSTS).collect()}
    assert {k.rsplit("/", 1)[1] for k in got} == {"1", "2", "6", "9"}
    assert (got[url.format(1)].title, got[url.format(1)].description) == ("Rover maps a frozen lake", "Two passes & done")
    again = {r.link: r for r in Fd.parse_atom_feed(raw.repartition(3), hosts=HOSTS).collect()}
    assert again == got


def trend_row(rank, term, movement="▲ 10", heat="9.5"):
    return (
        f'<li><button><span>{rank}</span><span><span title="{term}">标题 {rank}</span><span>blurb</span>'
        f"<span><span>{movement}</span><span>x</span><span>{heat}</span></span></span></button></li>"
    )


def test_trending_shapes(spark):
    good = "<ol><li>decoy</li></ol><main><ol>" + trend_row(1, "a") + trend_row(2, "b", "新上榜") + "</ol></main>"
    cases = {
        "2026-07-01": good,
        "2026-07-02": "<div></div>",
        "2026-07-03": "<main><ol>" + trend_row(1, "a") + trend_row(3, "b") + "</ol></main>",
        "2026-07-04": "<main><ol>" + trend_row(1, "a") + trend_row(2, "a") + "</ol></main>",
        "2026-07-05": "<main><ol>" + trend_row(1, "a", "sideways") + "</ol></main>",
        "2026-07-06": "<main><ol>" + trend_row(1, "a", heat="-3") + "</ol></main>",
    }
    pages = spark.createDataFrame([(dt.date.fromisoformat(d), h) for d, h in cases.items()], "edition date, html string")
    trends, failed = Fd.parse_trending_list(pages)
    assert [(r["rank"], r.term_en, r.state, r.delta) for r in trends.orderBy("rank").collect()] == [(1, "a", "up", 10), (2, "b", "new", 0)]
    assert {str(r.edition): r.code for r in failed.collect()} == {
        "2026-07-02": "no_main",
        "2026-07-03": "rank_contiguity",
        "2026-07-04": "term_uniqueness",
        "2026-07-05": "movement",
        "2026-07-06": "heat",
    }


def test_page_detail(spark):
    html = (
        "<html><head><title>Page title</title><meta property='article:published_time' content='2026-07-18T01:02:03Z'></head>"
        "<body><h1>Hey</h1><div class='post-title big'>Real headline here</div><article><p>short</p>"
        "<p>This paragraph is long enough to count.</p><ul><li>And this list item is also long enough.</li></ul></article></body></html>"
    )
    row = Pg.extract_article_detail(spark.createDataFrame([(html,)], "html string")).first()
    assert row.title == "Real headline here" and row.publish_time == "2026-07-18T01:02:03Z"
    assert row.description == "This paragraph is long enough to count. And this list item is also long enough."
    timed = "<time datetime='2026-07-18'>x</time><article><p>" + "word " * 100 + "</p></article>"
    row = Pg.extract_article_detail(spark.createDataFrame([(timed,)], "html string")).first()
    assert row.publish_time == "2026-07-18" and len(row.description) == 400 and row.description.endswith("…")
    assert spark.range(1).select(html_text(F.lit("<b>a</b>&amp;<i>b</i>"))).first()[0] == "a & b"


def test_edition_files(spark, tmp_path):
    doc = {"date": "2026-07-17", "articles": [{"title": "t1", "link": "l1", "priority": 1}], "summary": {"items": [{"article_id": "a1", "url": "u"}]}}
    (tmp_path / "2026-07-17.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "2026-07-18.json").write_text('{"articles": [')
    (tmp_path / "notes.json").write_text(json.dumps(doc))
    rows = Se.read_editions(spark, str(tmp_path))
    assert [str(r.edition) for r in rows.collect()] == ["2026-07-17"]
    assert Se.edition_articles(rows).first().title == "t1" and Se.edition_items(rows).first().url == "u"
    md = tmp_path / "md"
    md.mkdir()
    (md / "2026-07-17.md").write_text("---\ntitle: T: x\ndate: 2026-07-17\n---\n\nbody\n")
    (md / "2026-07-16.md").write_text("plain")
    got = {str(r.edition): (r.title, r.date, r.body.strip()) for r in Se.read_markdown_editions(spark, str(md)).collect()}
    assert got == {"2026-07-17": ("T: x", "2026-07-17", "body"), "2026-07-16": ("2026-07-16", "2026-07-16", "plain")}


def test_markdown_and_registry(spark):
    items = spark.createDataFrame([(DAY, 2, "乙: 二。", ""), (DAY, 1, "[a1] 甲。", "影响。")], "edition date, item_no int, summary string, why_it_matters string")
    topics = spark.createDataFrame([(DAY, "话题"), (dt.date(2026, 7, 17), "空")], "edition date, discussion_topic string")
    got = {str(r.edition): r.body for r in Sk.render_markdown(items, topics).collect()}
    assert got["2026-07-16"] == "1. 甲。影响。\n2. 乙， 二。\n\n💬 互动话题：话题"
    assert got["2026-07-17"].startswith("今日没有达到证据门槛的主新闻。")
    registry = SourceRegistry({"x": lambda df: df})
    assert registry.get("y") is None and list(registry.parse({"x": topics, "y": topics})) == ["x"]


def result(pos, rnd, rank, title, url, score=0.9, date="2026-07-18T00:00:00+00:00", text="word " * 30):
    return (dt.date(2026, 7, 18), pos, rnd, rank, title, url, date, score, text, "", "2026-07-18T01:00:00+00:00")


def test_evidence_rules(spark):
    leads = frame(
        spark,
        [
            article(1, "OpenLab GPT K3 launch", "https://agihunt.info/?t=1", kind="lead", description="", provenance={"trend_rank": "1"}),
            article(2, "Plain chair factory story", "https://a.com/x"),
            article(3, "巨型发布会", "https://b.com/x", kind="lead", description=""),
        ],
    )
    rows = [
        result(1, 1, 1, "Mega Orca K3 launch", "https://n.com/1"),  # other entity
        result(1, 1, 2, "OpenLab GPT launch", "https://n.com/2"),  # version missing
        result(1, 1, 3, "OpenLab GPT K3 launch", "https://n.com/3", 0.5),
        result(1, 1, 4, "OpenLab GPT K3 launch", "https://n.com/3", 0.9),  # same URL
        result(1, 1, 5, "GPT K3 launch by OpenLab", "https://m.com/4", 0.8),
        result(1, 1, 6, "GPT K3 launch again", "https://m.com/5", 0.7),
        result(1, 1, 7, "GPT K3 launch later", "https://m.com/6", 0.7),  # after the stop
        result(1, 2, 1, "GPT K3 launch later", "https://m.com/6", 0.7),  # one more in round two
        result(1, 2, 2, "GPT K3 launch last", "https://m.com/7", 0.7),
        result(2, 1, 1, "anything", "https://a.com/x"),  # own URL
        result(2, 1, 2, "chair factory", "https://x.com/1"),  # social host
        result(2, 1, 3, "chair factory", "https://k.com/2", 0.1),  # low score
        result(3, 1, 1, "关于巨型发布会的消息", "https://c.com/1", text="字" * 90),
    ]
    df = spark.createDataFrame(rows, "edition date, pos long, round int, rank int, title string, url string, published_date string, score double, content string, raw_content string, r string")
    df = df.withColumn("reference_ts", F.col("r").cast("timestamp")).drop("r")
    out = Ev.match_evidence(leads, df, CATALOG, EnrichSettings())
    got = {(r.pos, r["round"], r["rank"]) for r in out.filter("accepted").collect()}
    assert got == {(1, 1, 3), (1, 1, 5), (1, 1, 6), (1, 2, 1), (2, 1, 1), (3, 1, 1)}
    accepted = out.filter("accepted")
    story = {r.pos: r for r in Ev.resolve_stories(leads.filter("kind = 'lead'"), accepted).collect()}
    assert story[1].link == "https://m.com/4" and story[1].confidence == "corroborated"
    assert story[1].provenance["evidence_urls"] == "https://m.com/4|https://m.com/5|https://m.com/6"
    assert story[3].confidence == "reported" and story[3].provenance["lead_title"] == "巨型发布会"
    kept = Ev.enrich_stories(leads.filter("kind = 'story'"), accepted).first()
    assert kept.title == "Plain chair factory story" and [e.origin for e in kept.evidence] == ["fetch"]


def test_recent_antijoin_and_grounding(spark):
    rows = [article(i, f"t{i}", f"https://www.h.com/{i}/?q=1", dt.date(2026, 7, 10)) for i in range(1, 5)]
    past = [(dt.date(2026, 7, 9), "http://h.com/1"), (dt.date(2026, 7, 7), "https://h.com/2/"), (dt.date(2026, 7, 6), "https://h.com/3"), (dt.date(2026, 7, 10), "https://h.com/4")]
    history = spark.createDataFrame(past, "edition date, url string")
    kept, removed, checked = Dd.recent_exact_antijoin(frame(spark, rows), history)
    assert sorted(r.pos for r in kept.collect()) == [3, 4] and sorted(r.pos for r in removed.collect()) == [1, 2]
    assert sorted(str(r.checked_day) for r in checked.collect()) == ["2026-07-07", "2026-07-09"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    arts = frame(spark, [article(1, "raised $2 billion", description="two people")]).withColumn("article_id", F.lit("a1"))
    items = spark.createDataFrame([(dt.date(2026, 7, 18), "a1", "融资20亿，涨30%", "")], "edition date, article_id string, summary string, why_it_matters string")
    got = {(r.rule, r.detail) for r in Vd.check_grounding(items, arts).collect()}
    assert got == {("unsupported_number", "30%"), ("unsupported_funding_or_valuation", "")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    base = dt.datetime(2026, 7, 18, 12)
    rows = [(f"https://h.com/{i % 3}", base + dt.timedelta(hours=h), "fetch", "timeout") for i, h in enumerate((0, -1, -2, -3, -40, 1))]
    df = spark.createDataFrame(rows, "link string, published_at timestamp, stage string, outcome string").withColumn("title", F.col("link"))
    df.write.parquet(src)

    def stream():
        return spark.readStream.schema(df.schema).parquet(src)

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    ref = F.lit(base).cast("timestamp")
    fresh, rejects = St.stream_freshness_gate(stream(), ref)
    assert run(fresh, "fresh").count() == 4
    assert sorted(r.reason for r in run(rejects, "rejects").collect()) == ["future_published_at", "stale_published_at"]
    assert run(St.stream_recent_dedupe(stream()), "dedupe").count() == 3
    daily = run(St.stream_daily_diagnostics(stream(), "published_at"), "daily", "complete")
    assert daily.agg(F.sum("n")).first()[0] == 6


def test_stream_close_delivers_each_day_once_and_whole(spark, tmp_path):
    src, base = str(tmp_path / "in"), dt.datetime(2026, 7, 18, 12)
    schema = "link string, published_at timestamp, tags map<string,string>"

    def land(*hours):
        rows = [(f"https://h.test/{h}", base + dt.timedelta(hours=h), {"a": str(h)}) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    seen = []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = St.stream_edition_close(stream, lambda rows, i: seen.append(sorted(r.link[15:] for r in rows.collect())), str(tmp_path / "ck"), str(tmp_path / "store"))
        q.awaitTermination()

    # one day in two batches, the next day opens without closing it
    land(0, 1, -2)
    land(5)
    land(13)
    run()
    assert seen == []
    # a restart with a row beyond the grace period: the day comes whole
    land(19)
    run()
    assert seen == [["-2", "0", "1", "5"]]
    # a late row of the closed day is not delivered, the next day is
    land(2, 43)
    run()
    assert seen[1:] == [["13", "19"]]


def test_stream_dedupe_takes_map_columns(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("https://h.test/a", "t", {"x": "1"}), ("https://h.test/a", "t", {"x": "2"}), ("", "t", {"x": "1"}), ("", "t", {"x": "2"})]
    df = spark.createDataFrame(rows, "link string, title string, provenance map<string,string>").withColumn("published_at", F.lit("2026-07-18 12:00:00").cast("timestamp"))
    df.write.parquet(src)
    out = St.stream_recent_dedupe(spark.readStream.schema(df.schema).parquet(src))
    q = out.writeStream.format("memory").queryName("maps").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("maps").count() == 3
