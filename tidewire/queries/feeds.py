"""Feed parsers, sinks and retention."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewire.operators import ranking as Rk
from tidewire.queries import views as V
from tidewire.queries.registry import query
from tidewire.settings import ChannelSettings, TrendSettings
from tidewire.sinks import editions as Sk
from tidewire.sources import editions as Se
from tidewire.sources import feeds as Fd
from tidewire.sources import pages as Pg
from tidewire.sources.registry import union_sources
from tidewire.workspace import checkpoint_root

_EDITION = f"CAST(DATE '{V.BASE_DAY}' + CAST(page_id % 7 AS INTEGER) AS DATE)"


def _edition(spark, sf):
    return V.table(spark, sf, "pages").withColumn("edition", F.date_add(F.lit(V.BASE_DAY).cast("date"), (F.col("page_id") % 7).cast("int")))


# an anchor's href is made a dated article link so that every rule of the parser decides something
_LINKS = f"""lk AS (SELECT page_id, {_EDITION} AS edition, unnest(range(len(a))) AS ordinal, unnest(a) AS anchor FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>') AS a FROM pages)),
l2 AS (SELECT page_id, edition, ordinal, trim(regexp_extract(anchor, '(?is)^<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href, {V.sql_html_text('anchor')} AS label FROM lk WHERE regexp_matches(anchor, '(?is)^<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']'))"""


@query("page_links", f"WITH {_LINKS} SELECT page_id, CAST(ordinal AS BIGINT) AS ordinal, href, label FROM l2")
def page_links(spark, sf):
    return Pg.page_links(_edition(spark, sf), ["page_id"]).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    "homepage_links",
    f"""WITH {_LINKS}, l3 AS (SELECT edition, page_id * 1000 + ordinal AS pos, label || ' headline text' AS label, 'https://techcrunch.com/' || CASE WHEN ordinal % 4 = 3 THEN 'tag' ELSE '2024/01/' || (20 + ordinal) END || '/' || trim(regexp_replace(href, '[^a-z]', '', 'g')) || '/' || (page_id % 3) AS link, ordinal FROM l2),
 f AS (SELECT *, row_number() OVER (PARTITION BY edition, link ORDER BY pos) AS r FROM l3 WHERE length(label) >= 10 AND contains(link, '/2024/'))
 SELECT edition, pos, substring(label, 1, 150) AS title, link, '2024-01-' || (20 + ordinal) AS publish_time, CASE WHEN date_diff('day', CAST('2024-01-' || (20 + ordinal) AS DATE), edition) <= 1 THEN 1 ELSE 0 END AS priority FROM f WHERE r = 1""",
)
def homepage_links(spark, sf):
    links = Pg.page_links(_edition(spark, sf), ["page_id", "edition"])
    o = F.col("ordinal")
    day = F.when(o % 4 == 3, "tag").otherwise(F.concat(F.lit("2024/01/"), (o + 20).cast("string")))
    links = links.select(
        "edition",
        (F.col("page_id") * 1000 + o).alias("ordinal"),
        F.concat(F.lit("/"), day, F.lit("/"), F.regexp_replace("href", "[^a-z]", ""), F.lit("/"), (F.col("page_id") % 3).cast("string")).alias("href"),
        F.concat("label", F.lit(" headline text")).alias("label"),
        V.reference_ts(F.col("edition")).alias("reference_ts"),
    )
    out = Pg.parse_homepage_links(links, "https://techcrunch.com", "techcrunch.com")
    return out.select("edition", "pos", "title", "link", "publish_time", "priority")


@query(
    "latest_digest_link",
    f"""WITH {_LINKS}, u AS (SELECT page_id, ordinal, label, 'https://news.example.com' || CASE ordinal % 3 WHEN 0 THEN '/daily' WHEN 1 THEN '/news' ELSE '/about' END || href AS link FROM l2 WHERE starts_with(href, '/')),
 s AS (SELECT *, CASE WHEN contains(link, '/daily/') THEN 5 ELSE 0 END + CASE WHEN length(label) BETWEEN 10 AND 100 THEN 3 ELSE 0 END + length(link) / 1000.0::DOUBLE AS score FROM u WHERE regexp_matches(link, '/(daily|article|news|post)/'))
 SELECT page_id, link, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ordinal) AS r FROM s) WHERE r = 1""",
)
def latest_digest_link(spark, sf):
    links = Pg.page_links(_edition(spark, sf), ["page_id"]).filter(F.col("href").startswith("/"))
    kind = F.when(F.col("ordinal") % 3 == 0, "/daily").when(F.col("ordinal") % 3 == 1, "/news").otherwise("/about")
    links = links.withColumn("href", F.concat(kind, "href"))
    return Pg.pick_latest_digest_link(links, ["page_id"], "https://news.example.com").select("page_id", "link", F.round("score", 4).alias("score"))


_CUT = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g')"


@query(
    "article_detail",
    f"""WITH t AS (SELECT page_id, {_CUT} AS h FROM pages), x AS (SELECT page_id, {V.sql_html_text("regexp_extract(h, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")} AS h1, {V.sql_html_text("regexp_extract(h, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")} AS tt,
 {V.sql_html_text("regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)")} AS content FROM t)
 SELECT page_id, CASE WHEN length(h1) > 4 THEN h1 WHEN tt <> '' THEN tt ELSE '未找到标题' END AS title, '未知时间' AS publish_time, md5(content) AS content_md5 FROM x""",
)
def article_detail(spark, sf):
    return Pg.extract_article_detail(V.table(spark, sf, "pages")).select("page_id", "title", "publish_time", F.md5("content").alias("content_md5"))


@query("article_summary")
def article_summary(spark, sf):
    return Pg.extract_article_detail(V.table(spark, sf, "pages")).select("page_id", "description", F.length("description").alias("n"))


@query("atom_feed")
def atom_feed(spark, sf):
    """Atom documents built from page rows, one entry each, parsed back to articles."""
    rows = V.articles(spark, sf).select("edition", "title", "publish_time", "description", "pos")
    esc = [F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")) for c in ("title", "description")]
    entry = F.concat(
        F.lit("<entry><title>"), esc[0], F.lit('</title><link rel="alternate" href="https://www.theverge.com/x/'),
        (F.col("pos") % 30).cast("string"), F.lit('"/><published>'), F.col("publish_time"), F.lit("</published><summary>"), esc[1], F.lit("</summary></entry>"),
    )
    raw = rows.select("edition", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry, F.lit("</feed>")).alias("payload"))
    return Fd.parse_atom_feed(raw).select("edition", "title", "link", "publish_time")


@query(
    "digest_api",
    f"""WITH {V.DOC} SELECT doc_id, title, link, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' ELSE CAST(edition AS VARCHAR) END AS publish_time FROM doc WHERE doc_id % 7 <> 3""",
)
def digest_api(spark, sf):
    d = F.col("doc_id")
    item = F.struct("title", "link", F.when(d % 2 == 0, "2024-01-01").alias("date"), F.col("doc_id").cast("string").alias("description"))
    payload = F.to_json(F.struct((d % 7 != 3).alias("success"), F.array(item).alias("articles")))
    articles, _ = Fd.parse_digest_api(V.doc_articles(spark, sf).select("edition", payload.alias("payload")))
    return articles.select(F.col("description").cast("long").alias("doc_id"), "title", "link", "publish_time")


CHANNELS = ChannelSettings(core_channels=("click", "view", "error"), supplemental_channel="purchase", entity_keywords=("u1", "u2", "u3"))


def channel_items(spark, sf):
    """Events as channel items; ranks follow time."""
    rows = V.events(spark, sf)
    m = F.col("event_id") % 11
    iso = F.date_format(F.col("ts") - F.make_dt_interval(hours=F.when(m == 3, 40).otherwise(F.col("k") % 20)), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(m == 1, iso).when(m == 2, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+00:00")))
    rank = F.row_number().over(Rk.W.partitionBy("edition", "event_type").orderBy("ts", "event_id"))
    return rows.select(
        "edition",
        "event_id",
        F.concat(F.col("ts").cast("string"), F.lit(" UTC")).cast("timestamp").alias("reference_ts"),
        F.col("event_type").alias("channel"),
        rank.alias("rank"),
        F.lit(True).alias("is_item"),
        F.when(m == 4, "  ").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string"), F.lit(" story  "), F.col("k").cast("string"))).alias("title"),
        F.concat(F.lit("text "), F.col("props")).alias("text"),
        F.when(m == 5, "mailto:x").otherwise(F.concat(F.lit("https://h"), (F.col("user_id") % 13).cast("string"), F.lit(".com/"), F.col("k").cast("string"))).alias("url"),
        F.when(m == 6, "ann").otherwise("").alias("author"),
        F.when(m != 7, F.col("value")).alias("hot"),
        stamp.alias("published_at"),
    )


CHAN = f"""{V.EV}, ch AS (SELECT edition, event_id, event_type AS channel, ts, value, k, user_id, row_number() OVER (PARTITION BY edition, event_type ORDER BY ts, event_id) AS rank,
 CASE event_id % 11 WHEN 4 THEN 'invalid_title' WHEN 5 THEN 'invalid_url' WHEN 1 THEN 'invalid_published_at' WHEN 3 THEN 'stale_published_at' END AS reason FROM ev)"""


@query("channel_items", f"WITH {CHAN} SELECT event_id, channel, rank, coalesce(reason, '') AS reason FROM ch")
def parsed_channel_items(spark, sf):
    out = Fd.parse_channel_items(channel_items(spark, sf), CHANNELS)
    return out.select("event_id", "channel", F.col("rank").cast("long").alias("rank"), F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "channel_articles",
    f"""WITH {CHAN} SELECT edition, channel, rank AS pos, 'u' || (user_id % 9) || ' story ' || k AS title, 'https://h' || (user_id % 13) || '.com/' || k AS link, CASE WHEN event_id % 11 = 6 THEN 'ann' ELSE '' END AS author,
 CAST(rank AS VARCHAR) AS channel_rank, event_id % 11 <> 7 AS has_hot FROM ch WHERE reason IS NULL""",
)
def channel_articles(spark, sf):
    rows = Fd.parse_channel_items(channel_items(spark, sf), CHANNELS).filter("reason is null")
    p = F.col("provenance")

    def get(k):
        return F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))

    return Fd.channel_items_to_articles(rows, CHANNELS).select(
        "edition", "channel", "pos", "title", "link", get("author").alias("author"), get("channel_rank").alias("channel_rank"), (get("hot") != "").alias("has_hot")
    )


@query(
    "rank_channel",
    f"""WITH {CHAN} SELECT edition, channel, rank, channel_pos FROM (SELECT *, row_number() OVER (PARTITION BY edition, channel ORDER BY CASE WHEN event_id % 11 <> 7 THEN value END DESC NULLS LAST, rank) AS channel_pos FROM ch WHERE reason IS NULL) WHERE channel_pos <= 6""",
)
def rank_channel(spark, sf):
    rows = Fd.parse_channel_items(channel_items(spark, sf), CHANNELS).filter("reason is null")
    return Rk.rank_channel(rows, 6).select("edition", "channel", F.col("rank").cast("long").alias("rank"), F.col("channel_pos").cast("long").alias("channel_pos"))


@query("select_channel_quota")
def select_channel_quota(spark, sf):
    from tidewire.operators.selection import select_channel_quota as pick

    rows = Fd.parse_channel_items(channel_items(spark, sf), CHANNELS).filter("reason is null")
    return pick(rows, CHANNELS)


@query(
    "parse_movement",
    f"""WITH {V.EV} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'new' WHEN 3 THEN 'steady' END AS state, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 4 THEN NULL ELSE 0 END AS delta, CASE WHEN event_id % 6 <> 0 THEN CAST(k AS VARCHAR) || '.5' END AS heat FROM ev""",
)
def parse_movement(spark, sf):
    k = F.col("k").cast("string")
    m = F.col("event_id") % 5
    raw = F.when(m == 0, F.concat(F.lit(" ▲  "), k)).when(m == 1, F.concat(F.lit("↓ "), k)).when(m == 2, "new").when(m == 3, "—").otherwise("??")
    heat = F.when(F.col("event_id") % 6 == 0, "-1").otherwise(F.concat(F.lit(" "), k, F.lit(".5 ")))
    mv = Fd.parse_movement(raw)
    return V.events(spark, sf).select("event_id", mv["state"].alias("state"), mv["delta"].alias("delta"), Fd.normalize_heat(heat).alias("heat"))


def trends(spark, sf):
    rows = Rk.top_k(V.events(spark, sf), ["edition"], [F.col("value").desc(), F.col("event_id").asc()], 15, "rank")
    m = F.col("event_id") % 4
    return rows.select(
        "edition",
        V.reference_ts(F.col("edition")).alias("reference_ts"),
        "rank",
        F.concat(F.lit("title "), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("term & "), F.col("event_id").cast("string")).alias("term_en"),
        F.concat(F.lit("blurb "), F.col("k").cast("string")).alias("blurb"),
        F.col("k").cast("string").alias("heat"),
        F.when(m == 0, "up").when(m == 1, "down").when(m == 2, "new").otherwise("steady").alias("state"),
        F.when(m <= 1, F.col("k")).otherwise(0).alias("delta"),
        F.when(m == 0, F.concat(F.lit("▲ "), F.col("k"))).when(m == 1, F.concat(F.lit("▼ "), F.col("k"))).when(m == 2, "NEW").otherwise("—").alias("movement"),
    )


TREND = f"{V.EV}, tr AS (SELECT edition, event_id, k, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY value DESC, event_id) AS r FROM ev) WHERE r <= 15)"


@query(
    "trends_to_leads",
    f"""WITH {TREND} SELECT edition, rank AS pos, 'title ' || event_id AS title, 'https://agihunt.info/?day=' || edition || '&t=term+%26+' || event_id AS link, CASE WHEN rank <= 3 THEN 4 WHEN rank <= 10 THEN 3 ELSE 2 END AS priority,
 edition || 'T08:36:00+08:00' AS publish_time, CAST(k AS VARCHAR) AS heat, 'lead' AS kind FROM tr""",
)
def trends_to_leads(spark, sf):
    out = Fd.trends_to_leads(trends(spark, sf), TrendSettings())
    return out.select("edition", "pos", "title", "link", "priority", "publish_time", F.element_at("provenance", "trend_heat").alias("heat"), "kind")


@query(
    "trending_list",
    f"""WITH {TREND} SELECT edition, rank, 'title ' || event_id AS title, 'term & ' || event_id AS term_en, CAST(k AS VARCHAR) AS heat, CASE event_id % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'new' ELSE 'steady' END AS state,
 CASE WHEN event_id % 4 <= 1 THEN k ELSE 0 END AS delta FROM tr WHERE day(edition) % 5 <> 0""",
)
def trending_list(spark, sf):
    """Trending pages rendered from events and parsed back; every fifth day breaks the shape."""
    row = F.concat(
        F.lit("<li><button><span>"), F.col("rank").cast("string"), F.lit('</span><span><span title="'), F.replace("term_en", F.lit("&"), F.lit("&amp;")),
        F.lit('">'), F.col("title"), F.lit("</span><span>"), F.col("blurb"), F.lit("</span><span><span>"), F.col("movement"), F.lit("</span><span>x</span><span>"),
        F.col("heat"), F.lit("</span></span></span></button></li>"),
    )
    pages = trends(spark, sf).groupBy("edition").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("h")))), lambda x: x["h"]), "").alias("rows")
    )
    close = F.when(F.dayofmonth("edition") % 5 == 0, "</div>").otherwise("</main>")
    opening = F.when(F.dayofmonth("edition") % 5 == 0, "<div>").otherwise("<main>")
    pages = pages.select("edition", F.concat(F.lit("<html><ol><li>decoy</li></ol>"), opening, F.lit("<ol>"), "rows", F.lit("</ol>"), close, F.lit("</html>")).alias("html"))
    out, _ = Fd.parse_trending_list(pages)
    return out.select("edition", F.col("rank").cast("long").alias("rank"), "title", "term_en", "heat", "state", "delta")


@query(
    "rank_contiguity",
    f"""WITH {TREND} SELECT edition, count(*) AS n, min(rank) AS lowest, max(rank) AS highest FROM tr WHERE NOT (day(edition) % 3 = 0 AND rank = 2) GROUP BY edition HAVING min(rank) <> 1 OR max(rank) <> count(*)""",
)
def rank_contiguity(spark, sf):
    rows = trends(spark, sf).filter(~((F.dayofmonth("edition") % 3 == 0) & (F.col("rank") == 2)))
    return Rk.rank_contiguity(rows).select("edition", "n", F.col("lowest").cast("long").alias("lowest"), F.col("highest").cast("long").alias("highest"))


@query(
    "union_sources",
    f"""WITH {V.ART}, {V.DOC}, a AS (SELECT edition, title, row_number() OVER (PARTITION BY edition ORDER BY pos) AS r FROM art), d AS (SELECT edition, title, row_number() OVER (PARTITION BY edition ORDER BY pos) AS r FROM doc),
 u AS (SELECT edition, 0 AS o, r, title FROM a WHERE r <= 5 UNION ALL SELECT edition, 2, r, title FROM d) SELECT edition, row_number() OVER (PARTITION BY edition ORDER BY o, r) AS pos, title FROM u""",
)
def union_of_sources(spark, sf):
    return _union(spark, sf)[0].select("edition", "pos", "title")


@query(
    "source_outcomes",
    f"""WITH {V.ART}, {V.DOC}, e AS (SELECT DISTINCT edition FROM art), a AS (SELECT edition, count(*) AS n FROM art GROUP BY edition), d AS (SELECT edition, count(*) AS n FROM doc GROUP BY edition)
 SELECT e.edition, 'pages' AS source, 'ok' AS status, a.n AS fetched_count, least(5, a.n) AS accepted_count FROM e JOIN a USING (edition) UNION ALL SELECT edition, 'gone', 'failed', 0, 0 FROM e
 UNION ALL SELECT e.edition, 'docs', CASE WHEN d.n > 0 THEN 'ok' ELSE 'empty' END, coalesce(d.n, 0), coalesce(d.n, 0) FROM e LEFT JOIN d USING (edition)""",
)
def source_outcomes(spark, sf):
    return _union(spark, sf)[1].select("edition", "source", "status", "fetched_count", "accepted_count")


def _union(spark, sf):
    pages = V.articles(spark, sf)
    docs = V.doc_articles(spark, sf)
    enabled = {"pages": True, "gone": True, "docs": True, "off": False}
    return union_sources(pages.select("edition"), {"pages": pages, "docs": docs, "off": docs}, enabled, {"pages": 5})


@query(
    "publish_if_changed",
    f"WITH {V.DOC}, f AS (SELECT edition, bool_or(doc_id % 500 = 3) AS changed FROM doc GROUP BY edition) SELECT edition, changed FROM f",
)
def publish_if_changed(spark, sf):
    new = V.doc_articles(spark, sf).select("edition", "pos", "title", "link", "doc_id")
    old = new.withColumn("title", F.when(F.col("doc_id") % 500 == 3, "older").otherwise(F.col("title")))
    return Sk.publish_if_changed(new, old, ["pos", "title", "link"])


@query(
    "retention_split",
    f"WITH {V.DOC} SELECT edition, edition >= DATE '2024-01-27' AS kept, count(*) AS n FROM doc GROUP BY edition",
)
def retention_split(spark, sf):
    keep, archive = Sk.retention_split(V.doc_articles(spark, sf).select("edition"), 4, "2024-01-30")
    rows = keep.withColumn("kept", F.lit(True)).union(archive.withColumn("kept", F.lit(False)))
    return rows.groupBy("edition", "kept").agg(F.count(F.lit(1)).alias("n"))


_FILES = f"{V.DOC}, fl AS (SELECT DISTINCT edition, 'data/' || source || '.json' AS file FROM doc)"


@query(
    "archive_manifest",
    f"WITH {_FILES} SELECT edition, 'daily-report-' || edition || '.tar.gz' AS asset_name, string_agg(file, ',' ORDER BY file) AS files, count(*) AS file_count FROM fl WHERE edition < DATE '2024-01-28' GROUP BY edition",
)
def archive_manifest(spark, sf):
    files = V.doc_articles(spark, sf).select("edition", F.concat(F.lit("data/"), "source", F.lit(".json")).alias("file")).distinct()
    _, archive = Sk.retention_split(files, 3, "2024-01-30")
    return Sk.archive_manifest(archive).withColumn("files", F.array_join("files", ","))


@query("retention_counts", f"WITH {_FILES} SELECT edition, count(*) AS n FROM fl GROUP BY edition")
def retention_counts(spark, sf):
    from tidewire.operators.metrics import retention_counts as count

    return count(V.doc_articles(spark, sf).select("edition", "source").distinct())


def _scratch(spark, name):
    """Fresh folder below the checkpoint root, or a temporary one for a local path."""
    import uuid

    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_and_read_edition", f"WITH {V.DOC} SELECT edition, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS chars FROM doc GROUP BY edition")
def write_and_read_edition(spark, sf):
    path = _scratch(spark, "editions")
    rows = V.doc_articles(spark, sf)
    Sk.write_edition(rows.filter("edition < date '2024-01-28'").withColumn("title", F.lit("stale")), path)
    # the second write replaces only the editions it carries
    Sk.write_edition(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.to_date("edition").alias("edition")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).alias("chars"))


@query(
    "markdown_edition",
    f"WITH {V.DOC} SELECT CAST(edition AS VARCHAR) AS date, count(*) + 7 AS lines, CAST(min(pos) AS BIGINT) AS least FROM doc GROUP BY edition",
)
def markdown_edition(spark, sf):
    """Markdown pages written per edition as lines and read back."""
    path = _scratch(spark, "markdown")
    items = Rk.global_rank(V.doc_articles(spark, sf), ["edition"], [F.col("pos")], "item_no").select(
        "edition", "item_no", F.col("title").alias("summary"), F.col("pos").cast("string").alias("why_it_matters")
    )
    topics = items.select("edition").distinct().withColumn("discussion_topic", F.lit("topic"))
    Sk.write_markdown_lines(Sk.markdown_lines(items, topics), path)
    back = spark.read.option("lineSep", "\n").text(path)
    number = F.regexp_extract("value", r"^(\d+)\. ", 1)
    return back.groupBy(F.col("edition").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("lines"), F.min(F.when(number != "", number.cast("long"))).alias("least")
    )


@query(
    "read_editions",
    f"""WITH {V.DOC}, r AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY priority DESC, pos) AS place FROM doc)
 SELECT edition, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS title_chars, CAST(sum(length(content)) AS BIGINT) AS content_chars,
  CAST(max(place) AS BIGINT) AS last, CAST(sum(place * (length(title) + 7 * priority)) AS BIGINT) AS order_sum FROM r GROUP BY edition""",
)
def read_editions(spark, sf):
    """JSON editions written as bounded records and read back in order."""
    path = _scratch(spark, "json")
    rows = Rk.global_rank(V.doc_articles(spark, sf), ["edition"], Rk.priority_order(), "place")
    Sk.write_edition_json(rows.select("edition", "place", "title", "link", "content", "source", "priority"), path, "place")
    found = Se.edition_articles(Se.read_editions(spark, path, lines=True))
    return found.groupBy("edition").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("title")).alias("title_chars"),
        F.sum(F.length("content")).alias("content_chars"),
        F.max("pos").alias("last"),
        F.sum(F.col("pos") * (F.length("title") + 7 * F.col("priority"))).alias("order_sum"),
    )


@query(
    "latest_run_status",
    f"WITH {V.EV} SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, event_id) AS status FROM ev GROUP BY user_id",
)
def latest_run_status(spark, sf):
    rows = V.events(spark, sf).select(
        F.col("user_id").cast("string").alias("run_id"), "edition", F.col("event_type").alias("status"), F.lit("").alias("reason"), F.col("event_id").alias("updated_at")
    )
    path = _scratch(spark, "manifests")
    Sk.write_run_manifest(rows.filter("updated_at % 2 = 0"), path)
    Sk.write_run_manifest(rows.filter("updated_at % 2 = 1"), path)
    return Sk.latest_run_status(spark.read.parquet(path)).select("run_id", "status")


