"""Landed feed payloads (Atom, digest JSON, channel JSON, trending pages) to article rows."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.functions.text import clean_html_fragment, compact_text, strip, text
from tidewire.functions.urls import domain_of, is_http_url, path_of, with_query
from tidewire.operators.ranking import top_k
from tidewire.settings import REPORT_TZ, ChannelSettings, TrendSettings

_ATOM = (
    "entry array<struct<title:string,published:string,summary:string,"
    "link:array<struct<_rel:string,_href:string>>>>"
)


def parse_atom_feed(
    raw: DataFrame, source: str = "theverge", hosts: tuple[str, ...] = ("theverge.com", "www.theverge.com")
) -> DataFrame:
    """raw: (edition, payload). Entries with a usable title, date and article link, in feed order."""
    feed = F.from_xml("payload", _ATOM, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    rows = raw.select("edition", F.xxhash64("payload").alias("_p"), F.posexplode(feed["entry"]).alias("_i", "e"))
    e = F.col("e")
    alternate = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    rows = rows.select(
        "edition",
        "_i",
        "_p",
        clean_html_fragment(e["title"]).alias("title"),
        strip(F.try_element_at(alternate, F.lit(1))["_href"]).alias("link"),
        strip(e["published"]).alias("publish_time"),
        clean_html_fragment(e["summary"]).alias("description"),
    )
    ok = (
        (F.length("title") >= 10)
        & D.parse_published("publish_time").isNotNull()
        & is_http_url("link")
        & domain_of("link").isin(*hosts)
        & ~path_of("link").isin("", "/")
    )
    # of equal places in several payloads the hash decides, so that reruns agree
    first = top_k(rows.filter(ok), ["edition", "link"], [F.col("_i").asc(), F.col("_p").asc(), F.col("title").asc()], 1, "_r")
    return first.select(
        "edition",
        F.col("_i").cast("long").alias("pos"),
        F.substring("title", 1, 200).alias("title"),
        "link",
        "description",
        "publish_time",
        F.lit(1).alias("priority"),
        F.lit(source).alias("source"),
    )


def parse_digest_api(raw: DataFrame, source: str = "syft", limit: int = 14) -> tuple[DataFrame, DataFrame]:
    """raw: (edition, payload). (articles, editions whose payload reports no success)."""
    shape = "success boolean, articles array<struct<title:string,link:string,description:string,date:string>>"
    rows = raw.withColumn("p", F.from_json("payload", shape))
    good = F.coalesce(F.col("p.success"), F.lit(False))
    articles = rows.filter(good).select("edition", F.posexplode("p.articles").alias("pos", "a")).filter(F.col("pos") < limit)
    articles = articles.select(
        "edition",
        F.col("pos").cast("long").alias("pos"),
        text("a.title").alias("title"),
        text("a.link").alias("link"),
        text("a.description").alias("description"),
        F.coalesce("a.date", F.col("edition").cast("string")).alias("publish_time"),
        F.lit(1).alias("priority"),
        F.lit(source).alias("source"),
    )
    return articles, rows.filter(~good).select("edition", F.lit(source).alias("source"))


def explode_channels(raw: DataFrame) -> DataFrame:
    """raw: (edition, reference_ts, channel, payload) with payload {"items": [...]}. Ranks are list positions."""
    shape = "items array<struct<title:string,text:string,url:string,author:string,hot:double,published_at:string>>"
    items = raw.select(
        "edition", "reference_ts", "channel", F.posexplode(F.from_json("payload", shape)["items"]).alias("_i", "x")
    )
    return items.select("edition", "reference_ts", "channel", (F.col("_i") + 1).alias("rank"), F.col("x").isNotNull().alias("is_item"), "x.*")


def parse_channel_items(items: DataFrame, settings: ChannelSettings = ChannelSettings()) -> DataFrame:
    """Add published_ts and the first reason to refuse an item (NULL when it is fine)."""
    at = D.parse_strict("published_at")
    ref = F.col("reference_ts")
    ahead = ref + F.make_dt_interval(mins=F.lit(settings.future_tolerance_minutes))
    oldest = ref - F.make_dt_interval(hours=F.lit(settings.max_age_hours))
    rows = items.withColumn("published_ts", at)
    reason = (
        F.when(~F.col("is_item"), "invalid_item")
        .when(strip("title") == "", "invalid_title")
        .when(~is_http_url("url"), "invalid_url")
        .when(F.col("published_ts").isNull(), "invalid_published_at")
        .when(F.col("published_ts") > ahead, "future_published_at")
        .when(F.col("published_ts") < oldest, "stale_published_at")
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("title", compact_text("title"))
        .withColumn("text", compact_text("text"))
        .withColumn("url", strip("url"))
        .withColumn("author", compact_text("author"))
    )


def _plain_number(value: Column) -> Column:
    """Shortest form of a small number, like %g for up to six significant digits."""
    digits = F.floor(F.log10(F.abs(value))) + 1
    rounded = F.when(value == 0, F.lit("0")).otherwise(
        F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    )
    shown = (
        F.when(digits >= 6, F.format_string("%.0f", value))
        .when(digits == 5, F.regexp_replace(F.format_string("%.1f", value), r"\.?0+$", ""))
        .when(digits == 4, F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", ""))
        .when(digits == 3, F.regexp_replace(F.format_string("%.3f", value), r"\.?0+$", ""))
        .when(digits == 2, F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", ""))
        .when(digits == 1, F.regexp_replace(F.format_string("%.5f", value), r"\.?0+$", ""))
    )
    return F.coalesce(shown, rounded)


def channel_items_to_articles(items: DataFrame, settings: ChannelSettings = ChannelSettings()) -> DataFrame:
    """items: parsed channel items, optionally with report_url."""
    def note(key: str, value: Column, keep: Column) -> Column:
        return F.when(keep, F.create_map(F.lit(key), value)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    report = text("report_url") if "report_url" in items.columns else F.lit("")
    fixed = F.create_map(
        F.lit("provider"), F.lit(settings.provider),
        F.lit("retrieval"), F.lit(settings.retrieval),
        F.lit("channel"), F.col("channel"),
        F.lit("channel_rank"), F.col("rank").cast("string"),
        F.lit("api_day"), F.col("edition").cast("string"),
    )
    provenance = F.map_concat(
        fixed,
        note("author", F.col("author"), text("author") != ""),
        note("hot", _plain_number(F.col("hot")), F.col("hot").isNotNull()),
        note("report_url", report, report != ""),
    )
    return items.select(
        "edition",
        "channel",
        F.col("rank").cast("long").alias("pos"),
        "title",
        F.col("url").alias("link"),
        F.substring("text", 1, 400).alias("description"),
        F.col("published_at").alias("publish_time"),
        F.substring("text", 1, 2000).alias("content"),
        F.lit(settings.source_priority).alias("priority"),
        F.lit(settings.source).alias("source"),
        provenance.alias("provenance"),
    )


# ---- trending pages -----------------------------------------------------------------------------


def parse_movement(value: Column | str) -> Column:
    v = compact_text(value)
    up, down = r"^(?:▲|↑)\s*(\d+)$", r"^(?:▼|↓)\s*(\d+)$"
    state = (
        F.when(v.rlike("(?i)^(?:新上榜|NEW)$"), "new")
        .when(v.rlike(up), "up")
        .when(v.rlike(down), "down")
        .when(v.rlike("^(?:—|-|持平)$"), "steady")
    )
    delta = (
        F.when(v.rlike(up), F.regexp_extract(v, up, 1).try_cast("int"))
        .when(v.rlike(down), F.regexp_extract(v, down, 1).try_cast("int"))
        .otherwise(0)
    )
    return F.struct(state.alias("state"), F.when(state.isNotNull(), delta).alias("delta"))


def normalize_heat(value: Column | str) -> Column:
    v = strip(value)
    return F.when(v.rlike(r"^\d+(\.\d+)?$"), v)


class _Tree(HTMLParser):
    """Elements of one page as nested [tag, attributes, children] lists."""

    _VOID = {"br", "meta", "img", "input", "link", "hr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in self._VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _elements(node, tag, deep=False):
    for child in node[2]:
        if isinstance(child, list):
            if child[0] == tag:
                yield child
            if deep:
                yield from _elements(child, tag, True)


def _words(node) -> str:
    parts: list[str] = []

    def walk(n):
        for c in n[2]:
            if isinstance(c, list):
                walk(c)
            elif c.strip():
                parts.append(c.strip())

    walk(node)
    return " ".join(parts)


_TREND_FIELDS = ["ordinal", "rank", "title", "term_en", "blurb", "movement", "heat", "error"]


def _trend_rows(html: str, maximum: int) -> list[tuple]:
    """Raw cells of the one trending list inside <main>; a single error row when the shape is off."""
    def error(code):
        return [(0, None, None, None, None, None, None, code)]

    tree = _Tree()
    tree.feed(html or "")
    main = next(_elements(tree.root, "main", True), None)
    if main is None:
        return error("no_main")

    def spans(n):
        return list(_elements(n, "span"))

    def is_list(ol):
        first = next(_elements(ol, "li"), None)
        button = next(_elements(first, "button"), None) if first else None
        return button is not None and any("title" in s[1] for s in _elements(button, "span", True))

    lists = [ol for ol in _elements(main, "ol", True) if is_list(ol)]
    if len(lists) != 1:
        return error("list_count")
    items = list(_elements(lists[0], "li"))
    if len(items) > maximum:
        return error("row_count")
    out = []
    for i, li in enumerate(items):
        button = next(_elements(li, "button"), None)
        columns = spans(button) if button else []
        if len(columns) != 2:
            return error("columns")
        cells = spans(columns[1])
        start = next((k for k, s in enumerate(cells) if "title" in s[1]), None)
        if start is None:
            return error("title_key")
        meta = spans(cells[start + 2]) if len(cells) > start + 2 else []
        if len(meta) != 3:
            return error("metadata")
        title, blurb = cells[start], cells[start + 1]
        out.append(
            (i, _words(columns[0]), _words(title), (title[1].get("title") or "").strip(), _words(blurb), _words(meta[0]), _words(meta[2]), None)
        )
    return out


def parse_trending_list(pages: DataFrame, settings: TrendSettings = TrendSettings()) -> tuple[DataFrame, DataFrame]:
    """pages: (edition, html). (trend rows, editions with an error code). An edition fails as a whole."""
    maximum = settings.maximum_rows

    def parse(batches):
        for batch in batches:
            rows = [(e, *r) for e, h in zip(batch["edition"], batch["html"]) for r in _trend_rows(h, maximum)]
            yield pd.DataFrame(rows, columns=["edition", *_TREND_FIELDS])

    schema = "edition date, ordinal int, rank string, title string, term_en string, blurb string, movement string, heat string, error string"
    cells = pages.select("edition", "html").mapInPandas(parse, schema)
    move = parse_movement("movement")
    rows = cells.withColumn("_rank", F.col("rank").try_cast("int")).withColumn("_m", move).withColumn("_heat", normalize_heat("heat"))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_rank").isNull(), "rank")
        .when(F.col("_m.state").isNull(), "movement")
        .when(F.col("_heat").isNull(), "heat")
        .when((F.col("title") == "") | (F.col("term_en") == "") | (F.col("blurb") == ""), "reader_content")
        .when(F.col("_rank") != F.col("ordinal") + 1, "rank_contiguity")
    )
    # a page has at most maximum_rows rows
    same_term = F.count(F.lit(1)).over(W.partitionBy("edition", "term_en"))
    rows = rows.withColumn("_p", F.coalesce(problem, F.when((same_term > 1), "term_uniqueness")))
    failed = rows.filter("_p is not null").groupBy("edition").agg(F.min_by("_p", "ordinal").alias("code"))
    trends = rows.join(failed.select("edition"), "edition", "left_anti").select(
        "edition", F.col("_rank").alias("rank"), "title", "term_en", "blurb", F.col("_heat").alias("heat"),
        F.col("_m.state").alias("state"), F.col("_m.delta").alias("delta"), "movement",
    )
    return trends, failed


def trends_to_leads(trends: DataFrame, settings: TrendSettings = TrendSettings()) -> DataFrame:
    """trends: (edition, reference_ts, rank, title, term_en, blurb, heat, state, delta)."""
    p = settings.source_priority
    priority = F.when(F.col("rank") <= 3, p + 1).when(F.col("rank") <= 10, p).otherwise(max(0, p - 1))
    day = F.col("edition").cast("string")
    local = D.local_wall_clock("reference_ts", REPORT_TZ)
    observed = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    provenance = F.create_map(
        F.lit("provider"), F.lit(settings.provider),
        F.lit("retrieval"), F.lit("homepage_trending_dom"),
        F.lit("trend_day"), day,
        F.lit("trend_window"), F.lit(settings.window),
        F.lit("trend_rank"), F.col("rank").cast("string"),
        F.lit("trend_heat"), F.col("heat").cast("string"),
        F.lit("trend_state"), F.col("state"),
        F.lit("trend_delta"), F.col("delta").cast("string"),
        F.lit("trend_term_en"), F.col("term_en"),
        F.lit("observed_at"), observed,
        F.lit("publish_time_semantics"), F.lit("trend_observed_at"),
    )
    return trends.filter(F.col("rank") <= settings.maximum).select(
        "edition",
        F.col("rank").cast("long").alias("pos"),
        "title",
        with_query(settings.page_url, {"day": day, "t": F.col("term_en")}).alias("link"),
        F.col("blurb").alias("description"),
        observed.alias("publish_time"),
        priority.alias("priority"),
        F.lit(settings.source).alias("source"),
        F.lit("lead").alias("kind"),
        F.lit("unresolved").alias("evidence_status"),
        F.lit("signal").alias("confidence"),
        provenance.alias("provenance"),
    )


__all__ = ["parse_atom_feed", "parse_digest_api", "explode_channels", "parse_channel_items", "channel_items_to_articles", "parse_movement", "normalize_heat", "parse_trending_list", "trends_to_leads"]
