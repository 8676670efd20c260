"""Raw web pages: homepage links, digest links and article details, by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.functions.text import html_text, strip, text
from tidewire.operators.ranking import top_k

_ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
_HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def page_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, ordinal, href, label) of every anchor with an href."""
    anchors = F.regexp_extract_all(text(html), F.lit(_ANCHOR), F.lit(0))
    rows = pages.select(*keys, F.posexplode(anchors).alias("ordinal", "a"))
    return rows.filter(F.col("a").rlike(_HREF)).select(
        *keys, "ordinal", strip(F.regexp_extract("a", _HREF, 1)).alias("href"), html_text("a").alias("label")
    )


def absolute_url(href: Column, base: Column) -> Column:
    """Relative links against a site root."""
    return (
        F.when(href.rlike("(?i)^https?:"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), href))
    )


def parse_homepage_links(
    links: DataFrame,
    base_url: str,
    site: str,
    source: str = "techcrunch",
    years: tuple[str, ...] | None = None,
    reference: str = "reference_ts",
) -> DataFrame:
    """Title-only leads. links: (edition, ordinal, href, label, reference_ts)."""
    url = F.when(F.col("href") == "", "").otherwise(absolute_url(F.col("href"), F.lit(base_url)))
    # without given years any dated path counts
    dated = F.lit(False) if years else F.col("link").rlike("/(?:19|20)[0-9]{2}/")
    for y in years or ():
        dated = dated | F.col("link").contains(f"/{y}/")
    rows = links.withColumn("link", url).filter(
        (F.length("label") >= 10) & F.col("link").contains(site) & dated
    )
    first = top_k(rows, ["edition", "link"], [F.col("ordinal").asc()], 1, "_r")
    day = D.date_from_url("link")
    return first.select(
        "edition",
        F.col("ordinal").cast("long").alias("pos"),
        F.substring("label", 1, 150).alias("title"),
        "link",
        F.lit("").alias("description"),
        day.alias("publish_time"),
        F.when(D.is_recent_date(day, reference), 1).otherwise(0).alias("priority"),
        F.lit(source).alias("source"),
        F.lit("lead").alias("kind"),
        F.lit("unresolved").alias("evidence_status"),
        F.lit("signal").alias("confidence"),
        F.create_map(
            F.lit("input_kind"), F.lit("lead"),
            F.lit("retrieval"), F.lit("homepage_title_only"),
            F.lit("publish_time_semantics"), F.lit("url_date"),
        ).alias("provenance"),
    )


def pick_latest_digest_link(links: DataFrame, keys: list[str], base_url: str | Column) -> DataFrame:
    """Best digest link per page; the first one wins ties."""
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    rows = links.filter((F.col("href") != "") & ~F.col("href").startswith("#")).withColumn(
        "link", absolute_url(F.col("href"), base)
    )
    rows = rows.filter(F.col("link").rlike("/(daily|article|news|post)/"))
    score = (
        F.when(F.col("link").rlike(r"\d{4}[-/]\d{2}[-/]\d{2}"), 10).otherwise(0)
        + F.when(F.col("link").contains("/daily/"), 5).otherwise(0)
        + F.when(F.length("label").between(10, 100), 3).otherwise(0)
        + F.length("link") / F.lit(1000.0)
    )
    rows = rows.withColumn("score", score)
    return top_k(rows, keys, [F.col("score").desc(), F.col("ordinal").asc()], 1, "_r").drop("_r")


def _block(html: Column, selector: str) -> Column:
    """Inner markup of the first element a simple selector (tag, .class or #id) matches, else NULL."""
    if selector.startswith("."):
        opening = rf"""<(\w+)\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{selector[1:]}(?:\s[^"']*)?["'][^>]*>"""
    elif selector.startswith("#"):
        opening = rf"""<(\w+)\b[^>]*\bid\s*=\s*["']{selector[1:]}["'][^>]*>"""
    else:
        opening = rf"<({selector})\b[^>]*>"
    pattern = rf"(?is){opening}(.*?)</\1\s*>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 2))


def _blocks(html: Column, tags: str) -> Column:
    pattern = rf"(?is)<({tags})\b[^>]*>(.*?)(?=</\1\s*>|<(?:{tags})\b|$)"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(2))


TITLE_SELECTORS = ("h1", ".post-title", ".article-title", ".title")
AREA_SELECTORS = ("article", ".post-content", ".article-content", ".content", "#content", ".entry-content", "main")


def extract_title(html: Column) -> Column:
    """First heading of more than four characters by selector priority, else the page title."""
    found = []
    for s in TITLE_SELECTORS:
        t = html_text(_block(html, s))
        found.append(F.when(F.length(t) > 4, t))
    return F.coalesce(*found, F.nullif(html_text(_block(html, "title")), F.lit("")), F.lit("未找到标题"))


def extract_publish_time(html: Column) -> Column:
    def attribute(pattern: str) -> Column:
        return F.nullif(strip(F.regexp_extract(html, pattern, 1)), F.lit(""))

    return F.coalesce(
        attribute(r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']*)["']"""),
        F.nullif(html_text(_block(html, "time")), F.lit("")),
        attribute(r"""(?is)<meta\b[^>]*property=["']article:published_time["'][^>]*content=["']([^"']*)["']"""),
        attribute(r"""(?is)<meta\b[^>]*name=["']pubdate["'][^>]*content=["']([^"']*)["']"""),
        F.nullif(html_text(_block(html, ".date")), F.lit("")),
        F.lit("未知时间"),
    )


def content_area(html: Column) -> Column:
    return F.coalesce(*[_block(html, s) for s in AREA_SELECTORS], html)


def extract_summary(area: Column, max_chars: int = 400) -> Column:
    """Leading paragraphs and list items of more than 20 characters, at least max_chars together."""
    parts = F.filter(
        F.transform(F.slice(_blocks(area, "p|li"), 1, 20), lambda b: html_text(b)), lambda t: F.length(t) > 20
    )
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    # stop once the kept texts reach the budget
    kept = F.aggregate(
        parts,
        start,
        lambda acc, t: F.when(acc["n"] >= max_chars, acc).otherwise(
            F.struct(F.concat(acc["kept"], F.array(t)).alias("kept"), (acc["n"] + F.length(t)).alias("n"))
        ),
        lambda acc: F.array_join(acc["kept"], " "),
    )
    return F.when(F.length(kept) > max_chars, F.concat(F.substring(kept, 1, max_chars - 1), F.lit("…"))).otherwise(kept)


def extract_article_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add title, publish_time, description and content of one article page."""
    body = F.regexp_replace(text(html), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    rows = pages.withColumn("_html", body).withColumn("_area", content_area(F.col("_html")))
    summary = extract_summary(F.col("_area"))
    return (
        rows.withColumn("title", extract_title(F.col("_html")))
        .withColumn("publish_time", extract_publish_time(F.col("_html")))
        .withColumn("description", F.coalesce(F.nullif(summary, F.lit("")), F.lit("无描述")))
        .withColumn("content", html_text("_area"))
        .drop("_html", "_area")
    )
