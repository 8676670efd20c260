"""Views over the given tables, once for Spark and once as SQL text for the comparison engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import html_text
from tidewire.operators.catalog import load_catalog

BASE_DAY = "2024-01-24"

CATALOG_SPEC = {
    "schema_version": 1,
    "as_of": "2024-01-31",
    "core_ai_terms": ["attion", "für", "schheit"],
    "neighbor_terms": ["that", "sch", "que"],
    "actions": {
        "lawsuit": ["der", "de la"],
        "recall": ["nicht"],
        "release": ["the", "le"],
        "train": ["was"],
        "benchmark": ["ertionre"],
        "access": ["this"],
        "integrate": ["is"],
        "funding": ["of"],
        "deal": ["et"],
        "policy": ["von"],
        "security": ["onwh"],
        "research": ["with"],
        "rename": ["un"],
    },
    "objects": {
        "robotaxi": ["bleenat"],
        "data_center": ["oner", "enau"],
        "humanoid": ["erüver"],
        "open_source": ["und"],
    },
    "topics": {"model_release": ["release", "train"]},
    "entities": [
        {
            "id": "north",
            "region": "us",
            "tier": "frontier_lab",
            "requires_ai_context": False,
            "aliases": ["thanedble"],
            "models": [{"id": "north_one", "aliases": ["anea", "thanea"]}],
        },
        {"id": "south", "region": "eu", "tier": "frontier_lab", "aliases": ["eriner", "für"]},
        {
            "id": "east",
            "region": "cn",
            "tier": "ai_infrastructure",
            "requires_ai_context": False,
            "aliases": ["therhean", "du"],
        },
        {
            "id": "west",
            "region": "us",
            "tier": "broad_tech",
            "aliases": ["by", "des"],
            "models": [
                {"id": "west_a", "aliases": ["reedes"]},
                {"id": "west_b", "aliases": ["esndha", "reat"]},
            ],
        },
        {"id": "mid", "region": "other", "tier": "broad_tech", "aliases": ["and", "straße"]},
    ],
}
CATALOG = load_catalog(CATALOG_SPEC)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reference_ts(edition: Column) -> Column:
    """08:36 in the report zone."""
    return F.concat(edition.cast("string"), F.lit(" 00:36:00 UTC")).cast("timestamp")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    edition = F.date_add(F.lit(BASE_DAY).cast("date"), (p % 7).cast("int"))
    at = F.to_timestamp_ntz(F.concat(edition.cast("string"), F.lit(" 00:36:00"))) - F.make_dt_interval(hours=(p % 96).cast("int"))
    local = at + F.make_dt_interval(hours=F.lit(8))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    publish = (
        F.when(p % 8 <= 2, F.concat(iso, F.lit("+00:00")))
        .when(p % 8 == 3, F.concat(iso, F.lit("Z")))
        .when(p % 8 == 4, F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
        .when(p % 8 == 5, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(p % 8 == 6, F.date_format(at, "yyyy-MM-dd"))
        .otherwise("unknown")
    )
    heat = p * 37 % 1000
    provenance = F.map_filter(
        F.create_map(
            F.lit("trend_rank"), (p % 7).cast("string"),
            F.lit("trend_heat"), F.concat(F.floor(heat / 10).cast("string"), F.lit("."), (heat % 10).cast("string")),
            F.lit("publish_time_semantics"), F.when(p % 23 == 0, "trend_observed_at"),
            F.lit("trend_term_en"), F.when(p % 3 == 0, F.regexp_extract("url", "/(\\d+)", 1)),
        ),
        lambda k, v: v.isNotNull(),
    )
    para = html_text(F.regexp_extract("html", "(?s)<article>.*?<p>(.*?)</p>", 1))
    body = html_text(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1))
    return table(spark, sf, "pages").select(
        edition.alias("edition"),
        (F.floor(p / 7) + 1).cast("long").alias("pos"),
        html_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.col("url").alias("link"),
        F.when(p % 4 == 0, "").otherwise(para).alias("description"),
        F.when(p % 9 == 0, "").otherwise(body).alias("content"),
        publish.alias("publish_time"),
        (p % 5).cast("int").alias("priority"),
        F.when(p % 19 == 0, "aibase").when(p % 17 == 0, "techcrunch").when(p % 10 == 0, "")
        .otherwise(F.regexp_extract("url", r"://(?:[a-z]+\.)?([a-z-]+)\.example", 1)).alias("source"),
        F.when(p % 11 == 0, "lead").otherwise("story").alias("kind"),
        F.when(p % 13 == 0, "unresolved").otherwise("direct").alias("evidence_status"),
        F.lit("reported").alias("confidence"),
        provenance.alias("provenance"),
        F.array().cast(
            "array<struct<title:string,url:string,domain:string,published_date:string,text:string,snippet:string,score:double,origin:string>>"
        ).alias("evidence"),
        reference_ts(edition).alias("reference_ts"),
    )


def sql_html_text(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


ART = f"""art AS (
 SELECT edition, pos, title, link, CASE WHEN p % 4 = 0 THEN '' ELSE para END AS description,
  CASE WHEN p % 9 = 0 THEN '' ELSE body END AS content,
  CASE WHEN p % 8 <= 2 THEN strftime(t0, '%Y-%m-%dT%H:%M:%S+00:00')
       WHEN p % 8 = 3 THEN strftime(t0, '%Y-%m-%dT%H:%M:%SZ')
       WHEN p % 8 = 4 THEN strftime(t0 + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S')
       WHEN p % 8 = 5 THEN strftime(t0, '%a, %d %b %Y %H:%M:%S GMT')
       WHEN p % 8 = 6 THEN strftime(t0, '%Y-%m-%d') ELSE 'unknown' END AS publish_time,
  -- the instant a reader of publish_time gets; a bare date is midnight in the report zone
  CASE WHEN p % 8 <= 5 THEN t0 WHEN p % 8 = 6 THEN CAST(CAST(t0 AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR END AS published,
  CAST(p % 5 AS INTEGER) AS priority,
  CASE WHEN p % 19 = 0 THEN 'aibase' WHEN p % 17 = 0 THEN 'techcrunch' WHEN p % 10 = 0 THEN ''
       ELSE regexp_extract(link, '://(?:[a-z]+\\.)?([a-z-]+)\\.example', 1) END AS source,
  CASE WHEN p % 11 = 0 THEN 'lead' ELSE 'story' END AS kind,
  CASE WHEN p % 13 = 0 THEN 'unresolved' ELSE 'direct' END AS evidence_status,
  p % 7 AS trend_rank, (p * 37 % 1000) / 10.0 AS trend_heat, p % 23 = 0 AS observed,
  CASE WHEN p % 3 = 0 THEN regexp_extract(link, '/(\\d+)', 1) ELSE '' END AS term_en,
  CAST(edition AS TIMESTAMP) + INTERVAL 36 MINUTE AS ref, p
 FROM (SELECT page_id AS p, url AS link, CAST(DATE '{BASE_DAY}' + CAST(page_id % 7 AS INTEGER) AS DATE) AS edition,
   CAST(page_id // 7 + 1 AS BIGINT) AS pos,
   CAST(DATE '{BASE_DAY}' + CAST(page_id % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 36 MINUTE - to_hours(CAST(page_id % 96 AS INTEGER)) AS t0,
   {sql_html_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
   {sql_html_text("regexp_extract(html, '(?s)<article>.*?<p>(.*?)</p>', 1)")} AS para,
   {sql_html_text("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS body
  FROM pages))"""


def doc_articles(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf, "documents").select(
        F.date_add(F.lit(BASE_DAY).cast("date"), (d % 7).cast("int")).alias("edition"),
        (F.floor(d / 7) + 1).cast("long").alias("pos"),
        head.alias("title"),
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".Example.org/d/"), (d % 797).cast("string"),
            F.when(d % 3 == 0, "/?utm_source=feed&b=2&a=1#top").otherwise("?a=1&ref=x&b=2"),
        ).alias("link"),
        F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("content"),
        "source",
        (d % 5).cast("int").alias("priority"),
        "lang",
        d.alias("doc_id"),
    )


DOC = f"""doc AS (
 SELECT doc_id, CAST(DATE '{BASE_DAY}' + CAST(doc_id % 7 AS INTEGER) AS DATE) AS edition, CAST(doc_id // 7 + 1 AS BIGINT) AS pos,
  split_part(text, chr(10), 1) AS title,
  'https://' || source || '.Example.org/d/' || (doc_id % 797) || CASE WHEN doc_id % 3 = 0 THEN '/?utm_source=feed&b=2&a=1#top' ELSE '?a=1&ref=x&b=2' END AS link,
  substring(text, CAST(length(split_part(text, chr(10), 1)) + 2 AS BIGINT)) AS content, source, CAST(doc_id % 5 AS INTEGER) AS priority, lang
 FROM documents)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.withColumn("k", k).withColumn("edition", F.col("ts").cast("date"))


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS edition FROM events)"
