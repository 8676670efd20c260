"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import dates as D
from tidewire.functions import numbers as N
from tidewire.functions import reader as R
from tidewire.functions import text as X
from tidewire.functions import tokens as K
from tidewire.functions import urls as U
from tidewire.operators.similarity import title_similarity
from tidewire.queries import sqltext as S
from tidewire.queries import views as V
from tidewire.queries.registry import query


def join(c, sep="|"):
    return F.array_join(c, sep)


@query(
    "normalize_title",
    f"WITH {V.DOC} SELECT doc_id, {S.identity_title('title')} AS identity, {S.search_title('title')} AS search, {S.compact('content')} AS compacted FROM doc",
)
def normalize_title(spark, sf):
    return V.doc_articles(spark, sf).select(
        "doc_id",
        X.normalize_title_identity("title").alias("identity"),
        X.normalize_title_search("title").alias("search"),
        X.compact_text("content").alias("compacted"),
    )


@query(
    "canonical_url",
    f"""SELECT page_id, {S.identity_url('url')} AS identity_url, {S.search_url('url')} AS search_url, {S.story_url('url')} AS story_url,
 {S.netloc('url')} AS domain, lower({S.url_part('url', 1)}) IN ('http','https') AND {S.url_part('url', 2)} <> '' AS is_http FROM pages
 UNION ALL SELECT -1 - doc_id, {S.identity_url('link')}, {S.search_url('link')}, {S.story_url('link')}, {S.netloc('link')}, true
 FROM (WITH {V.DOC} SELECT doc_id, link FROM doc)""",
)
def canonical_url(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    docs = V.doc_articles(spark, sf).select((-1 - F.col("doc_id")).alias("page_id"), F.col("link").alias("url"))
    return pages.union(docs).select(
        "page_id",
        U.canonical_url_identity("url").alias("identity_url"),
        U.canonical_url_search("url").alias("search_url"),
        U.canonical_story_url("url").alias("story_url"),
        U.domain_of("url").alias("domain"),
        U.is_http_url("url").alias("is_http"),
    )


@query("article_key", f"WITH {V.ART} SELECT edition, pos, {S.article_key('title', 'link')} AS article_key FROM art")
def article_key(spark, sf):
    return V.articles(spark, sf).select("edition", "pos", U.article_key(F.col("title"), F.col("link")).alias("article_key"))


@query(
    "parse_published",
    f"""WITH {V.ART} SELECT edition, pos, CAST(epoch(published) AS BIGINT) AS published_epoch,
 CASE WHEN p % 8 <= 3 THEN CAST(epoch(published) AS BIGINT) END AS strict_epoch,
 CASE WHEN p % 8 IN (5, 7) THEN NULL ELSE CAST(substring(publish_time, 1, 10) AS DATE) END AS prefix_date FROM art""",
)
def parse_published(spark, sf):
    return V.articles(spark, sf).select(
        "edition",
        "pos",
        F.unix_seconds(D.parse_published("publish_time")).alias("published_epoch"),
        F.unix_seconds(D.parse_strict("publish_time")).alias("strict_epoch"),
        D.parse_date_prefix("publish_time").alias("prefix_date"),
    )


_URLDAY = "'https://h.example/' || (2020 + doc_id % 5) || '/' || (doc_id % 12 + 1) || '/' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/x'"


@query(
    "date_from_url",
    f"""SELECT doc_id, CASE WHEN doc_id % 12 >= 9 THEN (2020 + doc_id % 5) || '-' || (doc_id % 12 + 1) || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS strict_date,
 (2020 + doc_id % 5) || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS padded_date FROM (SELECT doc_id, {_URLDAY} AS u FROM documents)""",
)
def date_from_url(spark, sf):
    d = F.col("doc_id")
    url = F.concat(
        F.lit("https://h.example/"), (2020 + d % 5).cast("string"), F.lit("/"), (d % 12 + 1).cast("string"), F.lit("/"),
        F.lpad((d % 28 + 1).cast("string"), 2, "0"), F.lit("/x"),
    )
    return V.table(spark, sf, "documents").select(
        "doc_id", D.date_from_url(url).alias("strict_date"), D.date_from_url(url, pad=True).alias("padded_date")
    )


@query(
    "report_window",
    f"""WITH {V.EV} SELECT event_id, CAST(ts + INTERVAL 8 HOUR - to_hours(CASE WHEN k % 50 = 0 THEN 24 ELSE k % 50 END) AS DATE) AS start_date, CAST(ts + INTERVAL 8 HOUR AS DATE) AS end_date FROM ev""",
)
def report_window(spark, sf):
    ref = F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.expr("current_timezone()"))
    # an NTZ instant read as UTC, whatever the session zone
    ref = F.concat(F.col("ts").cast("string"), F.lit(" UTC")).cast("timestamp")
    w = D.report_window(ref, F.col("k") % 50)
    return V.events(spark, sf).select("event_id", w["start_date"].alias("start_date"), w["end_date"].alias("end_date"))


@query(
    "within_hours",
    f"""WITH {V.ART} SELECT edition, pos, published BETWEEN ref - INTERVAL 24 HOUR AND ref AS strict_24h, published BETWEEN ref - INTERVAL 72 HOUR AND ref AS lenient_72h,
 coalesce(published BETWEEN ref - INTERVAL 48 HOUR AND ref + INTERVAL 5 MINUTE, false) AS recent_48h,
 CASE WHEN p % 8 = 6 THEN date_diff('day', CAST(publish_time AS DATE), edition) <= 1 ELSE false END AS recent_date FROM art""",
)
def within_hours(spark, sf):
    at = D.parse_published("publish_time")
    return V.articles(spark, sf).select(
        "edition",
        "pos",
        D.within_hours(at, "reference_ts", 24).alias("strict_24h"),
        D.within_hours(at, "reference_ts", 72).alias("lenient_72h"),
        D.is_recent_instant(at, "reference_ts").alias("recent_48h"),
        D.is_recent_date("publish_time", "reference_ts").alias("recent_date"),
    )


@query(
    "is_edition_day",
    f"""WITH {V.ART} SELECT edition, pos, coalesce(CASE WHEN p % 3 = 0 THEN true END, false) OR
 coalesce(CASE WHEN p % 8 IN (5, 7) THEN NULL ELSE CAST(substring(publish_time, 1, 10) AS DATE) = edition END, false) AS edition_day FROM art""",
)
def is_edition_day(spark, sf):
    # every third page states its edition day in words
    rows = V.articles(spark, sf)
    p = (F.col("pos") - 1) * 7 + F.datediff("edition", F.lit(V.BASE_DAY).cast("date"))
    said = F.when(p % 3 == 0, F.concat(F.date_format("edition", "yyyy年M月d号"), F.lit(" "))).otherwise("")
    return rows.select("edition", "pos", D.is_edition_day(F.concat(said, "content"), "publish_time", "edition").alias("edition_day"))


@query(
    "story_tokens",
    f"""WITH {V.DOC}, t AS (SELECT doc_id, {S.tokens('title')} AS tk FROM doc) SELECT doc_id, array_to_string(tk, '|') AS tokens,
 round(coalesce(list_sum(list_transform(tk, lambda w: CASE WHEN regexp_matches(w, '[0-9]') OR length(w) >= 6 THEN 1.5 WHEN length(w) >= 5 THEN 1.0 ELSE 0.5 END)), 0.0), 4)::DOUBLE AS weight FROM t""",
)
def story_tokens(spark, sf):
    rows = V.doc_articles(spark, sf).withColumn("tk", K.story_tokens("title"))
    return rows.select("doc_id", join("tk").alias("tokens"), K.token_weight_sum("tk").alias("weight"))


_CLAIM_SQL = "'raised $' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' million, ' || k || '% of ' || user_id || ' 万 and two ' || event_type || k"


@query(
    "number_claims",
    f"""WITH {V.EV}, t AS (SELECT event_id, CAST(round(CAST(value AS DECIMAL(18,2)) * 1000000, 0) AS BIGINT) AS big, k, user_id * 10000 AS wan, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM ev)
 SELECT event_id, array_to_string(list_sort(list_distinct([CAST(big AS VARCHAR), k || '%', CAST(wan AS VARCHAR), '2'])), '|') AS claims,
 array_to_string(list_sort(list_distinct(['$' || v || 'million', CAST(k AS VARCHAR), (wan // 10000) || '万'])), '|') AS keys FROM t""",
)
def number_claims(spark, sf):
    rows = V.events(spark, sf)
    v = F.col("value").cast("decimal(18,2)").cast("string")
    said = F.concat(
        F.lit("raised $"), v, F.lit(" million, "), F.col("k").cast("string"), F.lit("% of "), F.col("user_id").cast("string"),
        F.lit(" 万 and two "), F.col("event_type"), F.col("k").cast("string"),
    )
    return rows.select("event_id", join(N.number_claims(said)).alias("claims"), join(N.number_keys(said, F.lit(""))).alias("keys"))


@query(
    "text_counts",
    """SELECT doc_id, CAST(length(regexp_replace(text, '[\\s\\p{Z}]', '', 'g')) AS BIGINT) AS visible, CAST(length(regexp_replace('中文' || text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS BIGINT) AS cjk,
 round(2.0 / (2 + length(regexp_replace(text, '[^A-Za-z]', '', 'g'))), 4)::DOUBLE AS ratio FROM documents""",
)
def text_counts(spark, sf):
    both = F.concat(F.lit("中文"), F.col("text"))
    return V.table(spark, sf, "documents").select(
        "doc_id",
        X.visible_chars("text").cast("long").alias("visible"),
        X.count_cjk(both).cast("long").alias("cjk"),
        F.round(X.chinese_ratio(both), 4).alias("ratio"),
    )


@query("clean_html_fragment", f"SELECT page_id, {V.sql_html_text('html')} AS cleaned FROM pages")
def clean_html_fragment(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", X.html_text("html").alias("cleaned"))


@query(
    "public_text",
    f"""WITH {V.DOC}, t AS (SELECT doc_id, {S.compact("'see ' || source || ' ' || regexp_replace(title, '[\\[\\]()]', '', 'g')")} || '，x' AS c FROM doc) SELECT doc_id, c AS shown, regexp_replace(c, '[:：]', '，', 'g') AS listed FROM t""",
)
def public_text(spark, sf):
    raw = F.concat(
        F.lit("[a"), F.col("doc_id").cast("string"), F.lit("] see ["), F.col("source"), F.lit("](http://x/1) "),
        F.lit("〔AGI 趋势 #3〕 "), F.regexp_replace("title", r"[\[\]()]", ""), F.lit(" http://y.z/q ，x"),
    )
    return V.doc_articles(spark, sf).select("doc_id", R.public_text(raw).alias("shown"), R.public_text(raw, list_item=True).alias("listed"))


@query(
    "source_group",
    f"""WITH {V.ART}, h AS (SELECT *, {S.netloc('link')} AS host FROM art) SELECT edition, pos, CASE WHEN source <> '' THEN source ELSE host END AS source_group,
 CASE source WHEN 'aibase' THEN 'AIBase' WHEN 'techcrunch' THEN 'TechCrunch' ELSE regexp_replace(host, '^www\\.', '') END AS label FROM h""",
)
def source_group(spark, sf):
    return V.articles(spark, sf).select("edition", "pos", A.source_group().alias("source_group"), A.source_label().alias("label"))


@query(
    "article_reference_id",
    f"WITH {V.ART} SELECT edition, pos, CASE WHEN pos % 3 = 0 THEN 'a' || (pos + 5) WHEN pos % 5 = 0 THEN NULL ELSE 'a' || pos END AS ref FROM art",
)
def article_reference_id(spark, sf):
    given = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("a"), F.col("pos") + 5)).when(F.col("pos") % 5 == 0, "b1").otherwise("")
    return V.articles(spark, sf).select("edition", "pos", A.article_reference_id(given, "pos").alias("ref"))


def _identity_sql(x):
    drop = S.quoted_list(K.FILLER)
    stem = (
        "CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN substring(w, 1, length(w) - 3) || 'y' "
        "WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 4 THEN substring(w, 1, length(w) - 1) ELSE w END"
    )
    parts = (
        f"flatten(list_transform(regexp_extract_all(lower({S.compact(x)}), '[a-z0-9]+(?:[.+#\\-][a-z0-9]+)*'), "
        "lambda t: list_concat([t], string_split_regex(t, '[\\-.]'))))"
    )
    return f"list_sort(list_distinct(list_filter(list_transform({parts}, lambda w: {stem}), lambda s: s <> '' AND NOT list_contains({drop}, s))))"


@query(
    "identity_terms",
    f"""WITH {V.DOC}, t AS (SELECT doc_id, {_identity_sql("title || ' K' || (doc_id % 9) || '-b stories'")} AS terms FROM doc)
 SELECT doc_id, array_to_string(terms, '|') AS terms, array_to_string(list_filter(terms, lambda s: regexp_matches(s, '[a-z]') AND regexp_matches(s, '[0-9]')), '|') AS versions FROM t""",
)
def identity_terms(spark, sf):
    said = F.concat(F.col("title"), F.lit(" K"), (F.col("doc_id") % 9).cast("string"), F.lit("-b stories"))
    rows = V.doc_articles(spark, sf).withColumn("t", K.identity_terms(said))
    return rows.select("doc_id", join("t").alias("terms"), join(K.version_terms(F.col("t"))).alias("versions"))


_DQ = f"substring(concat_ws(' ', nullif({S.compact('title')}, ''), nullif({S.compact('term_en')}, ''), nullif({S.compact('description')}, '')), 1, 380)"


@query(
    "discovery_query",
    f"""WITH {V.ART} SELECT edition, pos, {_DQ} AS discovery, substring({_DQ} || ' official announcement details pricing benchmark funding impact', 1, 400) AS followup FROM art""",
)
def discovery_query(spark, sf):
    return V.articles(spark, sf).select(
        "edition", "pos", A.discovery_query().alias("discovery"), A.followup_query(F.lit("")).alias("followup")
    )


@query(
    "evidence_text",
    f"""WITH {V.DOC}, c AS (SELECT doc_id, {S.compact('title')} AS a, {S.compact('content')} AS b FROM doc)
 SELECT doc_id, rtrim(substring(CASE WHEN b <> '' AND NOT contains(a, b) THEN trim(a || ' ' || b) ELSE a END, 1, 600)) AS evidence FROM c""",
)
def evidence_text(spark, sf):
    return V.doc_articles(spark, sf).select("doc_id", A.evidence_text("title", "content", 600).alias("evidence"))


@query(
    "trend_signal",
    f"""WITH {V.ART} SELECT edition, pos, CASE WHEN trend_rank >= 1 AND p % 2 = 0 THEN CAST(trend_rank AS INTEGER) END AS rank, CASE WHEN trend_rank >= 1 AND p % 2 = 0 THEN CAST(trend_heat AS DOUBLE) END AS heat FROM art""",
)
def trend_signal(spark, sf):
    p = (F.col("pos") - 1) * 7 + F.datediff("edition", F.lit(V.BASE_DAY).cast("date"))
    rows = V.articles(spark, sf).withColumn("source", F.when(p % 2 == 0, "agihunt_trending").otherwise("x"))
    return rows.withColumn("s", A.trend_signal()).select("edition", "pos", F.col("s.rank").alias("rank"), F.col("s.heat").alias("heat"))


@query(
    "compress_articles",
    f"""WITH {V.ART} SELECT edition, pos, 'a' || pos AS article_id, substring(title, 1, 150) AS title, substring(description, 1, 300) AS description FROM art""",
)
def compress_articles(spark, sf):
    rows = V.articles(spark, sf).withColumn("article_id", F.concat(F.lit("a"), F.col("pos"))).withColumn("j", A.compress_article())
    return rows.select("edition", "pos", *[F.get_json_object("j", f"$.{k}").alias(k) for k in ("article_id", "title", "description")])


@query(
    "redact_map",
    f"WITH {V.EV} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'name,user' ELSE 'name' END AS kept, 'failed with [redacted] at ' || k AS scrubbed FROM ev",
)
def redact_map(spark, sf):
    m = F.create_map(
        F.lit("name"), F.lit("x"), F.lit("api_Key"), F.lit("s"), F.when(F.col("k") % 2 == 0, "user").otherwise("USER_TOKEN"), F.lit("v")
    )
    return V.events(spark, sf).select(
        "event_id",
        F.array_join(F.map_keys(X.redact_map(m)), ",").alias("kept"),
        X.scrub_text(F.concat(F.lit("failed with s3cr3t at "), F.col("k").cast("string")), ["s3cr3t"]).alias("scrubbed"),
    )


@query(
    "safe_code",
    f"""WITH {V.DOC} SELECT doc_id, coalesce(nullif(substring(regexp_replace(regexp_replace({S.compact('title')}, '[^a-zA-Z0-9_.\\-]+', '_', 'g'), '^[_.\\-]+|[_.\\-]+$', '', 'g'), 1, 80), ''), 'unknown_error') AS code FROM doc""",
)
def safe_code(spark, sf):
    return V.doc_articles(spark, sf).select("doc_id", X.safe_code(X.compact_text("title")).alias("code"))


@query(
    "safe_numbers",
    f"""WITH {V.EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN k ELSE -1 END::BIGINT AS as_int, CASE WHEN k % 4 = 0 THEN 1.5 ELSE value END AS as_float,
 CASE WHEN user_id % 7 > 0 THEN round(k / (user_id % 7)::DOUBLE, 4) END AS rate FROM ev""",
)
def safe_numbers(spark, sf):
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise(F.concat(F.col("k").cast("string"), F.lit(".0")))
    num = F.when(F.col("k") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return V.events(spark, sf).select(
        "event_id", N.safe_int(raw, -1).alias("as_int"), N.safe_float(num, 1.5).alias("as_float"), N.rate(F.col("k"), F.col("user_id") % 7).alias("rate")
    )


@query(
    "entity_for_title",
    f"""WITH {V.DOC}, n AS (SELECT doc_id, {S.identity_title('title')} AS t FROM doc) SELECT doc_id, CASE WHEN contains(t, 'than') THEN 'than' WHEN contains(t, 'que') THEN 'que' WHEN contains(t, 'the in') THEN 'The-In' ELSE '' END AS entity FROM n""",
)
def entity_for_title(spark, sf):
    return V.doc_articles(spark, sf).select("doc_id", X.entity_for_title("title", ("than", "que", "The-In")).alias("entity"))


@query(
    "source_sentences",
    f"""WITH t AS (SELECT doc_id, {S.compact("replace(text, '.', '。')")} AS v FROM documents), f AS (SELECT doc_id, v, list_transform(regexp_extract_all(v, '[^。！？]+[。！？]'), lambda s: trim(s)) AS found FROM t)
 SELECT doc_id, CASE WHEN len(found) > 0 THEN len(found) WHEN v <> '' THEN 1 ELSE 0 END::BIGINT AS n, md5(regexp_replace(CASE WHEN len(found) > 0 THEN array_to_string(found, '|') WHEN v = '' THEN '' ELSE regexp_replace(v, '[ ，、；:：]+$', '') || '。' END, '[:：]', '，', 'g')) AS digest FROM f""",
)
def source_sentences(spark, sf):
    rows = V.table(spark, sf, "documents").withColumn("s", R.source_sentences(F.replace("text", F.lit("."), F.lit("。"))))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(join("s")).alias("digest"))


@query(
    "headline_sentence",
    f"""WITH {V.DOC}, t AS (SELECT doc_id, source, regexp_replace({S.compact('title')}, '[:：。！？]', '', 'g') AS c FROM doc)
 SELECT doc_id, regexp_replace(trim(source || CASE WHEN c = '' THEN '' WHEN doc_id % 2 = 0 THEN '称' ELSE '是' END || trim(c)), '[ ，、；:：]+$', '') || '。' AS sentence FROM t""",
)
def headline_sentence(spark, sf):
    claim = F.regexp_replace(X.compact_text("title"), "[:：。！？]", "")
    title = F.concat(F.col("source"), F.lit("："), claim)
    description = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("据了解"), F.col("source"), F.lit(" 表示乐观"))).otherwise(F.col("source"))
    return V.doc_articles(spark, sf).select("doc_id", R.headline_sentence(title, description).alias("sentence"))


@query(
    "parse_draft_json",
    "SELECT doc_id, doc_id % 5 <> 0 AS valid, CASE WHEN doc_id % 5 <> 0 THEN 'a' || doc_id END AS article_id, CASE WHEN doc_id % 5 <> 0 THEN source END AS summary FROM documents",
)
def parse_draft_json(spark, sf):
    d = F.col("doc_id")
    extra = F.when(d % 5 == 0, ',"badge":1').otherwise("")
    body = F.concat(
        F.lit('{"items":[{"article_id":"a'), d.cast("string"), F.lit('","summary":"'), F.col("source"), F.lit('"'), extra, F.lit("}]}")
    )
    fenced = F.when(d % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = V.table(spark, sf, "documents").withColumn("p", R.parse_draft_json(fenced))
    item = F.try_element_at("p.items", F.lit(1))
    return rows.select("doc_id", F.col("p").isNotNull().alias("valid"), item["article_id"].alias("article_id"), item["summary"].alias("summary"))


@query(
    "numbered_items",
    """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
 SELECT doc_id, CAST(len(ls) AS BIGINT) AS n, md5(array_to_string(list_transform(ls, lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), '|')) AS digest FROM l""",
)
def numbered_items(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    content = F.array_join(
        F.transform(lines, lambda x, i: F.concat(F.when(i % 2 == 0, "## ").otherwise(""), (i + 1).cast("string"), F.when(i % 3 == 0, "、 ").otherwise(". "), x)), "\n"
    )
    rows = V.table(spark, sf, "documents").withColumn("items", R.numbered_items(content))
    return rows.select("doc_id", F.size("items").cast("long").alias("n"), F.md5(join("items")).alias("digest"))


@query(
    "query_for_round",
    f"""WITH {V.EV} SELECT event_id, ['q0', 'q1', 'q2'][(date_diff('day', DATE '1970-01-01', edition) + 719163 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END + k % 4) % 3 + 1] AS q FROM ev""",
)
def query_for_round(spark, sf):
    pack = F.array(F.lit("q0"), F.lit(" "), F.lit("q1 "), F.lit("q2"))
    stage = F.when(F.col("event_type") == "click", "secondary_refill").otherwise("priority_refill")
    return V.events(spark, sf).select("event_id", A.query_for_round(pack, "edition", stage, F.col("k") % 4).alias("q"))


@query(
    "request_outcome",
    f"""WITH {V.EV} SELECT event_id, CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'timeout' WHEN 'error' THEN
 CASE WHEN s IN (401, 403) THEN 'authentication_error' WHEN s IN (400, 404, 405, 422) THEN 'invalid_request' WHEN s = 429 THEN 'rate_limited' ELSE 'http_error' END
 WHEN 'purchase' THEN 'connection_error' ELSE 'unexpected_error' END AS outcome FROM (SELECT *, 400 + k % 30 AS s FROM ev)""",
)
def request_outcome(spark, sf):
    names = {"click": "", "view": "timeout", "error": "http", "purchase": "connection"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    error = F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("other"))
    return V.events(spark, sf).select("event_id", A.request_outcome(error, 400 + F.col("k") % 30).alias("outcome"))


@query("title_similarity")
def similarity(spark, sf):
    """Each title against the title of the next document of the same source."""
    from pyspark.sql import Window as W

    rows = V.doc_articles(spark, sf)
    nxt = F.lead("title").over(W.partitionBy("source", "edition").orderBy("pos"))
    return rows.withColumn("other", nxt).filter("other is not null").select(
        "doc_id", title_similarity("title", "other").alias("title_similarity")
    )


@query(
    "ai_topic",
    f"""WITH {V.DOC}, t AS (SELECT doc_id, title || CASE doc_id % 6 WHEN 0 THEN ' AI' WHEN 1 THEN ' ai2' WHEN 2 THEN ' 机器人' WHEN 3 THEN ' models' WHEN 4 THEN ' inference' ELSE '' END AS t, doc_id % 6 AS m FROM doc)
 SELECT doc_id, regexp_matches(lower(t), '(^|[^a-z])(ai|llm)([^a-z]|$)|openai|anthropic|claude|gemini|gpt|xai|deepseek|qwen|kimi|grok|copilot|agentic|neural|inference|robot|artificial intelligence|machine learning|机器人') AS selection,
 regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])(ai|openai|anthropic|claude|chatgpt|llm|model|models|agent|agents|robot|robotics|startup|startups|copilot|sora)([^\\p{{L}}\\p{{N}}_]|$)|机器人') AS benchmark,
 regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])(ai|openai|anthropic|claude|chatgpt|llm|agent|agents|assistant|copilot|sora|generative|inference|developer tools|machine learning|deep learning|robot|robotics)([^\\p{{L}}\\p{{N}}_]|$)|机器人') AS domain FROM t""",
)
def ai_topic(spark, sf):
    m = F.col("doc_id") % 6
    tail = F.when(m == 0, " AI").when(m == 1, " ai2").when(m == 2, " 机器人").when(m == 3, " models").when(m == 4, " inference").otherwise("")
    t = F.concat(F.col("title"), tail)
    return V.doc_articles(spark, sf).select("doc_id", *[A.ai_topic(t, v).alias(v) for v in ("selection", "benchmark", "domain")])
