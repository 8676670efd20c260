"""Contract checks. Every check returns violation rows: edition, subject_id, rule, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import dates as D
from tidewire.functions import numbers as N
from tidewire.functions import reader as R
from tidewire.functions.text import compact_text, count_cjk, strip, text, visible_chars
from tidewire.functions.urls import host_of, is_http_url, scheme_of


def _violations(df: DataFrame, subject: Column, *rules: tuple[str, Column], detail: Column | None = None) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    note = detail if detail is not None else F.lit("")
    return df.select("edition", subject.cast("string").alias("subject_id"), F.explode(codes).alias("rule"), note.cast("string").alias("detail"))


def _whole(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    return _violations(df, F.lit(""), *rules)


def check_reader_sentence(items: DataFrame, column: str = "summary") -> DataFrame:
    rows = items.select(
        "edition", F.col("article_id").alias("subject_id"),
        F.explode(R.reader_issues(column)).alias("rule"),
        visible_chars(compact_text(column)).cast("string").alias("detail"),
    )
    return rows


def check_impact_sentence(items: DataFrame, column: str = "why_it_matters") -> DataFrame:
    return items.select(
        "edition", F.col("article_id").alias("subject_id"),
        F.explode(R.impact_issues(column)).alias("rule"),
        visible_chars(compact_text(column)).cast("string").alias("detail"),
    )


def check_article_ids(df: DataFrame) -> DataFrame:
    """Invalid or repeated ids per edition. Repeats are counted, not windowed, so one id may be hot."""
    rows = df.withColumn("_id", strip("article_id")).withColumn("_ref", A.article_reference_id("article_id", "pos"))
    invalid = rows.filter("_ref is null").select(
        "edition", F.col("_id").alias("subject_id"), F.lit("invalid_article_id").alias("rule"), F.col("pos").cast("string").alias("detail")
    )
    repeated = rows.filter("_ref is not null").groupBy("edition", "_ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return invalid.unionByName(
        repeated.select(
            "edition", F.col("_ref").alias("subject_id"), F.lit("duplicate_article_id").alias("rule"), F.col("n").cast("string").alias("detail")
        )
    )


def check_summary(
    items: DataFrame, articles: DataFrame, selected: DataFrame, summaries: DataFrame, limit: int = 10
) -> DataFrame:
    """Published items against a recomputed selection.

    items: (edition, item_no, article_id, title, summary, url, why_it_matters); articles: (edition,
    article_id, link); selected: (edition, selected_rank, article_id); summaries: (edition,
    discussion_topic, presentation).
    """
    sizes = (
        summaries.join(items.groupBy("edition").agg(F.count(F.lit(1)).alias("_items")), "edition", "left")
        .join(articles.groupBy("edition").agg(F.count(F.lit(1)).alias("_arts")), "edition", "left")
        .na.fill(0, ["_items", "_arts"])
    )
    totals = _whole(
        sizes,
        ("items_without_articles", (F.col("_arts") == 0) & (F.col("_items") > 0)),
        ("no_items", (F.col("_arts") > 0) & (F.col("_items") == 0)),
        ("too_many_items", F.col("_items") > limit),
        ("topic_trend_signal", text("discussion_topic").rlike(R.TREND_SIGNAL)),
    )
    want = selected.select("edition", F.col("selected_rank").cast("int").alias("_no"), F.col("article_id").alias("_want"))
    have = items.select("edition", F.col("item_no").cast("int").alias("_no"), F.col("article_id").alias("_have"))
    order = have.join(want, ["edition", "_no"], "full")
    order = _violations(
        order, F.coalesce("_have", "_want"),
        ("selection_mismatch", ~F.col("_have").eqNullSafe(F.col("_want"))),
        detail=F.col("_no"),
    )
    joined = items.join(
        articles.select("edition", "article_id", strip("link").alias("_link"), F.lit(True).alias("_known")),
        ["edition", "article_id"], "left",
    ).join(summaries.select("edition", "presentation"), "edition", "left")
    each = _violations(
        joined, F.col("article_id"),
        ("unknown_article_id", F.col("_known").isNull()),
        ("url_mismatch", F.col("_known") & (strip("url") != F.col("_link"))),
        ("missing_text", (strip("title") == "") | (strip("summary") == "")),
        ("missing_impact", (F.col("presentation") == "fact_impact_v1") & (strip("why_it_matters") == "")),
    )
    sentences = check_reader_sentence(items.filter(strip("summary") != ""))
    impacts = check_impact_sentence(items.filter(strip("why_it_matters") != ""))
    prefix = F.concat(F.lit("impact_"), F.col("rule"))
    return (
        totals.unionByName(order).unionByName(each).unionByName(sentences).unionByName(impacts.withColumn("rule", prefix))
    )


def check_draft(
    items: DataFrame, topics: DataFrame, expected: DataFrame | None, limit: int = 10, require_impact: bool = False
) -> DataFrame:
    """Model drafts before they are joined with sources.

    items: (edition, item_no, article_id, title, summary, why_it_matters); topics: (edition,
    discussion_topic); expected: (edition, item_no, article_id) or None.
    """
    letters = F.regexp_count(text("summary"), F.lit(r"[\x{4e00}-\x{9fff}A-Za-z]"))
    stats = items.groupBy("edition").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(count_cjk("summary")).alias("_cjk"), F.sum(letters).alias("_letters")
    )
    whole = topics.join(stats, "edition", "left").na.fill(0, ["_n", "_cjk", "_letters"])
    topic = strip("discussion_topic")
    totals = _whole(
        whole,
        ("no_items", F.col("_n") == 0),
        ("too_many_items", F.col("_n") > limit),
        ("missing_topic", topic == ""),
        ("topic_link", topic.rlike(R.PUBLIC_LINK)),
        ("topic_article_id", topic.rlike(R.PUBLIC_ID)),
        ("not_chinese", (F.col("_n") > 0) & (F.col("_cjk") / F.greatest(F.lit(1), F.col("_letters")) < 0.45)),
    )
    title, fact, impact = strip("title"), strip("summary"), strip("why_it_matters")
    each = _violations(
        items, F.col("article_id"),
        ("missing_summary", fact == ""),
        ("few_chinese_characters", count_cjk(fact) < 8),
        ("link", fact.rlike(R.PUBLIC_LINK) | title.rlike(R.PUBLIC_LINK)),
        ("article_id", fact.rlike(R.PUBLIC_ID) | title.rlike(R.PUBLIC_ID)),
        ("missing_impact", F.lit(require_impact) & (impact == "")),
        ("impact_link", impact.rlike(R.PUBLIC_LINK)),
        ("impact_article_id", impact.rlike(R.PUBLIC_ID)),
    )
    out = totals.unionByName(each).unionByName(check_reader_sentence(items.filter(fact != "")))
    impacts = check_impact_sentence(items.filter(impact != ""))
    out = out.unionByName(impacts.withColumn("rule", F.concat(F.lit("impact_"), F.col("rule"))))
    if expected is None:
        return out
    unknown = items.withColumn("_id", strip("article_id")).join(
        expected.select("edition", F.col("article_id").alias("_id")).distinct(), ["edition", "_id"], "left_anti"
    )
    order = items.select("edition", "item_no", strip("article_id").alias("_have")).join(
        expected.select("edition", "item_no", F.col("article_id").alias("_want")), ["edition", "item_no"], "full"
    )
    return out.unionByName(_violations(unknown, F.col("_id"), ("unknown_article_id", F.lit(True)))).unionByName(
        _violations(order, F.coalesce("_have", "_want"), ("order_mismatch", ~F.col("_have").eqNullSafe(F.col("_want"))))
    )


# fixed values: claim families that need an anchor in the source text
CLAIM_ANCHORS = (
    ("intellectual_property", "知识产权|版权|专利|商标", r"(?i)知识产权|版权|专利|商标|intellectual\s+property|copyright|patent|trademark"),
    ("unfair_competition", "不正当竞争|不公平竞争", r"(?i)不正当竞争|不公平竞争|unfair\s+competition|anti-?competitive"),
    ("antitrust", "反垄断|垄断行为", r"(?i)反垄断|垄断行为|antitrust|monopol"),
    ("acquisition", "收购|并购", r"(?i)收购|并购|acquir|acquisition|buyout"),
    ("funding_or_valuation", "融资|估值", r"(?i)融资|估值|funding|fundrais|valu(?:e|ed|ation)"),
)


def check_grounding(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Numbers and sensitive claims of an item must occur in its article or evidence."""
    parts = F.concat(
        F.array(text("title"), text("description"), text("content")),
        F.flatten(
            F.transform(
                "evidence",
                lambda e: F.array(*[F.coalesce(e[k], F.lit("")) for k in ("title", "published_date", "snippet", "text")]),
            )
        ),
    )
    source = articles.select(
        "edition", F.col("article_id").alias("_id"), F.array_join(parts, " ").alias("_source")
    )
    rows = items.withColumn("_id", strip("article_id")).join(source, ["edition", "_id"])
    said = F.concat(text("summary"), F.lit(" "), text("why_it_matters"))
    rows = rows.withColumn("_loose", F.array_except(N.number_claims(said), N.number_claims("_source")))
    numbers = rows.filter(F.size("_loose") > 0).select(
        "edition", F.col("_id").alias("subject_id"), F.lit("unsupported_number").alias("rule"), F.array_join("_loose", ", ").alias("detail")
    )
    claims = _violations(
        rows, F.col("_id"),
        *[
            (f"unsupported_{code}", text("summary").rlike(claim) & ~F.col("_source").rlike(anchor))
            for code, claim, anchor in CLAIM_ANCHORS
        ],
    )
    return numbers.unionByName(claims)


def check_source_outcome(runs: DataFrame) -> DataFrame:
    """runs: (edition, source, status, fetched_count, accepted_count, error_kind, error_message, diagnostic_codes)."""
    kind = text("error_kind") != ""
    error = kind | (text("error_message") != "")
    status = F.col("status")
    return _violations(
        runs, F.col("source"),
        ("accepted_exceeds_fetched", F.col("accepted_count") > F.col("fetched_count")),
        ("empty_with_counts_or_error", (status == "empty") & ((F.col("fetched_count") != 0) | (F.col("accepted_count") != 0) | error)),
        ("ok_with_error", (status == "ok") & error),
        ("failure_without_reason", status.isin("degraded", "failed") & ~kind & (F.size("diagnostic_codes") <= 0)),
    )


MANIFEST_KEYS = (
    "schema_version run_id report_date timezone started_at cutoff_at deadline_at config_fingerprint "
    "config_snapshot stages sources artifacts publication diagnostics"
).split()


def check_manifest(manifests: DataFrame) -> DataFrame:
    """manifests: (edition, run_id, document) with the manifest as JSON text."""
    shape = (
        "schema_version string, started_at string, cutoff_at string, deadline_at string, "
        "stages array<struct<started_at:string,finished_at:string>>"
    )
    manifests = manifests.withColumn("_m", F.from_json("document", shape))

    def at(k: str) -> Column:
        return D.parse_strict(F.col("_m")[k])

    stages = F.col("_m")["stages"]
    extra = F.array_except(F.json_object_keys("document"), F.array(*[F.lit(k) for k in MANIFEST_KEYS]))

    def late(s: Column) -> Column:
        start, end = D.parse_strict(s["started_at"]), D.parse_strict(s["finished_at"])
        return start.isNull() | (s["finished_at"].isNotNull() & F.coalesce(end < start, F.lit(True)))

    rows = manifests.select(
        "edition", "run_id", at("started_at").alias("s"), at("cutoff_at").alias("c"), at("deadline_at").alias("d"),
        extra.alias("x"), F.exists(stages, late).alias("bad_stage"),
        F.col("_m")["schema_version"].alias("v"),
    )
    return _violations(
        rows, F.col("run_id"),
        ("schema_version", F.coalesce(F.col("v"), F.lit("1")) != "1"),
        ("clock_not_zoned", F.col("s").isNull() | F.col("c").isNull() | F.col("d").isNull()),
        ("clock_order", ~((F.col("s") <= F.col("c")) & (F.col("c") <= F.col("d")))),
        ("stage_times", F.col("bad_stage")),
        ("unknown_field", F.size("x") > 0),
        detail=F.array_join("x", ","),
    )


def publication_gate(editions: DataFrame, source_runs: DataFrame, allow_empty: bool = False) -> DataFrame:
    """editions: (edition, articles_count, summary_succeeded, build_succeeded)."""
    stats = source_runs.groupBy("edition").agg(
        F.bool_and(F.col("status") == "failed").alias("_all_failed"),
        F.bool_or(F.col("status").isin("failed", "degraded")).alias("_degraded"),
    )
    rows = editions.join(stats, "edition", "left")
    reason = (
        F.when(F.coalesce("_all_failed", F.lit(False)), "all_enabled_sources_failed")
        .when((F.col("articles_count") <= 0) & F.lit(not allow_empty), "no_accepted_articles")
        .when(~F.col("summary_succeeded"), "summary_failed")
        .when(~F.col("build_succeeded"), "build_failed")
        .when(F.coalesce("_degraded", F.lit(False)), "source_degraded")
    )
    rows = rows.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNull(), "published")
        .when(F.col("reason") == "source_degraded", "degraded")
        .otherwise("failed")
    )
    return rows.withColumn("status", status).withColumn("publish", F.col("status") != "failed").drop("_all_failed", "_degraded")


def provenance_audit(summaries: DataFrame) -> DataFrame:
    """summaries: (edition, mode, policy, provider, model)."""
    ai = F.col("policy") == "required_ai"
    offline = (F.col("policy") == "offline") & (F.col("provider") == "local") & (F.col("model") == "deterministic")
    return _violations(
        summaries, F.col("mode"),
        ("ai_mode_without_ai_result", (F.col("mode") == "ai") & ~ai),
        ("ai_result_in_other_mode", (F.col("mode") != "ai") & ai),
        ("offline_not_deterministic", (F.col("mode") == "offline") & ~ai & ~offline),
    )


def represented_links_check(captured: DataFrame, articles: DataFrame, signals: DataFrame) -> DataFrame:
    """Captured (edition, link) that appear neither as article, article signal nor observation."""
    known = (
        articles.select("edition", text("link").alias("link"))
        .union(articles.select("edition", text(A.prov("signal_url"))))
        .union(signals.select("edition", text("signal_url")))
        .filter("link <> ''")
    )
    return captured.join(known, ["edition", "link"], "left_anti")


#: parts a head of links is spread over
LEAK_SALTS = 16


def _visible_links(public: DataFrame, links: DataFrame) -> DataFrame:
    """(edition, page, url) of the links whose text stands in a body.

    A link is its head, up to its last sign, and its tail of letters and digits. Heads are looked up at the places of a body
    where a link can begin, tails only where the head is one of the edition's. No place yields more than the longest
    link's signs and characters, however long the body's unbroken text is.
    """
    cut = links.select("edition", "url", F.regexp_extract("url", r"^(.*[^A-Za-z0-9])?([A-Za-z0-9]*)$", 1).alias("head"))
    cut = cut.withColumn("tail", F.length("url") - F.length("head"))
    signs = F.length(F.regexp_replace("url", "[A-Za-z0-9]", ""))
    bounds = cut.groupBy("edition").agg(
        F.max(F.length("url")).alias("longest"),
        F.max(signs).alias("signs"),
        F.min(signs).alias("fewest"),
        F.max((~F.col("url").rlike("^[A-Za-z0-9]")).cast("int")).alias("leading"),
    )
    first = F.when(F.col("leading") == 1, r"\S").otherwise("[A-Za-z0-9]")
    place = F.concat(F.lit(r"(?:(?<![A-Za-z0-9])|(?=https?://))(?=("), first, F.lit(r"\S{0,"), F.col("longest") - 1, F.lit("}))"))
    # a row an edition: as a shuffled join it would bring all bodies of an edition into one task
    runs = public.join(F.broadcast(bounds), "edition").select(
        "edition", "page", "signs", "fewest", F.explode(F.array_distinct(F.regexp_extract_all(text("body"), place, F.lit(1)))).alias("run")
    )
    pieces = F.slice(F.regexp_extract_all("run", F.lit("[A-Za-z0-9]*[^A-Za-z0-9]"), F.lit(0)), F.lit(1), F.col("signs"))
    sizes = F.sequence(F.when(F.col("fewest") == 0, 0).otherwise(1), F.size("pieces"))
    heads = F.transform(sizes, lambda n: F.array_join(F.slice("pieces", F.lit(1), n), ""))
    salt = F.pmod(F.xxhash64("page", "run"), F.lit(LEAK_SALTS)).cast("int").alias("salt")
    starts = runs.withColumn("pieces", pieces).filter("size(pieces) > 0 or fewest = 0")
    starts = starts.select("edition", "page", "run", salt, F.explode(heads).alias("head"))
    # the run itself stays behind, whose signs are as many rows
    rest = F.regexp_extract(F.expr("substr(run, length(head) + 1)"), "^[A-Za-z0-9]*", 0).alias("rest")
    starts = starts.select("edition", "page", "salt", "head", rest)
    # one row a head; a head that very many places share, such as a host's, is spread over the salts
    # few bytes that become a row a salt: no coalescing of tasks
    slots = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut.repartition(slots, "edition", "head").groupBy("edition", "head").agg(F.min("tail").alias("least"), F.max("tail").alias("most"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LEAK_SALTS - 1))))
    reach = F.least("most", F.length("rest"))
    found = starts.join(known, ["edition", "head", "salt"]).withColumn("reach", reach).filter("reach >= least")
    urls = found.select("edition", "page", F.explode(F.expr("transform(sequence(least, reach), k -> concat(head, substr(rest, 1, k)))")).alias("url"))
    return urls.distinct().join(links, ["edition", "url"], "left_semi")


def leak_check(public: DataFrame, articles: DataFrame) -> DataFrame:
    """Source URLs or article ids that are visible in public text, each once a page.

    public: (edition, page, body). A link, with a scheme or without, counts where a body holds its text from a place that no
    ASCII letter or digit precedes (http and https links: from any place); more text may follow. Links with
    whitespace inside are no URLs and are not looked for. Null and empty bodies and links give no rows.
    """
    links = articles.select("edition", strip("link").alias("url")).filter(r"url <> '' and not url rlike '\\s'").distinct()
    urls = _visible_links(public, links)
    urls = urls.select("edition", F.col("page").alias("subject_id"), F.lit("source_url").alias("rule"), F.col("url").alias("detail"))
    ids = public.select(
        "edition", F.col("page").alias("subject_id"), F.lit("article_id").alias("rule"),
        F.explode(F.array_distinct(F.regexp_extract_all(text("body"), F.lit(R.PUBLIC_ID), F.lit(0)))).alias("detail"),
    )
    return urls.unionByName(ids)


def _source_rows(source_runs: DataFrame, name: str, editions: DataFrame) -> DataFrame:
    mine = source_runs.filter(F.col("source") == name)
    stats = mine.groupBy("edition").agg(
        F.count(F.lit(1)).alias("_runs"),
        F.first("status").alias("status"),
        F.first("accepted_count").alias("accepted_count"),
        F.first("fetched_count").alias("fetched_count"),
        F.first("details").alias("details"),
    )
    return editions.select("edition", "publication_status").join(stats, "edition", "left").na.fill(0, ["_runs"])


def check_trending_run(
    editions: DataFrame, source_runs: DataFrame, captured: DataFrame, articles: DataFrame, signals: DataFrame, settings
) -> DataFrame:
    """Health of a trending run; an edition without rows is healthy.

    editions: (edition, publication_status); source_runs carry details map<string,string>; captured:
    (edition, pos, link, provenance).
    """
    rows = _source_rows(source_runs, settings.source, editions)
    per = captured.groupBy("edition").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct(A.prov("trend_term_en")).alias("_terms"),
        F.count_if(text(A.prov("trend_term_en")) == "").alias("_blank"),
        F.count_distinct(A.prov("trend_rank").try_cast("int")).alias("_ranks"),
        F.min(A.prov("trend_rank").try_cast("int")).alias("_lo"),
        F.max(A.prov("trend_rank").try_cast("int")).alias("_hi"),
    )
    rows = rows.join(per, "edition", "left").na.fill(0, ["_n", "_terms", "_blank", "_ranks"])
    n = F.col("_n")
    day = F.col("edition").cast("string")
    details = F.col("details")

    def note(k: str) -> Column:
        return F.coalesce(F.try_element_at(details, F.lit(k)), F.lit(""))

    needed = ("requested_day", "row_count", "chrome_version", "render_duration_ms", "dom_sha256", "parser_version")
    whole = _whole(
        rows,
        ("source_outcome_count", F.col("_runs") != 1),
        ("source_status", ~F.coalesce(F.col("status").isin("ok", "degraded"), F.lit(False))),
        ("article_count", ~F.coalesce(F.col("accepted_count").between(1, settings.maximum), F.lit(False)) | (n != F.coalesce("accepted_count", F.lit(-1)))),
        ("fetched_mismatch", ~F.col("fetched_count").eqNullSafe(F.col("accepted_count"))),
        *[(f"snapshot_{k}", note(k) == "") for k in needed],
        ("snapshot_day", note("requested_day") != day),
        ("snapshot_rows", note("row_count") != F.col("accepted_count").cast("string")),
        ("rank_contiguity", (n > 0) & ~((F.col("_lo") == 1) & (F.col("_hi") == n) & (F.col("_ranks") == n))),
        ("term_uniqueness", (F.col("_blank") > 0) | (F.col("_terms") != n)),
        ("publication", ~F.coalesce(F.col("publication_status") == "published", F.lit(False))),
    )
    host = host_of(settings.page_url if isinstance(settings.page_url, Column) else F.lit(settings.page_url))
    each = _violations(
        captured, F.col("pos"),
        ("link_host", (scheme_of("link") != "https") | (host_of("link") != host)),
        ("provider", ~text(A.prov("provider")).eqNullSafe(F.lit(settings.provider))),
        ("retrieval", text(A.prov("retrieval")) != "homepage_trending_dom"),
        ("article_day", text(A.prov("trend_day")) != F.col("edition").cast("string")),
        ("window", text(A.prov("trend_window")) != settings.window),
        ("state", ~text(A.prov("trend_state")).isin("up", "down", "new", "steady")),
        ("numbers", A.prov("trend_heat").try_cast("double").isNull() | A.prov("trend_delta").try_cast("int").isNull()),
    )
    missing = represented_links_check(captured.select("edition", "link"), articles, signals)
    lost = _violations(missing.select("edition", "link"), F.col("link"), ("not_represented", F.lit(True)))
    return whole.unionByName(each).unionByName(lost)


def check_shadow_run(
    editions: DataFrame, source_runs: DataFrame, captured: DataFrame, articles: DataFrame,
    items: DataFrame, markdown: DataFrame, settings,
) -> DataFrame:
    """Health of a channel run.

    items: (edition, article_id, url, summary); markdown: (edition, body).
    """
    rows = _source_rows(source_runs, settings.source, editions)
    rows = rows.join(captured.groupBy("edition").agg(F.count(F.lit(1)).alias("_n")), "edition", "left")
    rows = rows.join(items.groupBy("edition").agg(F.count(F.lit(1)).alias("_items")), "edition", "left")
    rows = rows.join(markdown.withColumnRenamed("body", "_body"), "edition", "left").na.fill(0, ["_n", "_items"])
    requests = F.try_element_at("details", F.lit("network_requests")).try_cast("int")
    lines = F.split(F.coalesce("_body", F.lit("")), "\n")
    rendered = F.transform(
        F.filter(lines, lambda x: x.startswith("发生了什么：") | x.rlike(r"^\d.*\. ")),
        lambda x: F.when(x.startswith("发生了什么："), F.substring(x, 7, 1_000_000)).otherwise(F.regexp_extract(x, r"^.*?\. (.*)$", 1)),
    )
    whole = _whole(
        rows,
        ("source_outcome_count", F.col("_runs") != 1),
        ("source_status", ~F.coalesce(F.col("status") == "ok", F.lit(False))),
        ("accepted_count", F.coalesce("accepted_count", F.lit(0)) <= 0),
        ("snapshot_count", F.col("_n") != F.coalesce("accepted_count", F.lit(-1))),
        ("requests_missing", requests.isNull()),
        ("requests_exceeded", requests > 5),
        ("no_items", F.col("_items") == 0),
        ("markdown_missing", F.col("_body").isNull()),
        ("attribution_lines", F.col("_body").isNotNull() & (F.size(F.filter(lines, lambda x: x.startswith("入选来源："))) != 1)),
        ("rendered_count", (F.col("_items") > 0) & F.col("_body").isNotNull() & (F.size(rendered) != F.col("_items"))),
        ("rendered_colon", F.exists(rendered, lambda x: x.rlike("[:：]"))),
        ("private_metadata", F.coalesce(F.col("_body").rlike("观察信号|运行诊断"), F.lit(False))),
        ("publication", ~F.coalesce(F.col("publication_status") == "published", F.lit(False))),
    )
    each = _violations(
        captured, F.col("pos"),
        ("link", ~is_http_url("link")),
        *[(f"provenance_{k}", text(A.prov(k)) == "") for k in ("channel", "channel_rank", "api_day")],
        ("provider", text(A.prov("provider")) != settings.provider),
        ("retrieval", text(A.prov("retrieval")) != settings.retrieval),
        ("api_day", text(A.prov("api_day")) != F.col("edition").cast("string")),
    )
    known = articles.filter(is_http_url("link")).select("edition", "link").distinct()
    lost = captured.filter(is_http_url("link")).select("edition", "link").join(known, ["edition", "link"], "left_anti")
    loose = items.select("edition", F.col("url").alias("link")).join(known, ["edition", "link"], "left_anti")
    exposed = items.join(markdown, "edition").filter(is_http_url("url") & F.contains(F.col("body"), F.col("url")))
    return (
        whole.unionByName(each)
        .unionByName(_violations(lost, F.col("link"), ("not_in_edition", F.lit(True))))
        .unionByName(_violations(loose, F.col("link"), ("item_url_unknown", F.lit(True))))
        .unionByName(_violations(exposed, F.col("article_id"), ("url_exposed", F.lit(True))))
        .unionByName(check_reader_sentence(items))
    )


def verdicts(editions: DataFrame, violations: DataFrame) -> DataFrame:
    bad = violations.groupBy("edition").agg(F.count(F.lit(1)).alias("error_count"))
    out = editions.select("edition").distinct().join(bad, "edition", "left").na.fill(0, ["error_count"])
    return out.withColumn("healthy", F.col("error_count") == 0)
