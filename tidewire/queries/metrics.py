"""Counters, scorecards and benchmark summaries over facts made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import metrics as M
from tidewire.operators import ranking as Rk
from tidewire.queries import sqltext as S
from tidewire.queries import views as V
from tidewire.queries.registry import query

_STAGES = ("verify", "priority_refill", "secondary_refill", "official_fallback")


def stage_runs(spark, sf):
    """Every event is one run."""
    e = F.col("event_id")
    k = F.col("k")
    return V.events(spark, sf).select(
        "edition",
        F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (e % 4 + 1).cast("int")).alias("stage"),
        F.col("user_id").alias("run_id"),
        F.when(k % 6 == 0, "timeout").when(k % 6 == 1, "http_error").when(k % 6 == 5, "").otherwise("success").alias("request_outcome"),
        F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "no_match").when(k % 5 == 2, "outside_24h").when(k % 5 == 3, "missing_published_date").alias("validation_outcome"),
        k.cast("long").alias("result_count"),
        (k % 3).cast("long").alias("accepted_count"),
        (k % 2).cast("long").alias("near_duplicate_rejected_count"),
        F.floor(k / 2 % 2).cast("long").alias("story_cluster_rejected_count"),
        F.when(F.col("user_id") % 3 > 0, F.date_sub("edition", (F.col("user_id") % 3).cast("int"))).alias("start_date"),
        F.when(F.col("user_id") % 4 > 0, F.col("edition")).alias("end_date"),
        F.col("value").alias("latency_ms"),
    )


def stage_candidates(spark, sf):
    """Every event is one candidate of the run of its user."""
    e = F.col("event_id")

    def tri(m):
        return F.when(m == 1, False).when(m > 1, True)

    return V.events(spark, sf).select(
        "edition",
        F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (e % 4 + 1).cast("int")).alias("stage"),
        F.col("user_id").alias("run_id"),
        e.alias("rank"),
        F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("k") % 10).cast("string"), F.lit("-"), e.cast("string"))).alias("title"),
        F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("domain"),
        F.when(e % 5 == 0, "").otherwise(F.col("edition").cast("string")).alias("published_date"),
        tri(e % 5).alias("within_24h"),
        (e % 3 != 0).alias("ai_title_relevant"),
        (e % 7 == 0).alias("accepted"),
        (e % 11 == 0).alias("duplicate_existing"),
        (e % 13 == 0).alias("duplicate_within_results"),
        (e % 17 == 0).alias("near_duplicate_existing"),
        (e % 19 == 0).alias("story_cluster_existing"),
        (e % 2 == 0).alias("lenient_candidate"),
        tri(e % 9).alias("lenient_within_window"),
        (e % 6 == 0).alias("valid_new_candidate"),
    )


RUNS = f"""{V.EV}, runs AS (SELECT edition, ['verify', 'priority_refill', 'secondary_refill', 'official_fallback'][event_id % 4 + 1] AS stage, user_id AS run_id,
 CASE k % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_error' WHEN 5 THEN '' ELSE 'success' END AS request_outcome, CASE k % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'no_match' WHEN 2 THEN 'outside_24h' WHEN 3 THEN 'missing_published_date' END AS validation_outcome,
 k AS rc, k % 3 AS ac, k % 2 AS nd, (k // 2) % 2 AS sc, CASE WHEN user_id % 3 > 0 THEN CAST(edition - CAST(user_id % 3 AS INTEGER) AS DATE) END AS start_date, CASE WHEN user_id % 4 > 0 THEN edition END AS end_date, value AS latency_ms FROM ev),
cand AS (SELECT edition, ['verify', 'priority_refill', 'secondary_refill', 'official_fallback'][event_id % 4 + 1] AS stage, user_id AS run_id, event_id AS e, CASE WHEN k % 10 = 0 THEN '' ELSE 't' || (k % 10) || '-' || event_id END AS title, 'd' || (user_id % 7) AS domain FROM ev)"""
_REFILL = "stage <> 'verify'"
_DUP = "(e % 11 = 0 OR e % 13 = 0 OR e % 17 = 0 OR e % 19 = 0)"


@query("verify_outcomes", f"WITH {RUNS} SELECT edition, 'validation' AS kind, coalesce(validation_outcome, 'unknown') AS value, count(*) AS n FROM runs WHERE stage = 'verify' GROUP BY 1, 3 UNION ALL SELECT edition, 'request', coalesce(nullif(request_outcome, ''), 'unknown'), count(*) FROM runs WHERE stage = 'verify' GROUP BY 1, 3")
def verify_outcomes(spark, sf):
    return M.verify_outcomes(stage_runs(spark, sf))


STAGES = f"""sr AS (SELECT edition, stage, count(*) AS calls, sum(rc)::BIGINT AS result_count, sum(ac)::BIGINT AS accepted_count, sum(nd)::BIGINT AS near_duplicate_rejected_count, sum(sc)::BIGINT AS story_cluster_rejected_count,
  count(*) FILTER (request_outcome IN ('timeout', 'http_error')) AS network_failures FROM runs WHERE {_REFILL} GROUP BY 1, 2),
 sc AS (SELECT edition, stage, count(*) AS n, count(*) FILTER (e % 5 = 0) AS published_date_missing_count, count(*) FILTER (e % 7 <> 0 AND (e % 11 = 0 OR e % 13 = 0)) AS duplicate_rejected_count, count(*) FILTER (e % 7 <> 0 AND e % 3 = 0) AS non_ai_rejected_count,
  count(*) FILTER (e % 7 <> 0 AND e % 5 = 1) AS outside_window_rejected_count, count(*) FILTER (e % 2 = 0) AS lenient_candidate_count, count(*) FILTER (e % 2 = 0 AND e % 9 > 1) AS proven_within_lenient_window_count,
  count(*) FILTER (e % 2 = 0 AND e % 5 = 0) AS missing_date_unproven_count, count(*) FILTER (e % 9 = 1) AS outside_lenient_window_rejected_count, count(*) FILTER (e % 2 = 0 AND e % 3 = 0) AS lenient_non_ai_count,
  count(*) FILTER (e % 2 = 0 AND {_DUP}) AS lenient_duplicate_or_cluster_count FROM cand GROUP BY 1, 2),
 stages AS (SELECT * EXCLUDE (n), round(published_date_missing_count / n::DOUBLE, 4) AS published_date_missing_rate FROM sr JOIN sc USING (edition, stage))"""


@query("refill_stage_summary", f"WITH {RUNS}, {STAGES} SELECT * FROM stages")
def refill_stage_summary(spark, sf):
    return M.refill_stage_summary(stage_runs(spark, sf), stage_candidates(spark, sf))


@query(
    "title_preview",
    f"WITH {RUNS}, t AS (SELECT *, row_number() OVER (PARTITION BY edition, stage ORDER BY run_id, e) AS r FROM cand WHERE e % 7 = 0 AND title <> '') SELECT edition, stage, string_agg(title, '|' ORDER BY r) AS preview FROM t WHERE r <= 3 GROUP BY 1, 2",
)
def title_preview(spark, sf):
    out = M.title_preview(stage_candidates(spark, sf), F.col("accepted"))
    return out.withColumn("preview", F.array_join("preview", "|"))


LENIENT = f"""ld AS (SELECT edition, stage, arg_min(start_date, run_id) FILTER (start_date IS NOT NULL) AS start_date, arg_min(end_date, run_id) FILTER (end_date IS NOT NULL) AS end_date, sum(rc)::BIGINT AS result_count FROM runs WHERE {_REFILL} GROUP BY 1, 2),
 lc AS (SELECT edition, stage, lenient_candidate_count, proven_within_lenient_window_count AS proven_within_window_count, missing_date_unproven_count, outside_lenient_window_rejected_count AS outside_window_rejected_count, lenient_non_ai_count, lenient_duplicate_or_cluster_count FROM sc),
 lenient AS (SELECT * FROM ld JOIN lc USING (edition, stage))"""


@query("lenient_stage_diagnostics", f"WITH {RUNS}, {STAGES}, {LENIENT} SELECT *, 72 AS window_hours FROM lenient")
def lenient_stage_diagnostics(spark, sf):
    return M.lenient_stage_diagnostics(stage_runs(spark, sf), stage_candidates(spark, sf), 72)


@query(
    "lenient_edition_diagnostics",
    f"""WITH {RUNS}, {STAGES}, {LENIENT}, o AS (SELECT *, CASE stage WHEN 'priority_refill' THEN 1 WHEN 'secondary_refill' THEN 2 ELSE 3 END AS o FROM lenient)
 SELECT edition, sum(lenient_candidate_count)::BIGINT AS lenient_candidate_count, sum(proven_within_window_count)::BIGINT AS proven_within_window_count, sum(missing_date_unproven_count)::BIGINT AS missing_date_unproven_count,
 sum(outside_window_rejected_count)::BIGINT AS outside_window_rejected_count, sum(lenient_non_ai_count)::BIGINT AS lenient_non_ai_count, sum(lenient_duplicate_or_cluster_count)::BIGINT AS lenient_duplicate_or_cluster_count,
 arg_min(start_date, o) FILTER (start_date IS NOT NULL) AS start_date, arg_min(end_date, o) FILTER (end_date IS NOT NULL) AS end_date FROM o GROUP BY edition""",
)
def lenient_edition_diagnostics(spark, sf):
    return M.lenient_edition_diagnostics(M.lenient_stage_diagnostics(stage_runs(spark, sf), stage_candidates(spark, sf)))


TOTALS = """vf AS (SELECT edition, count(*) FILTER (request_outcome IN ('timeout', 'http_error')) AS v FROM runs WHERE stage = 'verify' GROUP BY 1),
 rf AS (SELECT edition, sum(network_failures) AS n, sum(near_duplicate_rejected_count + story_cluster_rejected_count + duplicate_rejected_count + non_ai_rejected_count + outside_window_rejected_count)::BIGINT AS quality_rejections,
  sum(published_date_missing_count)::BIGINT AS missing_dates, sum(result_count) AS rr FROM stages GROUP BY 1),
 totals AS (SELECT edition, (n + coalesce(v, 0))::BIGINT AS network_failures, quality_rejections, missing_dates, CASE WHEN rr > 0 THEN round(missing_dates / rr::DOUBLE, 4) END AS published_date_missing_rate FROM rf LEFT JOIN vf USING (edition))"""


@query("failure_totals", f"WITH {RUNS}, {STAGES}, {TOTALS} SELECT * FROM totals")
def failure_totals(spark, sf):
    runs = stage_runs(spark, sf)
    return M.failure_totals(runs, M.refill_stage_summary(runs, stage_candidates(spark, sf)))


def reports(spark, sf):
    d = F.col("d")
    rows = V.events(spark, sf).groupBy("edition").agg(F.count(F.lit(1)).alias("input_count")).withColumn("d", F.dayofmonth("edition"))
    return rows.select(
        "edition", "input_count", (d % 11 != 0).alias("report_present"), (d % 13 != 0).alias("has_enrichment"), (d % 7 != 0).alias("applied"),
        F.when(d % 7 == 0, "missing_api_key").when(d % 9 == 0, "enrichment_error").otherwise("").alias("skip_reason"),
        F.when(d % 4 == 0, "budget_exhausted_after_priority_refill").otherwise("done").alias("stop_reason"),
        d.cast("long").alias("final_count"), (d % 9).cast("long").alias("total_calls"), F.lit(25).alias("min_articles"), F.lit(8).alias("max_total_calls"),
        F.when(d % 18 == 0, "timeout").otherwise("").alias("terminal_error_code"),
    )


REPORT = """rep AS (SELECT *, day(edition) AS d FROM (SELECT edition, count(*) AS input_count FROM ev GROUP BY 1)),
 diag AS (SELECT *, d % 4 = 0 OR d % 9 >= 8 AS budget, CASE WHEN d % 7 = 0 THEN 'missing_api_key' WHEN d % 9 = 0 THEN 'enrichment_error' ELSE '' END AS skip FROM rep JOIN totals USING (edition)),
 diagnosis AS (SELECT edition, CASE WHEN d % 11 = 0 THEN 'report_json_missing' WHEN d % 13 = 0 THEN 'enrichment_missing' WHEN d % 7 = 0 THEN 'enrichment_not_applied:' || skip WHEN d >= 25 THEN 'min_articles_satisfied' WHEN network_failures > 0 THEN 'network_failure'
   WHEN input_count = 0 THEN 'source_empty' WHEN budget THEN 'budget_exhausted' WHEN missing_dates > 0 THEN 'metadata_missing' WHEN quality_rejections > 0 THEN 'candidate_quality' ELSE 'below_min_unresolved' END AS primary_limiter,
  array_to_string(list_filter([CASE WHEN budget THEN 'budget_exhausted' END, CASE WHEN missing_dates > 0 THEN 'published_date_missing' END, CASE WHEN quality_rejections > 0 THEN 'candidate_quality_rejections' END,
   CASE WHEN network_failures > 0 THEN 'network_failures' END, CASE WHEN input_count = 0 THEN 'source_empty' END, CASE WHEN skip <> '' THEN 'skip_reason:' || skip END], lambda x: x IS NOT NULL), '|') AS factors FROM diag)"""


@query("diagnosis", f"WITH {RUNS}, {STAGES}, {TOTALS}, {REPORT} SELECT edition, primary_limiter, factors, primary_limiter NOT IN ('min_articles_satisfied', 'enrichment_not_applied:disabled') AS needs_fixture FROM diagnosis")
def diagnosis(spark, sf):
    runs = stage_runs(spark, sf)
    totals = M.failure_totals(runs, M.refill_stage_summary(runs, stage_candidates(spark, sf)))
    out = M.diagnosis(reports(spark, sf), totals)
    return out.select("edition", "primary_limiter", F.array_join("contributing_factors", "|").alias("factors"), "needs_fixture")


@query(
    "scorecard",
    f"""WITH {RUNS}, {STAGES}, {TOTALS}, {REPORT}, {LENIENT}, v AS (SELECT edition, count(*) AS verify_calls, count(*) FILTER (validation_outcome = 'accepted') AS verified_count FROM runs WHERE stage = 'verify' GROUP BY 1),
 s AS (SELECT edition, sum(accepted_count)::BIGINT AS refilled_count, max(CASE WHEN stage = 'priority_refill' THEN calls END) AS priority_calls FROM stages GROUP BY 1), l AS (SELECT edition, sum(lenient_candidate_count)::BIGINT AS lenient_candidate_count FROM lenient GROUP BY 1)
 SELECT edition, primary_limiter, verify_calls, verified_count, refilled_count, priority_calls, lenient_candidate_count, greatest(0, 25 - day(edition))::BIGINT AS remaining FROM diagnosis JOIN v USING (edition) JOIN s USING (edition) JOIN l USING (edition)""",
)
def scorecard(spark, sf):
    out = M.scorecard(reports(spark, sf), stage_runs(spark, sf), stage_candidates(spark, sf))
    return out.select(
        "edition", "primary_limiter", "verify_calls", "verified_count", "refilled_count", F.element_at("refill", "priority_refill")["calls"].alias("priority_calls"), "lenient_candidate_count", F.col("remaining").cast("long").alias("remaining")
    )


def enrichment_runs(spark, sf):
    kinds = F.array(F.lit("candidate_enrichment"), F.lit("lead_resolution"), F.lit("verify"), F.lit("priority_refill"))
    return V.events(spark, sf).select(
        "edition",
        F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("stage"),
        F.when(F.col("k") % 6 == 0, "timeout").when(F.col("k") % 6 == 1, "http_error").when(F.col("k") % 6 == 5, "").otherwise("success").alias("request_outcome"),
    ).filter((F.dayofmonth("edition") % 3 != 0) | (F.col("stage") != "candidate_enrichment"))


FAIL = f"""{V.EV}, fr AS (SELECT edition, ['candidate_enrichment', 'lead_resolution', 'verify', 'priority_refill'][event_id % 4 + 1] AS stage, CASE k % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_error' ELSE '' END AS code FROM ev),
 fails AS (SELECT edition, stage, code, count(*) AS n FROM fr WHERE code <> '' AND NOT (day(edition) % 3 = 0 AND stage = 'candidate_enrichment') AND NOT (day(edition) % 3 <> 0 AND stage = 'lead_resolution') GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT edition, 'enrichment', CASE WHEN day(edition) % 7 = 0 THEN 'missing_api_key' WHEN day(edition) % 18 = 0 THEN 'timeout' ELSE 'enrichment_error' END, 1 FROM ev WHERE day(edition) % 7 = 0 OR day(edition) % 9 = 0)"""


@query("stage_failures", f"WITH {FAIL} SELECT edition, stage, code, n FROM fails")
def stage_failures(spark, sf):
    return M.stage_failures(enrichment_runs(spark, sf), reports(spark, sf))


@query(
    "pipeline_failures",
    f"""WITH {FAIL}, e AS (SELECT DISTINCT edition, event_type AS s FROM ev), src AS (SELECT edition, 'fetch.' || s AS stage, CASE WHEN day(edition) % 2 = 0 THEN 'slow_feed' WHEN s = 'click' THEN 'Timeout_Error' ELSE 'source_degraded' END AS code FROM e WHERE (day(edition) + length(s)) % 3 = 0),
 att AS (SELECT edition, 'summary.' || event_type || '_x' AS stage, CASE WHEN k % 2 = 0 THEN 'quota' ELSE 'provider_failed' END AS code FROM ev WHERE k % 10 < 3),
 u AS (SELECT edition, stage, code, 1 AS n FROM src UNION ALL SELECT edition, 'enrichment.' || stage, code, n FROM fails UNION ALL SELECT edition, stage, code, 1 FROM att) SELECT edition, stage, code, sum(n)::BIGINT AS n FROM u GROUP BY 1, 2, 3""",
)
def pipeline_failures(spark, sf):
    ev = V.events(spark, sf)
    bad = (F.dayofmonth("edition") + F.length("source")) % 3 == 0
    sources = ev.select("edition", F.col("event_type").alias("source")).distinct()
    none = F.array().cast("array<string>")
    sources = sources.select(
        "edition", "source", F.when(bad, "degraded").otherwise("ok").alias("status"),
        F.when(F.col("source") == "click", "Timeout Error").alias("error_kind"),
        F.when(F.dayofmonth("edition") % 2 == 0, F.array(F.lit("slow_feed"), F.lit("x_snapshot"))).otherwise(none).alias("diagnostic_codes"),
    )
    attempts = ev.select(
        "edition", F.concat("event_type", F.lit(" x")).alias("provider"), F.when(F.col("k") % 10 < 3, "failed").otherwise("ok").alias("status"), F.when(F.col("k") % 2 == 0, "quota").alias("error_kind")
    )
    return M.pipeline_diagnostics(sources, M.stage_failures(enrichment_runs(spark, sf), reports(spark, sf)), attempts)


@query("diagnostics_status", f"WITH {FAIL}, n AS (SELECT edition, sum(n)::BIGINT AS failure_count FROM fails WHERE stage = 'enrichment' GROUP BY 1) SELECT e.edition, coalesce(failure_count, 0) AS failure_count, CASE WHEN failure_count > 0 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT DISTINCT edition FROM ev) e LEFT JOIN n USING (edition)")
def diagnostics_status(spark, sf):
    failures = M.stage_failures(enrichment_runs(spark, sf), reports(spark, sf)).filter("stage = 'enrichment'")
    return M.diagnostics_status(V.events(spark, sf), failures)


def benchmark_runs(spark, sf):
    k = F.col("k")
    scen = F.element_at(F.array(F.lit("verify_exact"), F.lit("verify_fuzzy"), F.lit("refill_topic")), (F.col("event_id") % 3 + 1).cast("int"))
    return V.events(spark, sf).select(
        F.col("event_id").alias("run_no"), scen.alias("scenario"), F.when(F.col("user_id") % 2 == 0, "basic").otherwise("advanced").alias("search_depth"),
        F.concat(F.lit("s"), F.floor(F.col("event_id") / 3).cast("string")).alias("sample_id"), F.when(k % 8 == 0, "boom").alias("error"), F.col("value").alias("latency_ms"),
        F.when(k % 9 > 0, k / 100).alias("title_similarity"), F.when(k % 5 > 0, k / 50).alias("published_date_availability"), k.alias("new_valid_news_count"), (k % 4).alias("duplicate_count"),
        F.when(k % 7 > 0, k % 7 > 4).alias("matched"), F.when(k % 3 > 0, k % 3 == 1).alias("same_domain"), F.when(k % 11 > 0, k % 11 > 6).alias("within_24h"),
    )


BENCH = f"""{V.EV}, br AS (SELECT event_id AS run_no, ['verify_exact', 'verify_fuzzy', 'refill_topic'][event_id % 3 + 1] AS scenario, CASE WHEN user_id % 2 = 0 THEN 'basic' ELSE 'advanced' END AS search_depth, 's' || (event_id // 3) AS sample_id, k % 8 <> 0 AS good, value, k FROM ev)"""


@query(
    "benchmark_groups",
    f"""WITH {BENCH} SELECT scenario, search_depth, count(*) AS run_count, count(*) FILTER (good) AS success_count, count(*) FILTER (NOT good) AS failure_count, round(avg(value) FILTER (good), 4) AS avg_latency_ms,
 round(avg(k / 100.0::DOUBLE) FILTER (good AND k % 9 > 0), 4) AS avg_title_similarity, round(avg(k / 50.0::DOUBLE) FILTER (good AND k % 5 > 0), 4) AS avg_published_date_availability,
 CASE WHEN scenario = 'refill_topic' THEN round(avg(k) FILTER (good), 4) END AS avg_new_valid_news_count, CASE WHEN scenario = 'refill_topic' THEN round(avg(k % 4) FILTER (good), 4) END AS avg_duplicate_count,
 CASE WHEN scenario <> 'refill_topic' THEN round(avg((k % 7 > 4)::INT) FILTER (good AND k % 7 > 0), 4) END AS matched_rate, CASE WHEN scenario <> 'refill_topic' THEN round(avg((k % 3 = 1)::INT) FILTER (good AND k % 3 > 0), 4) END AS same_domain_rate,
 CASE WHEN scenario <> 'refill_topic' THEN round(avg((k % 11 > 6)::INT) FILTER (good AND k % 11 > 0), 4) END AS within_24h_rate FROM br GROUP BY 1, 2""",
)
def benchmark_groups(spark, sf):
    return M.benchmark_groups(benchmark_runs(spark, sf))


@query(
    "fuzzy_rescue",
    f"""WITH {BENCH}, l AS (SELECT sample_id, bool_or(scenario = 'verify_fuzzy' AND search_depth = 'advanced' AND good AND k % 7 > 4) AS f, bool_or(scenario = 'verify_exact' AND k % 7 > 4) AS x FROM br GROUP BY 1)
 SELECT sample_id FROM l WHERE f AND NOT x""",
)
def fuzzy_rescue(spark, sf):
    return M.fuzzy_rescue(benchmark_runs(spark, sf))


@query("valid_domain_frequency", f"WITH {RUNS} SELECT stage, domain, count(*) AS n FROM cand WHERE e % 6 = 0 GROUP BY 1, 2")
def valid_domain_frequency(spark, sf):
    return M.valid_domain_frequency(stage_candidates(spark, sf), ["stage"])


def _result_rows(spark, sf):
    rows = V.doc_articles(spark, sf)
    return rows.select(
        F.concat("source", F.lit("-"), F.col("edition").cast("string")).alias("run_id"), "edition", F.col("pos").alias("rank"), "title", F.col("link").alias("url"),
        F.when(F.col("doc_id") % 5 > 0, F.col("edition").cast("string")).otherwise("").alias("published_date"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4 > 1).alias("within_24h"),
    )


@query(
    "evaluate_results",
    f"""WITH {V.DOC}, r AS (SELECT doc_id, source || '-' || edition AS run_id, edition, pos, title, {S.search_title('title')} AS t, {S.search_url('link')} AS u FROM doc), b AS (SELECT * FROM r WHERE pos % 9 = 0),
 f AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE b.edition = r.edition AND b.t = r.t) OR EXISTS (SELECT 1 FROM b WHERE b.edition = r.edition AND b.u = r.u) AS de, row_number() OVER (PARTITION BY run_id, t ORDER BY pos) > 1 AS dw,
  regexp_matches(lower(title), '(^|[^\\p{{L}}\\p{{N}}_])(ai|openai|anthropic|claude|chatgpt|llm|model|models|agent|agents|robot|robotics|startup|startups|copilot|sora)([^\\p{{L}}\\p{{N}}_]|$)') AS ai FROM r),
 s AS (SELECT run_id, count(*) AS result_count, count(*) FILTER (doc_id % 5 > 0) AS dated, count(*) FILTER (doc_id % 4 > 1) AS within_24h_count, count(*) FILTER (de) AS duplicate_existing_count, count(*) FILTER (de OR dw) AS duplicate_count,
  count(*) FILTER (ai) AS ai_title_count, count(*) FILTER (doc_id % 4 > 1 AND ai AND NOT de AND NOT dw) AS valid_count FROM f GROUP BY 1), g AS (SELECT *, substring(run_id, 4, 1) <> '7' AS good FROM s)
 SELECT run_id, CASE WHEN good THEN result_count ELSE 0 END AS result_count, CASE WHEN good THEN within_24h_count ELSE 0 END AS within_24h_count, CASE WHEN good THEN duplicate_existing_count ELSE 0 END AS duplicate_existing_count, CASE WHEN good THEN duplicate_count ELSE 0 END AS duplicate_count,
 CASE WHEN good THEN ai_title_count ELSE 0 END AS ai_title_count, CASE WHEN good THEN valid_count ELSE 0 END AS valid_count, CASE WHEN good THEN round(dated / result_count::DOUBLE, 4) END AS published_date_availability FROM g""",
)
def evaluate_results(spark, sf):
    results = _result_rows(spark, sf)
    existing = results.filter("rank % 9 = 0").select("edition", "title", "url")
    runs = results.select("run_id", "edition").distinct().withColumn("error", F.when(F.substring("run_id", 4, 1) == "7", "boom"))
    out = M.evaluate_results(runs, results, existing)
    return out.select("run_id", "result_count", "within_24h_count", "duplicate_existing_count", "duplicate_count", "ai_title_count", "valid_count", "published_date_availability")


def _domains(spark, sf):
    runs = stage_runs(spark, sf).select(
        F.concat(F.lit("d"), (F.col("run_id") % 7).cast("string")).alias("domain"), F.col("run_id").alias("run_no"), F.when(F.col("run_id") % 5 == 0, "boom").alias("error"), "latency_ms", "result_count",
        (F.col("result_count") / 100).alias("published_date_availability"), (F.col("result_count") / 200).alias("within_24h_rate"), (F.col("result_count") / 400).alias("ai_title_rate"),
        F.col("accepted_count").alias("duplicate_existing_count"), F.col("near_duplicate_rejected_count").alias("unique_valid_count"),
    )
    cands = stage_candidates(spark, sf).select("domain", F.col("run_id").alias("run_no"), "rank", "title", F.col("valid_new_candidate").alias("unique_valid_candidate"))
    dims = spark.range(9).select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"), F.lit("l").alias("label"), F.lit("media").alias("family"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("src"), F.col("id").cast("string"))).alias("source_key"), (F.col("id") % 4 == 0).alias("configured_source_enabled")
    )
    observed = V.table(spark, sf, "documents").groupBy(F.col("source").alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    seen = spark.range(3).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("domain"))
    return M.domain_summary(runs, cands, dims, observed, seen)


DOMAINS = f"""{RUNS}, dr AS (SELECT 'd' || (run_id % 7) AS domain, run_id, run_id % 5 <> 0 AS good, latency_ms, rc, ac, nd FROM runs),
 ds AS (SELECT domain, count(*) AS run_count, count(*) FILTER (good) AS success_count, round(avg(latency_ms) FILTER (good), 4) AS avg_latency_ms, round(avg(rc / 100.0::DOUBLE) FILTER (good), 4) AS avg_published_date_availability, round(avg(nd) FILTER (good), 4) AS avg_unique_valid_count, sum(CASE WHEN good THEN nd ELSE 0 END)::BIGINT AS total_unique_valid_count FROM dr GROUP BY 1),
 dt AS (SELECT domain, title, min(run_id * 1000000 + e) AS o FROM cand WHERE e % 6 = 0 AND title <> '' AND run_id % 5 <> 0 GROUP BY 1, 2), dp AS (SELECT domain, string_agg(title, '|' ORDER BY o) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o) AS r FROM dt) WHERE r <= 5 GROUP BY 1),
 dd AS (SELECT 'd' || i AS domain, CASE WHEN i % 2 = 0 THEN 'src' || i END AS source_key, i FROM range(9) t(i)),
 dom AS (SELECT dd.domain, coalesce(run_count, 0) AS run_count, coalesce(success_count, 0) AS success_count, avg_latency_ms, avg_published_date_availability, avg_unique_valid_count, coalesce(total_unique_valid_count, 0) AS total_unique_valid_count, coalesce(titles, '') AS titles, coalesce(o.n, 0) AS observed_recent_articles, i < 3 AS appeared_before
  FROM dd LEFT JOIN ds USING (domain) LEFT JOIN dp USING (domain) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) o ON o.source = dd.source_key)"""


@query("domain_summary", f"WITH {DOMAINS} SELECT * FROM dom")
def domain_summary(spark, sf):
    return _domains(spark, sf).select(
        "domain", "run_count", "success_count", "avg_latency_ms", "avg_published_date_availability", "avg_unique_valid_count", "total_unique_valid_count", F.array_join("sample_titles", "|").alias("titles"), "observed_recent_articles", "appeared_before"
    )


@query("domain_ranking", f"WITH {DOMAINS} SELECT domain, row_number() OVER (ORDER BY coalesce(avg_unique_valid_count, -1) DESC, coalesce(avg_published_date_availability, -1) DESC, domain) AS place FROM dom")
def domain_ranking(spark, sf):
    from pyspark.sql import Window as W

    # one row per configured domain: the order is numbered after the sort
    rows = Rk.domain_ranking(_domains(spark, sf)).select("domain", "avg_unique_valid_count", "avg_published_date_availability")
    keys = [F.coalesce(F.col(c), F.lit(-1.0)).desc() for c in ("avg_unique_valid_count", "avg_published_date_availability")]
    return rows.select("domain", F.row_number().over(W.orderBy(*keys, F.col("domain"))).cast("long").alias("place"))


@query("channel_counts", f"WITH {V.EV} SELECT edition, event_type AS channel, count(*) AS n FROM ev GROUP BY 1, 2")
def channel_counts(spark, sf):
    return M.channel_counts(V.events(spark, sf).withColumn("channel", F.col("event_type")))


@query("link_host_counts", f"WITH {V.ART} SELECT edition, {S.netloc('link')} AS host, count(*) * 2 AS n FROM art GROUP BY 1, 2")
def link_host_counts(spark, sf):
    body = F.concat(F.lit("see **"), F.col("link"), F.lit("**, and ["), F.col("source"), F.lit("]("), F.col("link"), F.lit(")."))
    rows = V.articles(spark, sf).select("edition", body.alias("md"))
    return M.link_host_counts(rows, "md", ["edition"])


@query("schema_keys", f"WITH {V.EV} SELECT event_type, unnest(json_keys(props)) AS key, count(*) AS n FROM ev GROUP BY 1, 2")
def schema_keys(spark, sf):
    return M.schema_keys(V.events(spark, sf), "props", ["event_type"])


@query(
    "length_audit",
    f"""WITH {V.DOC}, t AS (SELECT edition, length(regexp_replace(title, '[\\s\\p{{Z}}]', '', 'g')) + 1 AS n, {S.compact('title')} AS c FROM doc)
 SELECT edition, count(*) AS item_count, count(*) FILTER (n NOT BETWEEN 35 AND 60) AS outside_preferred_count, count(*) FILTER (n < 30 OR n > 80 OR regexp_matches(c, '[:：]|…|\\.{{3,}}') OR regexp_matches(c, '[。！？]')) AS format_violation_count,
 count(*) FILTER (n NOT BETWEEN 35 AND 60) = 0 AS preferred_target_met, count(*) FILTER (n < 30 OR n > 80 OR regexp_matches(c, '[:：]|…|\\.{{3,}}') OR regexp_matches(c, '[。！？]')) = 0 AS qualified FROM t GROUP BY edition""",
)
def length_audit(spark, sf):
    rows = V.doc_articles(spark, sf).select("edition", F.concat(F.lit("a"), F.col("pos")).alias("article_id"), F.concat("title", F.lit("。")).alias("summary"))
    return M.length_audit(rows)


@query("rejection_counts", f"WITH {V.EV} SELECT edition, event_type AS source, 'r' || (k % 4) AS reason, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def rejection_counts(spark, sf):
    return M.rejection_counts(V.events(spark, sf).select("edition", F.col("event_type").alias("source"), F.concat(F.lit("r"), (F.col("k") % 4).cast("string")).alias("reason")))


_FACTS = ["verify_calls", "verified_count", "priority_calls", "priority_count", "secondary_calls", "secondary_count", "official_calls", "official_count"]


@query(
    "replay_summary",
    f"""WITH {V.EV}, f AS (SELECT edition, count(*) AS raw_count, count(*) FILTER (value > 20) AS prefiltered_count, day(edition) % 5 AS vc, day(edition) % 4 AS vn, 1 AS pc, day(edition) % 3 AS pn, 1 AS sc, day(edition) % 2 AS sn, 1 AS oc, 2 AS n3 FROM ev GROUP BY edition),
 g AS (SELECT *, vc + pc AS u1, vn + pn AS f1, (vc + pc) < 6 AND (vn + pn) < 5 AS go2 FROM f), h AS (SELECT *, u1 + CASE WHEN go2 THEN sc ELSE 0 END AS u2, f1 + CASE WHEN go2 THEN sn ELSE 0 END AS f2 FROM g),
 i AS (SELECT *, u2 < 6 AND f2 < 5 AS go3 FROM h), j AS (SELECT *, u2 + CASE WHEN go3 THEN oc ELSE 0 END AS u3, f2 + CASE WHEN go3 THEN n3 ELSE 0 END AS f3 FROM i)
 SELECT edition, raw_count, prefiltered_count, u3::BIGINT AS total_calls, f3::BIGINT AS final_count, CASE WHEN go3 AND u3 >= 6 AND f3 < 5 THEN 'budget_exhausted_after_official_fallback' WHEN go3 THEN 'official_fallback_complete' WHEN u2 >= 6 AND f2 < 5 AND go2 THEN 'budget_exhausted_after_secondary_refill'
  WHEN u2 >= 6 AND f2 < 5 THEN 'budget_exhausted_after_priority_refill' WHEN go2 THEN 'secondary_refill_complete' ELSE 'priority_refill_complete' END AS stop_reason FROM j""",
)
def replay_summary(spark, sf):
    d = F.dayofmonth("edition").cast("long")
    one = F.lit(1).cast("long")
    values = [d % 5, d % 4, one, d % 3, one, d % 2, one, one * 2]
    rows = V.events(spark, sf).groupBy("edition").agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(F.col("value") > 20).alias("prefiltered_count"))
    rows = rows.select("*", *[v.alias(n) for n, v in zip(_FACTS, values)])
    return M.replay_summary(rows, 5, 6, official=True).select("edition", "raw_count", "prefiltered_count", "total_calls", "final_count", "stop_reason")


@query(
    "candidate_goal",
    f"WITH {V.ART} SELECT edition, sum(p % 4)::BIGINT AS network_requests, count(*) AS actual, count(*) >= 10 AS minimum_met, count(*) = 36 AS max_met, sum(p % 4) <= 50 AS within_request_cap FROM art GROUP BY edition",
)
def candidate_goal(spark, sf):
    rows = V.articles(spark, sf).withColumn("p", (F.col("pos") - 1) * 7 + F.datediff("edition", F.lit(V.BASE_DAY).cast("date")))
    runs = rows.select("edition", (F.col("p") % 4).alias("network_requests"))
    return M.candidate_goal(rows, runs, 10, 36, 50)


