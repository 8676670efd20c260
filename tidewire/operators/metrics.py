"""Counters, scorecards and benchmark summaries over exploded run facts.

Fact layouts used here:
  stage_runs        edition, stage, run_id, request_outcome, validation_outcome, result_count,
                    accepted_count, near_duplicate_rejected_count, story_cluster_rejected_count,
                    start_date, end_date
  stage_candidates  edition, stage, run_id, rank, title, domain, published_date, within_24h,
                    ai_title_relevant, accepted, duplicate_existing, duplicate_within_results,
                    near_duplicate_existing, story_cluster_existing, lenient_candidate,
                    lenient_within_window
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import numbers as N
from tidewire.functions import reader as R
from tidewire.functions.text import safe_code, text, visible_chars
from tidewire.functions.urls import url_host
from tidewire.operators.dedupe import flag_existing
from tidewire.operators.ranking import top_k, within_result_duplicates

# fixed values: request outcomes that mean the network failed
NETWORK_OUTCOMES = ("timeout", "http_error", "connection_error", "request_error", "unexpected_error")
REFILL_STAGES = ("priority_refill", "secondary_refill", "official_fallback")


def yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def no(name: str) -> Column:
    """Known to be false; NULL is neither."""
    return F.coalesce(~F.col(name), F.lit(False))


def source_counts(df: DataFrame, group: Column | None = None) -> DataFrame:
    """(edition, source, n, share); a blank source counts as unknown."""
    key = group if group is not None else F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("unknown"))
    counts = df.groupBy("edition", key.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("edition"))
    return counts.withColumn("share", N.rate("n", total))


def prefilter_stats(prefiltered: DataFrame) -> DataFrame:
    def out(reason: str) -> Column:
        return F.count_if(F.array_contains("exclude_reasons", reason))

    kept = F.col("included")

    def bucket(name: str) -> Column:
        return F.count_if(kept & (F.col("prefilter_bucket") == name)).alias(f"bucket_{name}")

    return prefiltered.groupBy("edition").agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(kept).alias("eligible_candidates"),
        out("missing_title").alias("excluded_missing_title"),
        out("missing_link").alias("excluded_missing_link"),
        out("aggregate_like").alias("excluded_aggregate_like"),
        out("non_ai_relevant").alias("excluded_non_ai_relevant"),
        F.count_if(kept & ~F.col("ai_relevant")).alias("soft_non_ai_relevant"),
        bucket("core_ai"),
        bucket("ai_neighbor"),
        bucket("generic_or_low_signal"),
    )


def stage_failures(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """(edition, stage, code, n). Candidate runs shadow lead runs of the same edition.

    reports: (edition, skip_reason, terminal_error_code).
    """
    shadow = runs.filter("stage = 'candidate_enrichment'").select("edition").distinct()
    leads = runs.filter("stage = 'lead_resolution'").join(shadow, "edition", "left_anti")
    rest = runs.filter("stage <> 'lead_resolution'").unionByName(leads)
    failed = rest.filter("coalesce(request_outcome, '') not in ('', 'success')").select(
        "edition", "stage", F.col("request_outcome").alias("code")
    )
    skipped = reports.filter("skip_reason in ('missing_api_key', 'enrichment_error')").select(
        "edition",
        F.lit("enrichment").alias("stage"),
        F.when(F.col("skip_reason") == "missing_api_key", "missing_api_key")
        .otherwise(F.coalesce(F.nullif("terminal_error_code", F.lit("")), F.lit("enrichment_error")))
        .alias("code"),
    )
    return failed.unionByName(skipped).groupBy("edition", "stage", "code").agg(F.count(F.lit(1)).alias("n"))


def pipeline_diagnostics(source_runs: DataFrame, failures: DataFrame, attempts: DataFrame) -> DataFrame:
    """(edition, stage, code, n) of reader-safe codes.

    source_runs: (edition, source, status, error_kind, diagnostic_codes array); failures: result of
    stage_failures; attempts: (edition, provider, status, error_kind).
    """
    codes = F.filter("diagnostic_codes", lambda c: (c != "") & ~c.endswith("_snapshot"))
    fallback = F.coalesce(F.nullif(text("error_kind"), F.lit("")), F.lit("source_degraded"))
    fetch = source_runs.filter("status in ('failed', 'degraded')").select(
        "edition",
        F.concat(F.lit("fetch."), F.col("source")).alias("stage"),
        F.explode(F.when(F.size(codes) > 0, codes).otherwise(F.array(fallback))).alias("code"),
        F.lit(1).cast("long").alias("n"),
    )
    enrich = failures.select(
        "edition",
        F.concat(F.lit("enrichment."), F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown"))).alias("stage"),
        "code",
        F.greatest(F.lit(1), F.col("n")).cast("long").alias("n"),
    )
    summary = attempts.filter("status = 'failed'").select(
        "edition",
        F.concat(F.lit("summary."), safe_code("provider")).alias("stage"),
        F.coalesce(F.nullif(text("error_kind"), F.lit("")), F.lit("provider_failed")).alias("code"),
        F.lit(1).cast("long").alias("n"),
    )
    rows = fetch.unionByName(enrich).unionByName(summary)
    return rows.groupBy(
        "edition", safe_code("stage", "unknown_stage").alias("stage"), safe_code("code").alias("code")
    ).agg(F.sum("n").alias("n"))


def diagnostics_status(editions: DataFrame, failures: DataFrame) -> DataFrame:
    n = failures.groupBy("edition").agg(F.sum("n").alias("failure_count"))
    out = editions.select("edition").distinct().join(n, "edition", "left").na.fill(0, ["failure_count"])
    return out.withColumn("status", F.when(F.col("failure_count") > 0, "degraded").otherwise("ok"))


def value_counts(runs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Counts per value; blank values count as unknown."""
    value = F.coalesce(F.nullif(text(column), F.lit("")), F.lit("unknown"))
    return runs.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def verify_outcomes(runs: DataFrame) -> DataFrame:
    """(edition, kind, value, n) over validation and request outcomes of the verify stage."""
    rows = runs.filter("stage = 'verify'")
    return (
        value_counts(rows, ["edition"], "validation_outcome")
        .withColumn("kind", F.lit("validation"))
        .unionByName(value_counts(rows, ["edition"], "request_outcome").withColumn("kind", F.lit("request")))
    )


def _duplicate_or_cluster() -> Column:
    return (
        yes("duplicate_existing")
        | yes("duplicate_within_results")
        | yes("near_duplicate_existing")
        | yes("story_cluster_existing")
    )


def _missing_date() -> Column:
    return text("published_date") == ""


def refill_stage_summary(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per (edition, stage)."""
    keys = ["edition", "stage"]
    per_run = runs.filter(F.col("stage").isin(*REFILL_STAGES)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce("result_count", F.lit(0))).alias("result_count"),
        F.sum(F.coalesce("accepted_count", F.lit(0))).alias("accepted_count"),
        F.sum(F.coalesce("near_duplicate_rejected_count", F.lit(0))).alias("near_duplicate_rejected_count"),
        F.sum(F.coalesce("story_cluster_rejected_count", F.lit(0))).alias("story_cluster_rejected_count"),
        F.count_if(F.col("request_outcome").isin(*NETWORK_OUTCOMES)).alias("network_failures"),
    )
    lenient, refused = yes("lenient_candidate"), ~yes("accepted")
    per_candidate = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(_missing_date()).alias("published_date_missing_count"),
        F.count_if(refused & (yes("duplicate_existing") | yes("duplicate_within_results"))).alias("duplicate_rejected_count"),
        F.count_if(refused & no("ai_title_relevant")).alias("non_ai_rejected_count"),
        F.count_if(refused & no("within_24h")).alias("outside_window_rejected_count"),
        F.count_if(lenient).alias("lenient_candidate_count"),
        F.count_if(lenient & yes("lenient_within_window")).alias("proven_within_lenient_window_count"),
        F.count_if(lenient & _missing_date()).alias("missing_date_unproven_count"),
        F.count_if(no("lenient_within_window")).alias("outside_lenient_window_rejected_count"),
        F.count_if(lenient & no("ai_title_relevant")).alias("lenient_non_ai_count"),
        F.count_if(lenient & _duplicate_or_cluster()).alias("lenient_duplicate_or_cluster_count"),
    )
    out = per_run.join(per_candidate, keys, "left")
    zeros = [c for c in per_candidate.columns if c not in keys]
    return (
        out.na.fill(0, zeros)
        .withColumn("published_date_missing_rate", N.rate("published_date_missing_count", "_n"))
        .drop("_n")
    )


def title_preview(candidates: DataFrame, keep: Column, k: int = 3, out: str = "preview") -> DataFrame:
    """First k non-empty titles per (edition, stage) in run and rank order."""
    rows = top_k(
        candidates.filter(keep & (text("title") != "")),
        ["edition", "stage"],
        [F.col("run_id").asc(), F.col("rank").asc()],
        k,
        "_r",
    )
    titles = F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"])
    return rows.groupBy("edition", "stage").agg(titles.alias(out))


def lenient_stage_diagnostics(runs: DataFrame, candidates: DataFrame, hours: int = 72) -> DataFrame:
    """The same candidates judged by a wider window, one row per (edition, stage)."""
    keys = ["edition", "stage"]
    has = F.col("start_date").isNotNull()
    dates = runs.filter(F.col("stage").isin(*REFILL_STAGES)).groupBy(*keys).agg(
        F.min_by(F.when(has, F.col("start_date")), F.when(has, F.col("run_id"))).alias("start_date"),
        F.min_by(
            F.col("end_date"), F.when(F.col("end_date").isNotNull(), F.col("run_id"))
        ).alias("end_date"),
        F.sum(F.coalesce("result_count", F.lit(0))).alias("result_count"),
    )
    lenient = yes("lenient_candidate")
    counts = candidates.groupBy(*keys).agg(
        F.count_if(lenient).alias("lenient_candidate_count"),
        F.count_if(lenient & yes("lenient_within_window")).alias("proven_within_window_count"),
        F.count_if(lenient & _missing_date()).alias("missing_date_unproven_count"),
        F.count_if(no("lenient_within_window")).alias("outside_window_rejected_count"),
        F.count_if(lenient & no("ai_title_relevant")).alias("lenient_non_ai_count"),
        F.count_if(lenient & _duplicate_or_cluster()).alias("lenient_duplicate_or_cluster_count"),
    )
    out = dates.join(counts, keys, "left").na.fill(0, [c for c in counts.columns if c not in keys])
    return out.withColumn("window_hours", F.lit(hours))


def lenient_edition_diagnostics(stage_rows: DataFrame) -> DataFrame:
    """Totals over the stages of an edition; dates come from the first stage that has them."""
    order = F.array_position(F.array(*[F.lit(s) for s in REFILL_STAGES]), F.col("stage"))
    sums = [
        "lenient_candidate_count",
        "proven_within_window_count",
        "missing_date_unproven_count",
        "outside_window_rejected_count",
        "lenient_non_ai_count",
        "lenient_duplicate_or_cluster_count",
    ]
    rows = stage_rows.withColumn("_o", order)
    return rows.groupBy("edition").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min_by("start_date", F.when(F.col("start_date").isNotNull(), F.col("_o"))).alias("start_date"),
        F.min_by("end_date", F.when(F.col("end_date").isNotNull(), F.col("_o"))).alias("end_date"),
    )


def failure_totals(runs: DataFrame, stage_rows: DataFrame) -> DataFrame:
    """Network failures, quality rejections and the missing-date rate of an edition."""
    verify = runs.filter("stage = 'verify'").groupBy("edition").agg(
        F.count_if(F.col("request_outcome").isin(*NETWORK_OUTCOMES)).alias("_v")
    )
    quality = sum(
        (
            F.col(c)
            for c in (
                "story_cluster_rejected_count",
                "duplicate_rejected_count",
                "non_ai_rejected_count",
                "outside_window_rejected_count",
            )
        ),
        F.col("near_duplicate_rejected_count"),
    )
    refill = stage_rows.groupBy("edition").agg(
        F.sum("network_failures").alias("_n"),
        F.sum(quality).alias("quality_rejections"),
        F.sum("published_date_missing_count").alias("missing_dates"),
        F.sum("result_count").alias("refill_results"),
    )
    out = refill.join(verify, "edition", "full").na.fill(
        0, ["_n", "_v", "quality_rejections", "missing_dates", "refill_results"]
    )
    return out.select(
        "edition",
        (F.col("_n") + F.col("_v")).alias("network_failures"),
        "quality_rejections",
        "missing_dates",
        N.rate("missing_dates", "refill_results").alias("published_date_missing_rate"),
    )


def diagnosis(reports: DataFrame, totals: DataFrame) -> DataFrame:
    """Primary limiter and contributing factors per edition.

    reports: (edition, report_present, has_enrichment, applied, skip_reason, stop_reason, input_count,
    final_count, total_calls, min_articles, max_total_calls).
    """
    rows = reports.join(totals, "edition", "left").na.fill(
        0, ["network_failures", "quality_rejections", "missing_dates"]
    )
    budget = F.coalesce(F.col("stop_reason").contains("budget_exhausted"), F.lit(False)) | F.coalesce(
        F.col("total_calls") >= F.col("max_total_calls"), F.lit(False)
    )
    empty = F.coalesce("input_count", F.lit(0)) == 0
    skip = text("skip_reason")
    goal = F.coalesce("min_articles", F.lit(0))
    factors = F.array_compact(
        F.array(
            F.when(budget, "budget_exhausted"),
            F.when(F.col("missing_dates") > 0, "published_date_missing"),
            F.when(F.col("quality_rejections") > 0, "candidate_quality_rejections"),
            F.when(F.col("network_failures") > 0, "network_failures"),
            F.when(empty, "source_empty"),
            F.when(skip != "", F.concat(F.lit("skip_reason:"), skip)),
        )
    )
    skip_name = F.when(skip == "", "unknown").otherwise(skip)
    primary = (
        F.when(~F.col("report_present"), "report_json_missing")
        .when(~F.col("has_enrichment"), "enrichment_missing")
        .when(~yes("applied"), F.concat(F.lit("enrichment_not_applied:"), skip_name))
        .when((goal != 0) & (F.coalesce("final_count", F.lit(0)) >= goal), "min_articles_satisfied")
        .when(F.col("network_failures") > 0, "network_failure")
        .when(empty, "source_empty")
        .when(budget, "budget_exhausted")
        .when(F.col("missing_dates") > 0, "metadata_missing")
        .when(F.col("quality_rejections") > 0, "candidate_quality")
        .otherwise("below_min_unresolved")
    )
    out = rows.withColumn("primary_limiter", primary).withColumn("contributing_factors", factors)
    return out.withColumn(
        "needs_fixture",
        ~F.col("primary_limiter").isin("min_articles_satisfied", "enrichment_not_applied:disabled"),
    )


def scorecard(
    reports: DataFrame, runs: DataFrame, candidates: DataFrame, hours: int = 72
) -> DataFrame:
    """One wide row per run artifact, with nested stage summaries."""
    stages = refill_stage_summary(runs, candidates)
    totals = failure_totals(runs, stages)
    lenient = lenient_edition_diagnostics(lenient_stage_diagnostics(runs, candidates, hours))
    fields = [c for c in stages.columns if c not in ("edition", "stage")]
    refill = stages.groupBy("edition").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", F.struct(*fields)))).alias("refill"),
        F.sum("accepted_count").alias("refilled_count"),
    )
    verify = runs.filter("stage = 'verify'").groupBy("edition").agg(
        F.count(F.lit(1)).alias("verify_calls"),
        F.count_if(F.col("validation_outcome") == "accepted").alias("verified_count"),
    )
    out = diagnosis(reports, totals)
    for side in (refill, verify, lenient.drop("start_date", "end_date")):
        out = out.join(side, "edition", "left")
    remaining = F.greatest(F.lit(0), F.coalesce("min_articles", F.lit(0)) - F.coalesce("final_count", F.lit(0)))
    return out.withColumn("remaining", remaining)


# ---- benchmark summaries ------------------------------------------------------------------------


def benchmark_groups(runs: DataFrame) -> DataFrame:
    """One row per (scenario, search_depth); averages skip NULLs and failed runs."""
    ok = text("error") == ""

    def mean(c: str) -> Column:
        return F.round(F.avg(F.when(ok, F.col(c))), 4)

    def share(c: str) -> Column:
        return F.round(F.avg(F.when(ok, F.col(c).cast("int"))), 4)

    out = runs.groupBy("scenario", "search_depth").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        mean("latency_ms").alias("avg_latency_ms"),
        mean("title_similarity").alias("avg_title_similarity"),
        mean("published_date_availability").alias("avg_published_date_availability"),
        mean("new_valid_news_count").alias("avg_new_valid_news_count"),
        mean("duplicate_count").alias("avg_duplicate_count"),
        share("matched").alias("matched_rate"),
        share("same_domain").alias("same_domain_rate"),
        share("within_24h").alias("within_24h_rate"),
    )
    refill = (F.col("scenario") == "refill_topic") & (F.col("success_count") > 0)
    for c in ("avg_new_valid_news_count", "avg_duplicate_count"):
        out = out.withColumn(c, F.when(refill, F.col(c)))
    for c in ("matched_rate", "same_domain_rate", "within_24h_rate"):
        out = out.withColumn(c, F.when(~refill, F.col(c)))
    return out


def valid_domain_frequency(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.filter(yes("valid_new_candidate")).groupBy(*keys, "domain").agg(
        F.count(F.lit(1)).alias("n")
    )


def fuzzy_rescue(runs: DataFrame) -> DataFrame:
    """Samples that only the fuzzy scenario matched. The last run of a scenario counts."""
    key = F.concat_ws("::", "scenario", "search_depth")
    rows = runs.filter("scenario in ('verify_exact', 'verify_fuzzy')").withColumn("_k", key)

    def last(k: str, value: Column) -> Column:
        return F.max_by(value, F.when(F.col("_k") == k, F.col("run_no")))

    hit = yes("matched")
    out = rows.groupBy("sample_id").agg(
        last("verify_fuzzy::advanced", F.struct(hit.alias("m"), text("error").alias("e"))).alias("fuzzy"),
        last("verify_exact::basic", hit).alias("basic"),
        last("verify_exact::advanced", hit).alias("advanced"),
    )
    rescued = (
        F.col("fuzzy.m") & (F.col("fuzzy.e") == "") & ~yes("basic") & ~yes("advanced")
    )
    return out.filter(rescued).select("sample_id")


def evaluate_results(
    runs: DataFrame, results: DataFrame, existing: DataFrame, topic: str = "benchmark"
) -> DataFrame:
    """Per-run metrics of search results against the articles of the edition.

    runs: (run_id, edition, error); results: (run_id, edition, rank, title, url, published_date,
    within_24h); existing: (edition, title, url). Failed runs keep a row with empty metrics.
    """
    from tidewire.functions.text import normalize_title_search

    flagged = flag_existing(results, existing).withColumn("_n", normalize_title_search("title"))
    flagged = within_result_duplicates(flagged, "_n", ["run_id"]).drop("_n")
    ai = A.ai_topic("title", topic)
    duplicate = F.col("duplicate_existing") | F.col("duplicate_within_results")
    valid = yes("within_24h") & ai & ~duplicate
    stats = flagged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(text("published_date") != "").alias("_dated"),
        F.count_if(yes("within_24h")).alias("within_24h_count"),
        F.count_if(ai).alias("ai_title_count"),
        F.count_if("duplicate_existing").alias("duplicate_existing_count"),
        F.count_if(duplicate).alias("duplicate_count"),
        F.count_if(valid).alias("valid_count"),
    )
    ok = text("error") == ""
    out = runs.join(stats, "run_id", "left")
    counts = ["result_count", "_dated", "within_24h_count", "ai_title_count", "duplicate_existing_count", "duplicate_count", "valid_count"]
    out = out.na.fill(0, counts)
    for c in counts:
        out = out.withColumn(c, F.when(ok, F.col(c)).otherwise(0))
    return (
        out.withColumn("published_date_availability", N.rate("_dated", "result_count"))
        .withColumn("within_24h_rate", N.rate("within_24h_count", "result_count"))
        .withColumn("ai_title_rate", N.rate("ai_title_count", "result_count"))
        .withColumn("duplicate_existing_rate", N.rate("duplicate_existing_count", "result_count"))
        .withColumn("valid_rate", N.rate("valid_count", "result_count"))
        .drop("_dated")
    )


def domain_summary(
    runs: DataFrame, candidates: DataFrame, domains: DataFrame, observed: DataFrame, seen_domains: DataFrame
) -> DataFrame:
    """One row per benchmarked domain.

    runs: (domain, run_no, error, latency_ms, result_count, ..., unique_valid_count); candidates:
    (domain, run_no, rank, title, unique_valid_candidate); domains: (domain, label, family,
    source_key, configured_source_enabled); observed: (source_key, n); seen_domains: (domain).
    """
    ok = text("error") == ""

    def mean(c: str) -> Column:
        return F.round(F.avg(F.when(ok, F.col(c))), 4)

    stats = runs.groupBy("domain").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        mean("latency_ms").alias("avg_latency_ms"),
        mean("result_count").alias("avg_result_count"),
        mean("published_date_availability").alias("avg_published_date_availability"),
        mean("within_24h_rate").alias("avg_within_24h_rate"),
        mean("ai_title_rate").alias("avg_ai_title_rate"),
        mean("duplicate_existing_count").alias("avg_duplicate_existing_count"),
        mean("unique_valid_count").alias("avg_unique_valid_count"),
        F.sum(F.when(ok, F.col("unique_valid_count")).otherwise(0)).alias("total_unique_valid_count"),
    )
    good = runs.filter(ok).select("domain", "run_no")
    titles = (
        candidates.filter(yes("unique_valid_candidate") & (text("title") != ""))
        .join(good, ["domain", "run_no"], "left_semi")
        .groupBy("domain", "title")
        .agg(F.min(F.struct("run_no", "rank")).alias("o"))
    )
    samples = top_k(titles, ["domain"], [F.col("o").asc()], 5, "_r").groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("sample_titles")
    )
    out = (
        domains.join(stats, "domain", "left")
        .join(samples, "domain", "left")
        .join(observed.select("source_key", F.col("n").alias("observed_recent_articles")), "source_key", "left")
        .join(seen_domains.select(F.lower("domain").alias("domain")).distinct().withColumn("_s", F.lit(True)), "domain", "left")
    )
    return (
        out.na.fill(0, ["run_count", "success_count", "failure_count", "total_unique_valid_count", "observed_recent_articles"])
        .withColumn("appeared_before", F.coalesce("_s", F.lit(False)))
        .withColumn("sample_titles", F.coalesce("sample_titles", F.array().cast("array<string>")))
        .drop("_s")
    )


# ---- counters of one edition --------------------------------------------------------------------


def enrichment_counters(
    calls: DataFrame, queue: DataFrame, stories: DataFrame, unresolved: DataFrame,
    rounds: int = 2, budget: int = 30, provider: str = "tavily",
) -> DataFrame:
    """Calls by kind, processed, resolved, unresolved and the stop reason.

    calls: (edition, pos, round, outcome, candidate_kind).
    """
    by_call = calls.groupBy("edition").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("candidate_kind") == "lead").alias("lead_calls"),
        F.count_if(F.col("candidate_kind") == "story").alias("story_calls"),
        F.count_distinct("pos").alias("processed_count"),
        F.max(F.when(F.col("outcome").isin(*A.TERMINAL_OUTCOMES), F.col("outcome"))).alias("terminal"),
    )
    resolved = stories.groupBy("edition").agg(
        F.count(F.lit(1)).alias("final_count"),
        F.count_if(A.prov("resolution_stage") == f"{provider}_lead_resolution").alias("lead_resolved_count"),
    )
    out = queue.groupBy("edition").agg(F.count(F.lit(1)).alias("queue_count"))
    out = (
        out.join(by_call, "edition", "left")
        .join(resolved, "edition", "left")
        .join(unresolved.groupBy("edition").agg(F.count(F.lit(1)).alias("lead_unresolved_count")), "edition", "left")
    )
    out = out.na.fill(
        0, ["calls", "lead_calls", "story_calls", "processed_count", "final_count", "lead_resolved_count", "lead_unresolved_count"]
    )
    stop = (
        F.when(F.col("terminal").isNotNull(), F.concat(F.lit("candidate_enrichment_"), F.col("terminal")))
        .when(
            (F.col("calls") < F.col("queue_count") * rounds) & (F.col("calls") >= budget), "budget_exhausted"
        )
        .otherwise("candidate_queue_exhausted")
    )
    return out.withColumn("stop_reason", stop).drop("terminal")


def channel_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("edition", "channel").agg(F.count(F.lit(1)).alias("n"))


def link_host_counts(df: DataFrame, markdown: str, keys: list[str]) -> DataFrame:
    """Links per host in Markdown text."""
    links = F.regexp_extract_all(text(markdown), F.lit(r"""https?://[^\s<>()\[\]{}"']+"""), F.lit(0))
    rows = df.select(*keys, F.explode(links).alias("url")).withColumn("host", url_host("url"))
    return rows.filter("host <> ''").groupBy(*keys, "host").agg(F.count(F.lit(1)).alias("n"))


def schema_keys(df: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """Distinct top-level JSON keys seen per group."""
    rows = df.select(*keys, F.explode(F.json_object_keys(document)).alias("key"))
    return rows.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n"))


def length_audit(items: DataFrame) -> DataFrame:
    """items: (edition, article_id, summary)."""
    n = visible_chars("summary")
    outside = ~n.between(R.TARGET_MIN, R.TARGET_MAX)
    broken = F.size(R.reader_issues("summary")) > 0
    out = items.groupBy("edition").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(outside).alias("outside_preferred_count"),
        F.count_if(broken).alias("format_violation_count"),
    )
    return out.withColumn("preferred_target_met", F.col("outside_preferred_count") == 0).withColumn(
        "qualified", F.col("format_violation_count") == 0
    )


def rejection_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("edition", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


def replay_summary(facts: DataFrame, min_articles: int, max_total_calls: int, official: bool = False) -> DataFrame:
    """Stage funnel of a replayed edition with its stop reason.

    facts: (edition, raw_count, prefiltered_count, verify_calls, verified_count, priority_calls,
    priority_count, secondary_calls, secondary_count, official_calls, official_count).
    A later stage counts only while budget and need remain.
    """
    used1 = F.col("verify_calls") + F.col("priority_calls")
    final1 = F.col("verified_count") + F.col("priority_count")
    rows = facts.withColumn("_u1", used1).withColumn("_f1", final1)
    go2 = (F.col("_u1") < max_total_calls) & (F.col("_f1") < min_articles)
    rows = rows.withColumn("_go2", go2)
    rows = rows.withColumn("_c2", F.when(F.col("_go2"), F.col("secondary_calls")).otherwise(0)).withColumn(
        "_n2", F.when(F.col("_go2"), F.col("secondary_count")).otherwise(0)
    )
    rows = rows.withColumn("_u2", F.col("_u1") + F.col("_c2")).withColumn("_f2", F.col("_f1") + F.col("_n2"))
    left2 = F.col("_u2") < max_total_calls
    short2 = F.col("_f2") < min_articles
    go3 = left2 & short2 if official else F.lit(False)
    rows = rows.withColumn("_go3", go3)
    calls3 = F.when(F.col("_go3"), F.col("official_calls")).otherwise(0)
    count3 = F.when(F.col("_go3"), F.col("official_count")).otherwise(0)
    ran2 = F.col("_c2") > 0
    rows = rows.withColumn("total_calls", F.col("_u2") + calls3).withColumn("final_count", F.col("_f2") + count3)
    stop = (
        F.when(
            F.col("_go3") & (F.col("total_calls") >= max_total_calls) & (F.col("final_count") < min_articles),
            "budget_exhausted_after_official_fallback",
        )
        .when(F.col("_go3"), "official_fallback_complete")
        .when(~left2 & short2 & ran2, "budget_exhausted_after_secondary_refill")
        .when(~left2 & short2, "budget_exhausted_after_priority_refill")
    )
    if not official:
        stop = stop.when(short2, "official_fallback_disabled")
    stop = stop.when(ran2, "secondary_refill_complete").otherwise("priority_refill_complete")
    return rows.select(
        "edition",
        "raw_count",
        "prefiltered_count",
        "verified_count",
        "priority_count",
        F.col("_n2").alias("secondary_count"),
        count3.alias("official_count"),
        "total_calls",
        "final_count",
        stop.alias("stop_reason"),
    )


def candidate_goal(articles: DataFrame, source_runs: DataFrame, minimum: int = 10, maximum: int = 20, request_cap: int = 5) -> DataFrame:
    """Did the edition collect enough candidates within the request budget?"""
    have = articles.groupBy("edition").agg(F.count(F.lit(1)).alias("actual"))
    used = source_runs.groupBy("edition").agg(F.sum("network_requests").alias("network_requests"))
    out = used.join(have, "edition", "left").na.fill(0, ["actual"])
    return (
        out.withColumn("minimum_met", F.col("actual") >= minimum)
        .withColumn("max_met", F.col("actual") == maximum)
        .withColumn("within_request_cap", F.col("network_requests") <= request_cap)
    )


def verify_samples(articles: DataFrame, n: int, selectors: list[tuple[str, tuple[str, ...], str | None]]) -> DataFrame:
    """Newest-first sample per selector, then the newest other links. Links are never repeated.

    There are at most `n` rows, so the selectors run one after the other on distributed top-1s.
    """
    order = [F.col("edition").desc(), F.col("pos").asc()]
    rows = articles.filter(text("link") != "")
    picked: DataFrame | None = None

    def unseen(df: DataFrame) -> DataFrame:
        return df if picked is None else df.join(picked.select("link"), "link", "left_anti")

    columns = ["edition", "pos", "source", "title", "link"]
    for name, needles, source in selectors[:n]:
        padded = F.concat(F.lit(" "), F.lower(text("title")), F.lit(" "))
        hit = F.lit(False)
        for needle in needles:
            hit = hit | padded.contains(needle)
        pool = rows.filter(hit) if source is None else rows.filter(hit & (F.col("source") == source))
        one = unseen(pool).orderBy(*order).limit(1).select(*columns, F.lit(name).alias("selection_reason"))
        picked = one if picked is None else picked.unionByName(one)
    # one row per link, newest first
    best = unseen(rows).groupBy("link").agg(F.min(F.struct((-F.unix_date("edition")).alias("d"), "pos")).alias("o"))
    rest = unseen(rows).join(best, "link").filter(
        (F.col("o.d") == -F.unix_date("edition")) & (F.col("o.pos") == F.col("pos"))
    )
    rest = rest.orderBy(*order).limit(n).select(*columns, F.lit("fallback_recent_article").alias("selection_reason"))
    every = rest if picked is None else picked.unionByName(rest)
    first = (F.col("selection_reason") == "fallback_recent_article").cast("int")
    return every.orderBy(first, *order).limit(n)


def retention_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("edition").agg(F.count(F.lit(1)).alias("n"))


