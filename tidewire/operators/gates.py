"""Row-level gates between discovery leads and publishable stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import dates as D
from tidewire.functions.text import compact_text, strip, text
from tidewire.functions.urls import domain_of
from tidewire.operators.catalog import Catalog, bucket_rank, prefilter_bucket, title_relevance
from tidewire.settings import EnrichSettings, GateSettings


def route_for_publication(df: DataFrame, gates: GateSettings = GateSettings()) -> DataFrame:
    """Add reasons and a route: story, lead or rejected. A titled failure becomes a lead."""
    routed = df.withColumn("reasons", A.publishability_reasons(gates))
    known_lead = F.array_contains("reasons", "unresolved_lead")
    titled = compact_text("title") != ""
    route = (
        F.when(F.size("reasons") == 0, "story")
        .when(known_lead | titled, "lead")
        .otherwise("rejected")
    )
    rewritten = (F.col("route") == "lead") & ~F.array_contains("reasons", "unresolved_lead")
    routed = routed.withColumn("route", route)
    for name, value in (("kind", "lead"), ("evidence_status", "unresolved"), ("confidence", "signal")):
        routed = routed.withColumn(name, F.when(rewritten, value).otherwise(F.col(name)))
    return routed


def partition_for_publication(
    df: DataFrame, gates: GateSettings = GateSettings()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stories, leads, rejected records)."""
    routed = route_for_publication(df, gates)
    stories = routed.filter("route = 'story'").drop("route", "reasons")
    leads = routed.filter("route = 'lead'").drop("route", "reasons")
    rejected = routed.filter("route = 'rejected'").select(
        "edition",
        "pos",
        compact_text("title").alias("title"),
        compact_text("source").alias("source"),
        "reasons",
    )
    return stories, leads, rejected


def observation_signals(leads: DataFrame, reason) -> DataFrame:
    return leads.select(
        "edition",
        "pos",
        compact_text("title").alias("title"),
        compact_text("source").alias("source"),
        compact_text("link").alias("signal_url"),
        reason.alias("reason"),
    )


def unresolved_lead_signals(leads: DataFrame, calls: DataFrame, deadline_hit: DataFrame) -> DataFrame:
    """Reason per lead without evidence; calls carry (edition, pos, title, outcome)."""
    mine = calls.groupBy("edition", "pos").agg(F.count(F.lit(1)).alias("_calls"))
    # a failed request counts for every lead of the same title
    failed = (
        calls.filter("outcome <> 'success'")
        .select("edition", compact_text("title").alias("_title"))
        .distinct()
        .withColumn("_failed", F.lit(True))
    )
    joined = (
        leads.withColumn("_title", compact_text("title"))
        .join(mine, ["edition", "pos"], "left")
        .join(failed, ["edition", "_title"], "left")
        .join(deadline_hit.select("edition", F.lit(True).alias("_deadline")), "edition", "left")
    )
    idle = F.col("_calls").isNull()
    reason = (
        F.when(F.col("_deadline") & idle, "enrichment_deadline_exceeded")
        .when(idle, "candidate_budget_exhausted")
        .when(F.col("_failed"), "lead_resolution_request_failed")
        .otherwise("no_publishable_evidence")
    )
    return observation_signals(joined, reason)


def prefilter(
    df: DataFrame, catalog: Catalog, legacy: bool = False, gates: GateSettings = GateSettings()
) -> DataFrame:
    """Add bucket, relevance flags, exclude reasons and the bucket rank of the verify order."""
    rows = title_relevance(df.withColumn("title", strip("title")), catalog, "title", "_ta")
    relevant = F.col("_ta")["relevance"] >= 2
    bucket = prefilter_bucket("_ta")
    rows = (
        rows.withColumn("core_ai_relevant", relevant)
        .withColumn("prefilter_bucket", bucket)
        .withColumn("ai_relevant", F.col("prefilter_bucket") != "generic_or_low_signal")
        .withColumn("aggregate_like", A.is_aggregate_like(gates))
    )
    reasons = [
        F.when(F.col("title") == "", "missing_title"),
        F.when(strip("link") == "", "missing_link"),
        F.when(F.col("aggregate_like"), "aggregate_like"),
    ]
    if legacy:
        reasons.append(F.when(~F.col("core_ai_relevant"), "non_ai_relevant"))
    return (
        rows.withColumn("exclude_reasons", F.array_compact(F.array(*reasons)))
        .withColumn("included", F.size("exclude_reasons") == 0)
        .withColumn("bucket_rank", bucket_rank("prefilter_bucket"))
        .drop("_ta")
    )


def gate_evidence(results: DataFrame, settings: EnrichSettings, reference: str = "reference_ts") -> DataFrame:
    """Search results that count as evidence, in evidence shape. `url`, dates and score come along."""
    rows = results.withColumn("_url", compact_text("url")).withColumn(
        "_date", compact_text("published_date")
    )
    rows = rows.withColumn("_snip", compact_text("content")).withColumn("_raw", compact_text("raw_content"))
    rows = rows.withColumn(
        "_text", A.join_evidence(F.col("_snip"), F.col("_raw"), settings.evidence_chars)
    )
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    inside = D.within_hours(D.parse_published("_date"), reference, settings.max_age_hours)
    ok = (
        A.is_direct_evidence_url("_url")
        & F.coalesce(inside, F.lit(False))
        & (F.length("_text") >= settings.min_evidence_chars)
        & (score >= settings.min_score)
    )
    evidence = F.struct(
        compact_text("title").alias("title"),
        F.col("_url").alias("url"),
        domain_of("_url").alias("domain"),
        F.col("_date").alias("published_date"),
        F.col("_text").alias("text"),
        F.col("_text").alias("snippet"),
        score.alias("score"),
        F.lit(settings.provider).alias("origin"),
    )
    return rows.withColumn("evidence_item", evidence).withColumn(
        "evidence_ok", F.coalesce(ok, F.lit(False))
    ).drop("_url", "_date", "_snip", "_raw", "_text")


def source_text(*names: str):
    return F.concat_ws(" ", *[text(n) for n in names])
