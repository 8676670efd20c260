"""The edition job: from landed articles to published items, for all editions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.operators import dedupe as Dd
from tidewire.operators import digest as Dg
from tidewire.operators import evidence as Ev
from tidewire.operators import gates as G
from tidewire.operators import metrics as M
from tidewire.operators import ranking as Rk
from tidewire.operators import selection as Sel
from tidewire.operators import validate as V
from tidewire.operators.catalog import Catalog
from tidewire.schema import conform_articles
from tidewire.settings import EnrichSettings, GateSettings, SelectSettings
from tidewire.workspace import Rounds


@dataclass
class Enriched:
    stories: DataFrame
    unresolved: DataFrame
    dropped: DataFrame
    rejected: DataFrame
    calls: DataFrame
    counters: DataFrame


def fail_open(df: DataFrame, reason: str, gates: GateSettings = GateSettings()) -> tuple[DataFrame, DataFrame]:
    """(direct stories, leads as private signals) when enrichment is skipped or fails."""
    stories, leads, _ = G.partition_for_publication(df, gates)
    return stories, G.observation_signals(leads, F.lit(reason))


def enrich_edition(
    df: DataFrame,
    results: DataFrame,
    outcomes: DataFrame,
    catalog: Catalog,
    settings: EnrichSettings = EnrichSettings(),
    gates: GateSettings = GateSettings(),
) -> Enriched:
    """Gate, queue, cap, breadth-first evidence, resolve or enrich, gate again.

    results: search results per (edition, pos, round, rank); outcomes: (edition, pos, round, outcome).
    """
    work = Rounds(df.sparkSession, "enrich")
    routed = work.save(G.route_for_publication(df, gates), "routed")
    candidates = routed.filter("route in ('story', 'lead')").withColumn("_late", F.col("route") == "lead")
    candidates = candidates.drop("reasons", "route")
    # stories come before leads in the input order of the queue
    shifted = candidates.withColumn("_pos", F.col("pos"))
    span = F.lit(1 << 40)
    shifted = shifted.withColumn("pos", F.when(F.col("_late"), F.col("pos") + span).otherwise(F.col("pos")))
    cap = max(0, settings.max_total_calls)
    queue = work.save(
        Ev.prepare_queue(shifted.drop("_late"), catalog, cap).withColumn("pos", F.col("_pos")).drop("_pos"), "queue"
    )
    dropped = candidates.join(queue.select("edition", "pos"), ["edition", "pos"], "left_anti")
    calls = Rk.call_plan(queue, outcomes, settings.rounds, cap)
    kinds = queue.select("edition", "pos", "title", F.when(A.is_lead(gates), "lead").otherwise("story").alias("candidate_kind"))
    calls = work.save(calls.join(kinds, ["edition", "pos"]), "calls")
    served = results.join(
        calls.filter("outcome = 'success'").select("edition", "pos", "round"), ["edition", "pos", "round"], "left_semi"
    )
    decisions = work.save(Ev.match_evidence(queue, served, catalog, settings), "decisions")
    evidence = decisions.filter("accepted")
    leads = queue.filter(A.is_lead(gates))
    direct = queue.filter(~A.is_lead(gates))
    resolved = Ev.resolve_stories(leads, evidence, settings)
    enriched = Ev.enrich_stories(direct, evidence, settings)
    together = conform_articles(resolved).unionByName(conform_articles(enriched))
    # input position is kept for joins; the queue position is the new order
    together = together.join(queue.select("edition", "pos", "queue_pos"), ["edition", "pos"])
    final = work.save(G.route_for_publication(together, gates), "final")
    stories = final.filter("route = 'story'").drop("reasons", "route")
    silent = leads.join(evidence.select("edition", "pos").distinct(), ["edition", "pos"], "left_anti")
    deadline = calls.filter("outcome = 'deadline_exceeded'").select("edition").distinct()
    unresolved = G.unresolved_lead_signals(silent, calls, deadline)
    rejected = routed.filter("route = 'rejected'").select("edition", "pos", "title", "source", "reasons").unionByName(
        final.filter("route <> 'story'").select("edition", "pos", "title", "source", "reasons")
    )
    return Enriched(
        stories,
        unresolved,
        G.observation_signals(dropped, F.lit("candidate_daily_budget_cap")),
        rejected,
        calls,
        M.enrichment_counters(calls, queue, stories, unresolved, settings.rounds, cap, settings.provider),
    )


def offline_digest(
    articles: DataFrame, catalog: Catalog, select: SelectSettings = SelectSettings()
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(items, errors, selection)."""
    selection = Sel.select_v2(articles, catalog, select)
    items, errors = Dg.offline_items(selection["selected"])
    return items, errors, selection


def build_edition(
    articles: DataFrame,
    source_runs: DataFrame,
    history: DataFrame,
    results: DataFrame,
    outcomes: DataFrame,
    catalog: Catalog,
    enrich: EnrichSettings = EnrichSettings(),
    select: SelectSettings = SelectSettings(),
) -> dict[str, DataFrame]:
    """Dedupe, enrich, cross-day filter, select, digest, diagnose and gate."""
    work = Rounds(articles.sparkSession, "edition")
    kept, duplicates = Dd.dedupe_stories(conform_articles(articles))
    # read only where they are routed, and written there
    enriched = enrich_edition(kept, results, outcomes, catalog, enrich)
    ordered = enriched.stories.withColumn("pos", F.col("queue_pos")).drop("queue_pos")
    fresh, repeated, _ = Dd.recent_exact_antijoin(ordered, history)
    fresh = work.save(fresh, "fresh")
    items, errors, selection = offline_digest(fresh, catalog, select)
    items = work.save(items, "items")
    none = enriched.calls.select("edition").limit(0)
    reports = none.select("edition", F.lit("").alias("skip_reason"), F.lit("").alias("terminal_error_code"))
    runs = enriched.calls.select(
        "edition", F.lit("candidate_enrichment").alias("stage"), F.col("outcome").alias("request_outcome")
    )
    failures = M.stage_failures(runs, reports)
    attempts = none.select("edition", F.lit("").alias("provider"), F.lit("").alias("status"), F.lit("").alias("error_kind"))
    diagnostics = M.pipeline_diagnostics(source_runs, failures, attempts)
    wanted = articles.select("edition").distinct()
    counts = fresh.groupBy("edition").agg(F.count(F.lit(1)).alias("articles_count"))
    broken = errors.select("edition").distinct().withColumn("_bad", F.lit(True))
    gate_in = (
        wanted.join(counts, "edition", "left")
        .join(broken, "edition", "left")
        .select(
            "edition",
            F.coalesce("articles_count", F.lit(0)).alias("articles_count"),
            F.col("_bad").isNull().alias("summary_succeeded"),
            F.lit(True).alias("build_succeeded"),
        )
    )
    # an edition without stories is publishable
    decisions = V.publication_gate(gate_in, source_runs, allow_empty=True)
    refs = fresh.withColumn("article_id", F.concat(F.lit("a"), F.col("pos")))
    return {
        "items": items,
        "errors": errors,
        "articles": fresh,
        "duplicates": duplicates,
        "repeated": repeated,
        "unresolved": enriched.unresolved,
        "counters": enriched.counters,
        "selection_counts": selection["counts"],
        "diagnostics": diagnostics,
        "decisions": decisions,
        "attribution": Dg.source_attribution(items, refs),
    }
