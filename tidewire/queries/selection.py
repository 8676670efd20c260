"""Orders, queues, budgets and shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.operators import catalog as Cat
from tidewire.operators import evidence as Ev
from tidewire.operators import metrics as M
from tidewire.operators import ranking as Rk
from tidewire.operators import selection as Sel
from tidewire.plans.edition import offline_digest
from tidewire.queries import sqltext as S
from tidewire.queries import views as V
from tidewire.queries.registry import query
from tidewire.queries.stories import ANA
from tidewire.settings import EnrichSettings, SelectSettings
from tidewire.workspace import save_once


def analysed(spark, sf):
    return Cat.analyze_articles(V.articles(spark, sf), V.CATALOG)


@query("priority_order", f"WITH {V.DOC} SELECT edition, pos, row_number() OVER (PARTITION BY edition ORDER BY priority DESC, pos) AS rank FROM doc")
def priority_order(spark, sf):
    rows = V.doc_articles(spark, sf).select("edition", "pos", "priority")
    return Rk.global_rank(rows, ["edition"], Rk.priority_order()).select("edition", "pos", "rank")


@query(
    "base_order_v1",
    f"""WITH {V.ART} SELECT edition, pos, row_number() OVER (PARTITION BY edition ORDER BY priority DESC, regexp_matches(lower(title || chr(10) || description), '(^|[^a-z])(ai|llm)([^a-z]|$)|openai|anthropic|claude|gemini|gpt|xai|deepseek|qwen|kimi|grok|copilot|agentic|neural|inference|robot|artificial intelligence|machine learning') DESC, trend_rank, trend_heat DESC, pos) AS rank FROM art""",
)
def base_order_v1(spark, sf):
    return Rk.global_rank(V.articles(spark, sf), ["edition"], Rk.base_order_v1()).select("edition", "pos", "rank")


@query(
    "base_order_v2",
    f"WITH {V.ART}, {ANA} SELECT edition, pos, row_number() OVER (PARTITION BY edition ORDER BY rel DESC, priority DESC, trend_rank, trend_heat DESC, pos) AS rank FROM ana",
)
def base_order_v2(spark, sf):
    return Rk.global_rank(analysed(spark, sf), ["edition"], Rk.base_order_v2()).select("edition", "pos", "rank")


@query("lead_order", f"WITH {V.ART}, {ANA} SELECT edition, pos, row_number() OVER (PARTITION BY edition ORDER BY rel DESC, priority DESC, trend_rank, pos) AS rank FROM ana WHERE kind = 'lead'")
def lead_order(spark, sf):
    rows = analysed(spark, sf).filter("kind = 'lead'")
    return Rk.global_rank(rows, ["edition"], Rk.lead_order()).select("edition", "pos", "rank")


QUEUE = f"""{ANA}, q1 AS (SELECT *, CASE WHEN primary_entity <> '' THEN primary_entity ELSE '~' || pos END AS bucket, row_number() OVER (PARTITION BY edition ORDER BY rel DESC, priority DESC, coalesce(epoch_us(published), 0) DESC, trend_rank, pos) AS r FROM ana),
q2 AS (SELECT *, row_number() OVER (PARTITION BY edition, bucket ORDER BY r) AS turn, min(r) OVER (PARTITION BY edition, bucket) AS first FROM q1),
queue AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY turn, first) AS queue_pos FROM q2)"""


@query("candidate_queue", f"WITH {V.ART}, {QUEUE} SELECT edition, pos, queue_pos FROM queue")
def candidate_queue(spark, sf):
    return Rk.candidate_queue(analysed(spark, sf)).select("edition", "pos", "queue_pos")


@query("admission_cap", f"WITH {V.ART}, {QUEUE} SELECT edition, pos, CASE WHEN queue_pos <= 20 THEN queue_pos END AS queue_pos, CASE WHEN queue_pos <= 20 THEN '' ELSE 'candidate_daily_budget_cap' END AS reason FROM queue")
def admission_cap(spark, sf):
    admitted, dropped = Rk.admission_split(analysed(spark, sf), cap=20)
    return admitted.select("edition", "pos", "queue_pos", F.lit("").alias("reason")).unionByName(
        dropped.select("edition", "pos", F.lit(None).cast("long").alias("queue_pos"), "reason")
    )


_OUTCOME = "CASE WHEN (pos * 7 + round) % 23 = 0 THEN 'timeout' WHEN day(edition) % 3 = 0 AND (pos + round) % 19 = 0 THEN 'rate_limited' ELSE 'success' END"


@query(
    "call_plan",
    f"""WITH {V.ART}, {QUEUE}, c AS (SELECT edition, pos, queue_pos, unnest([1, 2]) AS round FROM queue WHERE queue_pos <= 20), o AS (SELECT *, {_OUTCOME} AS outcome, row_number() OVER (PARTITION BY edition ORDER BY round, queue_pos) AS call_no FROM c),
 s AS (SELECT *, coalesce(max(outcome = 'rate_limited') OVER (PARTITION BY edition ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM o)
 SELECT edition, pos, round, call_no, outcome FROM s WHERE call_no <= 33 AND NOT stopped""",
)
def call_plan(spark, sf):
    queue = Rk.candidate_queue(analysed(spark, sf), cap=20).select("edition", "pos", "queue_pos")
    out = Rk.call_plan(queue, outcomes(queue), 2, 33)
    return out.select("edition", "pos", "round", "call_no", "outcome")


def outcomes(rows):
    """Request outcomes of both rounds, by position."""
    both = rows.select("edition", "pos", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    slow = (F.col("pos") * 7 + F.col("round")) % 23 == 0
    limited = (F.dayofmonth("edition") % 3 == 0) & ((F.col("pos") + F.col("round")) % 19 == 0)
    return both.withColumn("outcome", F.when(slow, "timeout").when(limited, "rate_limited").otherwise("success"))


@query(
    "verify_budget_split",
    f"WITH {V.DOC} SELECT edition, pos, r <= 11 AS verify FROM (SELECT edition, pos, row_number() OVER (PARTITION BY edition ORDER BY priority DESC, pos) AS r FROM doc)",
)
def verify_budget_split(spark, sf):
    settings = EnrichSettings(max_total_calls=15, max_verify_calls=20, max_refill_rounds=2, min_articles=8)
    rows = V.doc_articles(spark, sf).select("edition", "pos", "priority")
    verify, rest = Rk.verify_budget_split(rows, settings, Rk.priority_order())
    return verify.select("edition", "pos", F.lit(True).alias("verify")).union(rest.select("edition", "pos", F.lit(False)))


@query(
    "first_per_source",
    f"""WITH {V.DOC}, f AS (SELECT *, row_number() OVER (PARTITION BY edition, source ORDER BY priority DESC, pos) AS r, count(*) OVER (PARTITION BY edition) AS n FROM doc)
 SELECT edition, source AS source_group, pos, CAST(least(10, n) AS INTEGER) AS target, CAST(greatest(1, floor(least(10, n) * 0.6)) AS INTEGER) AS source_cap FROM f WHERE r = 1""",
)
def first_per_source(spark, sf):
    rows = V.doc_articles(spark, sf).withColumn("source_group", A.source_group())
    return Rk.first_per_source(rows, Rk.priority_order()).select("edition", "source_group", "pos", "target", "source_cap")


@query(
    "sample_titles",
    f"WITH {V.DOC} SELECT edition, string_agg(title, '|' ORDER BY r) AS titles FROM (SELECT edition, title, row_number() OVER (PARTITION BY edition ORDER BY pos) AS r FROM doc WHERE title <> '') WHERE r <= 3 GROUP BY edition",
)
def sample_titles(spark, sf):
    out = Rk.sample_per_edition(V.doc_articles(spark, sf), "title", [F.col("pos").asc()], 3)
    return out.select("edition", F.array_join("sample", "|").alias("titles"))


@query(
    "within_result_duplicates",
    f"WITH {V.DOC}, n AS (SELECT edition, source, pos, {S.search_title('title')} AS t FROM doc) SELECT edition, source, pos, row_number() OVER (PARTITION BY edition, source, t ORDER BY pos) > 1 AS duplicate_within_results FROM n",
)
def within_result_duplicates(spark, sf):
    from tidewire.functions.text import normalize_title_search

    rows = V.doc_articles(spark, sf).select("edition", "source", "pos", normalize_title_search("title").alias("t"))
    return Rk.within_result_duplicates(rows, "t", ["edition", "source"], "pos").select("edition", "source", "pos", "duplicate_within_results")


@query(
    "select_report_dates",
    f"WITH {V.DOC}, w AS (SELECT CAST(DATE '2024-01-22' + CAST(i AS INTEGER) AS DATE) AS edition FROM range(12) t(i)) SELECT edition, EXISTS (SELECT 1 FROM doc WHERE doc.edition = w.edition) AS found FROM w",
)
def select_report_dates(spark, sf):
    wanted = spark.range(12).select(F.date_add(F.lit("2024-01-22").cast("date"), F.col("id").cast("int")).alias("edition"))
    have, missing = Rk.select_editions(V.doc_articles(spark, sf), wanted)
    return have.withColumn("found", F.lit(True)).union(missing.withColumn("found", F.lit(False)))


@query("latest_manifest", f"WITH {V.EV} SELECT user_id, max(event_id) AS event_id FROM ev GROUP BY user_id")
def latest_manifest(spark, sf):
    rows = V.events(spark, sf).select("user_id", "event_id", "event_type", "ts")
    return Rk.latest_runs(rows, "user_id", "event_id").select("user_id", "event_id")


@query("verify_samples")
def verify_samples(spark, sf):
    picks = [("than_case", ("than",), None), ("que_case", ("que", "el"), "src3"), ("der_case", (" der ",), None)]
    return M.verify_samples(V.doc_articles(spark, sf), 6, picks).select("edition", "pos", "source", "link", "selection_reason")


@query(
    "one_lead_per_entity",
    f"""WITH {V.ART}, {ANA}, l AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY rel DESC, priority DESC, trend_rank, pos) AS r, CASE WHEN primary_entity <> '' THEN primary_entity ELSE '~' || pos END AS e FROM ana),
 f AS (SELECT *, row_number() OVER (PARTITION BY edition, e ORDER BY r) AS er FROM l), s AS (SELECT edition, pos, e, row_number() OVER (PARTITION BY edition ORDER BY r) AS lead_index FROM f WHERE er = 1)
 SELECT l.edition, l.pos, CASE WHEN s.lead_index <= 4 THEN s.lead_index END AS lead_index, CASE WHEN s.lead_index <= 4 THEN '' WHEN EXISTS (SELECT 1 FROM s x WHERE x.edition = l.edition AND x.e = l.e AND x.lead_index <= 4) THEN 'lead_duplicate_entity' ELSE 'lead_candidate_limit' END AS reason
 FROM l LEFT JOIN s ON s.edition = l.edition AND s.pos = l.pos""",
)
def one_lead_per_entity(spark, sf):
    selected, deferred = Ev.one_lead_per_entity(analysed(spark, sf), 4)
    return selected.select("edition", "pos", F.col("lead_index").cast("long").alias("lead_index"), F.lit("").alias("reason")).unionByName(
        deferred.select("edition", "pos", F.lit(None).cast("long").alias("lead_index"), "reason")
    )


@query("select_v1")
def select_v1(spark, sf):
    return Sel.select_v1(V.articles(spark, sf)).select("edition", "pos", "selected_rank")


@query("select_v2")
def select_v2(spark, sf):
    out = Sel.select_v2(V.articles(spark, sf), V.CATALOG)
    return out["selected"].select("edition", "pos", "selected_rank", "source_group", F.col("analysis.topic").alias("topic"))


@query("selection_diagnostics")
def selection_diagnostics(spark, sf):
    out = Sel.select_v2(V.articles(spark, sf), V.CATALOG)
    return Sel.selection_counts(save_once(out["selected"], "selected"))


@query("offline_digest")
def digest(spark, sf):
    # descriptions get Chinese sentence ends so that sentences can be valid
    rows = V.articles(spark, sf).withColumn("description", F.regexp_replace("description", r"\.\s", "。"))
    items, errors, _ = offline_digest(rows, V.CATALOG, SelectSettings())
    return items.select("edition", "item_no", "article_id", "summary").unionByName(
        errors.select("edition", F.lit(None).cast("int").alias("item_no"), F.concat(F.lit("a"), "pos").alias("article_id"), F.lit("no_sentence").alias("summary"))
    )


@query(
    "source_counts",
    f"""WITH {V.ART} SELECT edition, coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY edition)::DOUBLE, 4) AS share FROM art GROUP BY 1, 2""",
)
def source_counts(spark, sf):
    return M.source_counts(V.articles(spark, sf))
