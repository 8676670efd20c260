"""Search results: matching, verification, refill, resolution, enrichment and the edition job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import evidence as Ev
from tidewire.operators import gates as G
from tidewire.plans import edition as Plan
from tidewire.queries import sqltext as S
from tidewire.queries import views as V
from tidewire.queries.registry import query
from tidewire.queries.scalars import _identity_sql
from tidewire.queries.selection import outcomes
from tidewire.queries.stories import _DIRECT, history
from tidewire.settings import EnrichSettings
from tidewire.workspace import save_once


def search_results(spark, sf, rows=None):
    """Five results in each of two rounds per article, made from the article itself."""
    p = (F.col("pos") - 1) * 7 + F.datediff("edition", F.lit(V.BASE_DAY).cast("date"))
    rows = (V.articles(spark, sf) if rows is None else rows).withColumn("p", p)
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(2)))).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(5))))
    m = (F.col("p") + F.col("rank") + F.col("round")) % 5
    at = F.col("reference_ts") - F.make_dt_interval(hours=((F.col("p") * 7 + F.col("rank") * 13) % 90).cast("int"))
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    url = (
        F.when(m == 0, F.col("link"))
        .when(m == 3, F.concat(F.lit("https://x.com/"), F.col("p").cast("string")))
        .when(m == 4, F.concat(F.lit("https://wire"), F.col("rank").cast("string"), F.lit(".com/s/"), F.col("p").cast("string")))
        .otherwise(F.concat(F.lit("https://news"), (F.col("p") % 4).cast("string"), F.lit(".com/a/"), F.col("p").cast("string")))
    )
    return rows.select(
        "edition",
        "pos",
        "round",
        "rank",
        F.when(m == 1, F.concat("title", F.lit(" update"))).when(m == 2, "unrelated words here").otherwise(F.col("title")).alias("title"),
        url.alias("url"),
        F.when((F.col("p") + F.col("rank")) % 9 != 0, stamp).alias("published_date"),
        (((F.col("p") * 13 + F.col("rank") * 29 + F.col("round") * 7) % 100) / F.lit(100.0)).alias("score"),
        F.col("description").alias("content"),
        F.col("content").alias("raw_content"),
        "reference_ts",
    )


RES = f"""res AS (SELECT *, CASE m WHEN 1 THEN ctitle || ' update' WHEN 2 THEN 'unrelated words here' ELSE ctitle END AS title,
 CASE m WHEN 0 THEN clink WHEN 3 THEN 'https://x.com/' || p WHEN 4 THEN 'https://wire' || rank || '.com/s/' || p ELSE 'https://news' || (p % 4) || '.com/a/' || p END AS link,
 CASE WHEN (p + rank) % 9 <> 0 THEN ref - to_hours(CAST((p * 7 + rank * 13) % 90 AS INTEGER)) END AS rpub, ((p * 13 + rank * 29 + round * 7) % 100) / 100.0 AS score
 FROM (SELECT *, (p + rank + round) % 5 AS m FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS rank FROM (SELECT edition, pos, p, ref, title AS ctitle, link AS clink, description, content, term_en, unnest([1, 2]) AS round FROM art))))"""

_LA = S.analysis("art", "title", S.body_sql(), "*", "la")
_RA = S.analysis("res", "title", "''", "*", "ra")
_TEXT = "CASE WHEN b <> '' AND NOT contains(a, b) THEN trim(a || ' ' || b) ELSE a END"
MATCH = f"""{RES}, {_LA}, {_RA}, ev0 AS (SELECT r.edition, r.pos, r.round, r.rank, r.link AS url, r.score, r.rpub, {S.netloc('r.link')} AS domain,
  {_identity_sql("concat_ws(' ', l.title, nullif(l.term_en, ''))")} AS lt, {_identity_sql('r.title')} AS tt, {S.search_url('l.link')} AS lu, {S.search_url('r.link')} AS ru,
  l.primary_entity AS lp, r.primary_entity AS rp, l.fams AS lf, r.fams AS rf, {S.compact('r.description')} AS a, {S.compact('r.content')} AS b, {_DIRECT.replace('link', 'r.link')} AS direct, r.ref
  FROM ra r JOIN la l ON l.edition = r.edition AND l.pos = r.pos),
 ev1 AS (SELECT *, CASE WHEN lu <> '' AND lu = ru THEN true WHEN lp <> '' AND rp <> '' AND lp <> rp THEN false WHEN len(lf) > 0 AND NOT list_has_any(lf, rf) THEN false
   WHEN len(list_filter(lt, lambda s: regexp_matches(s, '[a-z]') AND regexp_matches(s, '[0-9]') AND NOT list_contains(tt, s))) > 0 THEN false
   ELSE len(list_intersect(lt, tt)) >= CASE WHEN len(lt) >= 2 THEN 2 ELSE 1 END END AS relevant,
  coalesce(direct AND rpub BETWEEN ref - INTERVAL 72 HOUR AND ref AND length(rtrim(substring({_TEXT}, 1, 600))) >= 80 AND score >= 0.15, false) AS ok FROM ev0),
 a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition, pos ORDER BY rank) AS n FROM (SELECT *, row_number() OVER (PARTITION BY edition, pos, url ORDER BY rank) AS u FROM ev1 WHERE round = 1 AND relevant AND ok) WHERE u = 1) WHERE n <= 3),
 a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition, pos ORDER BY rank) AS n, (SELECT count(*) FROM a1 WHERE a1.edition = e.edition AND a1.pos = e.pos) AS have
   FROM (SELECT *, row_number() OVER (PARTITION BY edition, pos, url ORDER BY rank) AS u FROM ev1 WHERE round = 2 AND relevant AND ok AND NOT EXISTS (SELECT 1 FROM a1 WHERE a1.edition = ev1.edition AND a1.pos = ev1.pos AND a1.url = ev1.url)) e WHERE u = 1)
   WHERE n <= greatest(1, 3 - have)),
 acc AS (SELECT edition, pos, round, rank FROM a1 UNION ALL SELECT edition, pos, round, rank FROM a2)"""


def decisions(spark, sf):
    # the pages are read for the candidates and for their results
    rows = save_once(V.articles(spark, sf), "evidence-articles")
    return save_once(Ev.match_evidence(rows, search_results(spark, sf, rows), V.CATALOG, EnrichSettings()), "decisions")


@query("evidence_gate", f"WITH {V.ART}, {MATCH} SELECT edition, pos, round, rank, ok AS evidence_ok FROM ev1")
def evidence_gate(spark, sf):
    return G.gate_evidence(search_results(spark, sf), EnrichSettings()).select("edition", "pos", "round", "rank", "evidence_ok")


@query(
    "match_evidence",
    f"WITH {V.ART}, {MATCH} SELECT edition, pos, round, rank, relevant, EXISTS (SELECT 1 FROM acc WHERE acc.edition = ev1.edition AND acc.pos = ev1.pos AND acc.round = ev1.round AND acc.rank = ev1.rank) AS accepted FROM ev1",
)
def match_evidence(spark, sf):
    return decisions(spark, sf).select("edition", "pos", "round", "rank", "relevant", "accepted")


_TOP = f"""ev2 AS (SELECT e.*, row_number() OVER (PARTITION BY e.edition, e.pos ORDER BY e.score DESC, e.round, e.rank) AS s FROM (SELECT ev1.*, row_number() OVER (PARTITION BY ev1.edition, ev1.pos, ru ORDER BY score DESC, round, rank) AS c FROM ev1 JOIN acc USING (edition, pos, round, rank)) e WHERE c = 1)"""


@query("evidence_top3", f"WITH {V.ART}, {MATCH}, {_TOP} SELECT edition, pos, s AS evidence_no, url FROM ev2 WHERE s <= 3")
def evidence_top3(spark, sf):
    accepted = decisions(spark, sf).filter("accepted")
    return Ev.evidence_top(accepted).select("edition", "pos", F.col("evidence_no").cast("long").alias("evidence_no"), F.col("evidence_item.url").alias("url"))


@query(
    "resolve_story",
    f"""WITH {V.ART}, {MATCH}, {_TOP}, g AS (SELECT edition, pos, count(DISTINCT domain) AS doms, arg_min(url, s) AS link, string_agg(CASE WHEN s <= 3 THEN url END, '|' ORDER BY s) AS urls,
   string_agg(CASE WHEN s <= 3 THEN '[' || domain || '] ' || rtrim(substring({_TEXT}, 1, 600)) END, ' ' ORDER BY s) AS body FROM ev2 GROUP BY edition, pos)
 SELECT edition, pos, link, CASE WHEN doms >= 2 THEN 'corroborated' ELSE 'reported' END AS confidence, urls AS evidence_urls, md5(rtrim(substring(body, 1, 1800))) AS body_md5 FROM g""",
)
def resolve_story(spark, sf):
    out = Ev.resolve_stories(V.articles(spark, sf), decisions(spark, sf).filter("accepted"))
    return out.select("edition", "pos", "link", "confidence", F.element_at("provenance", "evidence_urls").alias("evidence_urls"), F.md5("description").alias("body_md5"))


_OWN = f"""own AS (SELECT edition, pos, link AS url, {S.netloc('link')} AS domain, {S.search_url('link')} AS ru, 0 AS s FROM art WHERE {_DIRECT} AND trim(publish_time) <> '' AND ({S.compact('content')} <> '' OR {S.compact('description')} <> '')),
 both1 AS (SELECT edition, pos, url, domain, ru, s FROM own UNION ALL SELECT e.edition, e.pos, e.url, e.domain, e.ru, e.s FROM ev2 e WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.edition = e.edition AND o.pos = e.pos AND o.ru = e.ru)),
 sel AS (SELECT *, row_number() OVER (PARTITION BY edition, pos ORDER BY s) AS n FROM both1)"""


@query(
    "enrich_story",
    f"""WITH {V.ART}, {MATCH}, {_TOP}, {_OWN}, g AS (SELECT edition, pos, string_agg(url, '|' ORDER BY n) AS urls, count(DISTINCT domain) AS doms FROM sel WHERE n <= 3 GROUP BY edition, pos)
 SELECT a.edition, a.pos, coalesce(g.urls, '') AS evidence_urls, CASE WHEN EXISTS (SELECT 1 FROM acc WHERE acc.edition = a.edition AND acc.pos = a.pos) THEN CASE WHEN g.doms >= 2 THEN 'corroborated' ELSE 'direct' END ELSE a.evidence_status END AS evidence_status FROM art a LEFT JOIN g USING (edition, pos)""",
)
def enrich_story(spark, sf):
    out = Ev.enrich_stories(V.articles(spark, sf), decisions(spark, sf).filter("accepted"))
    return out.select("edition", "pos", F.element_at("provenance", "evidence_urls").alias("evidence_urls"), "evidence_status")


@query(
    "evidence_runs",
    f"""WITH {V.ART}, {MATCH}, cut AS (SELECT edition, pos, 1 AS round, max(rank) AS c FROM a1 GROUP BY edition, pos HAVING count(*) = 3 UNION ALL SELECT edition, pos, 2, max(rank) FROM a2 GROUP BY edition, pos, have HAVING count(*) = greatest(1, 3 - have)),
 x AS (SELECT e.edition, e.pos, e.round, e.rank, e.relevant, acc.rank IS NOT NULL AS accepted, cut.c IS NULL OR e.rank <= cut.c AS seen FROM ev1 e LEFT JOIN acc USING (edition, pos, round, rank) LEFT JOIN cut ON cut.edition = e.edition AND cut.pos = e.pos AND cut.round = e.round)
 SELECT edition, pos, round, count(*) AS result_count, count(*) FILTER (accepted) AS accepted_evidence_count, count(*) FILTER (seen AND NOT relevant) AS rejected_irrelevant_count, count(*) FILTER (seen AND relevant AND NOT accepted) AS rejected_invalid_count FROM x GROUP BY edition, pos, round""",
)
def evidence_runs(spark, sf):
    return Ev.evidence_runs(decisions(spark, sf))


@query("pick_best_match")
def pick_best_match(spark, sf):
    out = Ev.pick_best_match(V.articles(spark, sf), search_results(spark, sf).filter("round = 1").drop("round"))
    return out.select("edition", "pos", "rank", "exact_url_match", "same_domain", "title_similarity")


@query("verify_candidates")
def verify_candidates(spark, sf):
    rows = V.articles(spark, sf)
    results = search_results(spark, sf).filter("round = 1").drop("round", "reference_ts")
    states = outcomes(rows).filter("round = 1").join(rows.select("edition", "pos", "reference_ts"), ["edition", "pos"])
    states = states.select("edition", "pos", F.col("outcome").alias("request_outcome"), "reference_ts")
    out = Ev.verify_candidates(rows.drop("reference_ts"), results, states, EnrichSettings())
    return out.select("edition", "pos", "validation_outcome", "accepted", "preserved", "publish_time")


@query("find_story_cluster_match")
def find_story_cluster_match(spark, sf):
    rows = V.doc_articles(spark, sf).select("edition", "pos", "title")
    accepted = rows.filter("pos % 4 = 0").withColumn("order", F.col("pos"))
    return Ev.find_cluster_match(rows.filter("pos % 4 <> 0"), accepted).select("edition", "title", "matched_title", "relation_type", "title_similarity")


@query("accept_refill")
def accept_refill(spark, sf):
    rows = V.articles(spark, sf)
    results = rows.filter("pos % 3 <> 0").select(
        "edition", (F.col("pos") % 3).cast("int").alias("round"), F.col("pos").cast("int").alias("rank"), "title", F.col("link").alias("url"), F.col("publish_time").alias("published_date"), "reference_ts"
    )
    base = rows.filter("pos % 6 = 0").select("edition", "title", F.col("link").alias("url"))
    prior = rows.filter("pos % 6 = 3").select("edition", "title", F.col("link").alias("url"))
    needed = rows.select("edition").distinct().withColumn("needed", F.lit(4))
    out = Ev.accept_refill(results, base, prior, needed, V.CATALOG, EnrichSettings(max_refill_rounds=2, strict_hours=72))
    return out.select("edition", "round", "rank", "accepted", "duplicate_existing", "duplicate_within_results", "near_duplicate_existing", "story_cluster_existing")


@query("resolve_leads")
def resolve_leads(spark, sf):
    rows = V.articles(spark, sf).filter("kind = 'lead'")
    results = search_results(spark, sf).join(rows.select("edition", "pos"), ["edition", "pos"], "left_semi")
    stories, unresolved, _ = Ev.resolve_leads(rows.drop("reference_ts"), results, outcomes(rows), V.CATALOG, EnrichSettings(max_leads=4), budget=6)
    return stories.select("edition", "pos", "link", F.lit("resolved").alias("reason")).unionByName(
        unresolved.select("edition", "pos", F.col("signal_url").alias("link"), "reason")
    )


@query("enrich_edition")
def enrich_edition(spark, sf):
    rows = V.articles(spark, sf)
    out = Plan.enrich_edition(rows.drop("reference_ts"), search_results(spark, sf), outcomes(rows), V.CATALOG, EnrichSettings(max_total_calls=20))
    return out.stories.select("edition", "queue_pos", "pos", "link", "evidence_status")


@query("enrichment_counters")
def enrichment_counters(spark, sf):
    rows = V.articles(spark, sf)
    return Plan.enrich_edition(rows.drop("reference_ts"), search_results(spark, sf), outcomes(rows), V.CATALOG, EnrichSettings(max_total_calls=20)).counters


def edition_job(spark, sf):
    rows = V.articles(spark, sf)
    # sentence ends in the style the reader contract expects
    rows = rows.withColumn("description", F.regexp_replace("description", r"\.\s", "。"))
    runs = rows.select("edition").distinct().select(
        "edition", F.lit("pages").alias("source"), F.when(F.dayofmonth("edition") % 2 == 0, "degraded").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("error_kind"), F.array(F.lit("slow_feed"), F.lit("x_snapshot")).alias("diagnostic_codes"),
    )
    past = history(spark, sf, rows)
    return Plan.build_edition(rows.drop("reference_ts"), runs, past, search_results(spark, sf), outcomes(rows), V.CATALOG)


@query("build_edition")
def build_edition(spark, sf):
    return edition_job(spark, sf)["items"].select("edition", "item_no", "article_id", "title", "summary", "url", "source_label", "confidence")


