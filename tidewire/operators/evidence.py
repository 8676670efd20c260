"""Search results as evidence: matching, verification, refill, lead resolution and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import dates as D
from tidewire.functions import tokens as K
from tidewire.functions.text import compact_text, normalize_title_search, text
from tidewire.functions.urls import canonical_url_search, domain_of
from tidewire.operators.catalog import Catalog, analyze, analyze_articles
from tidewire.operators.dedupe import flag_existing
from tidewire.operators.gates import gate_evidence, observation_signals
from tidewire.operators.greedy import first_fit
from tidewire.operators.ranking import candidate_queue, global_rank, lead_order, top_k, within_result_duplicates
from tidewire.operators.similarity import best_related, facing_relations, facing_titles, title_similarity
from tidewire.settings import EnrichSettings
from tidewire.workspace import Rounds, save_once

#: ranks of an edition that a refill round looks at first
LOT = 128


def flag_relevant(candidates: DataFrame, results: DataFrame, catalog: Catalog) -> DataFrame:
    """Results joined to their candidate, with `relevant`: does the result keep its identity?"""
    lead_text = F.concat_ws(
        " ", *[F.nullif(p, F.lit("")) for p in (compact_text("title"), compact_text(A.prov("trend_term_en")))]
    )
    leads = analyze_articles(candidates, catalog, "_la").select(
        "edition",
        "pos",
        F.col("_la")["primary_entity"].alias("_lp"),
        F.col("_la")["families"].alias("_lf"),
        canonical_url_search(compact_text("link")).alias("_lu"),
        K.identity_terms(lead_text).alias("_lt"),
        K.cjk_runs(lead_text).alias("_lc"),
    )
    title = compact_text("title")
    found = analyze(results.withColumn("_rt", title), catalog, F.col("_rt"), F.lit(""), "_ra")
    found = (
        found.withColumn("_ru", canonical_url_search(compact_text("url")))
        .withColumn("_tt", K.identity_terms("_rt"))
        .withColumn("_rc", K.cjk_runs("_rt"))
    )
    joined = found.join(leads, ["edition", "pos"])
    rp, rf = F.col("_ra")["primary_entity"], F.col("_ra")["families"]
    same_url = (F.col("_lu") != "") & (F.col("_lu") == F.col("_ru"))
    other_subject = (F.col("_lp") != "") & (rp != "") & (F.col("_lp") != rp)
    other_family = (F.size("_lf") > 0) & ~F.arrays_overlap("_lf", rf)
    missing_version = F.size(F.array_except(K.version_terms(F.col("_lt")), F.col("_tt"))) > 0
    need = F.when(F.size("_lt") >= 2, 2).otherwise(1)
    overlap = F.size(F.array_intersect("_lt", "_tt")) >= need
    cjk = F.exists("_lc", lambda a: F.exists("_rc", lambda b: F.contains(a, b) | F.contains(b, a)))
    relevant = (
        F.when(same_url, True)
        .when(other_subject | other_family | missing_version, False)
        .otherwise(overlap | cjk)
    )
    return joined.withColumn("relevant", relevant).drop(
        "_rt", "_ra", "_ru", "_tt", "_rc", "_lp", "_lf", "_lu", "_lt", "_lc"
    )


def match_evidence(
    candidates: DataFrame,
    results: DataFrame,
    catalog: Catalog,
    settings: EnrichSettings = EnrichSettings(),
    stop_at: int | None = 3,
) -> DataFrame:
    """Decide every result: relevant, evidence_ok, processed, accepted (with evidence_item).

    results: (edition, pos, round, rank, title, url, published_date, score, content, raw_content,
    reference_ts). A round stops once the evidence of the candidate has reached `stop_at`, checked
    after each acceptance, so a later round may still add one. content and raw_content stay behind: what
    counts of them is in evidence_item, and whole texts of all results would travel through every join.
    """
    gated = gate_evidence(results, settings).drop("content", "raw_content")
    flagged = flag_relevant(candidates, gated, catalog)
    flagged = save_once(flagged.withColumn("_url", compact_text("url")), "evidence")
    key = ["edition", "pos"]
    work = Rounds(flagged.sparkSession, "match-evidence")
    accepted: DataFrame | None = None
    decided: DataFrame | None = None
    for number in range(1, settings.rounds + 1):
        rows = flagged.filter(F.col("round") == number)
        # texts stay out of the joins
        eligible = rows.filter("relevant and evidence_ok").select(*key, "round", "rank", "_url")
        if accepted is not None:
            eligible = eligible.join(accepted.select(*key, "_url"), [*key, "_url"], "left_anti")
        fresh = top_k(eligible, [*key, "_url"], [F.col("rank").asc()], 1, "_u")
        fresh = fresh.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("rank")))
        if stop_at is None:
            taken = fresh.withColumn("_allowed", F.lit(None).cast("int"))
        else:
            if accepted is None:
                taken = fresh.withColumn("_have", F.lit(0))
            else:
                have = accepted.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("_have"))
                taken = fresh.join(have, key, "left")
            room = F.greatest(F.lit(1), F.lit(stop_at) - F.coalesce("_have", F.lit(0)))
            taken = taken.withColumn("_allowed", room).filter(F.col("_n") <= F.col("_allowed"))
        # written, so that a later round reads this one instead of planning it again
        taken = work.save(taken.select(*key, "round", "rank", "_url", "_n", "_allowed"), f"taken{number}")
        cut = taken.filter(F.col("_n") == F.col("_allowed")).select(*key, F.col("rank").alias("_cut"))
        picked = taken.select(*key, "round", "rank", "_url")
        outcome = (
            rows.join(picked.select(*key, "rank", F.lit(True).alias("_acc")), [*key, "rank"], "left")
            .join(cut, key, "left")
            .withColumn("accepted", F.coalesce("_acc", F.lit(False)))
            .withColumn("processed", F.col("_cut").isNull() | (F.col("rank") <= F.col("_cut")))
            .drop("_acc", "_cut")
        )
        decided = outcome if decided is None else decided.unionByName(outcome)
        accepted = picked if accepted is None else accepted.unionByName(picked)
    return decided.drop("_url")


def evidence_runs(decisions: DataFrame) -> DataFrame:
    """Counts per search call."""
    return decisions.groupBy("edition", "pos", "round").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_if("accepted").alias("accepted_evidence_count"),
        F.count_if(F.col("processed") & ~F.col("relevant")).alias("rejected_irrelevant_count"),
        F.count_if(F.col("processed") & F.col("relevant") & ~F.col("accepted")).alias("rejected_invalid_count"),
    )


def evidence_top(evidence: DataFrame, k: int = 3) -> DataFrame:
    """First k evidence rows per candidate by score, one per canonical URL."""
    e = F.col("evidence_item")
    rows = evidence.withColumn("_canon", canonical_url_search(e["url"])).filter("_canon <> ''")
    order = [e["score"].desc(), F.col("round").asc(), F.col("rank").asc()]
    one = top_k(rows, ["edition", "pos", "_canon"], order, 1, "_u").drop("_u", "_canon")
    return top_k(one, ["edition", "pos"], order, k, "evidence_no")


def _gathered(evidence: DataFrame) -> DataFrame:
    """Per candidate: evidence in acceptance order and distinct evidence by score.

    A candidate has at most rounds x results-per-call accepted rows.
    """
    e = F.col("evidence_item")
    canon = canonical_url_search(e["url"])
    w = W.partitionBy("edition", "pos", canon).orderBy(e["score"].desc(), "round", "rank")
    rows = evidence.withColumn("_first", (F.row_number().over(w) == 1) & (canon != ""))
    by_time = F.struct("round", "rank", F.col("evidence_item").alias("item"))
    by_score = F.struct((-e["score"]).alias("s"), "round", "rank", F.col("evidence_item").alias("item"))
    return rows.groupBy("edition", "pos").agg(
        F.transform(F.array_sort(F.collect_list(by_time)), lambda x: x["item"]).alias("_in_order"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_first"), by_score))), lambda x: x["item"]
        ).alias("_ranked"),
    )


def _domains(items: Column) -> Column:
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(items, lambda i: i["domain"]), lambda d: d != ""))
    )


def resolve_stories(leads: DataFrame, evidence: DataFrame, settings: EnrichSettings = EnrichSettings()) -> DataFrame:
    """Leads with evidence become stories under the best evidence's identity."""
    rows = leads.join(_gathered(evidence), ["edition", "pos"])
    best = F.col("_best")
    top = F.col("_top")
    rows = (
        rows.withColumn("_best", F.element_at("_ranked", 1))
        .withColumn("_top", F.slice("_ranked", 1, 3))
        .withColumn("_doms", _domains(F.col("_ranked")))
    )
    body = F.rtrim(
        F.substring(
            F.array_join(
                F.transform(top, lambda i: F.concat(F.lit("["), i["domain"], F.lit("] "), i["text"])), " "
            ),
            1,
            1800,
        )
    )
    status = F.when(F.size("_doms") >= 2, "corroborated").otherwise("reported")
    added = F.create_map(
        F.lit("input_kind"), F.lit("story"),
        F.lit("resolution_stage"), F.lit(f"{settings.provider}_lead_resolution"),
        F.lit("lead_title"), compact_text("title"),
        F.lit("lead_source"), compact_text("source"),
        F.lit("signal_url"), compact_text("link"),
        F.lit("evidence_count"), F.size("_top").cast("string"),
        F.lit("evidence_domains"), F.array_join("_doms", ","),
        F.lit("evidence_urls"), F.array_join(F.transform(top, lambda i: i["url"]), "|"),
        F.lit("publish_time_semantics"), F.lit("source_published_at"),
    )
    return rows.select(
        "edition",
        "pos",
        F.when(best["title"] != "", best["title"]).otherwise(compact_text("title")).alias("title"),
        best["url"].alias("link"),
        body.alias("description"),
        body.alias("content"),
        best["published_date"].alias("publish_time"),
        F.coalesce("priority", F.lit(0)).alias("priority"),
        best["domain"].alias("source"),
        F.lit("story").alias("kind"),
        status.alias("evidence_status"),
        status.alias("confidence"),
        _merge("provenance", added).alias("provenance"),
        F.col("_top").alias("evidence"),
    )


def _merge(base: str, added: Column) -> Column:
    """Map update: keys of `added` win."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(added), k))
    return F.map_concat(kept, added)


def enrich_stories(stories: DataFrame, evidence: DataFrame, settings: EnrichSettings = EnrichSettings()) -> DataFrame:
    """Stories keep their identity and gain at most three sources, their own text first."""
    rows = stories.drop("evidence").join(_gathered(evidence), ["edition", "pos"], "left")
    none = F.array().cast(rows.schema["_ranked"].dataType)
    own_text = F.coalesce(F.nullif(compact_text("content"), F.lit("")), compact_text("description"))
    snippet = F.rtrim(F.substring(own_text, 1, settings.evidence_chars))
    url = compact_text("link")
    item = F.struct(
        compact_text("title").alias("title"),
        url.alias("url"),
        domain_of(url).alias("domain"),
        compact_text("publish_time").alias("published_date"),
        snippet.alias("text"),
        snippet.alias("snippet"),
        F.lit(1.0).alias("score"),
        F.lit("fetch").alias("origin"),
    )
    has_own = A.is_direct_evidence_url(url) & (compact_text("publish_time") != "") & (own_text != "")
    rows = (
        rows.withColumn("_in_order", F.coalesce("_in_order", none))
        .withColumn("_ranked", F.coalesce("_ranked", none))
        .withColumn("_own", F.when(has_own & (canonical_url_search(url) != ""), F.array(item)).otherwise(none))
    )
    own_key = F.when(F.size("_own") > 0, canonical_url_search(url)).otherwise("")
    rows = rows.withColumn(
        "_sel",
        F.slice(
            F.concat(
                "_own", F.filter("_ranked", lambda i: canonical_url_search(i["url"]) != own_key)
            ),
            1,
            3,
        ),
    )
    extra = F.rtrim(
        F.substring(
            F.array_join(
                F.transform(
                    F.filter(F.slice("_in_order", 1, 3), lambda i: i["snippet"] != ""),
                    lambda i: F.concat(F.lit("["), i["domain"], F.lit("] "), i["snippet"]),
                ),
                " ",
            ),
            1,
            2400,
        )
    )
    joined = F.rtrim(
        F.substring(
            F.concat_ws(" ", F.nullif(compact_text("description"), F.lit("")), F.nullif(extra, F.lit(""))), 1, 3000
        )
    )
    got = F.size("_in_order") > 0
    rows = rows.withColumn("_text", joined).withColumn(
        "_status", F.when(F.size(_domains(F.col("_sel"))) >= 2, "corroborated").otherwise("direct")
    )
    added = F.create_map(
        F.lit("input_kind"), F.lit("story"),
        F.lit("resolution_stage"), F.lit(f"{settings.provider}_story_enrichment"),
        F.lit("evidence_count"), F.size("_sel").cast("string"),
        F.lit("evidence_urls"), F.array_join(F.transform("_sel", lambda i: i["url"]), "|"),
    )
    return (
        rows.withColumn("description", F.when(got, F.col("_text")).otherwise(F.col("description")))
        .withColumn("content", F.when(got, F.col("_text")).otherwise(F.col("content")))
        .withColumn("evidence_status", F.when(got, F.col("_status")).otherwise(F.col("evidence_status")))
        .withColumn("confidence", F.when(got, F.col("_status")).otherwise(F.col("confidence")))
        .withColumn("kind", F.lit("story"))
        .withColumn("provenance", _merge("provenance", added))
        .withColumn("evidence", F.col("_sel"))
        .drop("_in_order", "_ranked", "_own", "_sel", "_text", "_status")
    )


# ---- verification -------------------------------------------------------------------------------


def pick_best_match(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Best result per candidate: exact URL, then domain, then title similarity, then rank."""
    want = candidates.select(
        "edition",
        "pos",
        F.col("title").alias("expected_title"),
        canonical_url_search("link").alias("_eu"),
        domain_of("link").alias("_ed"),
    )
    rows = results.join(want, ["edition", "pos"])
    rows = (
        rows.withColumn("exact_url_match", (F.col("_eu") != "") & (F.col("_eu") == canonical_url_search("url")))
        .withColumn("same_domain", (F.col("_ed") != "") & (F.col("_ed") == domain_of("url")))
        .withColumn("title_similarity", title_similarity("expected_title", text("title")))
    )
    score = (
        F.when(F.col("exact_url_match"), 10.0).otherwise(0.0)
        + F.when(F.col("same_domain"), 2.0).otherwise(0.0)
        + F.col("title_similarity")
        - (F.col("rank") - 1) * F.lit(0.01)
    )
    rows = rows.withColumn("match_score", score).drop("_eu", "_ed")
    return top_k(rows, ["edition", "pos"], [F.col("match_score").desc(), F.col("rank").asc()], 1, "_r").drop("_r")


def verify_candidates(
    candidates: DataFrame, results: DataFrame, outcomes: DataFrame, settings: EnrichSettings = EnrichSettings()
) -> DataFrame:
    """One row per verified candidate with validation_outcome; accepted rows get the matched date.

    outcomes: (edition, pos, request_outcome, reference_ts).
    """
    best = pick_best_match(candidates, results).select(
        "edition",
        "pos",
        "exact_url_match",
        "same_domain",
        "title_similarity",
        F.col("url").alias("matched_url"),
        F.col("title").alias("matched_title"),
        F.col("published_date").alias("matched_published_date"),
    )
    rows = candidates.join(outcomes, ["edition", "pos"]).join(best, ["edition", "pos"], "left")
    matched = F.coalesce(
        F.col("exact_url_match") | (F.col("same_domain") & (F.col("title_similarity") >= settings.similarity)),
        F.lit(False),
    )
    within = D.within_hours(D.parse_published("matched_published_date"), "reference_ts", settings.strict_hours)
    rows = rows.withColumn("matched", matched).withColumn(
        "within_strict", F.when(F.col("matched_url").isNotNull(), within)
    )
    rows = rows.withColumn("validation_outcome", verify_outcome())
    accepted = F.col("validation_outcome") == "accepted"
    return rows.withColumn("accepted", accepted).withColumn(
        "publish_time",
        F.when(accepted & (text("matched_published_date") != ""), F.col("matched_published_date")).otherwise(
            F.col("publish_time")
        ),
    ).withColumn("preserved", F.col("request_outcome") != "success")


def verify_outcome() -> Column:
    return (
        F.when(F.col("request_outcome") != "success", "not_evaluated")
        .when(F.col("matched") & F.coalesce("within_strict", F.lit(False)), "accepted")
        .when(~F.col("matched"), "no_match")
        .when(F.col("within_strict") == F.lit(False), "outside_24h")
        .otherwise("missing_published_date")
    )


def find_cluster_match(results: DataFrame, accepted: DataFrame) -> DataFrame:
    """Best related accepted story per result title; earliest accepted row wins ties.

    accepted: (edition, title, order) where `order` is the position in the accepted list.
    """
    related = best_related(results.select("edition", "title"), accepted.select("edition", "title"))
    first = accepted.groupBy("edition", F.col("title").alias("right_title")).agg(F.min("order").alias("order"))
    rows = related.join(first, ["edition", "right_title"])
    order = [
        (F.col("relation_type") == "near_duplicate").cast("int").desc(),
        F.col("shared_weight").desc(),
        F.size("shared_tokens").desc(),
        F.col("title_similarity").desc(),
        F.col("order").asc(),
    ]
    return top_k(rows, ["edition", "left_title"], order, 1, "_r").select(
        "edition",
        F.col("left_title").alias("title"),
        F.col("right_title").alias("matched_title"),
        "relation_type",
        "shared_tokens",
        "shared_weight",
        "overlap_ratio",
        "title_similarity",
    )


def accept_refill(
    results: DataFrame,
    base: DataFrame,
    prior: DataFrame,
    needed: DataFrame,
    catalog: Catalog,
    settings: EnrichSettings = EnrichSettings(),
) -> DataFrame:
    """Decide refill results round by round.

    results: (edition, round, rank, title, url, published_date, reference_ts); base, prior:
    (edition, title, url); needed: (edition, needed). In a round, results are taken in rank order
    while slots are left; a result related to anything accepted before it is refused. A round goes on in
    lots of ranks, LOT first and then as many as all before, so that nothing is compared far beyond the last slot.
    """
    spark = results.sparkSession
    work = Rounds(spark, "refill")
    rows = within_result_duplicates(
        results.withColumn("_norm", normalize_title_search("title")), "_norm", ["edition", "round"]
    )
    rows = global_rank(rows.drop("_norm"), ["edition", "round"], [F.col("rank").asc()], "_no")
    lot = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_no") / LOT))).cast("int")
    rows = work.save(rows.withColumn("_lot", lot).drop("_no"), "rows")
    lots = {r["round"]: r["_lots"] for r in rows.groupBy("round").agg(F.max("_lot").alias("_lots")).collect()}
    base = work.save(base.select("edition", "title", "url"), "base")
    known = work.save(prior.select("edition", "title", "url"), "prior")
    # what results are compared with: accepted in earlier rounds or lots
    seen = work.save(facing_titles(known.filter("title is not null")), "seen")
    decided: DataFrame | None = None
    left = work.save(needed.select("edition", "needed"), "needed")
    for number in range(1, settings.max_refill_rounds + 1):
        accepted: DataFrame | None = None
        for part in range(lots.get(number, 0) + 1):
            if part and left.filter("needed > 0").isEmpty():
                break
            current = rows.filter((F.col("round") == number) & (F.col("_lot") == part)).drop("_lot")
            current = analyze(current.join(left.filter("needed > 0"), "edition"), catalog, F.col("title"), F.lit(""), "_ta")
            current = current.withColumn("ai_title_relevant", F.col("_ta")["relevance"] >= 2).withColumn(
                "within_strict",
                D.within_hours(D.parse_published("published_date"), "reference_ts", settings.strict_hours),
            )
            current = flag_existing(current.drop("_ta"), base, known).withColumn("_id", F.md5("title"))
            fit = (
                F.coalesce("within_strict", F.lit(False))
                & F.col("ai_title_relevant")
                & ~F.col("duplicate_existing")
                & ~F.col("duplicate_within_results")
            )
            current = work.save(current.withColumn("_fit", fit), f"lot{number}")
            named = current.filter("title is not null")
            others = seen.withColumn("known", F.lit(True)).unionByName(
                facing_titles(named.filter("_fit")).withColumn("known", F.lit(False))
            )
            related = work.save(facing_relations(facing_titles(named), others), f"related{number}")
            prior_near = related.filter("right_id is null").groupBy("edition", F.col("left_id").alias("_id")).agg(F.max("near").alias("_prior"))
            current = work.save(current.join(prior_near, ["edition", "_id"], "left"), f"round{number}")
            inner = related.filter("right_id is not null")
            members = current.filter("_fit and _prior is null").select(
                "edition", F.col("rank").cast("long").alias("node"), F.col("rank").alias("ord"), F.coalesce("_id", F.md5(F.lit(""))).alias("hub")
            )
            edges = inner.select("edition", F.col("left_id").alias("later"), F.col("right_id").alias("earlier"))
            for side in ("later", "earlier"):
                edges = edges.join(members.select("edition", F.col("hub").alias(side)), ["edition", side], "left_semi")
            kept = first_fit(members, edges, "refill-fit").filter("kept").select("edition", F.col("node").alias("rank"))
            slots = F.row_number().over(W.partitionBy("edition").orderBy("rank"))
            taken = kept.join(left, "edition").withColumn("_n", slots).filter("_n <= needed")
            taken = work.save(taken.select("edition", "rank", "_n", "needed"), f"taken{number}")
            last = taken.filter("_n = needed").select("edition", F.col("rank").alias("_last"))
            marked = (
                current.join(taken.select("edition", "rank", F.lit(True).alias("_acc")), ["edition", "rank"], "left")
                .join(last, "edition", "left")
                .withColumn("accepted", F.coalesce("_acc", F.lit(False)))
                # nothing is looked at once the last slot is taken
                .filter(F.col("_last").isNull() | (F.col("rank") <= F.col("_last")))
                .drop("_acc", "_last", "needed")
            )
            # accepted earlier in this lot, seen by later results
            live = marked.filter("accepted").select("edition", F.col("_id").alias("right_id"), F.col("rank").alias("_arank"))
            hits = (
                marked.filter("not accepted").select("edition", F.col("_id").alias("left_id"), "rank")
                .join(inner.join(live, ["edition", "right_id"]), ["edition", "left_id"])
                .filter("_arank < rank")
                .groupBy("edition", "rank")
                .agg(F.max("near").alias("_near"))
            )
            near = F.greatest("_prior", "_near")
            marked = (
                marked.join(hits, ["edition", "rank"], "left")
                .withColumn("near_duplicate_existing", F.coalesce(near, F.lit(False)))
                .withColumn("story_cluster_existing", near.isNotNull() & ~F.col("near_duplicate_existing"))
                .drop("_prior", "_near", "_id", "_fit")
            )
            marked = work.save(marked, f"decided{number}")
            decided = marked if decided is None else decided.unionByName(marked)
            fresh = marked.filter("accepted")
            seen = seen.unionByName(work.save(facing_titles(fresh.filter("title is not null")), "seen"))
            fresh = fresh.select("edition", "title", "url")
            accepted = fresh if accepted is None else accepted.unionByName(fresh)
            got = fresh.groupBy("edition").agg(F.count(F.lit(1)).alias("_got"))
            left = work.save(
                left.join(got, "edition", "left").select(
                    "edition", (F.col("needed") - F.coalesce("_got", F.lit(0))).alias("needed")
                ),
                "needed",
            )
        if accepted is not None:
            known = known.unionByName(accepted)
    return decided


# ---- lead resolution ----------------------------------------------------------------------------


def one_lead_per_entity(
    leads: DataFrame, max_leads: int = 5, analysis: str = "analysis"
) -> tuple[DataFrame, DataFrame]:
    """(selected leads with lead_index, deferred leads with reason)."""
    primary = F.col(analysis)["primary_entity"]
    key = F.when(primary != "", primary).otherwise(F.concat(F.lit("\0"), F.col("pos")))
    rows = leads.withColumn("_entity", key)
    first = top_k(rows, ["edition", "_entity"], lead_order(analysis), 1, "_r").drop("_r")
    selected = top_k(first, ["edition"], lead_order(analysis), max_leads, "lead_index")
    taken = selected.select("edition", "_entity", F.lit("lead_duplicate_entity").alias("_dup"))
    deferred = (
        rows.join(selected.select("edition", "pos"), ["edition", "pos"], "left_anti")
        .join(taken, ["edition", "_entity"], "left")
        .withColumn("reason", F.coalesce("_dup", F.lit("lead_candidate_limit")))
        .drop("_dup", "_entity")
    )
    return selected.drop("_entity"), deferred


def resolve_leads(
    leads: DataFrame,
    results: DataFrame,
    outcomes: DataFrame,
    catalog: Catalog,
    settings: EnrichSettings = EnrichSettings(),
    budget: int = 30,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Depth-first variant: (resolved stories, unresolved signals, calls)."""
    analysed = analyze_articles(leads, catalog)
    selected, deferred = one_lead_per_entity(analysed, settings.max_leads)
    selected = save_once(selected, "leads")
    calls = selected.select("edition", "pos", "lead_index").withColumn(
        "round", F.explode(F.sequence(F.lit(1), F.lit(settings.rounds)))
    )
    calls = calls.join(outcomes.select("edition", "pos", "round", "outcome"), ["edition", "pos", "round"], "left")
    calls = calls.withColumn("outcome", F.coalesce("outcome", F.lit("success")))
    w = W.partitionBy("edition").orderBy("lead_index", "round")
    stop = F.col("outcome").isin(*A.TERMINAL_OUTCOMES)
    calls = (
        calls.withColumn("call_no", F.row_number().over(w))
        .withColumn(
            "_stopped",
            F.coalesce(F.max(stop.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .filter((F.col("call_no") <= budget) & (F.col("_stopped") == 0))
        .drop("_stopped")
    )
    calls = save_once(calls, "calls")
    served = results.join(
        calls.filter("outcome = 'success'").select("edition", "pos", "round"), ["edition", "pos", "round"], "left_semi"
    )
    decisions = match_evidence(selected, served, catalog, settings, stop_at=None)
    evidence = decisions.filter("accepted")
    stories = resolve_stories(selected, evidence, settings)
    terminal = calls.filter(stop).groupBy("edition").agg(
        F.min_by("outcome", "call_no").alias("_code"), F.min("lead_index").alias("_at")
    )
    mine = calls.groupBy("edition", "pos").agg(
        F.count(F.lit(1)).alias("_calls"), F.count_if(F.col("outcome") != "success").alias("_failed")
    )
    silent = (
        selected.join(stories.select("edition", "pos"), ["edition", "pos"], "left_anti")
        .join(mine, ["edition", "pos"], "left")
        .join(terminal, "edition", "left")
    )
    reason = (
        F.when(
            F.col("_code").isNotNull() & (F.col("lead_index") > F.col("_at")),
            F.when(F.col("_code") == "deadline_exceeded", "enrichment_deadline_exceeded").otherwise(
                F.concat(F.lit("lead_resolution_"), F.col("_code"))
            ),
        )
        .when(F.col("_calls").isNull(), "lead_budget_exhausted")
        .when(F.col("_failed") > 0, "lead_resolution_request_failed")
        .otherwise("no_publishable_evidence")
    )
    unresolved = observation_signals(silent, reason).unionByName(
        observation_signals(deferred, F.col("reason"))
    )
    return stories, unresolved, calls


def prepare_queue(candidates: DataFrame, catalog: Catalog, cap: int) -> DataFrame:
    """Admitted queue rows with the fetched text kept in provenance for the later selection."""
    queue = candidate_queue(analyze_articles(candidates, catalog), cap=cap).drop("analysis")
    added = F.create_map(
        F.lit("selection_title"), compact_text("title"),
        F.lit("selection_description"), compact_text("description"),
        F.lit("selection_content"), compact_text("content"),
    )
    return queue.withColumn("provenance", _merge("provenance", added))


