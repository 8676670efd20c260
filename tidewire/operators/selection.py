"""Constrained shortlists, picked for all editions in lockstep.

Round i picks the i-th item of every edition: candidates are joined with the few picks made so
far, and one minimum per edition decides. The pool stays distributed however large an edition is,
and the number of rounds is the shortlist size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.operators.catalog import Catalog, analyze_for_selection
from tidewire.operators.clusters import collapse_story_clusters_v2, story_signature
from tidewire.operators.ranking import base_order_v1, top_k
from tidewire.settings import ChannelSettings, SelectSettings
from tidewire.workspace import Rounds

# violations in the order in which the ladder gives them up; the source cap goes last
_LADDER = ("model_family", "mentioned_entity", "primary_entity", "source_cap")


def order_key(version: str) -> Column:
    """Static selection order as one comparable struct."""
    if version == "v1":
        lead = [(-F.col("priority")).alias("a"), (-F.col("ai_topic").cast("int")).alias("b")]
    else:
        lead = [(-F.col("analysis")["relevance"]).alias("a"), (-F.col("priority")).alias("b")]
    return F.struct(
        *lead, A.trend_rank().alias("c"), (-A.trend_heat()).alias("d"), F.col("pos").cast("long").alias("pos")
    )


def _with_flag(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Add whether any row of the edition satisfies `flag`."""
    marks = df.groupBy("edition").agg(F.max(flag.cast("int")).alias(name))
    return df.join(marks, "edition")


def story_pool(df: DataFrame) -> DataFrame:
    """Qualified stories of each edition, or all stories where none qualifies."""
    rows = df.filter(A.is_story()).withColumn("qualified", A.has_enough_facts())
    rows = _with_flag(rows, F.col("qualified"), "_any")
    return rows.filter(F.col("qualified") | (F.col("_any") == 0)).drop("_any")


def edition_plan(candidates: DataFrame, limit: int, share: float, only_qualified: bool) -> DataFrame:
    """Per edition: target, source cap and the source groups to reserve, in candidate order."""
    groups = candidates.groupBy("edition", "source_group").agg(
        F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.col("qualified").cast("int")).alias("q")
    )
    reserve = groups.filter("q = 1") if only_qualified else groups
    sizes = groups.groupBy("edition").agg(F.sum("n").alias("n"))
    # only the first `limit` groups can be reserved
    heads = top_k(reserve, ["edition"], [F.col("first").asc()], limit, "_r").groupBy("edition").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "source_group"))), lambda x: x["source_group"]
        ).alias("groups")
    )
    number = reserve.groupBy("edition").agg(F.count(F.lit(1)).alias("g"))
    plan = sizes.join(heads, "edition", "left").join(number, "edition", "left")
    target = F.least(F.lit(limit).cast("long"), F.col("n"))
    cap = F.when(F.coalesce("g", F.lit(0)) >= 2, F.greatest(F.lit(1).cast("long"), F.floor(target * F.lit(share)))).otherwise(target)
    none = F.array().cast("array<string>")
    return plan.select(
        "edition",
        target.cast("int").alias("target"),
        cap.cast("int").alias("source_cap"),
        F.slice(F.coalesce("groups", none), F.lit(1), F.greatest(F.lit(1), target.cast("int"))).alias("groups"),
    )


def _times(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def _lockstep(
    candidates: DataFrame, plan: DataFrame, payload: list[str], level: Column, key: Column, relaxed: Column, limit: int
) -> DataFrame:
    """Run the rounds. `level` and `key` may use the `picked` array of the edition.

    Returns (edition, step, pos, relaxed).
    """
    spark = candidates.sparkSession
    rounds = Rounds(spark, "lockstep")
    pool = rounds.save(candidates.select("edition", "pos", "ord", *payload), "pool")
    fields = [F.col("pos").cast("long").alias("pos"), *[F.col(c) for c in payload], relaxed.alias("relaxed")]
    schema = pool.select(
        F.array(F.struct(*[F.col("pos").cast("long").alias("pos"), *[F.col(c) for c in payload], F.array().cast("array<string>").alias("relaxed")])).alias("x")
    ).schema["x"].dataType
    state = rounds.save(plan.withColumn("picked", F.array().cast(schema)))
    for step in range(limit):
        open_rows = state.filter(F.size("picked") < F.col("target"))
        reserved = F.try_element_at("groups", F.lit(step + 1))
        joined = (
            pool.join(open_rows, "edition")
            .filter(reserved.isNull() | (F.col("source_group") == reserved))
            .filter(~F.exists("picked", lambda p: p["pos"] == F.col("pos")))
            .withColumn("_level", level)
        )
        choice = joined.groupBy("edition").agg(
            F.min_by(F.struct(*fields), F.struct(F.col("_level").alias("l"), key.alias("k"))).alias("_pick")
        )
        merged = state.join(choice, "edition", "left")
        appended = F.when(F.col("_pick").isNotNull(), F.concat("picked", F.array("_pick"))).otherwise(F.col("picked"))
        previous, state = state, rounds.save(merged.select("edition", "target", "source_cap", "groups", appended.alias("picked")))
        rounds.drop(previous)
        if state.filter(F.size("picked") < F.col("target")).isEmpty():
            break
    flat = state.select("edition", F.posexplode("picked").alias("step", "p"))
    return flat.select("edition", (F.col("step") + 1).alias("step"), "p.pos", "p.relaxed")


def select_v1(df: DataFrame, limit: int = 10, share: float = 0.6) -> DataFrame:
    """Older policy: one reserved pick per qualified source, then priority fill under a source cap."""
    topic = A.ai_topic(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))
    pool = story_pool(df).withColumn("source_group", A.source_group()).withColumn("ai_topic", topic)
    pool = pool.withColumn("ord", order_key("v1"))
    plan = edition_plan(pool, limit, share, only_qualified=True)
    # same source, same counts: only its first `limit` rows can ever be chosen
    pruned = top_k(pool, ["edition", "source_group"], [F.col("ord").asc()], limit, "_r").drop("_r")
    used = _times(F.transform("picked", lambda p: p["source_group"]), F.col("source_group"))
    level = F.when(used < F.col("source_cap"), 0).otherwise(1)
    o = F.col("ord")
    key = F.struct(o["a"], o["b"], used.alias("used"), o["c"], o["d"], o["pos"])
    picks = _lockstep(pruned, plan, ["source_group"], level, key, F.array().cast("array<string>"), limit)
    rows = df.join(picks.select("edition", "pos"), ["edition", "pos"])
    return top_k(rows, ["edition"], base_order_v1(), limit, "selected_rank")


def select_v2(
    df: DataFrame, catalog: Catalog, settings: SelectSettings = SelectSettings()
) -> dict[str, DataFrame]:
    """Current policy. Returns selected rows, per-edition counters, cluster members and relaxations."""
    limit = settings.limit
    saved = Rounds(df.sparkSession, "select")
    ranked = analyze_for_selection(df, catalog).withColumn("source_group", A.source_group())
    ranked = ranked.withColumn("ord", order_key("v2"))
    ranked = saved.save(story_signature(ranked, catalog), "ranked")
    base = story_pool(ranked)
    representatives, members, clusters = collapse_story_clusters_v2(base)
    representatives = saved.save(representatives, "reps")
    core = _with_flag(representatives, F.col("analysis")["relevance"] >= 2, "_core")
    pool = core.filter((F.col("_core") == 0) | (F.col("analysis")["relevance"] >= 2)).drop("_core")
    a = F.col("analysis")
    pool = (
        pool.withColumn("primary", a["primary_entity"])
        .withColumn("entities", a["entities"])
        .withColumn("families", a["families"])
        .withColumn("topic", a["topic"])
    )
    plan = edition_plan(pool, limit, settings.source_share, only_qualified=False)
    signature = pool.withColumn("_ents", F.array_sort("entities"))
    # rows of one signature face the same constraints, so they are taken in static order
    by = ["edition", "source_group", "primary", "_ents", "families", "topic"]
    pruned = top_k(signature, by, [F.col("ord").asc()], limit, "_r").drop("_r", "_ents")

    def picked(name: str) -> Column:
        return F.transform("picked", lambda p: p[name])

    used = _times(picked("source_group"), F.col("source_group"))
    mentioned = F.flatten(picked("entities"))
    families = F.flatten(picked("families"))
    violations = {
        "source_cap": used >= F.col("source_cap"),
        "primary_entity": (F.col("primary") != "")
        & (_times(picked("primary"), F.col("primary")) >= settings.max_primary),
        "mentioned_entity": F.exists("entities", lambda e: _times(mentioned, e) >= settings.max_mentioned),
        "model_family": F.exists("families", lambda f: _times(families, f) >= settings.max_family),
    }
    level = F.lit(0)
    for rung, name in enumerate(_LADDER, 1):
        level = F.when(violations[name], rung).otherwise(level)
    relaxed = F.array_compact(
        F.array(*[F.when(violations[n], F.lit(n)) for n in sorted(violations)])
    )
    o = F.col("ord")
    penalty = F.greatest(F.lit(0), _times(picked("topic"), F.col("topic")) - 1)
    key = F.struct(o["a"], o["b"], penalty.alias("penalty"), used.alias("used"), o["c"], o["d"], o["pos"])
    payload = ["source_group", "primary", "entities", "families", "topic"]
    picks = saved.save(_lockstep(pruned, plan, payload, level, key, relaxed, limit), "picks")
    selected = top_k(
        ranked.join(picks.select("edition", "pos"), ["edition", "pos"]),
        ["edition"], [F.col("ord").asc()], limit, "selected_rank",
    ).withColumn("article_id", F.concat(F.lit("a"), F.col("pos")))
    counts = (
        ranked.groupBy("edition")
        .agg(
            F.count(F.lit(1)).alias("input_count"),
            F.count_if(A.has_enough_facts()).alias("qualified_count"),
            F.count_if(a["relevance"] >= 2).alias("core_ai_input_count"),
        )
        .join(representatives.groupBy("edition").agg(F.count(F.lit(1)).alias("candidate_story_count")), "edition", "left")
        .join(picks.groupBy("edition").agg(F.count(F.lit(1)).alias("selected_count")), "edition", "left")
        .join(
            members.groupBy("edition").agg(F.count(F.lit(1)).alias("duplicate_story_rejected_count")), "edition", "left"
        )
        .na.fill(0, ["candidate_story_count", "selected_count", "duplicate_story_rejected_count"])
        .withColumn("selection_policy", F.lit(settings.policy))
        .withColumn("catalog_schema_version", F.lit(catalog.schema_version))
        .withColumn("catalog_as_of", F.lit(catalog.as_of))
    )
    relaxations = picks.filter(F.size("relaxed") > 0).select(
        "edition", "step", F.concat(F.lit("a"), F.col("pos")).alias("article_id"), F.col("relaxed").alias("constraints")
    )
    return {
        "selected": selected,
        "counts": counts,
        "members": members,
        "clusters": clusters,
        "relaxations": relaxations,
    }


def selection_counts(selected: DataFrame) -> DataFrame:
    """(edition, dimension, key, n) over source, entity, mention, family, topic and region."""
    a = F.col("analysis")

    def dim(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("key")))

    pairs = F.concat(
        dim("source", F.array("source_group")),
        dim("primary_entity", F.filter(F.array(a["primary_entity"]), lambda v: v != "")),
        dim("mentioned_entity", a["entities"]),
        dim("model_family", a["families"]),
        dim("topic", F.array(a["topic"])),
        dim("region", a["regions"]),
    )
    flat = selected.select("edition", F.explode(pairs).alias("d"))
    return flat.groupBy("edition", "d.dimension", "d.key").agg(F.count(F.lit(1)).alias("n"))


# ---- channel quota selection --------------------------------------------------------------------

_QUOTA_SCHEMA = (
    "edition date, channel string, rank int, selected_no int, reason string"
)


def select_channel_quota(items: DataFrame, settings: ChannelSettings = ChannelSettings()) -> DataFrame:
    """Quota per core channel, then the supplemental channel, then fill; first refusal reason per item.

    The channel prefix is cut first, so an edition has at most channels x per_channel_limit rows,
    a number fixed by the settings, before it becomes one group.
    """
    from tidewire.functions.text import entity_for_title, normalize_title_identity
    from tidewire.functions.urls import canonical_url_identity
    from tidewire.operators.ranking import rank_channel

    channels = [*settings.core_channels, settings.supplemental_channel]
    rows = rank_channel(items.filter(F.col("channel").isin(*channels)), settings.per_channel_limit)
    norm = normalize_title_identity("title")
    url = canonical_url_identity("url")
    rows = rows.select(
        "edition",
        "channel",
        F.col("rank").cast("int").alias("rank"),
        F.col("channel_pos").cast("int").alias("channel_pos"),
        norm.alias("norm"),
        F.when(url != "", url).otherwise(norm).alias("story_key"),
        entity_for_title("title", settings.entity_keywords).alias("entity"),
    )
    quotas = [settings.core_quota] * len(settings.core_channels) + [settings.supplemental_quota]
    limit, entity_limit = settings.max_articles, settings.entity_limit

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        return _fill_quota(group, channels, quotas, limit, entity_limit)

    return rows.groupBy("edition").applyInPandas(pick, _QUOTA_SCHEMA)


def _fill_quota(group: pd.DataFrame, channels, quotas, limit, entity_limit) -> pd.DataFrame:
    from difflib import SequenceMatcher

    queues = {c: group[group.channel == c].sort_values("channel_pos").to_dict("records") for c in channels}
    chosen: list[dict] = []
    fate: dict[tuple, tuple] = {}
    per_entity: dict[str, int] = {}

    def repeats(norm: str, other: str) -> bool:
        if not norm or not other:
            return False
        if norm == other:
            return True
        return min(len(norm), len(other)) >= 18 and SequenceMatcher(None, norm, other).ratio() >= 0.9

    def refuse(row: dict) -> str | None:
        if len(chosen) >= limit:
            return "max_articles"
        if not row["story_key"] or any(
            row["story_key"] == c["story_key"] or repeats(row["norm"], c["norm"]) for c in chosen
        ):
            return "duplicate_story"
        if row["entity"] and per_entity.get(row["entity"], 0) >= entity_limit:
            return "entity_limit"
        return None

    def offer(row: dict) -> bool:
        spot = (row["channel"], row["rank"])
        if spot in fate:
            return False
        reason = refuse(row)
        if reason is None:
            chosen.append(row)
            if row["entity"]:
                per_entity[row["entity"]] = per_entity.get(row["entity"], 0) + 1
        fate[spot] = (len(chosen) if reason is None else None, reason)
        return reason is None

    for channel, quota in zip(channels, quotas):
        taken = 0
        for row in queues[channel]:
            if taken >= quota:
                break
            taken += offer(row)
    for channel in channels:
        for row in queues[channel]:
            offer(row)
    out = pd.DataFrame(
        [(c, r, n, why) for (c, r), (n, why) in fate.items()],
        columns=["channel", "rank", "selected_no", "reason"],
    )
    out.insert(0, "edition", group["edition"].iloc[0])
    out["selected_no"] = out["selected_no"].astype("Int32")
    return out
