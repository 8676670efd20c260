"""Exact and near-exact deduplication inside an edition and against recent editions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import compact_text, normalize_title_identity, normalize_title_search
from tidewire.functions.urls import article_key, canonical_story_url, canonical_url_search
from tidewire.operators.greedy import first_fit
from tidewire.operators.similarity import repeated_titles
from tidewire.workspace import save_once


def dedupe_exact(df: DataFrame) -> DataFrame:
    """One row per (edition, key): highest priority, then first input row."""
    keyed = df.withColumn("article_key", article_key(F.col("title"), F.col("link")))
    w = W.partitionBy("edition", "article_key").orderBy(F.col("priority").desc(), "pos")
    return keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def mark_story_duplicates(df: DataFrame) -> DataFrame:
    """Add `kept` and `matched_pos` (the kept row a dropped row repeats).

    In priority order a row is kept iff no kept row has its key or a same-story title. Rows that
    share key and title always follow the first of them, so only that one enters the rounds.
    """
    order = F.struct((-F.col("priority")).alias("p"), F.col("pos").cast("long").alias("pos"))
    rows = df.withColumn("_key", article_key(F.col("title"), F.col("link"))).withColumn(
        "_norm", normalize_title_identity("title")
    )
    # keys and normal forms are dear and read for the titles, the nodes, the rounds and the result
    rows = save_once(rows, "stories")
    nodes = rows.groupBy("edition", "_key", "_norm").agg(F.min(order).alias("ord"))
    hubs = F.array_compact(
        F.array(
            F.concat(F.lit("k:"), F.col("_key")),
            F.when(F.col("_norm") != "", F.concat(F.lit("t:"), F.md5("_norm"))),
        )
    )
    members = nodes.select("edition", F.col("ord.pos").alias("node"), "ord", F.explode(hubs).alias("hub"))
    own = members.select("edition", F.col("hub").alias("later"), F.col("hub").alias("earlier")).distinct()
    titles = nodes.filter("_norm <> ''").groupBy("edition", F.col("_norm").alias("norm")).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    cross = repeated_titles(titles).select(
        "edition",
        F.concat(F.lit("t:"), F.md5("later")).alias("later"),
        F.concat(F.lit("t:"), F.md5("earlier")).alias("earlier"),
    )
    decided = first_fit(members, own.unionByName(cross), "dedupe")
    fate = nodes.select("edition", "_key", "_norm", F.col("ord.pos").alias("node")).join(
        decided.select("edition", "node", F.col("kept").alias("_kept"), F.col("match.pos").alias("_match")),
        ["edition", "node"],
    )
    out = rows.join(fate, ["edition", "_key", "_norm"])
    first = F.col("pos") == F.col("node")
    return (
        out.withColumn("kept", first & F.col("_kept"))
        .withColumn(
            "matched_pos",
            F.when(F.col("_kept") & ~first, F.col("node")).otherwise(F.col("_match")),
        )
        .drop("_key", "_norm", "node", "_kept", "_match")
    )


def dedupe_stories(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped rows with matched_pos)."""
    marked = mark_story_duplicates(df)
    return (
        marked.filter("kept").drop("kept", "matched_pos"),
        marked.filter(~F.col("kept")).drop("kept"),
    )


def mark_recent_exact(df: DataFrame, history: DataFrame, days: int = 3) -> DataFrame:
    """Flag rows whose URL was a selected item of one of the previous `days` editions.

    history: (edition, url) of selected items. Each item is copied to the editions it can affect,
    which keeps the day range an equi-join.
    """
    window = history.select(
        F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_d"),
        F.col("edition").alias("_e"),
        canonical_story_url("url").alias("_url"),
    ).filter("_url <> ''")
    seen = window.select(F.date_add("_e", F.col("_d")).alias("edition"), "_url").distinct()
    keyed = df.withColumn("_url", F.nullif(canonical_story_url("link"), F.lit("")))
    joined = keyed.join(seen.withColumn("_hit", F.lit(True)), ["edition", "_url"], "left")
    return (
        joined.withColumn("recent_duplicate", F.coalesce("_hit", F.lit(False)))
        .withColumnRenamed("_url", "url_key")
        .drop("_hit")
    )


def recent_exact_antijoin(
    df: DataFrame, history: DataFrame, days: int = 3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed with url_key, days that had an edition)."""
    marked = mark_recent_exact(df, history, days)
    kept = marked.filter(~F.col("recent_duplicate")).drop("recent_duplicate", "url_key")
    removed = marked.filter("recent_duplicate").select(
        "edition",
        "pos",
        compact_text("title").alias("title"),
        "url_key",
        F.lit("recent_exact_url").alias("reason"),
    )
    have = history.select(F.col("edition").alias("checked_day")).distinct()
    checked = (
        df.select("edition").distinct()
        .withColumn("checked_day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda d: F.date_sub("edition", d))))
        .join(have, "checked_day", "left_semi")
        .select("edition", "checked_day")
    )
    return kept, removed, checked


def flag_existing(
    results: DataFrame, base: DataFrame, extra: DataFrame | None = None
) -> DataFrame:
    """Add duplicate_existing: title or URL already known in the edition.

    base and extra have (edition, title, url). Empty keys count for base rows only.
    """
    known_titles = base.select("edition", normalize_title_search("title").alias("_t"))
    known_urls = base.select("edition", canonical_url_search("url").alias("_u"))
    if extra is not None:
        known_titles = known_titles.union(
            extra.select("edition", normalize_title_search("title").alias("_t")).filter("_t <> ''")
        )
        known_urls = known_urls.union(
            extra.select("edition", canonical_url_search("url").alias("_u")).filter("_u <> ''")
        )
    keyed = results.withColumn("_t", normalize_title_search("title")).withColumn(
        "_u", canonical_url_search("url")
    )
    return (
        keyed.join(known_titles.distinct().withColumn("_kt", F.lit(True)), ["edition", "_t"], "left")
        .join(known_urls.distinct().withColumn("_ku", F.lit(True)), ["edition", "_u"], "left")
        .withColumn("duplicate_existing", F.coalesce("_kt", "_ku", F.lit(False)))
        .drop("_t", "_u", "_kt", "_ku")
    )
