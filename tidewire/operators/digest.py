"""Summary items: offline sentences, drafts joined to sources, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import reader as R
from tidewire.functions.text import strip, text, visible_chars
from tidewire.operators.ranking import top_k


def best_offline_sentence(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one sentence per article, articles without a usable one).

    Valid sentences compete by length class, distance to the preferred range and origin
    (description before headline); the earlier candidate wins ties.
    """
    middle = (R.TARGET_MIN + R.TARGET_MAX) // 2
    heads = F.array(F.struct(F.lit(1).alias("origin"), R.headline_sentence("title", "description").alias("s")))
    bodies = F.transform(R.source_sentences("description"), lambda s: F.struct(F.lit(0).alias("origin"), s.alias("s")))
    rows = articles.select("edition", "pos", F.posexplode(F.concat(heads, bodies)).alias("no", "c"))
    rows = rows.select("edition", "pos", "no", "c.origin", F.col("c.s").alias("sentence"))
    rows = rows.filter(F.size(R.reader_issues("sentence")) == 0).withColumn("n", visible_chars("sentence"))
    n = F.col("n")
    rank = F.struct(
        F.when(n.between(R.TARGET_MIN, R.TARGET_MAX), 0).when(n > R.TARGET_MAX, 1).otherwise(2).alias("cls"),
        F.when(n.between(R.TARGET_MIN, R.TARGET_MAX), F.abs(n - middle))
        .when(n > R.TARGET_MAX, n - R.TARGET_MAX)
        .otherwise(R.TARGET_MIN - n)
        .alias("gap"),
        F.col("origin"),
        F.col("no"),
    )
    best = rows.groupBy("edition", "pos").agg(F.min_by("sentence", rank).alias("sentence"))
    errors = articles.select("edition", "pos", "title").join(best, ["edition", "pos"], "left_anti")
    return best, errors


def join_summary_items(drafts: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items bound to local title, URL, label, time and confidence; drafts with an unknown id).

    drafts: (edition, item_no, article_id, summary, why_it_matters).
    """
    def flat(name: str):
        return strip(F.replace(text(name), F.lit("\n"), F.lit(" ")))

    local = articles.select(
        "edition",
        F.col("article_id").alias("_id"),
        flat("title").alias("title"),
        strip("link").alias("url"),
        A.source_label("source", "link").alias("source_label"),
        strip("publish_time").alias("published_at"),
        F.coalesce(F.nullif(strip("confidence"), F.lit("")), F.lit("reported")).alias("confidence"),
    )
    rows = drafts.withColumn("_id", strip("article_id"))
    items = rows.join(local, ["edition", "_id"]).select(
        "edition", "item_no", F.col("_id").alias("article_id"), "title", flat("summary").alias("summary"), "url",
        flat("why_it_matters").alias("why_it_matters"), "source_label", "published_at", "confidence",
    )
    errors = rows.join(local.select("edition", "_id"), ["edition", "_id"], "left_anti").select(
        "edition", "item_no", "article_id"
    )
    return items, errors


def source_attribution(items: DataFrame, articles: DataFrame) -> DataFrame:
    """(edition, label_line): labels of the selected items in first-seen order."""
    labels = articles.select("edition", "article_id", A.source_label("source", "link").alias("label"))
    rows = items.select("edition", "article_id", "item_no").join(labels, ["edition", "article_id"])
    first = rows.filter("label <> ''").groupBy("edition", "label").agg(F.min("item_no").alias("no"))
    # at most one label per shortlist slot
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "label"))), lambda x: x["label"])
    return first.groupBy("edition").agg(
        F.concat(F.lit("入选来源："), F.array_join(ordered, "、"), F.lit("。")).alias("label_line")
    )


def offline_items(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deterministic summary items in selection order, selected articles without a sentence)."""
    best, errors = best_offline_sentence(selected)
    items = selected.join(best, ["edition", "pos"]).select(
        "edition",
        F.col("selected_rank").alias("item_no"),
        "article_id",
        strip(F.replace(text("title"), F.lit("\n"), F.lit(""))).alias("title"),
        F.col("sentence").alias("summary"),
        text("link").alias("url"),
        F.lit("").alias("why_it_matters"),
        A.source_label("source", "link").alias("source_label"),
        strip("publish_time").alias("published_at"),
        F.coalesce(F.nullif(strip("confidence"), F.lit("")), F.lit("reported")).alias("confidence"),
    )
    return items, errors


def first_items(items: DataFrame, k: int) -> DataFrame:
    return top_k(items, ["edition"], [F.col("item_no").asc()], k, "_r").drop("_r")
