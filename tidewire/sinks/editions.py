"""Edition tables, Markdown files, change detection, retention and run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.reader import public_text
from tidewire.functions.text import text

#: hashes that are joined into one at a time
SPAN = 1_000
#: articles of a JSON record
RECORD_ROWS = 200


def write_edition(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the editions present in df and leave all others alone."""
    (
        df.repartition("edition", F.pmod(F.xxhash64("pos") if "pos" in df.columns else F.lit(0), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("edition")
        .format(fmt)
        .save(path)
    )


def render_markdown(items: DataFrame, topics: DataFrame, attribution: DataFrame | None = None) -> DataFrame:
    """(edition, body): numbered public sentences, topic line and attribution.

    items: (edition, item_no, summary, why_it_matters), at most the shortlist size per edition.
    """
    fact, impact = public_text("summary", list_item=True), public_text("why_it_matters")
    line = F.concat(F.col("item_no").cast("string"), F.lit(". "), fact, impact)
    lines = items.groupBy("edition").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_no", line.alias("l")))), lambda x: x["l"]).alias("_lines")
    )
    out = topics.join(lines, "edition", "left")
    body = F.when(F.col("_lines").isNull(), "今日没有达到证据门槛的主新闻。").otherwise(F.array_join("_lines", "\n"))
    out = out.withColumn("body", F.concat(body, F.lit("\n\n💬 互动话题："), public_text("discussion_topic")))
    if attribution is not None:
        out = out.join(attribution.select("edition", "label_line"), "edition", "left")
        out = out.withColumn(
            "body", F.when(text("label_line") != "", F.concat("body", F.lit("\n\n"), F.col("label_line"))).otherwise(F.col("body"))
        )
    return out.select("edition", "body")


def with_front_matter(df: DataFrame, title: str = "AI 新闻日报") -> Column:
    day = F.col("edition").cast("string")
    return F.concat(F.lit(f"---\ntitle: {title} "), day, F.lit("\ndate: "), day, F.lit("\n---\n\n"), F.col("body"))


def write_markdown_edition(df: DataFrame, path: str) -> None:
    """One text file per edition directory."""
    (
        df.select("edition", with_front_matter(df).alias("value"))
        .repartition("edition")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\n")
        .partitionBy("edition")
        .text(path)
    )


def edition_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(edition, row_count, fingerprint) independent of row order and of edition size.

    Rows are hashed one by one and the hashes are folded, so no edition is collected.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)

    def fold(start: int) -> Column:
        # 15 hex digits fit a long; the sum is exact as a decimal
        return F.sum(F.conv(F.substring("_h", start, 15), 16, 10).cast("decimal(38,0)"))

    hashed = df.select("edition", row.alias("_h"))
    return hashed.groupBy("edition").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sha2(F.concat_ws("-", fold(1).cast("string"), fold(16).cast("string"), fold(31).cast("string"), fold(46).cast("string")), 256).alias("fingerprint"),
    )


def publish_if_changed(new: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(edition, changed) over the editions of `new`."""
    a = edition_fingerprint(new, columns).select("edition", F.col("fingerprint").alias("_new"))
    b = edition_fingerprint(current, columns).select("edition", F.col("fingerprint").alias("_old"))
    joined = a.join(b, "edition", "left")
    return joined.select("edition", (~F.col("_new").eqNullSafe(F.col("_old"))).alias("changed"))


def retention_split(editions: DataFrame, keep_days: int, reference: Column | str) -> tuple[DataFrame, DataFrame]:
    """(editions to keep, editions to archive); a filter on the partition column."""
    if keep_days < 1:
        raise ValueError("keep_days must be at least 1")
    ref = F.lit(reference).cast("date") if isinstance(reference, str) else reference
    first = F.date_sub(ref, keep_days - 1)
    return editions.filter(F.col("edition") >= first), editions.filter(F.col("edition") < first)


def archive_manifest(files: DataFrame) -> DataFrame:
    """files: (edition, file). A date has a handful of files."""
    return files.groupBy("edition").agg(
        F.concat(F.lit("daily-report-"), F.first("edition").cast("string"), F.lit(".tar.gz")).alias("asset_name"),
        F.array_sort(F.collect_list("file")).alias("files"),
        F.count(F.lit(1)).alias("file_count"),
    )


def write_run_manifest(runs: DataFrame, path: str) -> None:
    """Append status rows; readers take the newest per run."""
    runs.write.mode("append").parquet(path)


def latest_run_status(history: DataFrame) -> DataFrame:
    """history: (run_id, edition, status, updated_at, reason)."""
    newest = history.groupBy("run_id").agg(
        F.max_by(F.struct("edition", "status", "reason", "updated_at"), "updated_at").alias("m")
    )
    return newest.select("run_id", "m.*")


def _hash_of_ranges(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """One hash for each SPAN consecutive places: (*by, at, value) with `at` divided by SPAN."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])
    span = F.floor(F.col(at) / SPAN).alias("_span")
    found = rows.groupBy(*by, span).agg(F.sha2(F.array_join(ordered, ","), 256).alias(value))
    return found.withColumnRenamed("_span", at)


def fingerprint_input(articles: DataFrame, columns: list[str], prompt: str) -> DataFrame:
    """(edition, input_fingerprint, prompt_fingerprint) of editions of any size, in the order of selected_rank.

    An order-keeping hash tree: rows are hashed, then SPAN row hashes at a time, then SPAN of those, so that no value holds more than
    SPAN hashes up to SPAN^3 rows. A row is its columns in name order, each with its length before it, a null as '-'.
    """
    cells = [F.col(c).cast("string") for c in sorted(columns)]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]), 256)
    hashed = articles.select("edition", (F.col("selected_rank") - 1).alias("_at"), row.alias("_h"))
    for _ in range(3):
        hashed = _hash_of_ranges(hashed, ["edition"], "_at", "_h")
    top = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda x: x["_h"])
    return hashed.groupBy("edition").agg(
        F.sha2(F.array_join(top, ","), 256).alias("input_fingerprint"), F.sha2(F.lit(prompt), 256).alias("prompt_fingerprint")
    )


def write_edition_json(articles: DataFrame, path: str, order: str = "pos") -> None:
    """Editions as JSON lines of at most RECORD_ROWS articles each: date, first (articles before them) and articles.

    articles: (edition, `order` from 1 on without gaps, ...). A record is the unit of work, so an edition of any size is many
    records, over as many files as the shuffle has partitions.
    """
    item = F.struct(*[F.col(f"`{c}`") for c in articles.columns if c not in ("edition", order)])
    part = F.floor((F.col(order) - 1) / RECORD_ROWS).alias("_part")
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(item).alias("_j")))), lambda x: x["_j"])
    record = F.concat(
        F.lit('{"date":"'), F.col("edition").cast("string"), F.lit('","first":'), (F.col("_part") * RECORD_ROWS).cast("string"),
        F.lit(',"articles":['), F.array_join("_held", ","), F.lit("]}"),
    )
    records = articles.groupBy("edition", part).agg(held.alias("_held")).select("edition", record.alias("value"))
    (
        records.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\n")
        .partitionBy("edition")
        .text(path)
    )


def markdown_lines(items: DataFrame, topics: DataFrame, title: str = "AI 新闻日报") -> DataFrame:
    """(edition, line_no, line): the Markdown page of editions of any size as rows: front matter, numbered sentences, topic.

    items: (edition, item_no, summary, why_it_matters); topics: (edition, discussion_topic).
    """
    day = F.col("edition").cast("string")
    last = F.lit(1 << 62)
    head = [F.lit("---"), F.concat(F.lit(f"title: {title} "), day), F.concat(F.lit("date: "), day), F.lit("---"), F.lit("")]
    frame = [F.struct(F.lit(i - len(head)).cast("long").alias("line_no"), x.alias("line")) for i, x in enumerate(head)]
    foot = [F.lit(""), F.concat(F.lit("💬 互动话题："), public_text("discussion_topic"))]
    frame += [F.struct((last + i).cast("long").alias("line_no"), x.alias("line")) for i, x in enumerate(foot)]
    around = topics.select("edition", F.explode(F.array(*frame)).alias("l")).select("edition", "l.*")
    fact, impact = public_text("summary", list_item=True), public_text("why_it_matters")
    line = F.concat(F.col("item_no").cast("string"), F.lit(". "), fact, impact)
    none = topics.select("edition").join(items.select("edition").distinct(), "edition", "left_anti")
    none = none.select("edition", F.lit(1).cast("long").alias("line_no"), F.lit("今日没有达到证据门槛的主新闻。").alias("line"))
    return around.unionByName(items.select("edition", F.col("item_no").cast("long").alias("line_no"), line.alias("line"))).unionByName(none)


def write_markdown_lines(lines: DataFrame, path: str) -> None:
    """Text files per edition directory; in the order of their names they hold the page's lines in order."""
    (
        lines.repartitionByRange("edition", "line_no")
        .sortWithinPartitions("edition", "line_no")
        .select("edition", F.regexp_replace("line", "\n", " ").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\n")
        .partitionBy("edition")
        .text(path)
    )
