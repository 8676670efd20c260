"""Edition files on shared storage: one JSON or Markdown file per date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.schema import ARTICLE

_ITEM_FIELDS = "article_id title summary url why_it_matters source_label published_at confidence".split()


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def edition_schema() -> T.StructType:
    articles = T.StructType([f for f in ARTICLE.fields if f.name not in ("edition", "pos")])
    summary = T.StructType(
        [
            T.StructField("items", T.ArrayType(_strings(_ITEM_FIELDS))),
            *_strings(["discussion_topic", "policy", "provider", "model"]).fields,
        ]
    )
    return (
        T.StructType()
        .add("date", "string")
        .add("first", "long")
        .add("articles", T.ArrayType(articles))
        .add("summary", summary)
        .add("_corrupt_record", "string")
    )


def _edition_column():
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.[a-z]+$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/edition=(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return F.when(stem != "", stem.try_cast("date")).when(folder != "", folder.try_cast("date"))


def read_editions(
    spark: SparkSession, path: str, schema: T.StructType | None = None, skip_corrupt: bool = True, lines: bool = False
) -> DataFrame:
    """One row per edition file whose stem is a date; corrupt files are skipped or kept with the raw text.

    With `lines`, files below folders edition=<date> with one record per line, each a bounded part of an edition, as
    sinks.editions.write_edition_json writes them; a record's `first` counts the articles before it.
    """
    reader = spark.read.schema(schema or edition_schema()).option("multiLine", not lines).option("mode", "PERMISSIVE")
    reader = reader.option("recursiveFileLookup", lines)
    rows = reader.json(path).withColumn("edition", _edition_column()).filter("edition is not null")
    if skip_corrupt and "_corrupt_record" in rows.columns:
        rows = rows.filter("_corrupt_record is null").drop("_corrupt_record")
    return rows


def edition_articles(editions: DataFrame) -> DataFrame:
    before = F.coalesce("first", F.lit(0)) if "first" in editions.columns else F.lit(0)
    return editions.select("edition", before.alias("_before"), F.posexplode("articles").alias("_i", "a")).select(
        "edition", (F.col("_before") + F.col("_i") + 1).cast("long").alias("pos"), "a.*"
    )


def edition_items(editions: DataFrame) -> DataFrame:
    return editions.select("edition", F.posexplode("summary.items").alias("_i", "s")).select(
        "edition", (F.col("_i") + 1).alias("item_no"), "s.*"
    )


def read_markdown_editions(spark: SparkSession, path: str) -> DataFrame:
    """(edition, title, date, body) from files with an optional front-matter block."""
    rows = spark.read.text(path, wholetext=True).withColumn("stem", F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1))
    has = F.col("value").startswith("---") & (F.size(F.split("value", "---", 3)) == 3)
    parts = F.split("value", "---", 3)
    lines = F.filter(F.split(parts[1], "\n"), lambda x: x.contains(":"))
    keys = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^([^:]*):", 1)))
    values = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)))
    meta = F.map_from_arrays(keys, values)
    rows = rows.withColumn("meta", F.when(has, meta)).withColumn("body", F.when(has, F.trim(parts[2])).otherwise(F.col("value")))
    return rows.select(
        F.col("stem").try_cast("date").alias("edition"),
        F.coalesce(F.try_element_at("meta", F.lit("title")), F.col("stem")).alias("title"),
        F.coalesce(F.try_element_at("meta", F.lit("date")), F.col("stem")).alias("date"),
        "body",
    )
