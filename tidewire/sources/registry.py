"""Named sources, their union in configured order and one outcome row per source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.ranking import global_rank, top_k
from tidewire.schema import conform_articles

Parser = Callable[[DataFrame], DataFrame]


def union_sources(
    editions: DataFrame,
    sources: dict[str, DataFrame],
    enabled: dict[str, bool],
    caps: dict[str, int] | None = None,
    default_cap: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(articles numbered across sources, source_runs). Unknown enabled names become failed runs.

    editions: (edition), the runs to report on. Caps keep the first rows of a source per edition; without one all rows
    stay. `beyond_caps` returns what caps leave out.
    """
    caps = caps or {}
    names = [n for n, on in enabled.items() if on]
    parts, fetched = [], []
    for ordinal, name in enumerate(names):
        if name not in sources:
            continue
        rows = conform_articles(sources[name]).withColumn("source_ordinal", F.lit(ordinal))
        rows = rows.withColumn("_source_name", F.lit(name))
        fetched.append(rows.select("edition", "_source_name"))
        cap = caps.get(name, default_cap)
        parts.append(rows if cap is None else top_k(rows, ["edition"], [F.col("pos").asc()], cap, "_r").drop("_r"))
    plan = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(n in sources).alias("known")) for n in names])
    runs = editions.select("edition").distinct().select("edition", F.inline(plan))
    if not parts:
        empty = conform_articles(editions.limit(0))
        return empty, _outcomes(runs.withColumn("fetched_count", F.lit(0)).withColumn("accepted_count", F.lit(0)))
    every, seen = parts[0], fetched[0]
    for p, f in zip(parts[1:], fetched[1:]):
        every, seen = every.unionByName(p), seen.unionByName(f)

    def count(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("edition", F.col("_source_name").alias("source")).agg(F.count(F.lit(1)).alias(out))

    runs = (
        runs.join(count(seen, "fetched_count"), ["edition", "source"], "left")
        .join(count(every, "accepted_count"), ["edition", "source"], "left")
        .na.fill(0, ["fetched_count", "accepted_count"])
    )
    order = [F.col("source_ordinal").asc(), F.col("pos").asc()]
    numbered = global_rank(every, ["edition"], order, "_no")
    numbered = numbered.withColumn("pos", F.col("_no").cast("long")).drop("_no", "source_ordinal", "_source_name")
    return numbered, _outcomes(runs)


def beyond_caps(
    sources: dict[str, DataFrame], enabled: dict[str, bool], caps: dict[str, int], default_cap: int | None = None
) -> DataFrame:
    """Rows that the caps of `union_sources` leave out, with the reason."""
    cut = None
    for name, on in enabled.items():
        cap = caps.get(name, default_cap)
        if not on or name not in sources or cap is None:
            continue
        rows = conform_articles(sources[name])
        kept = top_k(rows, ["edition"], [F.col("pos").asc()], cap, "_r").select("edition", "pos")
        over = rows.join(kept, ["edition", "pos"], "left_anti").withColumns({"source_name": F.lit(name), "reason": F.lit("source_cap")})
        cut = over if cut is None else cut.unionByName(over)
    if cut is None:
        raise ValueError("no enabled source has a cap")
    return cut


def _outcomes(runs: DataFrame) -> DataFrame:
    status = (
        F.when(~F.col("known"), "failed")
        .when(F.col("accepted_count") > 0, "ok")
        .when(F.col("fetched_count") > 0, "degraded")
        .otherwise("empty")
    )
    none = F.array().cast("array<string>")
    return runs.withColumn("status", status).select(
        "edition",
        "source",
        "status",
        "fetched_count",
        "accepted_count",
        F.when(~F.col("known"), "configuration").alias("error_kind"),
        F.when(~F.col("known"), "unknown enabled source").alias("error_message"),
        F.when(F.col("status") == "degraded", F.array(F.lit("source_empty_after_fetch"))).otherwise(none).alias("diagnostic_codes"),
    )


class SourceRegistry:
    """Parsers by name: the extension point for new feeds."""

    def __init__(self, parsers: dict[str, Parser] | None = None):
        self._parsers = dict(parsers or {})

    def register(self, name: str, parser: Parser) -> None:
        self._parsers[name] = parser

    def get(self, name: str) -> Parser | None:
        return self._parsers.get(name)

    def parse(self, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {n: self._parsers[n](df) for n, df in raw.items() if n in self._parsers}
