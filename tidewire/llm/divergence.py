"""How sources of a language differ from each other and from the language: exact divergences by count-cell ranking.

Terms are runs of letters, where a letter is a-z, A-Z (lower-cased) or any character from U+0080. A language keeps the terms in at
least LEAST_DOCUMENTS of its documents. A group (lang, source) gives each kept term the share p = 1 + floor(SCALE * (count + 1) /
(N + V)), and so does the language. The divergence of p from q is f = floor((p - q)^2 / q).

f depends on counts only, so it is evaluated per cell of equal counts and never per term:
- term part: terms are grouped by (count in the group, count in the language). Cells of equal f are merged, ranked by cumulative
  multiplicity, and only cells that reach the report's ranks are expanded into terms, in UTF-8 order.
- pair part: for two groups the terms are grouped by (count, count). Terms that one or both groups lack need no rows: with f(a, b)
  - f(a, 0) - f(0, b) + f(0, 0) per cell of common terms, the rest follows from each group's own count histogram.

Counting happens in the tasks before the one shuffle of terms, so a source with a third of all rows, or a word of every text,
is a few rows a task. A term's entries are bounded by the number of sources. All arithmetic is on integers (decimals where a
product may pass 64 bits).

Nulls: a null text, lang or source counts as ''. Empty texts and languages without kept terms: their groups have pair rows of value 0
(the former by the empty counts) and no term rows. Repeated rows are documents of their own. Ties: equal values rank by UTF-8 item.
An empty table gives no rows. Further columns are ignored. Texts are used whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.words import LOWER, text_blocks, words_of
from tidewire.workspace import Rounds

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
#: ranks of the term part
TOP = 200
#: rows that a task counts together before it passes them on
HELD_ROWS = 600_000
HELD_PAIRS = 3_000_000

_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False


def term_counts_of_block(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
    """(group, term, occurrences, rows with it) of a run of rows; groups: one number per row."""
    words = words_of(raw, offsets, space=_OTHER)
    ends = np.cumsum(words.ends - words.starts)
    begin = np.concatenate([[0], ends]).astype(np.int64)
    letters = LOWER[raw[~_OTHER[raw]]]
    terms = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(begin), pa.py_buffer(letters))
    coded = terms.dictionary_encode()
    width = max(1, len(coded.dictionary))
    rows = np.repeat(np.arange(len(words)), np.diff(words.first))
    in_row, n = np.unique(rows * width + np.asarray(coded.indices).astype(np.int64), return_counts=True)
    in_group, at = np.unique(groups[in_row // width] * width + in_row % width, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(in_group)).astype(np.int64)
    rows_with = np.bincount(at, minlength=len(in_group)).astype(np.int64)
    return in_group // width, coded.dictionary.take(pa.array(in_group % width)), total, rows_with


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "df"]
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, raw, offsets in text_blocks(batch.column(2)):
            known: dict[tuple[str, str], int] = {}
            groups = np.array([known.setdefault(k, len(known)) for k in zip(langs[lo:hi], sources[lo:hi], strict=True)], np.int64)
            group, term, n, df = term_counts_of_block(raw, offsets, groups)
            lang = pa.array([k[0] for k in known], pa.large_string()).take(pa.array(group))
            source = pa.array([k[1] for k in known], pa.large_string()).take(pa.array(group))
            held.append(pa.table([lang, source, term, pa.array(n), pa.array(df)], names))
            rows += len(n)
            if rows >= HELD_ROWS:
                table = _added(held, names)
                held, rows = [table], len(table)
                # terms that hardly repeat are passed on; those that do stay for the next round
                if rows >= HELD_ROWS // 2:
                    yield from table.to_batches(50_000)
                    held, rows = [], 0
    if held:
        yield from _added(held, names).to_batches(50_000)


def _added(tables: list[pa.Table], names: list[str]) -> pa.Table:
    table = pa.concat_tables(tables)
    return table.group_by(names[:3]).aggregate([("n", "sum"), ("df", "sum")]).select([*names[:3], "n_sum", "df_sum"]).rename_columns(names)


def _pair_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of terms by (lang, source, other, count, other count), source < other, of a task's terms."""
    names: list[str] = []
    known: dict[str, int] = {}

    def coded(column: pa.Array) -> np.ndarray:
        found = column.dictionary_encode()
        codes = []
        for name in found.dictionary.to_pylist():
            if name not in known:
                known[name] = len(names)
                names.append(name)
            codes.append(known[name])
        return np.array(codes, np.int64)[np.asarray(found.indices)]

    keys = ["lang", "source", "other", "a", "b"]
    held: list[pa.Table] = []
    size = 0

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(keys).aggregate([("m", "sum")]).select([*keys, "m_sum"]).rename_columns([*keys, "m"])

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        text = pa.array(names, pa.string())
        columns = [text.take(table.column(k).combine_chunks()) if i < 3 else table.column(k) for i, k in enumerate([*keys, "m"])]
        yield from pa.table(columns, [*keys, "m"]).to_batches(50_000)

    for batch in batches:
        lists = batch.column(1)
        flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
        source, n = coded(flat.field(0)), np.asarray(flat.field(1))
        row = np.repeat(np.arange(len(sizes)), sizes)
        lang = coded(batch.column(0))[row]
        for step in range(1, int(sizes.max(initial=0))):
            left = np.flatnonzero(row[step:] == row[:-step])
            columns = [lang[left], source[left], source[left + step], n[left], n[left + step], np.ones(len(left), np.int64)]
            held.append(pa.table([pa.array(c) for c in columns], [*keys, "m"]))
            size += len(left)
            if size >= HELD_PAIRS:
                held = [added()]
                size = len(held[0])
                if size >= HELD_PAIRS // 2:
                    yield from rows(held[0])
                    held, size = [], 0
    if held:
        yield from rows(added())


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = F.lit(SCALE).cast("decimal(10,0)") * wide(count + F.lit(1).cast("long"))
    return F.when(terms > 0, F.call_function("div", product, wide(total + terms)) + F.lit(1).cast("long"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms): groups(lang, source) of all rows; terms(lang, term, total, counts: array of (source, n)) of the kept ones."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both groupings below are satisfied by this one shuffle
    dealt = counted.repartition(parts, "lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = (
        by_source.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
        .filter(F.col("df") >= least)
        .drop("df")
    )
    return rows.select("lang", "source").distinct(), terms


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part (pair, term), item, value, rank."""
    rounds = Rounds(docs.sparkSession, "divergence")
    groups, terms = kept_terms(docs, least)
    terms = rounds.save(terms, "terms")
    single = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "c.source", "term", "c.n", "total")
    cells = rounds.save(single.groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("m")), "cells")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    sizes = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("group_n"), F.sum("m").alias("own"))
    zero = F.lit(0).cast("long")
    groups = rounds.save(
        groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_n", "own", "terms", "lang_n"]), "groups"
    )
    parts = _pair_part(groups, terms, cells, zero).unionByName(_term_part(groups, single, cells, top))
    return parts.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pair_part(groups: DataFrame, terms: DataFrame, cells: DataFrame, zero: Column) -> DataFrame:
    column = lambda name: F.col(name)
    other = groups.select(
        "lang", F.col("source").alias("item"), F.col("group_n").alias("item_n"), F.col("own").alias("item_own")
    )
    # one row per row of the result
    pairs = groups.drop("lang_n").join(other, "lang").filter("source <> item")
    nothing = _share(zero, column("group_n"), column("terms"))
    nothing_there = _share(zero, column("item_n"), column("terms"))
    big = lambda c: c.cast("decimal(38,0)")
    weighted = lambda m, f: big(F.coalesce(m * big(f), F.lit(0))).alias("v")
    key = ["lang", "source", "item"]
    rest = pairs.select(
        *key, weighted(big(column("terms") - column("own") - column("item_own")), _divergence(nothing, nothing_there))
    )
    histogram = cells.groupBy("lang", "source", F.col("n").alias("a")).agg(F.sum("m").alias("m"))
    mine = pairs.join(histogram, ["lang", "source"]).select(
        *key, weighted(big(column("m")), _divergence(_share(column("a"), column("group_n"), column("terms")), nothing_there))
    )
    theirs = pairs.join(histogram.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        *key, weighted(big(column("m")), _divergence(nothing, _share(column("a"), column("item_n"), column("terms"))))
    )
    shape = "lang string, source string, other string, a long, b long, m long"
    common = terms.filter(F.size("counts") > 1).select("lang", "counts").mapInArrow(_pair_cells, shape)
    common = common.groupBy("lang", "source", F.col("other").alias("item"), "a", "b").agg(F.sum("m").alias("m"))
    both = common.unionByName(
        common.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("a"), F.col("a").alias("b"), "m")
    )
    p = _share(column("a"), column("group_n"), column("terms"))
    q = _share(column("b"), column("item_n"), column("terms"))
    change = big(_divergence(p, q)) - big(_divergence(p, nothing_there)) - big(_divergence(nothing, q)) + big(_divergence(nothing, nothing_there))
    joint = both.join(pairs, key).select(*key, weighted(big(column("m")), change))
    summed = rest.unionByName(mine).unionByName(theirs).unionByName(joint).groupBy(*key).agg(F.sum("v").cast("long").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))


def _term_part(groups: DataFrame, single: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    known = groups.select("lang", "source", "group_n", "terms", "lang_n")
    p = _share(F.col("n"), F.col("group_n"), F.col("terms"))
    q = _share(F.col("total"), F.col("lang_n"), F.col("terms"))
    valued = (
        cells.join(known, ["lang", "source"])
        .select("lang", "source", "n", "total", "m", p.alias("p"), q.alias("q"))
        .filter("p > q")
        .select("lang", "source", "n", "total", "m", _divergence(F.col("p"), F.col("q")).alias("value"))
    )
    group = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    # equal values are merged; each holds a term at least, so the first `top` of them reach the last rank
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    merged = merged.withColumn("_place", F.row_number().over(group)).filter(F.col("_place") <= top)
    before = F.sum("m").over(group.rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    reached = merged.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value", "before")
    chosen = valued.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "total", "value", "before")
    expanded = single.join(chosen, ["lang", "source", "n", "total"])
    in_value = W.partitionBy("lang", "source", "value").orderBy("term")
    expanded = expanded.withColumn("_nth", F.row_number().over(in_value)).filter(F.col("_nth") <= top)
    ranked = expanded.withColumn("rank", F.col("before") + F.col("_nth")).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank", F.lit("term").alias("part"))
