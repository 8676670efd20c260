"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0) on features of the whole text. The counts of vote patterns over all documents
(at most 2 ** rules rows) are enough for expectation-maximisation of each rule's accuracy in both classes and of the
share of good documents; each pattern's posterior then decides for its documents. Nothing is sampled.

Nulls: a null text counts as an empty one; it has no words and fails the base rule. Repeated rows and equal ids are judged alike, row
by row. An empty table gives no rows. Input columns are kept by `judged` whatever their names are; its struct is named `quality`, with underscores in front if that is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.workspace import Rounds

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "".join(map(chr, range(65, 91)))
#: the estimate's start and prior: shares of votes in good and in bad documents, worth so many documents
PRIOR_IN_GOOD, PRIOR_IN_BAD, PRIOR_WEIGHT = {-1: 0.02, 1: 0.85}, {-1: 0.3, 1: 0.4}, 20.0
PRIOR_GOOD = 0.85
#: a defect's vote is at least so many times likelier in bad documents than in good ones
BAD_RATIO = 9.0
ROUNDS = 40


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def repeated_words(tokens: Column) -> Column:
    """Words in windows of three words that occur at least twice in the array.

    Windows are sorted by (64-bit hash, place); equal neighbours mark both places.
    """
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - 2),
            lambda i: F.struct(
                F.xxhash64(F.element_at(tokens, i), F.element_at(tokens, i + 1), F.element_at(tokens, i + 2)).alias("h"),
                i.alias("i"),
            ),
        )
    )
    pairs = let(
        windows,
        lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
    )
    starts = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(tokens) >= 4, F.size(covered)).otherwise(0).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def features(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column `name` of the features of `text`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dark = F.translate(text, SPACES, "")
    lost = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))

    def measured(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(dark).cast("long").alias("word_chars"),
            lost(SYMBOLS).cast("long").alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            lost(UPPER).cast("long").alias("n_upper"),
            lost("!").cast("long").alias("n_shouts"),
            F.size(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w)))).cast("long").alias("n_distinct"),
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        )

    return docs.withColumn(name, let(words(text), measured))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def rules(f: Column) -> dict[str, Column]:
    """Votes: rules on one defect vote bad or abstain, rules on plain prose vote good or abstain."""

    def bad(found: Column) -> Column:
        return F.when(found, -1).otherwise(0)

    def good(found: Column) -> Column:
        return F.when(found, 1).otherwise(0)

    n, chars = f["n_words"], f["word_chars"]
    mean = chars / n
    symbols, upper = f["n_symbols"] / chars, f["n_upper"] / chars
    shouts, repeats = f["n_shouts"] / n, f["n_repeat_words"] / n
    distinct, lines = f["n_distinct"] / n, f["n_dup_lines"] / f["n_lines"]
    return {
        "mean_word_length": bad((mean < 2) | (mean > 15)),
        "symbols": bad(symbols > 0.06),
        "upper_case": bad(upper > 0.3),
        "shouting": bad(shouts > 0.3),
        "repeated_words": bad(repeats > 0.4),
        "few_words": bad((distinct < 0.15) & (n < 1000)),
        "repeated_lines": bad(lines > 0.5),
        "plain_marks": good((symbols < 0.02) & (upper < 0.15) & (shouts < 0.1)),
        "varied_words": good((repeats < 0.3) & (lines < 0.4)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of `good` by vote pattern, from the patterns and their counts.

    A rule's votes depend on the class alone: in class good it votes 1, 0, -1 with its own shares, likewise in class bad.
    """
    if not patterns:
        return {}
    k, votes = len(patterns[0][0]), (-1, 0, 1)
    share = {}
    total = sum(n for _, n in patterns)
    prior = {}
    for i in range(k):
        cast = {p[i] for p, _ in patterns}
        prior[i] = [{v: x if v in cast else 0.0 for v, x in side.items()} for side in (PRIOR_IN_GOOD, PRIOR_IN_BAD)]
        for side in prior[i]:
            side[0] = 1 - side[-1] - side[1]
        share[i] = [dict(side) for side in prior[i]]
    good, posterior = PRIOR_GOOD, {}
    for _ in range(rounds):
        for p, _ in patterns:
            a, b = math.log(good), math.log(1 - good)
            for i, v in enumerate(p):
                a += math.log(max(share[i][0][v], 1e-9))
                b += math.log(max(share[i][1][v], 1e-9))
            posterior[p] = 1 / (1 + math.exp(min(700, b - a)))
        weight = sum(posterior[p] * n for p, n in patterns)
        good = min(0.97, max(0.03, weight / total))
        for i in range(k):
            for side in (0, 1):
                sums = {v: PRIOR_WEIGHT * x for v, x in prior[i][side].items()}
                for p, n in patterns:
                    sums[p[i]] += n * (posterior[p] if side == 0 else 1 - posterior[p])
                whole = sum(sums.values())
                share[i][side].update({v: sums[v] / whole for v in votes})
            # what makes a vote: a class never earns the other one's votes more often than that one itself
            for side, v, least in ((0, -1, BAD_RATIO), (1, 1, 1.0)):
                most = share[i][1 - side][v] / least
                share[i][side][0] += max(0.0, share[i][side][v] - most)
                share[i][side][v] = min(share[i][side][v], most)
    return posterior


def judged(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (all, if None) and a struct `quality`: features, base_failed, posterior, kept.

    Documents that fail the base rule are rejected by it and take no part in the estimate. The features are written once, as
    the estimate and the verdicts both need them.
    """
    name = "quality"
    while name in docs.columns or f"{name}_votes" in docs.columns:
        name = f"_{name}"
    votes = f"{name}_votes"
    columns = docs.columns if columns is None else columns
    found = features(docs, name).select(*[F.col(f"`{c}`") for c in columns], name)
    f = F.col(name)
    voted = F.when(~base_failed(f), F.concat_ws(",", *[v.cast("string") for v in rules(f).values()]))
    found = Rounds(docs.sparkSession, "weak-quality").save(found).withColumn(votes, voted)
    # at most 2 ** 9 rows
    counts = found.groupBy(votes).count().filter(F.col(votes).isNotNull()).collect()
    posterior = fit(sorted((tuple(map(int, r[0].split(","))), r[1]) for r in counts))
    table = [F.lit(x) for p, q in posterior.items() for x in (",".join(map(str, p)), q)]
    chance = F.try_element_at(F.create_map(*table), F.col(votes)) if table else F.lit(None).cast("double")
    judged_ = (
        f.withField("base_failed", base_failed(f))
        .withField("posterior", chance)
        .withField("kept", ~base_failed(f) & (F.coalesce(chance, F.lit(0.0)) >= 0.5))
    )
    return found.withColumn(name, judged_).drop(votes)


def kept_only(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject."""
    found = judged(docs)
    return found.filter(F.col(f"{found.columns[-1]}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
