"""Brute-force models and small documents."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    words = words_of(lower_ascii(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def jaccard_components(rows, n, num, den):
    """rows: (doc_id, text) -> sorted (doc_id, set size, component)."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in index.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            index[g].append(i)
        for j, both in seen.items():
            if den * both >= num * (len(s) + len(sets[j]) - both) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = find(i), find(j)
                if a != b:
                    # roots keep the smallest id
                    keep, drop = (a, b) if rows[a][0] <= rows[b][0] else (b, a)
                    parent[drop] = keep
    return sorted(
        ((rows[i][0], len(sets[i]), None if rows[i][0] is None else rows[find(i)][0]) for i in range(len(rows))),
        key=repr,
    )


def prose(rng: random.Random, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}{rng.choice(['', '', ',', '.'])}" for _ in range(n)]


def near_copies(seed, n=60):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = prose(rng, rng.choice([1, 2, 3, 5, 9, 20, 60, 200]))
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.3:
                copy = copy[: -rng.randrange(1, 4)] or copy
            out.append((" " if rng.random() < 0.5 else "\n").join(copy))
    rng.shuffle(out)
    return out


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)
