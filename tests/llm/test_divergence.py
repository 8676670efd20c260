import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import DOCS
from tidewire.llm import divergence as d


def model(rows, least=3, top=200):
    """Rows (lang, source, text) -> sorted rows of the result, by the definition."""
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [x for x, n in documents[lang].items() if n >= least]
        own = {s: counts[g, s] for g, s in groups if g == lang}
        total = Counter()
        for c in own.values():
            total.update(c)

        def shares(c, kept=kept):
            n = sum(c[x] for x in kept)
            return {x: 1 + 10**9 * (c[x] + 1) // (n + len(kept)) for x in kept}

        f = lambda p, q: (p - q) * (p - q) // q
        share, whole = {s: shares(c) for s, c in own.items()}, shares(total)
        for s in own:
            pairs = [(sum(f(share[s][x], share[o][x]) for x in kept), o) for o in own if o != s]
            terms = [(f(share[s][x], whole[x]), x) for x in kept if own[s][x] and share[s][x] > whole[x]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                found = found[:top] if part == "term" else found
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, (lang, s, t) in enumerate(rows)], DOCS)


def found(df, **kw):
    got = d.divergences(df, **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


ROWS = (
    [("en", f"s{i % 3}", f"The cat-sat ON {'mat ' * (i % 4)} word{'abc'[i % 3]} Éa éa") for i in range(20)]
    + [("en", "s9", None), ("en", "s8", ""), (None, "s1", "one two"), (None, None, "one two three"), (None, None, "one"), ("xx", "a", "u"), ("xx", "b", "v")]
    + [("en", "s0", "alpha beta gamma delta"), ("en", "s1", "delta gamma"), ("en", "s2", "gamma beta delta alpha"), ("en", "s0", "beta alpha")]
    + [("fr", "s0", "the same row")] * 4
    + [("fr", "s1", "same " * 30_000)]
)


@pytest.mark.parametrize("top", [200, 2])
def test_equals_the_definition(spark, top):
    assert found(docs(spark, ROWS), top=top) == model(ROWS, top=top)


def test_small_holdings_and_many_ties(spark, monkeypatch):
    letters = "abcdefghijkl"
    words = [a + b for a in letters for b in letters]
    rows = [("en", f"s{i % 4}", " ".join(words[(7 * i + j) % 144] for j in range(40))) for i in range(60)]
    monkeypatch.setattr(d, "HELD_ROWS", 50)
    monkeypatch.setattr(d, "HELD_PAIRS", 20)
    assert found(docs(spark, rows), top=7) == model(rows, top=7)


def test_empty_table_and_clashing_columns(spark):
    assert found(docs(spark, [])) == []
    clash = docs(spark, ROWS).selectExpr("*", "1 as n", "2 as df", "3 as term", "4 as terms", "5 as total", "6 as item", "7 as value", "8 as m")
    assert found(clash) == model(ROWS)
