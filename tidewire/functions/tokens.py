"""Token sets used by the story and evidence relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import ColumnOrName, compact_text, strip

# fixed values: words that never identify a story
STOPWORDS = (
    "a an and are as at be but by for from has have how in into is it its more new now of on or "
    "that the their to was with your"
).split()
GENERIC = (
    "ai agent agents developer developers funding launch launches launching latest model models "
    "news startup startups tool tools"
).split()
# fixed values: words a search query may contain without naming its subject
FILLER = (
    "a ai an and announcement are at by detail for from funding hot impact in is list of official "
    "on or pricing rumored soon the to top vs was were with"
).split()

_TOKEN = r"[a-z0-9][a-z0-9+._\-]*"
_TERM = r"[a-z0-9]+(?:[.+#\-][a-z0-9]+)*"


def strip_source_suffix(title: ColumnOrName) -> Column:
    """Drop a trailing ' - Publisher'."""
    t = strip(title)
    cut = strip(F.regexp_replace(t, r"[\s\p{Z}]+-[\s\p{Z}]+[A-Za-z0-9&.' ]+$", ""))
    return F.when(t.contains(" - "), cut).otherwise(t)


def story_tokens(title: ColumnOrName) -> Column:
    """Distinct sorted tokens that can identify a story."""
    # Python lower() keeps non-ASCII letters out of the ASCII class, so do we
    found = F.regexp_extract_all(F.lower(strip_source_suffix(title)), F.lit(_TOKEN), F.lit(0))
    drop = F.array(*[F.lit(w) for w in STOPWORDS + GENERIC])
    kept = F.filter(
        found,
        lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~F.array_contains(drop, t),
    )
    return F.array_sort(F.array_distinct(kept))


def story_token_weight(token: Column) -> Column:
    return (
        F.when(token.rlike(r"\d"), 1.5)
        .when(F.length(token) >= 6, 1.5)
        .when(F.length(token) >= 5, 1.0)
        .otherwise(0.5)
    )


def token_weight_sum(tokens: ColumnOrName) -> Column:
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    total = F.aggregate(col, F.lit(0.0), lambda acc, t: acc + story_token_weight(t))
    return F.round(total, 4)


def _stem(part: Column) -> Column:
    word = F.regexp_replace(F.lower(part), r"^[\-.]+|[\-.]+$", "")
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.expr("''"), F.regexp_replace(word, "ies$", "y")))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 4), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def identity_terms(value: ColumnOrName) -> Column:
    """Stemmed terms of a text, with the parts of hyphenated and dotted terms."""
    found = F.regexp_extract_all(F.lower(compact_text(value)), F.lit(_TERM), F.lit(0))
    parts = F.flatten(F.transform(found, lambda t: F.concat(F.array(t), F.split(t, r"[\-.]"))))
    drop = F.array(*[F.lit(w) for w in FILLER])
    stems = F.transform(parts, _stem)
    return F.array_sort(
        F.array_distinct(F.filter(stems, lambda s: (s != "") & ~F.array_contains(drop, s)))
    )


def version_terms(terms: Column) -> Column:
    """Terms that mix letters and digits, such as model or hardware numbers."""
    return F.filter(terms, lambda t: t.rlike("[a-z]") & t.rlike(r"\d"))


def cjk_runs(value: ColumnOrName) -> Column:
    return F.regexp_extract_all(compact_text(value), F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
