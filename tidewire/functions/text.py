"""String normalisation. Word and space classes are spelled out: Java's \\w and \\s are ASCII."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"
WORD = r"\p{L}\p{N}_"


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: ColumnOrName) -> Column:
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def strip(value: ColumnOrName) -> Column:
    return F.regexp_replace(text(value), f"^{SPACE}+|{SPACE}+$", "")


def rstrip(value: ColumnOrName) -> Column:
    return F.regexp_replace(text(value), f"{SPACE}+$", "")


def compact_text(value: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(text(value), f"{SPACE}+", " "))


def no_space(value: ColumnOrName) -> Column:
    return F.regexp_replace(text(value), SPACE, "")


def visible_chars(value: ColumnOrName) -> Column:
    return F.length(no_space(value))


def casefold(value: ColumnOrName) -> Column:
    return F.replace(F.lower(text(value)), F.lit("ß"), F.lit("ss"))


def py_casefold(value: str) -> str:
    return value.lower().replace("ß", "ss")


def normalize_title_identity(title: ColumnOrName) -> Column:
    """Identity form: punctuation and dash runs become one blank."""
    cleaned = F.regexp_replace(F.lower(strip(title)), f"(?:(?!{SPACE})[^{WORD}])+", " ")
    return strip(F.regexp_replace(cleaned, rf"(?:{SPACE}|[\-—_])+", " "))


def normalize_title_search(title: ColumnOrName) -> Column:
    """Search form: like the identity form, but underscores survive."""
    cleaned = F.regexp_replace(F.lower(strip(title)), f"(?:(?!{SPACE})[^{WORD}])+", " ")
    return strip(F.regexp_replace(cleaned, f"{SPACE}+", " "))


def count_cjk(value: ColumnOrName) -> Column:
    return F.regexp_count(text(value), F.lit(r"[\x{4e00}-\x{9fff}]"))


def chinese_ratio(value: ColumnOrName) -> Column:
    letters = F.regexp_count(text(value), F.lit(r"[\x{4e00}-\x{9fff}A-Za-z]"))
    return count_cjk(value) / F.greatest(F.lit(1), letters)


def clean_html_fragment(fragment: ColumnOrName) -> Column:
    """Unescape, drop tags, collapse blanks."""
    return compact_text(unescape(F.regexp_replace(unescape(fragment), "<[^>]*>", " ")))


def html_text(markup: ColumnOrName) -> Column:
    """Visible text of markup: tags become blanks, entities are resolved afterwards."""
    return compact_text(unescape(F.regexp_replace(text(markup), "<[^>]*>", " ")))


# fixed values: named entities that occur in feeds
_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#x27;": "'",
    "&nbsp;": " ",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&#8211;": "–",
    "&#8212;": "—",
    "&#8216;": "‘",
    "&#8217;": "’",
    "&#8220;": "“",
    "&#8221;": "”",
    "&#8230;": "…",
    "&hellip;": "…",
    "&middot;": "·",
    "&copy;": "©",
}


def unescape(value: ColumnOrName) -> Column:
    out = text(value)
    for name, char in _ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def safe_code(value: ColumnOrName, fallback: str = "unknown_error") -> Column:
    code = F.regexp_replace(strip(value), r"[^a-zA-Z0-9_.\-]+", "_")
    code = F.regexp_replace(code, r"^[_.\-]+|[_.\-]+$", "")
    return F.coalesce(F.nullif(F.substring(code, 1, 80), F.lit("")), F.lit(fallback))


def redact_map(values: ColumnOrName) -> Column:
    """Drop entries whose key looks like a credential."""
    return F.map_filter(
        as_col(values), lambda k, v: ~F.lower(k).rlike("key|secret|token|password")
    )


def redact_json(document: ColumnOrName) -> Column:
    """Drop credential-like keys of string, number or flat-list value at any depth of a JSON text."""
    key = r'"[^"]*(?i:key|secret|token|password)[^"]*"'
    value = r'(?:"(?:[^"\\]|\\.)*"|\[[^\[\]{}]*\]|\{[^{}]*\}|[^,{}\[\]\s]+)'
    out = F.regexp_replace(text(document), rf"{key}\s*:\s*{value}\s*,\s*", "")
    return F.regexp_replace(out, rf",?\s*{key}\s*:\s*{value}", "")


def scrub_text(message: ColumnOrName, secrets: list[str]) -> Column:
    out = text(message)
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit("[redacted]"))
    return out


def quote_any(words: list[str] | tuple[str, ...]) -> str:
    """Regex alternation of literal words, longest first so that no prefix hides a longer word."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def entity_for_title(title: ColumnOrName, keywords: tuple[str, ...]) -> Column:
    """First configured keyword that the normalised title contains."""
    normal = normalize_title_identity(title)
    hits = [
        F.when(normal.contains(re.sub(r"[\W_]+", " ", k.lower()).strip()), F.lit(k))
        for k in keywords
    ]
    return F.coalesce(*hits, F.lit("")) if hits else F.lit("")
