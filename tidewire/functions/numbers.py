"""Safe casts, rates and number claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import ColumnOrName, SPACE, as_col, casefold, strip, text


def safe_int(value: ColumnOrName, default: int = 0) -> Column:
    return F.coalesce(strip(value).try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(value: ColumnOrName, default: float = 0.0) -> Column:
    return F.coalesce(strip(value).try_cast("double"), F.lit(default))


def rate(part: ColumnOrName, total: ColumnOrName) -> Column:
    """part/total with four digits, NULL for an empty total."""
    p, t = as_col(part).cast("double"), as_col(total).cast("double")
    return F.when(t > 0, F.round(F.try_divide(p, t), 4))


def avg4(value: ColumnOrName) -> Column:
    return F.round(F.avg(as_col(value)), 4)


# a number with an optional currency sign and unit, as used for same-story checks
_NUMBER_KEY = r"(?i)(?<![a-z0-9])[$¥]?\d+(?:\.\d+)?\s*(?:trillion|billion|million|[tbm]|万|亿)?"


def raw_number_keys(value: ColumnOrName) -> Column:
    """Number tokens exactly as written: blanks and case are kept."""
    return F.array_distinct(F.regexp_extract_all(text(value), F.lit(_NUMBER_KEY), F.lit(0)))


def number_keys(title: ColumnOrName, description: ColumnOrName) -> Column:
    both = F.concat(text(title), F.lit("\n"), text(description))
    found = F.regexp_extract_all(both, F.lit(_NUMBER_KEY), F.lit(0))
    return F.array_sort(
        F.array_distinct(F.transform(found, lambda x: F.regexp_replace(casefold(x), SPACE, "")))
    )


# fixed values: unit multipliers and number words
_UNITS = {
    "k": 1_000,
    "thousand": 1_000,
    "万": 10_000,
    "million": 1_000_000,
    "m": 1_000_000,
    "百万": 1_000_000,
    "千万": 10_000_000,
    "亿": 100_000_000,
    "billion": 1_000_000_000,
    "b": 1_000_000_000,
    "bn": 1_000_000_000,
    "trillion": 1_000_000_000_000,
}
_WORDS = {
    "zero": 0,
    "two": 2,
    "three": 3,
    "four": 4,
    "five": 5,
    "six": 6,
    "seven": 7,
    "eight": 8,
    "nine": 9,
    "ten": 10,
    "eleven": 11,
    "twelve": 12,
    "thirteen": 13,
    "fourteen": 14,
    "fifteen": 15,
    "sixteen": 16,
    "seventeen": 17,
    "eighteen": 18,
    "nineteen": 19,
    "twenty": 20,
}
_CLAIM = (
    r"(?i)(?<![A-Za-z0-9])(\d+(?:[,.，]\d+)*)\s*"
    r"(trillion|billion|million|thousand|bn|k|m|b|%|％|万|亿|百万|千万)?"
)
_WORD_CLAIM = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(_WORDS) + r")(?![\p{L}\p{N}_])"


def number_claims(value: ColumnOrName) -> Column:
    """Distinct sorted numbers a text states, scaled by unit, without exponent or trailing zeros."""
    v = text(value)
    words = F.create_map(*[F.lit(str(x)) for kv in _WORDS.items() for x in kv])
    units = F.create_map(
        *[F.lit(x) for k, n in _UNITS.items() for x in (k, str(n))]
    )
    written = F.transform(
        F.regexp_extract_all(v, F.lit(_WORD_CLAIM), F.lit(0)),
        lambda w: F.element_at(words, F.lower(w)),
    )

    def scaled(claim: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(claim, _CLAIM, 1), "[,，]", "")
        unit = F.lower(F.regexp_extract(claim, _CLAIM, 2))
        factor = F.coalesce(F.try_element_at(units, unit), F.lit("1")).cast("decimal(14,0)")
        number = digits.try_cast("decimal(24,8)") * factor
        plain = number.cast("string")
        plain = F.when(
            plain.contains("."), F.regexp_replace(plain, r"0+$", "")
        ).otherwise(plain)
        plain = F.regexp_replace(plain, r"\.$", "")
        return F.when(unit.isin("%", "％"), F.concat(plain, F.lit("%"))).otherwise(plain)

    numeric = F.transform(F.regexp_extract_all(v, F.lit(_CLAIM), F.lit(0)), scaled)
    # a malformed number such as 1.2.3 makes no claim
    kept = F.filter(F.concat(written, numeric), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(kept))
