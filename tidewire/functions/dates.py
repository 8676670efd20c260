"""Date and time parsing that never depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import ColumnOrName, as_col, strip, text
from tidewire.settings import REPORT_TZ

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_RFC = (
    r"^(?:[A-Za-z]{3,9},?\s*)?(\d{1,2})[\s-]([A-Za-z]{3})[a-z]*[\s-](\d{4}),?\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]{1,4}|[+-]\d{4})?(?:\s*\(.*\))?$"
)
# fixed values: month names and zone names of mail dates
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_ZONES = {
    "UT": "+00:00",
    "UTC": "+00:00",
    "GMT": "+00:00",
    "Z": "+00:00",
    "AST": "-04:00",
    "ADT": "-03:00",
    "EST": "-05:00",
    "EDT": "-04:00",
    "CST": "-06:00",
    "CDT": "-05:00",
    "MST": "-07:00",
    "MDT": "-06:00",
    "PST": "-08:00",
    "PDT": "-07:00",
}


def _offset(zone: Column, naive: str | None) -> Column:
    fallback = F.lit(" " + naive) if naive else F.lit(None).cast("string")
    numeric = F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    return (
        F.when(zone.isin("", "-0000"), fallback)
        .when(zone == "Z", F.lit("+00:00"))
        .otherwise(numeric)
    )


def _parse_iso(value: Column, naive: str | None) -> Column:
    # the engine reads this notation itself once fraction and offset are in its form
    tidy = F.regexp_replace(F.replace(value, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    tidy = F.regexp_replace(tidy, r"^(.{10}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    date_only = F.length(value) == 10
    zoned = value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & ~date_only
    if naive is None:
        stamp = F.when(zoned, tidy)
    else:
        stamp = (
            F.when(zoned, tidy)
            .when(date_only, F.concat(value, F.lit(f" 00:00:00 {naive}")))
            .otherwise(F.concat(tidy, F.lit(f" {naive}")))
        )
    return F.when(value.rlike(_ISO), stamp.try_cast("timestamp"))


def _parse_mail(value: Column, naive: str | None) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(value, _RFC, i)

    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(2)))
    zone_names = F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv])
    zone = F.coalesce(F.try_element_at(zone_names, F.upper(part(7))), part(7))
    zone = F.when(zone.rlike(r"^[A-Za-z]"), "").otherwise(zone)
    stamp = F.concat(
        part(3),
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad(part(1), 2, "0"),
        F.lit(" "),
        F.lpad(part(4), 2, "0"),
        F.lit(":"),
        part(5),
        F.lit(":"),
        F.when(part(6) == "", "00").otherwise(part(6)),
        _offset(zone, naive),
    )
    return F.when(value.rlike(_RFC) & (month > 0), stamp.try_cast("timestamp"))


def parse_published(value: ColumnOrName, tz: str = REPORT_TZ) -> Column:
    """ISO, then mail-style dates; a missing zone means the report zone; NULL when neither fits."""
    v = strip(value)
    return F.coalesce(_parse_iso(v, tz), _parse_mail(v, tz))


def parse_strict(value: ColumnOrName) -> Column:
    """ISO with a mandatory offset."""
    return _parse_iso(strip(value), None)


def parse_date_prefix(value: ColumnOrName) -> Column:
    """A leading YYYY-MM-DD, whatever follows."""
    head = F.substring(text(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def within_hours(published: ColumnOrName, reference: ColumnOrName, hours: int) -> Column:
    """Closed window that ends at the reference; NULL when there is no usable time."""
    at, ref = as_col(published), as_col(reference)
    return at.between(ref - F.make_dt_interval(hours=F.lit(hours)), ref)


def is_recent_instant(
    published: ColumnOrName, reference: ColumnOrName, hours: int = 48, ahead_minutes: int = 5
) -> Column:
    at, ref = as_col(published), as_col(reference)
    low = ref - F.make_dt_interval(hours=F.lit(hours))
    high = ref + F.make_dt_interval(mins=F.lit(ahead_minutes))
    return F.coalesce(at.between(low, high), F.lit(False))


def local_wall_clock(reference: ColumnOrName, tz: str = REPORT_TZ) -> Column:
    """Wall clock of an instant in tz, as a zone-less timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.to_timestamp_ntz(_utc_text(as_col(reference))))


def _utc_text(ts: Column) -> Column:
    # epoch arithmetic instead of formatting, which would follow the session zone
    micros = F.unix_micros(ts)
    return F.concat(
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86400000000).cast("int")), "yyyy-MM-dd"),
        F.lit(" "),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(F.pmod(micros, F.lit(86400000000)) / 3600000000).cast("int"),
            F.floor(F.pmod(micros, F.lit(3600000000)) / 60000000).cast("int"),
            F.floor(F.pmod(micros, F.lit(60000000)) / 1000000).cast("int"),
        ),
    )


def local_date(reference: ColumnOrName, tz: str = REPORT_TZ) -> Column:
    return local_wall_clock(reference, tz).cast("date")


def is_recent_date(day_text: ColumnOrName, reference: ColumnOrName, tz: str = REPORT_TZ) -> Column:
    """Date-only variant: whole days between local reference and midnight of the day is at most 1."""
    v = text(day_text)
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date"))
    # floor of a non-negative time of day never adds a day
    return F.coalesce(F.datediff(local_date(reference, tz), day) <= 1, F.lit(False))


def date_from_url(url: ColumnOrName, pad: bool = False) -> Column:
    digits = r"\d{1,2}" if pad else r"\d{2}"
    pattern = rf"/(\d{{4}})/({digits})/({digits})/"
    v = text(url)

    def part(i: int) -> Column:
        return F.regexp_extract(v, pattern, i)

    joined = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(v.rlike(pattern), joined).otherwise("")


def report_window(reference: ColumnOrName, hours: ColumnOrName | int = 24, tz: str = REPORT_TZ) -> Column:
    """First and last local date touched by the window that ends at the reference."""
    h = F.lit(hours) if isinstance(hours, int) else as_col(hours)
    h = F.greatest(F.lit(1), F.coalesce(F.nullif(h.cast("int"), F.lit(0)), F.lit(24)))
    ref = as_col(reference)
    return F.struct(
        local_date(ref - F.make_dt_interval(hours=h), tz).alias("start_date"),
        local_date(ref, tz).alias("end_date"),
    )


def replay_reference(edition: ColumnOrName, clock: str = "08:36:00", tz: str = REPORT_TZ) -> Column:
    """Fixed clock at which a historic edition is replayed."""
    return F.concat(as_col(edition).cast("string"), F.lit(f" {clock} {tz}")).try_cast("timestamp")


def is_edition_day(content: ColumnOrName, publish_time: ColumnOrName, edition: ColumnOrName) -> Column:
    """A written Chinese date in the text, or a date prefix in one of three notations."""
    body, day = text(content), as_col(edition)
    pattern = r"(\d{4})年(\d{1,2})月(\d{1,2})号"

    def ymd(v: Column, p: str) -> Column:
        parts = [F.regexp_extract(v, p, i) for i in (1, 2, 3)]
        iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
        return F.when(v.rlike(p), iso.try_cast("date"))

    head = F.substring(
        F.regexp_replace(text(publish_time), r"\s*\+\d{2}:\d{2}|\s*Z|\s*UTC.*", ""), 1, 10
    )
    dates = [
        ymd(body, pattern),
        ymd(head, r"^(\d{4})-(\d{1,2})-(\d{1,2})$"),
        ymd(head, r"^(\d{4})/(\d{1,2})/(\d{1,2})$"),
        ymd(head, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$"),
    ]
    hit = F.lit(False)
    for d in dates:
        hit = hit | F.coalesce(d == day, F.lit(False))
    return hit
