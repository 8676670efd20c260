"""URL parts and the three URL keys. java.net.URI rejects too much, so parts come from one regex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import ColumnOrName, compact_text, strip, text

_URL = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_TRACKING = r"(?i)^(utm_|fbclid$|gclid$|ref$)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[\t\r\n]", ""), _URL, group)


def scheme_of(url: ColumnOrName) -> Column:
    return F.lower(_part(text(url), 1))


def netloc_of(url: ColumnOrName) -> Column:
    return _part(text(url), 2)


def path_of(url: ColumnOrName) -> Column:
    return _part(text(url), 3)


def query_of(url: ColumnOrName) -> Column:
    return _part(text(url), 4)


def _plain_path(url: Column) -> Column:
    # path parameters of the last segment are not part of the path
    return F.regexp_replace(path_of(url), ";[^/]*$", "")


def host_of(url: ColumnOrName) -> Column:
    """Lower-case host without credentials and port."""
    host = F.regexp_replace(F.lower(netloc_of(url)), "^.*@", "")
    return F.regexp_replace(host, r":\d*$", "")


def domain_of(url: ColumnOrName) -> Column:
    return F.lower(netloc_of(url))


def url_host(url: ColumnOrName) -> Column:
    """Host of a link cut out of Markdown, without the punctuation that trails it."""
    return domain_of(F.regexp_replace(text(url), r"""[.,;:!?*_)\]}>'"]+$""", ""))


def _decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _encode(value: Column) -> Column:
    # java.net.URLEncoder differs from form encoding in these two characters only
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query_pairs(query: Column) -> Column:
    fields = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(
        fields,
        lambda x: F.struct(
            _decode(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(x, "(?s)^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )


def query_keys(url: ColumnOrName) -> Column:
    """Keys that carry a non-empty value."""
    pairs = F.filter(_query_pairs(query_of(url)), lambda p: p["v"] != "")
    return F.transform(pairs, lambda p: p["k"])


def canonical_url_identity(link: ColumnOrName) -> Column:
    """scheme://host/path plus the sorted query without tracking fields; '' unless absolute."""
    url = strip(link)
    pairs = F.array_sort(F.filter(_query_pairs(query_of(url)), lambda p: ~p["k"].rlike(_TRACKING)))
    query = F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    path = F.coalesce(F.nullif(F.regexp_replace(path_of(url), "/+$", ""), F.lit("")), F.lit("/"))
    key = F.concat(
        scheme_of(url),
        F.lit("://"),
        domain_of(url),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when((scheme_of(url) == "") | (netloc_of(url) == ""), "").otherwise(key)


def canonical_url_search(link: ColumnOrName) -> Column:
    """host + path without trailing slashes, any scheme."""
    url = strip(link)
    return F.concat(domain_of(url), F.regexp_replace(_plain_path(url), "/+$", ""))


def canonical_story_url(link: ColumnOrName) -> Column:
    """host without www. + path, web schemes only."""
    url = compact_text(link)
    path = F.coalesce(F.nullif(F.regexp_replace(_plain_path(url), "/+$", ""), F.lit("")), F.lit("/"))
    key = F.concat(F.regexp_replace(domain_of(url), r"^www\.", ""), path)
    return F.when(is_http_url(url), key).otherwise("")


def is_http_url(link: ColumnOrName) -> Column:
    url = strip(link)
    return scheme_of(url).isin("http", "https") & (netloc_of(url) != "")


def has_path(link: ColumnOrName) -> Column:
    return ~_plain_path(compact_text(link)).isin("", "/")


def article_key(title: Column, link: Column) -> Column:
    """md5 of the identity URL, or of the identity title when there is no usable URL."""
    from tidewire.functions.text import normalize_title_identity

    url = canonical_url_identity(link)
    return F.md5(F.when(url != "", url).otherwise(normalize_title_identity(title)))


def with_query(page_url: str, values: dict[str, Column]) -> Column:
    """page_url with its query replaced by form-encoded columns, in the given order."""
    parts = [F.concat(F.lit(f"{k}="), _encode(v)) for k, v in values.items()]
    return F.concat(F.lit(page_url.split("?")[0] + "?"), F.concat_ws("&", *parts))
