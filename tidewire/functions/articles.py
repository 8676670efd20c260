"""Expressions over whole article rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import dates, numbers, urls
from tidewire.functions.text import ColumnOrName, as_col, compact_text, no_space, strip, text
from tidewire.settings import EnrichSettings, GateSettings, SourceLabels

_GATES = GateSettings()


def prov(key: str, provenance: ColumnOrName = "provenance") -> Column:
    return F.try_element_at(as_col(provenance), F.lit(key))


def source_group(
    source: ColumnOrName = "source", link: ColumnOrName = "link", labels: SourceLabels = SourceLabels()
) -> Column:
    s = F.lower(strip(source))
    host = urls.host_of(link)
    out = F.when(s != "", s).when(host != "", host).otherwise("unknown")
    for name, group in labels.merged_groups.items():
        out = F.when(s == name, group).otherwise(out)
    return out


def source_label(
    source: ColumnOrName = "source", link: ColumnOrName = "link", labels: SourceLabels = SourceLabels()
) -> Column:
    s = F.lower(strip(source))
    host = urls.host_of(link)
    names = F.create_map(*[F.lit(x) for kv in labels.labels.items() for x in kv])
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.coalesce(
        F.try_element_at(names, s), F.try_element_at(names, host), F.nullif(bare, F.lit("")), s
    )


def is_direct_evidence_url(link: ColumnOrName, gates: GateSettings = _GATES) -> Column:
    url = compact_text(link)
    host = urls.host_of(url)
    social = host.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in gates.social_hosts) + r")$")
    listing = F.arrays_overlap(
        urls.query_keys(url), F.array(*[F.lit(k) for k in gates.listing_query_keys])
    )
    ranking_ok = host.endswith(gates.ranking_article_suffix) & urls.has_path(url) & ~listing
    direct = F.when(host.isin(*gates.ranking_hosts), ranking_ok).otherwise(urls.has_path(url))
    return urls.scheme_of(url).isin("http", "https") & (host != "") & ~social & direct


def has_real_publish_time(gates: GateSettings = _GATES) -> Column:
    value = compact_text("publish_time")
    observed = F.coalesce(prov("publish_time_semantics") == "trend_observed_at", F.lit(False))
    parsed = dates.parse_published(value).isNotNull() | dates.parse_date_prefix(value).isNotNull()
    return ~observed & (value != "") & ~F.lower(value).isin(*gates.unknown_times) & parsed


def has_body() -> Column:
    return (compact_text("description") != "") | (compact_text("content") != "")


def is_lead(gates: GateSettings = _GATES) -> Column:
    return (
        (F.lower(compact_text("kind")) == "lead")
        | F.coalesce(prov("input_kind") == "lead", F.lit(False))
        | F.coalesce(prov("publish_time_semantics") == "trend_observed_at", F.lit(False))
        | (~has_body() & F.lower(compact_text("source")).isin(*gates.title_only_sources))
    )


def publishability_reasons(gates: GateSettings = _GATES) -> Column:
    lead = is_lead(gates)
    return F.array_compact(
        F.array(
            F.when(lead, "unresolved_lead"),
            F.when(compact_text("title") == "", "missing_title"),
            F.when(~is_direct_evidence_url("link", gates), "non_evidence_url"),
            F.when(~has_real_publish_time(gates), "missing_real_publish_time"),
            F.when(lead & ~has_body(), "missing_evidence_text"),
        )
    )


def is_story() -> Column:
    return F.coalesce(F.nullif(F.lower(strip("kind")), F.lit("")), F.lit("story")) == "story"


def has_enough_facts(min_title_chars: int = 24) -> Column:
    status = F.lower(strip("evidence_status"))
    title = no_space("title")
    body = (strip("description") != "") | (strip("content") != "")
    return (
        is_story()
        & ~status.isin("unresolved", "signal")
        & (title != "")
        & (body | (F.length(title) >= min_title_chars))
    )


def is_aggregate_like(gates: GateSettings = _GATES) -> Column:
    source = F.lower(strip("source"))
    title = F.lower(strip("title"))
    prefixed = F.lit(False)
    for p in gates.digest_title_prefixes:
        prefixed = prefixed | title.startswith(p)
    return (
        source.isin(*gates.digest_sources)
        | prefixed
        | (F.regexp_count(title, F.lit("；")) >= 2)
        | (F.regexp_count(title, F.lit(";")) >= 2)
    )


# fixed values: the three topic dictionaries of the older reports
TOPIC_PATTERNS = {
    "selection": (
        r"(?i)(?:人工智能|大模型|机器学习|深度学习|生成式|智能体|机器人|算力|推理|"
        r"(?<![a-z])ai(?![a-z])|artificial intelligence|machine learning|"
        r"(?<![a-z])llm(?![a-z])|openai|anthropic|claude|gemini|gpt|xai|deepseek|"
        r"qwen|kimi|grok|copilot|agentic|neural|inference|robot)"
    ),
    "benchmark": (
        r"(?i)(?<![\p{L}\p{N}_])(ai|openai|anthropic|claude|chatgpt|llm|model|models|agent|agents|"
        r"robot|robotics|startup|startups|copilot|sora)(?![\p{L}\p{N}_])|"
        r"(人工智能|大模型|模型|智能体|机器人|融资|开源|发布|日报)"
    ),
    "domain": (
        r"(?i)(?<![\p{L}\p{N}_])(ai|openai|anthropic|claude|chatgpt|llm|agent|agents|"
        r"assistant|copilot|sora|generative|inference|developer tools|"
        r"machine learning|deep learning|robot|robotics)(?![\p{L}\p{N}_])|"
        r"(人工智能|大模型|模型|智能体|机器人|开发者工具|生成式AI|生成式人工智能)"
    ),
}


def ai_topic(value: ColumnOrName, variant: str = "selection") -> Column:
    return text(value).rlike(TOPIC_PATTERNS[variant])


def article_reference_id(article_id: ColumnOrName, pos: ColumnOrName) -> Column:
    """Kept id, or 'a' + position; NULL marks an id that is present but invalid."""
    v = strip(article_id)
    return F.when(v == "", F.concat(F.lit("a"), as_col(pos).cast("string"))).when(
        v.rlike(r"^a[1-9]\d*$"), v
    )


def trend_rank() -> Column:
    return numbers.safe_int(prov("trend_rank"), 1_000_000)


def trend_heat() -> Column:
    return numbers.safe_float(prov("trend_heat"), 0.0)


def trend_signal(trend_source: str = "agihunt_trending") -> Column:
    rank = strip(prov("trend_rank")).try_cast("int")
    heat = strip(prov("trend_heat")).try_cast("double")
    state = text(prov("trend_state"))
    delta = strip(prov("trend_delta")).try_cast("int")
    return F.when(
        (text("source") == trend_source) & (rank >= 1) & (heat >= 0),
        F.struct(
            rank.alias("rank"),
            heat.alias("heat"),
            F.when(state.isin("up", "down", "new", "steady"), state).alias("state"),
            F.when(delta >= 0, delta).alias("delta"),
        ),
    )


def compress_article(title_max: int = 150, desc_max: int = 300) -> Column:
    """Bounded projection of one article for a text model, without its own link."""

    def cut(v: Column, n: int) -> Column:
        return F.substring(text(v), 1, n)

    evidence = F.transform(
        F.slice("evidence", 1, 3),
        lambda e: F.struct(
            cut(e["title"], title_max).alias("title"),
            text(e["url"]).alias("url"),
            text(e["published_date"]).alias("published_date"),
            cut(F.coalesce(F.nullif(e["snippet"], F.lit("")), e["text"]), desc_max).alias("snippet"),
        ),
    )
    return F.to_json(
        F.struct(
            F.col("article_id"),
            cut(F.col("title"), title_max).alias("title"),
            cut(F.col("description"), desc_max).alias("description"),
            evidence.alias("evidence"),
            trend_signal().alias("trend_signal"),
        )
    )


def discovery_query() -> Column:
    parts = [compact_text("title"), compact_text(prov("trend_term_en")), compact_text("description")]
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.substring(joined, 1, 380)


def followup_query(best_title: ColumnOrName) -> Column:
    base = F.coalesce(F.nullif(compact_text(best_title), F.lit("")), discovery_query())
    tail = F.lit(" official announcement details pricing benchmark funding impact")
    return F.substring(F.concat(base, tail), 1, 400)


def evidence_text(content: ColumnOrName, raw_content: ColumnOrName, max_chars: int) -> Column:
    return join_evidence(compact_text(content), compact_text(raw_content), max_chars)


def join_evidence(snippet: Column, raw: Column, max_chars: int) -> Column:
    """Snippet plus raw text unless it repeats it; both are compact already."""
    joined = F.when(
        (raw != "") & ~F.contains(snippet, raw), F.trim(F.concat(snippet, F.lit(" "), raw))
    ).otherwise(snippet)
    return F.rtrim(F.substring(joined, 1, max_chars))


def query_for_round(
    pack: ColumnOrName, reference_date: ColumnOrName, stage: ColumnOrName, round_index: ColumnOrName
) -> Column:
    """Rotate a query pack by day ordinal, stage and round (rounds count from 0)."""
    packs = F.filter(F.transform(as_col(pack), lambda q: strip(q)), lambda q: q != "")
    # 719163 is the ordinal of 1970-01-01
    ordinal = F.datediff(as_col(reference_date), F.lit("1970-01-01").cast("date")) + 719163
    offset = F.when(as_col(stage) == "secondary_refill", 1).otherwise(0)
    index = F.pmod(ordinal + offset + as_col(round_index), F.size(packs)) + 1
    return F.when(F.size(packs) > 0, F.try_element_at(packs, index.cast("int")))


def request_outcome(error_class: ColumnOrName, status: ColumnOrName) -> Column:
    """Stable code of one request from its error class and HTTP status."""
    e, s = F.lower(text(error_class)), as_col(status)
    return (
        F.when(e == "", "success")
        .when(e == "deadline", "deadline_exceeded")
        .when(e == "timeout", "timeout")
        .when((e == "http") & s.isin(401, 403), "authentication_error")
        .when((e == "http") & s.isin(400, 404, 405, 422), "invalid_request")
        .when((e == "http") & (s == 429), "rate_limited")
        .when(e == "http", "http_error")
        .when(e == "connection", "connection_error")
        .when(e == "request", "request_error")
        .otherwise("unexpected_error")
    )


TERMINAL_OUTCOMES = ("authentication_error", "invalid_request", "rate_limited", "deadline_exceeded")


def reserved_refill_calls(settings: EnrichSettings, available: ColumnOrName | int) -> Column:
    have = F.lit(available) if isinstance(available, int) else as_col(available)
    total = F.greatest(F.lit(0), F.least(F.lit(settings.max_total_calls), have))
    stages = 3 if settings.official_fallback else 2
    wanted = settings.max_refill_rounds * stages
    if settings.max_refill_rounds <= 0 or settings.min_articles <= 1:
        return F.lit(0)
    room = F.greatest(F.lit(0), total - 1) if settings.max_verify_calls > 0 else total
    return F.least(F.lit(wanted), room)
