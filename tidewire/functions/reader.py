"""Reader-facing sentences: public text, source sentences, headline sentences, model drafts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import ColumnOrName, compact_text, strip, text, visible_chars

# fixed values: character budgets of one reader sentence
MIN_CHARS, TARGET_MIN, TARGET_MAX, MAX_CHARS = 30, 35, 60, 80
IMPACT_MIN, IMPACT_MAX = 15, 70

# fixed values: wording rules of the reader contract
VAGUE_ATTRIBUTION = (
    r"(?:据(?:公开|媒体|外媒|多方|相关|最新)?报道|据悉|据称|(?:有)?报道称|"
    r"(?:有|市场|相关)?消息(?:称|显示|透露)|消息人士(?:称|透露|表示)|"
    r"(?:知情|业内)人士(?:称|透露|表示)|(?:外媒|媒体)(?:报道称|报道|称)|传闻称|网传)"
)
TREND_SIGNAL = (
    r"(?i)(?:AGI\s*趋势|热度\s*\d|[↑↓]\s*\d|新上榜|"
    r"(?<![\p{L}\p{N}_])trend_(?:rank|heat|state|delta)(?![\p{L}\p{N}_]))"
)
TREND_BADGE = r"(?i)〔\s*AGI\s*趋势\s*#?\d+[^〕]*〕\s*"
TRUNCATION = r"(?:…|\.{3,})"
PUBLIC_LINK = r"(?i)(?:https?://|www\.)|\[[^\]]+\]\([^)]*\)"
PUBLIC_ID = r"(?i)\[a\d+\]"
REWRITES = (("能力飞跃", "能力显著跃迁"), ("引争议", "引发业界争议"))


def public_text(value: ColumnOrName, list_item: bool = False) -> Column:
    out = F.regexp_replace(text(value), TREND_BADGE, "")
    out = F.regexp_replace(out, r"(?i)\[a\d+\]\s*", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?i)(?:https?://|www\.)[^\s\p{Z}]+", "")
    out = F.regexp_replace(compact_text(out), r"\s+([，。！？；：])", "$1")
    return F.regexp_replace(out, "[:：]", "，") if list_item else out


def complete_sentence(value: ColumnOrName) -> Column:
    v = compact_text(value)
    closed = F.concat(F.regexp_replace(v, "[ ，、；:：]+$", ""), F.lit("。"))
    return F.when(v == "", "").when(v.rlike("[。！？]$"), v).otherwise(closed)


def source_sentences(value: ColumnOrName) -> Column:
    v = compact_text(value)
    # cut behind every sentence end: linear, unlike a pattern that scans for an end from each start
    pieces = F.split(v, "(?<=[。！？])")
    found = F.transform(
        F.filter(pieces, lambda s: s.rlike("[。！？]$") & (F.length(s) > 1)), lambda s: strip(s)
    )
    whole = F.when(v != "", F.array(complete_sentence(v))).otherwise(
        F.array().cast("array<string>")
    )
    picked = F.when(F.size(found) > 0, found).otherwise(whole)
    return F.transform(picked, lambda s: F.regexp_replace(s, "[:：]", "，"))


def headline_sentence(title: ColumnOrName, description: ColumnOrName) -> Column:
    """Headline as a sentence: 'subject：claim' gets a verb that fits the description."""
    t = compact_text(title)
    subject = strip(F.regexp_extract(t, "^([^:：]*)[:：]", 1))
    claim = strip(F.regexp_extract(t, "^[^:：]*[:：](.*)$", 1))
    body = text(description)
    quoted = F.concat(
        F.lit(r"\Q"), F.replace(subject, F.lit("\\E"), F.lit("")), F.lit(r"\E"),
        F.lit(r"\s*(?:说|称|表示|指出|认为|透露|宣布)"),
    )
    verb = F.when(F.regexp_like(body, quoted), "称").otherwise("是")
    out = F.when((subject != "") & (claim != ""), F.concat(subject, verb, claim)).otherwise(t)
    for old, new in REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return complete_sentence(F.regexp_replace(out, "[:：]", "，"))


def _rules(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in pairs]))


def reader_issues(value: ColumnOrName) -> Column:
    """Codes of violated rules for one fact sentence, in rule order."""
    v = compact_text(value)
    n = visible_chars(v)
    ends = v.rlike("[。！？]$")
    issues = _rules(
        ("too_short", n < MIN_CHARS),
        ("too_long", n > MAX_CHARS),
        ("colon", v.rlike("[:：]")),
        ("truncated", v.rlike(TRUNCATION)),
        ("vague_attribution", v.rlike(VAGUE_ATTRIBUTION)),
        ("trend_signal", v.rlike(TREND_SIGNAL)),
        ("no_sentence_end", ~ends),
        ("several_sentences", ends & v.rlike("[。！？](?=.)")),
    )
    return F.when(v == "", F.array(F.lit("empty"))).otherwise(issues)


def impact_issues(value: ColumnOrName) -> Column:
    v = compact_text(value)
    n = visible_chars(v)
    ends = v.rlike("[。！？]$")
    issues = _rules(
        ("too_short", n < IMPACT_MIN),
        ("too_long", n > IMPACT_MAX),
        ("truncated", v.rlike(TRUNCATION)),
        ("no_sentence_end", ~ends),
        ("several_sentences", ends & v.rlike("[。！？](?=.)")),
    )
    return F.when(v == "", F.array(F.lit("empty"))).otherwise(issues)


def numbered_items(content: ColumnOrName) -> Column:
    lines = F.split(text(content), r"\r\n|\r|\n")
    pattern = r"^\s*(?:#{1,6}\s+)?\d+[.、]\s+(.+?)\s*$"
    return F.transform(
        F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 1)
    )


def strip_code_fence(content: ColumnOrName) -> Column:
    v = strip(content)
    pattern = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return F.when(v.rlike(pattern), strip(F.regexp_extract(v, pattern, 1))).otherwise(v)


DRAFT = (
    "items array<struct<article_id:string,title:string,summary:string,why_it_matters:string>>,"
    "discussion_topic string"
)


def parse_draft_json(content: ColumnOrName) -> Column:
    """Strict draft contract: NULL unless keys and required fields match exactly."""
    body = strip_code_fence(content)
    parsed = F.from_json(body, DRAFT)
    keys = F.json_object_keys(body)
    allowed = F.array(F.lit("items"), F.lit("discussion_topic"))
    item_keys = F.transform(
        F.from_json(F.get_json_object(body, "$.items"), "array<map<string,string>>"),
        lambda m: F.map_keys(m),
    )
    item_allowed = F.array(*[F.lit(k) for k in ("article_id", "title", "summary", "why_it_matters")])
    ok = (
        F.array_contains(keys, "items")
        & (F.size(F.array_except(keys, allowed)) == 0)
        & F.forall(item_keys, lambda k: F.size(F.array_except(k, item_allowed)) == 0)
        & F.forall(
            parsed["items"], lambda i: i["article_id"].isNotNull() & i["summary"].isNotNull()
        )
    )
    items = F.transform(
        parsed["items"],
        lambda i: F.struct(
            i["article_id"].alias("article_id"),
            F.coalesce(i["title"], F.lit("")).alias("title"),
            i["summary"].alias("summary"),
            F.coalesce(i["why_it_matters"], F.lit("")).alias("why_it_matters"),
        ),
    )
    topic = F.coalesce(parsed["discussion_topic"], F.lit("你最关注哪条AI新闻？"))
    return F.when(ok, F.struct(items.alias("items"), topic.alias("discussion_topic")))
