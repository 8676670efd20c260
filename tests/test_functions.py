from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import dates as D
from tidewire.functions import numbers as N
from tidewire.functions import reader as R
from tidewire.functions import text as X
from tidewire.functions import tokens as K
from tidewire.functions import urls as U


def values(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    return [x.asDict(True) if hasattr(x, "asDict") else x for x in row]


def test_titles(spark):
    raw = F.lit("  Café—X_y: 人工智能！ B-2 ")
    assert values(spark, X.normalize_title_identity(raw), X.normalize_title_search(raw)) == [
        "café x y 人工智能 b 2",
        "café x_y 人工智能 b 2",
    ]


def test_url_keys(spark):
    a = F.lit("HTTPS://Ex.com/a/b/?utm_source=1&b=2&a=%20x~*&ref=q#f")
    out = values(
        spark,
        U.canonical_url_identity(a),
        U.canonical_url_identity(F.lit("example.com/a")),
        U.canonical_url_identity(F.lit("https://Example.com/story/?utm_source=feed#comments")),
        U.canonical_url_search(F.lit("http://www.Ex.com/a;p/")),
        U.canonical_story_url(F.lit("http://www.Ex.com/a/?q=1")),
        U.canonical_story_url(F.lit("ftp://a.b/c")),
        U.url_host(F.lit("https://Ex.com**.")),
        U.host_of(F.lit("https://u:p@Ex.com:80/x")),
    )
    assert out == [
        "https://ex.com/a/b?a=+x~%2A&b=2",
        "",
        "https://example.com/story",
        "www.ex.com/a;p",
        "ex.com/a",
        "",
        "ex.com",
        "ex.com",
    ]


def test_dates(spark):
    def epoch(s, f=D.parse_published):
        return F.unix_timestamp(f(F.lit(s)))

    base = 1784368800  # 2026-07-18T10:00:00Z
    out = values(
        spark,
        epoch("2026-07-18T10:00:00Z"),
        epoch("2026-07-18T18:00"),
        epoch("Sat, 18 Jul 2026 10:00:00 GMT"),
        epoch("18 Jul 2026 06:00:00 -0400"),
        epoch("2026-07-18T18:00:00.123456+08:00"),
        epoch("2026-07-18T18:00+0800"),
        epoch("2026-07-18 10:00Z"),
        epoch("2026-07-18"),
        epoch("2026-13-01"),
        epoch("junk"),
        epoch("2026-07-18T18:00", D.parse_strict),
        epoch("2026-07-18T10:00:00+00:00", D.parse_strict),
    )
    assert out == [base] * 7 + [base - 18 * 3600, None, None, None, base]
    ref = F.lit("2026-07-18 20:30:00 UTC").cast("timestamp")
    window = values(spark, D.report_window(ref, 24))[0]
    assert [str(v) for v in window.values()] == ["2026-07-18", "2026-07-19"]
    assert values(
        spark,
        D.is_recent_date(F.lit("2026-07-18"), ref),
        D.is_recent_date(F.lit("2026-07-17"), ref),
        D.date_from_url(F.lit("https://x/2026/7/08/a")),
        D.date_from_url(F.lit("https://x/2026/7/08/a"), pad=True),
        D.is_edition_day(F.lit("今天 2025年11月8号"), F.lit(""), F.lit("2025-11-08").cast("date")),
        D.is_edition_day(F.lit(""), F.lit("2025/11/08 10:00"), F.lit("2025-11-08").cast("date")),
        D.is_edition_day(F.lit(""), F.lit("未知时间"), F.lit("2025-11-08").cast("date")),
    ) == [True, False, "", "2026-07-08", True, True, False]
    edge = F.lit("2026-07-16 13:00:00 UTC").cast("timestamp")
    hours = [F.make_dt_interval(hours=F.lit(h), mins=F.lit(m)) for h, m in ((48, 0), (48, 1))]
    assert values(
        spark,
        D.is_recent_instant(edge - hours[0], edge),
        D.is_recent_instant(edge - hours[1], edge),
        D.is_recent_instant(edge + F.make_dt_interval(mins=F.lit(5)), edge),
        D.is_recent_instant(edge + F.make_dt_interval(mins=F.lit(6)), edge),
    ) == [True, False, True, False]


def test_numbers(spark):
    claims = N.number_claims(
        F.lit("raised $1.5 billion, 30％ and 2,000 万 two zero one 1.2.3 100 GPT5 3.10k")
    )
    out = values(
        spark,
        claims,
        N.number_keys(F.lit("$1.5 B 3 万"), F.lit("")),
        N.raw_number_keys(F.lit("7 Billion 5 x")),
        N.safe_int(F.lit("7.0"), 3),
        N.safe_float(F.lit("x"), 1.5),
        N.rate(F.lit(1), F.lit(3)),
        N.rate(F.lit(1), F.lit(0)),
    )
    assert out == [
        sorted(["1500000000", "30%", "20000000", "2", "0", "100", "3100"]),
        ["$1.5b", "3万"],
        ["7 Billion", "5 "],
        3,
        1.5,
        0.3333,
        None,
    ]


def test_tokens(spark):
    out = values(
        spark,
        K.story_tokens(F.lit("OpenAI launches GPT-5.1 for the Developers - The Verge")),
        K.identity_terms(F.lit("GPT-5.1 companies classes the Kimi-K3")),
        K.version_terms(K.identity_terms(F.lit("GPT-5.1 Kimi-K3"))),
        K.token_weight_sum(F.array(F.lit("gpt-5"), F.lit("openai"), F.lit("apple"), F.lit("cat"))),
        K.cjk_runs(F.lit("a模型b发布会c")),
    )
    assert out == [
        ["gpt-5.1", "openai"],
        sorted(["gpt-5.1", "gpt", "5", "1", "company", "classe", "kimi-k3", "kimi", "k3"]),
        ["gpt-5.1", "k3", "kimi-k3"],
        4.5,
        ["模型", "发布会"],
    ]


def test_reader_text(spark):
    long_fact = "这家公司今天发布了新的推理模型，并且向所有开发者开放了测试资格和完整文档。"
    out = values(
        spark,
        R.headline_sentence(F.lit("公司：能力飞跃"), F.lit("公司 表示很好")),
        R.headline_sentence(F.lit("公司：引争议"), F.lit("")),
        R.source_sentences(F.lit("甲。 乙: 丙！丁")),
        R.source_sentences(F.lit("没有句号")),
        R.reader_issues(F.lit(long_fact)),
        R.reader_issues(F.lit("据悉：短…。短")),
        R.numbered_items(F.lit("1. abc\n## 2、 xyz \nno")),
        R.public_text(F.lit("〔AGI 趋势 #3 热度 9〕 [a1] 看[这里](http://x) http://y.z ，好")),
        R.parse_draft_json(F.lit('```json\n{"items":[{"article_id":"a1","summary":"s"}]}\n```')),
        R.parse_draft_json(F.lit('{"items":[{"article_id":"a1","summary":"s","x":1}]}')),
        X.chinese_ratio(F.lit("中文ab")),
    )
    assert out[0] == "公司称能力显著跃迁。"
    assert out[1] == "公司是引发业界争议。"
    assert out[2:4] == [["甲。", "乙， 丙！"], ["没有句号。"]]
    assert out[4] == []
    assert out[5] == ["too_short", "colon", "truncated", "vague_attribution", "no_sentence_end"]
    assert out[6] == ["abc", "xyz"]
    assert out[7] == "看这里，好"
    assert out[8]["items"][0]["article_id"] == "a1" and out[9] is None
    assert out[10] == 0.5


def test_codes_and_redaction(spark):
    out = values(
        spark,
        X.safe_code(F.lit("__a b!!c..")),
        X.safe_code(F.lit("!!")),
        X.clean_html_fragment(F.lit("<p>A <b>useful</b> &amp;#8217; x</p>")),
        X.redact_json(F.lit('{"a":1,"api_key":"x","b":{"token":[1,2],"c":"d"}}')),
        X.scrub_text(F.lit("fail sk-1"), ["sk-1"]),
        A.request_outcome(F.lit("http"), F.lit(429)),
        A.query_for_round(
            F.array(F.lit("q0"), F.lit("q1")),
            F.lit("1970-01-01").cast("date"),
            F.lit("secondary_refill"),
            F.lit(0),
        ),
    )
    assert out == [
        "a_b_c",
        "unknown_error",
        "A useful ’ x",
        '{"a":1,"b":{"c":"d"}}',
        "fail [redacted]",
        "rate_limited",
        "q0",
    ]
