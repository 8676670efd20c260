"""Tunable policy values; every operator takes one of these or plain keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

REPORT_TZ = "Asia/Shanghai"


@dataclass(frozen=True)
class GateSettings:
    # fixed values: hosts that never count as direct evidence
    social_hosts: tuple[str, ...] = (
        "facebook.com",
        "instagram.com",
        "linkedin.com",
        "reddit.com",
        "tiktok.com",
        "twitter.com",
        "x.com",
        "youtube.com",
    )
    ranking_hosts: tuple[str, ...] = ("agihunt.info", "www.agihunt.info", "news.google.com")
    # ranking hosts whose article pages are evidence once they carry none of `listing_query_keys`
    ranking_article_suffix: str = "agihunt.info"
    listing_query_keys: tuple[str, ...] = ("t", "day")
    title_only_sources: tuple[str, ...] = ("techcrunch",)
    unknown_times: tuple[str, ...] = ("unknown", "未知", "未知时间", "none")
    digest_sources: tuple[str, ...] = ("aibase",)
    digest_title_prefixes: tuple[str, ...] = ("ai日报",)


@dataclass(frozen=True)
class EnrichSettings:
    provider: str = "tavily"
    min_articles: int = 0
    strict_hours: int = 24
    max_total_calls: int = 30
    max_verify_calls: int = 0
    max_refill_rounds: int = 0
    refill_max_results: int = 8
    official_fallback: bool = False
    lenient_enabled: bool = False
    lenient_hours: int = 72
    refill_window_hours: int = 24
    max_leads: int = 10
    rounds: int = 2
    max_age_hours: int = 72
    min_evidence_chars: int = 80
    evidence_chars: int = 600
    min_score: float = 0.15
    similarity: float = 0.82


@dataclass(frozen=True)
class SelectSettings:
    limit: int = 10
    source_share: float = 0.60
    max_primary: int = 2
    max_mentioned: int = 3
    max_family: int = 1
    policy: str = "source_balanced_v2"


@dataclass(frozen=True)
class ChannelSettings:
    source: str = "agihunt"
    provider: str = "AGI HUNT · agihunt.info"
    retrieval: str = "channel_hot"
    core_channels: tuple[str, ...] = ("models", "research", "coding-agents")
    supplemental_channel: str = "products"
    max_articles: int = 20
    per_channel_limit: int = 6
    core_quota: int = 3
    supplemental_quota: int = 3
    max_age_hours: int = 30
    future_tolerance_minutes: int = 5
    entity_limit: int = 2
    entity_keywords: tuple[str, ...] = (
        "openai",
        "anthropic",
        "google",
        "meta",
        "microsoft",
        "xai",
        "deepseek",
        "nvidia",
    )
    source_priority: int = 3


@dataclass(frozen=True)
class TrendSettings:
    source: str = "agihunt_trending"
    provider: str = "AGI HUNT · agihunt.info"
    page_url: str = "https://agihunt.info/"
    window: str = "1d"
    minimum: int = 10
    expected: int = 15
    maximum: int = 15
    maximum_rows: int = 20
    source_priority: int = 3


@dataclass(frozen=True)
class SourceLabels:
    # fixed values: reader-facing label per source key or host
    labels: dict[str, str] = field(
        default_factory=lambda: {
            "agihunt": "AGI HUNT · agihunt.info",
            "agihunt_trending": "AGI HUNT · agihunt.info",
            "aibase": "AIBase",
            "techcrunch": "TechCrunch",
            "techcrunch.com": "TechCrunch",
            "theverge": "The Verge",
            "theverge.com": "The Verge",
            "www.theverge.com": "The Verge",
            "reuters.com": "Reuters",
            "www.reuters.com": "Reuters",
            "nypost.com": "New York Post",
            "www.nypost.com": "New York Post",
            "syft": "Syft",
        }
    )
    merged_groups: dict[str, str] = field(
        default_factory=lambda: {"agihunt": "agihunt", "agihunt_trending": "agihunt"}
    )
