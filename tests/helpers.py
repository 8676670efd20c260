"""Small article builders and brute-force models of the order-dependent rules."""

from __future__ import annotations

import datetime as dt
import random

from tidewire.operators.catalog import load_catalog
from tidewire.schema import ARTICLE

CATALOG = load_catalog(
    {
        "schema_version": 1,
        "as_of": "2026-07-18",
        "core_ai_terms": ["AI", "人工智能", "大模型"],
        "neighbor_terms": ["robot", "chip", "芯片"],
        "actions": {
            "release": ["release", "launches", "发布"],
            "funding": ["raises", "融资"],
            "lawsuit": ["sues", "起诉"],
        },
        "objects": {"data_center": ["data center"], "robotaxi": ["robotaxi"]},
        "topics": {"model_release": ["release"]},
        "entities": [
            {
                "id": "openlab",
                "region": "us",
                "tier": "frontier_lab",
                "requires_ai_context": False,
                "aliases": ["OpenLab"],
                "models": [{"id": "gpt", "aliases": ["GPT", "GPT Image"]}],
            },
            {
                "id": "mega",
                "region": "us",
                "tier": "frontier_lab",
                "requires_ai_context": True,
                "aliases": ["Mega", "巨型"],
                "models": [{"id": "orca", "aliases": ["Orca"]}],
            },
            {
                "id": "chipco",
                "region": "cn",
                "tier": "ai_infrastructure",
                "requires_ai_context": False,
                "aliases": ["ChipCo"],
            },
            {"id": "shop", "region": "eu", "tier": "broad_tech", "aliases": ["Shop"]},
        ],
    }
)

DAY = dt.date(2026, 7, 18)


def article(pos, title, link=None, edition=DAY, **kw):
    row = dict(
        edition=edition,
        pos=pos,
        title=title,
        link=link if link is not None else f"https://site{pos % 3}.example.com/{pos}",
        description="body text",
        content="",
        publish_time="2026-07-18T08:00:00+08:00",
        priority=0,
        source=f"s{pos % 3}",
        kind="story",
        evidence_status="direct",
        confidence="reported",
        provenance={},
        evidence=[],
    )
    row.update(kw)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in ARTICLE.fields) for r in rows], ARTICLE)


def random_titles(seed, n):
    rng = random.Random(seed)
    base = [
        "openlab releases new reasoning model today",
        "mega raises billions for chip data center build",
        "robotaxi service launches in three more cities",
        "shop sues chipco over stolen designs in court",
    ]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            i = rng.randrange(len(t))
            op = rng.random()
            if op < 0.4:
                t[i] = rng.choice("abcdef ")
            elif op < 0.7:
                t.insert(i, rng.choice("xyz"))
            else:
                del t[i]
        out.append("".join(t))
    return out
