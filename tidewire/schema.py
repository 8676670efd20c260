"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("origin", T.StringType()),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("edition", T.DateType()),
        T.StructField("pos", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("publish_time", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("evidence_status", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)

# values a loose record gets when a field is absent
_DEFAULTS = {
    "description": "",
    "content": "",
    "publish_time": "",
    "source": "",
    "kind": "story",
    "evidence_status": "direct",
    "confidence": "reported",
}


def conform_articles(df: DataFrame) -> DataFrame:
    """Bring loosely shaped article rows to the ARTICLE layout, filling defaults."""

    def pick(field: T.StructField) -> Column:
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        if field.name in _DEFAULTS:
            value = F.coalesce(value, F.lit(_DEFAULTS[field.name]))
        elif field.name == "priority":
            value = F.coalesce(value, F.lit(0))
        elif field.name == "provenance":
            value = F.coalesce(value, F.create_map().cast(field.dataType))
        elif field.name == "evidence":
            value = F.coalesce(value, F.array().cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[pick(f) for f in ARTICLE.fields])
