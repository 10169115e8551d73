"""Types of the tables, and how a table of another age is brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PERSONS = (
    "id long, label string, givenName string, familyName string, sortLabel string, country string, politicalGroup string, "
    "is_current boolean, source string, last_updated timestamp"
)
SITTINGS = (
    "id string, type string, label string, personId long, date string, content string, docIdentifier string, notationId string, "
    "activity_type string, activity_date string, activity_start_date string, last_updated timestamp"
)
SPEECHES = (
    "id long, sitting_id string, speaker_name string, political_group string, title string, speech_content string, speech_order int, "
    "created_at timestamp, mep_id long, language string, topic string, macro_topic string, macro_specific_focus string, macro_confidence double, "
    "political_group_raw string, political_group_std string, political_group_kind string, political_group_reason string, "
    "macro_classified_by string, macro_classified_at timestamp, macro_classification_cost double"
)
MART = {
    "metadata": "key string, value string",
    "topics": "topic string, variants array<string>",
    "periods": "period string, interval_type string",
    "timeseries": "period string, topic string, n long, interval_type string",
    "by_group": "topic string, grp string, n long",
    "by_language": "topic string, language string, n long",
    "languages": "language string, n long",
    "overview": "total long, with_macro long, pct_with_macro double",
    "top_topics": "topic string, n long, topic_rank int",
    "top_focuses": "topic string, focus string, n long",
}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """`df` with the columns of `ddl` in order: missing ones are null, others are cast; additional ones stay behind them."""
    schema = StructType.fromDDL(ddl)
    have = set(df.columns)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return df.select(*cols, *[c for c in df.columns if c not in set(schema.names)])
