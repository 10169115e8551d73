"""What a request asks for: lists of topics, and spans of time by name."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Months that each named span goes back.
SPANS = {"year": 12, "6months": 6, "3months": 3}


def topic_filter(value: str | Sequence[str] | None) -> list[str] | None:
    """The topics of a list, of a JSON array in a string, or of a string with commas; None (no filter) for nothing and for broken JSON."""
    if not value:
        return None
    if not isinstance(value, str):
        return list(value)
    if not value.strip().startswith("["):
        return [t.strip() for t in value.split(",") if t.strip()]
    try:
        return json.loads(value)
    except ValueError:
        return None


def with_variants(topics: Sequence[str], variants: DataFrame) -> DataFrame:
    """(macro_topic) the labels that stand for `topics`: all variants (topic, variants) of a canonical label, and the labels themselves."""
    asked = variants.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    known = variants.join(asked, "topic", "left_semi").select(F.explode("variants").alias("macro_topic"))
    return known.union(asked).distinct()


def months_before(day: date, months: int) -> date:
    """The same day some months earlier; a day that the month lacks goes over into the next one."""
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(year, month + 1, 1) + timedelta(days=day.day - 1)


def time_frame(name: str, as_of: str, start: str | None = None, end: str | None = None) -> tuple[str | None, str | None]:
    """Inclusive bounds of "all", "year", "6months", "3months" (before `as_of`) or "custom" (`start` and `end`, each may be missing)."""
    if name in SPANS:
        return months_before(date.fromisoformat(as_of), SPANS[name]).isoformat(), None
    return (start or None, end or None) if name == "custom" else (None, None)
