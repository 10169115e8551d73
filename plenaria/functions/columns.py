"""Column expressions: dates and periods, missing values, eras and terms, topic labels, language scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dash code points that count as "-", and entities of topic labels.
DASHES = "‐‑‒–—―−﹘﹣－"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
# First days of the parliamentary terms 2 to 10.
TERMS = (
    (10, "2024-07-16"), (9, "2019-07-02"), (8, "2014-07-01"), (7, "2009-07-14"), (6, "2004-07-20"),
    (5, "1999-07-20"), (4, "1994-07-19"), (3, "1989-07-25"), (2, "1984-07-24"),
)
SPACE = r"[\s ﻿]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def period(date: str | Column, interval: str) -> Column:
    """An ISO date as yyyy-MM, yyyy-Qn or yyyy."""
    date = col(date)
    if interval == "month":
        return F.substring(date, 1, 7)
    if interval == "year":
        return F.substring(date, 1, 4)
    if interval == "quarter":
        return F.concat(F.substring(date, 1, 4), F.lit("-Q"), F.ceil(F.substring(date, 6, 2).cast("int") / 3).cast("string"))
    raise ValueError(f"no such interval: {interval}")


def filled(c: str | Column) -> Column:
    """Not null and not only spaces."""
    return col(c).isNotNull() & (F.trim(col(c)) != "")


def unset(c: str | Column) -> Column:
    """Null or empty; spaces count as a value here."""
    return col(c).isNull() | (col(c) == "")


def effective_group() -> Column:
    return F.coalesce("political_group_std", "political_group")


def effective_language() -> Column:
    return F.upper(F.coalesce("language", F.lit("UNK")))


def between(date: str | Column, start: str | None = None, end: str | None = None) -> Column:
    """An inclusive range, each bound optional."""
    date, out = col(date), F.lit(True)
    out = out if start is None else out & (date >= start)
    return out if end is None else out & (date <= end)


def percent(part: Column, whole: Column) -> Column:
    """Percent with one decimal, half up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 1000.0 / whole + 0.5) / 10.0)


def rounded(value: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def term(date: str | Column) -> Column:
    """Parliamentary term of a date; a missing date is the current term."""
    date = col(date)
    return F.when(date.isNull(), 10).otherwise(reduce(lambda rest, t: F.when(date >= t[1], t[0]).otherwise(rest), reversed(TERMS), F.lit(1)))


def brexit_era(date: str | Column) -> Column:
    date = col(date)
    return F.when(date < "2016-06-23", "Pre-Brexit").when(date <= "2020-01-31", "Brexit-Negotiation").otherwise("Post-Brexit")


def crisis_era(date: str | Column, covid_end: str = "2022-06-01") -> Column:
    date = col(date)
    return F.when(date.between("2020-03-01", covid_end), "COVID-Crisis").when(date >= "2022-02-24", "Ukraine-War").otherwise("Normal")


def brexit_phase(date: str | Column) -> Column:
    """Phases that share their boundary days with the earlier one."""
    date = col(date)
    return (
        F.when(date < "2016-06-23", "Pre-Referendum").when(date <= "2017-03-29", "Post-Referendum").when(date <= "2020-01-31", "Article-50").otherwise("Post-Exit")
    )


def trimmed(c: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def topic_label(c: str | Column) -> Column:
    """A topic label with its entities undone, plain dashes and no outer space."""
    out = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, col(c))
    return trimmed(F.translate(out, DASHES, "-" * len(DASHES)))


def topic_label_short(c: str | Column) -> Column:
    """As topic_label(), with the ampersand as the only entity."""
    return trimmed(F.translate(F.replace(col(c), F.lit("&amp;"), F.lit("&")), DASHES, "-" * len(DASHES)))


def collapse_key(c: str | Column) -> Column:
    """What variants of a label have in common: case, spacing and hyphens don't count."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(topic_label(c)), r"\s*-\s*", " "), r"\s+", " "))


def cleaned(c: str | Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"<[^>]*>", " "), r"\s+", " "))


def script_language(c: str | Column) -> Column:
    """struct(language, confidence) where three tenths of 20 characters or more are Greek or Cyrillic, else null."""
    n = F.length(F.regexp_replace(col(c), r"\s", ""))
    share = lambda block: F.regexp_count(col(c), F.lit(f"[{block}]")) / n
    found = lambda code, p: F.struct(F.lit(code).alias("language"), F.lit(p).alias("confidence"))
    return F.when(n >= 20, F.when(share(r"Ͱ-Ͽ") >= 0.3, found("EL", 0.999)).when(share(r"Ѐ-ӿ") >= 0.3, found("BG", 0.995)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def tokens(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"[^a-z0-9]+"), lambda t: t != ""))


def label_of(labels: Column) -> Column:
    """Of a map of languages: the English value, else the first, else empty."""
    return F.coalesce(F.try_element_at(labels, F.lit("EN")), F.get(F.map_values(labels), F.lit(0)), F.lit(""))


def longer(a: Column, b: Column) -> Column:
    return F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)


def sitting_date(date: str | Column, activity_date: str | Column, sitting_id: str | Column) -> Column:
    """The date, else the activity's, else the one in an id of the form sitting-DATE."""
    sid = col(sitting_id)
    return F.coalesce(col(date), col(activity_date), F.when(sid.startswith("sitting-"), F.substring(sid, 9, 10)))


def document_url(date: str | Column) -> Column:
    return F.concat(F.lit("https://www.europarl.europa.eu/doceo/document/CRE-"), term(date), F.lit("-"), col(date), F.lit("_EN.html"))


def looks_like_page(html: str | Column) -> Column:
    """Long enough and with the marks of a transcript page."""
    return (F.length(col(html)) >= 500) & col(html).rlike(r"(?i)<html|arrow_title_doc\.gif|<table|<td")


def has_markup(c: str | Column) -> Column:
    return F.contains(col(c), F.lit("<p ")) | F.contains(col(c), F.lit("<div "))


def short_uri(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def pretty_type(c: str | Column) -> Column:
    return F.initcap(F.replace(short_uri(c), F.lit("_"), F.lit(" ")))


def preview(paragraphs: Column, n: int = 3, chars: int = 300) -> Column:
    return F.substring(F.array_join(F.slice(paragraphs, 1, n), " "), 1, chars)


def json_block(c: str | Column, schema: str) -> Column:
    """A reply parsed as JSON, or else the first array or object in it."""
    inner = F.coalesce(F.nullif(F.regexp_extract(col(c), r"(?s)(\[.*\])", 1), F.lit("")), F.nullif(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1), F.lit("")))
    return F.coalesce(F.from_json(col(c), schema), F.from_json(inner, schema))


def cost(tokens: Column, price_per_million: float) -> Column:
    return tokens / 1e6 * price_per_million
