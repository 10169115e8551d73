"""Which texts contain which strings: an index of character grams and an exact look, instead of all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(c: Column, q: int) -> Column:
    """The distinct substrings of `q` characters, in one linear pass: a pattern that matches nothing looks ahead at each place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast: both sides are exploded, so they are many times as large as their files let Spark expect."""
    return left.join(right.hint("merge"), list(on), how)


def _ids(c: str, a: str, b: str) -> list[Column]:
    """128 bits that stand for a string where many rows refer to it."""
    return [F.xxhash64(c).alias(a), F.xxhash64(F.lit(1), F.col(c)).alias(b)]


def contained(forms: DataFrame, texts: DataFrame, within: Sequence[str] = (), q: int = 4) -> DataFrame:
    """(within..., form, text) of each distinct `form` and each distinct `text` that contains it, with equal values of `within`.

    A text that contains a form contains each of its grams, so each form is looked up by
    the one that the fewest texts have; forms with a gram that no text has are out
    at once. Forms of fewer than `q` characters are grams of their own length, and need no
    further look. Both sides are equi-joins, which adaptive execution splits where a
    gram is frequent; rows of the index are as many as the texts have characters, and
    hold hashes of form and text, never these. Of a long form every `q`-th gram is looked up.
    Nulls and empty forms match nothing.
    """
    keys, form, text = list(within), ["__f", "__g"], ["__t", "__u"]
    forms = forms.select(*keys, "form").where("form <> ''").distinct().select("*", *_ids("form", *form))
    texts = texts.select(*keys, "text").where("text <> ''").distinct().select("*", *_ids("text", *text))
    # Grams of all sizes are made only where there are forms as short as that.
    short = forms.where(F.length("form") < q).select(*keys, "form", F.length("form").alias("q"))
    sizes = short.groupBy(*keys).agg(F.collect_set("q").alias("sizes"))
    by_size = F.coalesce(*(F.when(F.col("q") == n, grams(F.col("text"), n)) for n in range(1, q)), F.array().cast("array<string>"))
    spread = joined(texts, sizes, keys) if keys else texts.join(F.broadcast(sizes))
    places = spread.withColumn("q", F.explode("sizes")).where(F.length("text") >= F.col("q")).select(*keys, *text, F.explode(by_size).alias("form"))
    exact = joined(joined(places, short.drop("q"), [*keys, "form"]), texts, [*keys, *text]).select(*keys, "form", "text")
    index = texts.where(F.length("text") >= q).select(*keys, *text, F.explode(grams(F.col("text"), q)).alias("gram"))
    held = index.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    long = forms.where(F.length("form") >= q)
    some = F.transform(F.sequence(F.lit(1), F.length("form") - q + 1, F.when(F.length("form") >= 8 * q, q).otherwise(1)), lambda i: F.substring("form", i, F.lit(q)))
    asked = long.select(*keys, *form, F.explode(F.array_distinct(some)).alias("gram"))
    rarest = joined(asked, held, [*keys, "gram"], "left").groupBy(*keys, *form).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("gone"))
    near = joined(rarest.where("gone = 0"), index, [*keys, "gram"]).select(*keys, *form, *text)
    near = joined(joined(near, long, [*keys, *form]), texts, [*keys, *text]).where(F.contains("text", F.col("form"))).select(*keys, "form", "text")
    return near.unionByName(exact)
