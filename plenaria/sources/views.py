"""The model's tables over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.columns import iso_date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sittings(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sittings, optionally of an inclusive range of days: as a filter on the stored timestamp, which the scan can use."""
    orders, time = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    if start is not None:
        orders = orders.where(time >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        orders = orders.where(time < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return orders.select(
        F.col("o_orderkey").alias("id"), iso_date("o_orderdate").alias("activity_date"), F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("person_id"), F.col("o_totalprice").alias("size"),
    )


def speeches(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Facts without a unique id, with missing standardised groups and languages; `of`: those of these sittings only, before anything else is joined."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    line = table(spark, sf_dir, "lineitem")
    line = line if of is None else line.join(of.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("sitting_id"), F.col("l_linenumber").alias("speech_order"), F.col("l_suppkey").alias("mep_id"),
        F.col("p_type").alias("macro_topic"), F.col("p_brand").alias("macro_specific_focus"), F.col("l_returnflag").alias("political_group"),
        F.nullif("l_linestatus", F.lit("O")).alias("political_group_std"), F.nullif("l_returnflag", F.lit("N")).alias("language"),
    )


def event_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a unique id and their own date."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("mep_id"), F.col("event_type").alias("macro_topic"), iso_date("ts").alias("activity_date"), "value", "props"
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("political_group"), (F.col("c_acctbal") >= 0).alias("is_current"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("sitting_id"), F.col("turn").alias("speech_order"), F.col("role").alias("speaker_name"), F.col("text").alias("speech_content")
    )


#: The same views for DuckDB, as common table expressions.
SQL = """
sittings AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS activity_date, o_orderpriority AS type, o_orderstatus AS label,
  o_custkey AS person_id, o_totalprice AS size FROM orders),
star AS (SELECT l_orderkey AS sitting_id, l_linenumber AS speech_order, l_suppkey AS mep_id, p_type AS macro_topic, p_brand AS macro_specific_focus,
  l_returnflag AS political_group, nullif(l_linestatus, 'O') AS political_group_std, nullif(l_returnflag, 'N') AS language
  FROM lineitem JOIN part ON p_partkey = l_partkey),
dated AS (SELECT star.*, activity_date FROM star JOIN sittings ON sittings.id = sitting_id),
ev AS (SELECT event_id AS id, user_id AS mep_id, event_type AS macro_topic, strftime(ts, '%Y-%m-%d') AS activity_date, value, props FROM events),
persons AS (SELECT c_custkey AS id, c_name AS label, n_name AS country, c_mktsegment AS political_group, c_acctbal >= 0 AS is_current
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
turns AS (SELECT conv_id AS sitting_id, turn AS speech_order, role AS speaker_name, text AS speech_content FROM conversations)
"""
