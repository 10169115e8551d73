"""The mart brought up to date equals one that is built anew, and reads only what has changed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plenaria.plans import mart
from plenaria.schema import MART
from plenaria.sources import sinks

FACTS = "sitting_id string, speech_order int, macro_topic string, macro_specific_focus string, political_group string, political_group_std string, language string, mep_id long"


def content(spark, path):
    out = {t: sorted(map(tuple, df.collect()), key=str) for t, df in mart.load(spark, path).items() if t != "metadata"}
    assert set(out) == set(MART) - {"metadata"}
    rows = sinks.read(spark, f"{path}/cube")
    names = sorted(set(rows.columns) - {mart.BUCKET, "n"})
    return out | {"cube": sorted(map(tuple, rows.groupBy(*names).agg(F.sum("n")).collect()), key=str)}


def facts(spark, some, days, n):
    topics = ["Fish", "fish", "Energy &amp; Climate", "energy & climate", " ", None, "Trade"]
    row = lambda day, i: (f"sitting-{day}" if day else "undated", i, some.choice(topics), some.choice(["f", None]), some.choice(["PPE", "ID"]), some.choice([None, "ECR"]), some.choice(["EN", "fr", None]), some.choice([None, 1, 7, 40_000, 70_001]))
    return spark.createDataFrame([row(day, i) for day in days for i in range(some.randint(1, n))], FACTS)


def test_refreshed_equals_built(spark, tmp_path):
    some = random.Random(8)
    days = [f"20{y}-{m:02}-{d:02}" for y in (20, 21) for m in (1, 5, 6) for d in (3, 9)]
    speeches, sittings, path = f"{tmp_path}/speeches", f"{tmp_path}/sittings", f"{tmp_path}/mart"
    sinks.write(facts(spark, some, [*days, None], 5), speeches, key="sitting_id")
    sinks.write(spark.createDataFrame([(f"sitting-{d}", d) for d in days] + [("undated", None)], "id string, activity_date string"), sittings, key="id")
    assert len(mart.refresh(spark, speeches, sittings, path)["cube"]) == 7
    assert mart.refresh(spark, speeches, sittings, path) == {"cube": set(), "speaker_days": set()}
    for nth in range(1, 3):
        touched = some.sample(days, 2)
        sinks.replace_sittings(facts(spark, some, touched, 6), speeches)
        if nth == 1:
            sinks.delete_sittings(spark.createDataFrame([(f"sitting-{days[0]}",), ("undated",)], "id string"), str(tmp_path))
        if nth == 2:
            sinks.upsert(spark.createDataFrame([(f"sitting-{days[5]}", "2022-02-02"), ("sitting-2023-01-01", "2023-01-01")], "id string, activity_date string"), sittings)
            sinks.append(facts(spark, some, ["2023-01-01"], 6), speeches)
        read = mart.refresh(spark, speeches, sittings, path)["cube"]
        assert {d[:7] for d in touched} <= read and len(read) <= 2 + 2 * (nth == 1) + 2 * (nth == 2)
        mart.build(sinks.read(spark, speeches), sinks.read(spark, sittings), f"{tmp_path}/anew{nth}")
        assert content(spark, path) == content(spark, f"{tmp_path}/anew{nth}")
        joined = sinks.read(spark, speeches).join(sinks.read(spark, sittings).withColumnRenamed("id", "sitting_id"), "sitting_id")
        inside = joined.where("activity_date between '2020-01-04' and '2021-06-03'").withColumn("grp", F.coalesce("political_group_std", "political_group"))
        want = inside.groupBy("grp").agg(F.count("*"), F.count_distinct("mep_id"), F.count_distinct("activity_date"))
        assert sorted(map(tuple, mart.distinct_counts(spark, path, "2020-01-04", "2021-06-03").collect())) == sorted(map(tuple, want.collect()))
        (all_groups,) = mart.distinct_counts(spark, path, by=None).collect()
        assert tuple(all_groups) == tuple(joined.where("activity_date is not null").agg(F.count("*"), F.count_distinct("mep_id"), F.count_distinct("activity_date")).first())


def test_refresh_after_cleared_commits_and_other_layouts(spark, tmp_path):
    some = random.Random(9)
    speeches, sittings, path = f"{tmp_path}/speeches", f"{tmp_path}/sittings", f"{tmp_path}/mart"
    sinks.write(facts(spark, some, ["2020-01-03", "2020-02-03"], 4), speeches, key="sitting_id")
    sinks.write(spark.createDataFrame([("sitting-2020-01-03", "2020-01-03"), ("sitting-2020-02-03", "2020-02-03")], "id string, activity_date string"), sittings)
    assert len(mart.refresh(spark, speeches, sittings, path)["cube"]) == 2 == len(mart.refresh(spark, speeches, sittings, path)["cube"])
    sinks.write(sinks.read(spark, sittings), sittings, key="id")
    mart.refresh(spark, speeches, sittings, path)
    sinks.replace_sittings(facts(spark, some, ["2020-01-03"], 4), speeches)
    sinks.vacuum(spark, speeches)
    assert len(mart.refresh(spark, speeches, sittings, path)["cube"]) == 2
    mart.build(sinks.read(spark, speeches), sinks.read(spark, sittings), f"{tmp_path}/anew")
    assert content(spark, path) == content(spark, f"{tmp_path}/anew")


def test_mart_of_no_facts(spark, tmp_path):
    empty = spark.createDataFrame([], FACTS)
    mart.build(empty, spark.createDataFrame([], "id string, activity_date string"), str(tmp_path), people=True)
    assert mart.distinct_counts(spark, str(tmp_path)).collect() == []
    with pytest.raises(sinks.TableNotFound):
        mart.distinct_counts(spark, f"{tmp_path}/none")
