"""Tables under concurrent writers, and how much of them a change writes."""

from __future__ import annotations

import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plenaria.sources import commits, sinks
from plenaria.streaming import counts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def size(folder, below=""):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and below in d)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def sittings(spark, n=2000, label="old"):
    day = F.date_add(F.lit("1999-07-20").cast("date"), F.col("id").cast("int"))
    return spark.range(n).select(F.concat(F.lit("sitting-"), day.cast("string")).alias("id"), F.lit(label).alias("label"), F.sha2(F.col("id").cast("string"), 512).alias("content"), F.col("id").alias("n"))


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    """Twenty of 2,000 sittings change: under 3 % of the bytes are written, and the other buckets keep their files."""
    path = str(tmp_path / "t")
    sinks.upsert(sittings(spark), path, by_key=True)
    before, all_files = size(path), files(path)
    changed = sittings(spark).where("n >= 1985").withColumn("label", F.lit("new"))
    sinks.upsert(changed.union(sittings(spark, 2005, "added").where("n >= 2000")), path)
    written = files(path) - all_files
    assert 0 < sum(map(os.path.getsize, written)) < 0.03 * before
    assert {f.split("__bucket=")[1][:7] for f in written} == {"2004-12", "2005-01"}
    assert len(set(sinks.read(spark, path).inputFiles())) < len(all_files) + 3
    assert rows(sinks.read(spark, path).groupBy("label").count()) == [("added", 5), ("new", 15), ("old", 1985)]
    sinks.delete_sittings(sittings(spark).where("n < 3").select("id"), str(tmp_path))  # no tables of these names: nothing to do
    assert sinks.read(spark, path).count() == 2005


def test_deletes_and_replacements_by_bucket(spark, tmp_path):
    said = sittings(spark, 400).select(F.col("id").alias("sitting_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("speech_order"), F.lit("x").alias("text"))
    sinks.write(said, f"{tmp_path}/speeches", key="sitting_id")
    sinks.write(sittings(spark, 400), f"{tmp_path}/sittings", key="id")
    before = files(tmp_path)
    sinks.delete_sittings(sittings(spark, 400).where("n in (0, 1)").select("id"), str(tmp_path))
    assert sinks.read(spark, f"{tmp_path}/speeches").count() == 1194 and sinks.read(spark, f"{tmp_path}/sittings").count() == 398
    assert {f.split("__bucket=")[1][:7] for f in files(tmp_path) - before} == {"1999-07"}
    sinks.replace_sittings(said.where("sitting_id = 'sitting-1999-07-25' and speech_order = 1").withColumn("text", F.lit("y")), f"{tmp_path}/speeches")
    assert rows(sinks.read(spark, f"{tmp_path}/speeches").where("sitting_id = 'sitting-1999-07-25'")) == [("sitting-1999-07-25", 1, "y")]
    sinks.delete_sittings(sittings(spark, 400).select("id"), str(tmp_path))
    assert sinks.read(spark, f"{tmp_path}/speeches").count() == 0 and sinks.read(spark, f"{tmp_path}/speeches").columns == ["sitting_id", "speech_order", "text"]
    sinks.append(said, f"{tmp_path}/speeches")
    assert sinks.read(spark, f"{tmp_path}/speeches").count() == 1200


def test_layouts_by_other_columns(spark, tmp_path):
    """A row whose bucket changes leaves the old one; keys without a date, nulls and odd values have buckets too."""
    path, kind = str(tmp_path / "t"), "id long, day string, v int"
    df = lambda *r: spark.createDataFrame(list(r), kind)
    sinks.write(df((1, "2020-01-05", 1), (2, "2020-02-05", 1), (3, None, 1), (4, "", 1), (5, "a/b=c", 1)), path, by="substr(day, 1, 7)")
    sinks.upsert(df((1, "2020-03-05", 2), (5, None, 2)), path)
    assert rows(sinks.read(spark, path)) == [(1, "2020-03-05", 2), (2, "2020-02-05", 1), (3, None, 1), (4, "", 1), (5, None, 2)]
    other = str(tmp_path / "h")
    sinks.upsert(df(*((i, None, 0) for i in range(500))), other, by_key=True)
    before = files(other)
    sinks.upsert(df((7, None, 1), (8, None, 1)), other)
    assert len(files(other) - before) == 2 and sinks.read(spark, other).agg(F.sum("v")).first()[0] == 2
    sinks.upsert(df((None, "x", 1), (None, "x", 1)), other)
    assert sinks.read(spark, other).where("id is null").count() == 1


def test_new_columns_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(sittings(spark, 40), path, by_key=True)
    for i in range(4):
        sinks.append(spark.createDataFrame([(f"sitting-1999-08-0{i + 1}b", i)], "id string, extra int"), path)
    assert sinks.read(spark, path).where("extra is not null").count() == 4 and sinks.read(spark, path).count() == 44
    assert sinks.compact(spark, path, most=3) == 1 and sinks.compact(spark, path, most=3) == 0
    assert sinks.read(spark, path).count() == 44
    sinks.vacuum(spark, path, older=3600)
    assert sinks.read(spark, path).count() == 44 and len(list((tmp_path / "t").glob("v-*"))) > 1
    sinks.vacuum(spark, path)
    assert len(list((tmp_path / "t").glob("v-*"))) == 1 and len(list((tmp_path / "t/_commits").glob("0*"))) == 1


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    """Eight appends, four replacements of one bucket and four insertions of the same keys, all at once."""
    path = str(tmp_path / "t")
    sinks.upsert(sittings(spark, 100), path, by_key=True)
    line = threading.Barrier(16)

    def work(i):
        line.wait()
        if i < 8:
            sinks.append(sittings(spark, 100).where(f"n = {i}").withColumn("label", F.lit(f"app{i}")), path)
        elif i < 12:
            sinks.replace_sittings(sittings(spark, 100).where(f"n = {40 + i}").withColumn("label", F.lit(f"rep{i}")), path, key="id")
        else:
            sinks.insert_absent(sittings(spark, 103, f"ins{i}").where("n >= 100"), path)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(work, range(16)))
    got = rows(sinks.read(spark, path).select("n", "label"))
    assert len(got) == 111
    assert [g for g in got if g[1].startswith("app")] == [(i, f"app{i}") for i in range(8)]
    assert [g for g in got if g[1].startswith("rep")] == [(40 + i, f"rep{i}") for i in range(8, 12)]
    assert [n for n, label in got if label.startswith("ins")] == [100, 101, 102]
    assert len(list((tmp_path / "t/_commits").glob("0*"))) >= 14


def test_concurrent_creation(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: sinks.upsert(sittings(spark, 10).where(f"n in ({i}, 9)"), path, by_key=i % 2 == 0), range(6)))
    assert sorted(r["n"] for r in sinks.read(spark, path).collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_numbers_are_given_once(spark, tmp_path):
    made = [commits.Commit(1, key=str(i)) for i in range(12)]
    with ThreadPoolExecutor(12) as pool:
        won = list(pool.map(lambda c: commits.publish(spark, str(tmp_path / "t"), c), made))
    assert sum(won) == 1 and commits.newest(spark, str(tmp_path / "t")).key == str(won.index(True))
    with pytest.raises(commits.Conflict):
        commits.commit(spark, str(tmp_path / "t"), None, lambda now: now, commits.EVERY)


def test_batches_are_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.append(sittings(spark, 3), path, once=("job", 0)) and not sinks.append(sittings(spark, 3), path, once=("job", 0))
    assert sinks.append(sittings(spark, 3), path, once=("other", 0)) and sinks.append(sittings(spark, 3), path, once=("job", 1))
    sinks.write(sittings(spark, 1), path)
    assert not sinks.append(sittings(spark, 3), path, once=("job", 1)) and sinks.read(spark, path).count() == 1


def test_updates_of_a_document_under_a_lock(spark, tmp_path):
    path = f"{tmp_path}/rules.json"
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: sinks.update_json(spark, path, lambda old: sorted([*(old or []), i])), range(6)))
    assert sinks.update_json(spark, path, lambda old: old) == [0, 1, 2, 3, 4, 5] and not os.path.exists(f"{path}.lock")
    with sinks.locked(spark, path), pytest.raises(TimeoutError):
        sinks.update_json(spark, path, lambda old: [], wait=0.1)


def test_a_stream_rewrites_only_what_it_brings(spark, tmp_path):
    table, source = str(tmp_path / "t"), tmp_path / "in"
    said = sittings(spark, 900).select(F.col("id").alias("sitting_id"), F.col("n").alias("id"))
    sinks.write(said, table, key="sitting_id")
    before = files(table)
    said.where("id = 10").withColumn("id", F.col("id") + 5000).write.parquet(str(source / "a"))
    counts.refresh_sittings(spark.readStream.schema(said.schema).parquet(str(source / "*")), table, str(tmp_path / "state")).awaitTermination()
    assert sinks.read(spark, table).count() == 900 and sinks.read(spark, table).where("id = 5010").count() == 1
    assert {f.split("__bucket=")[1][:7] for f in files(table) - before} == {"1999-07"}


def test_prepared_tables_change_together(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    sinks.write(sittings(spark, 3), a)
    one, two = sinks.prepare(sittings(spark, 5), a, key="id"), sinks.prepare(sittings(spark, 7), b)
    assert sinks.read(spark, a).count() == 3 and not sinks.exists(spark, b) and one.rows().count() == 5
    one.publish()
    two.publish()
    assert sinks.read(spark, a).count() == 5 and sinks.read(spark, b).count() == 7 and sinks.state(spark, a).key == "id"
