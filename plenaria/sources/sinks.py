"""Writing tables: upsert, insert if absent, replacement of a sitting, CSV, subsets, stamps and failures.

A table is a folder of Parquet folders and of numbered descriptions of them (commits.py).
Its rows are dealt into buckets by an expression, as a rule the month that a sitting's key
names (bucket_of). An upsert, a replacement or a delete finds the buckets that it touches,
reads and writes these alone, and publishes a description in which the other buckets
keep their files; an append only adds files. Writers work side by side: one that finds
its buckets changed by another does its work again. A lost executor costs only a
retry, and no write touches files that are read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from plenaria.schema import conform
from plenaria.sources import commits
from plenaria.sources.commits import Commit, TableNotFound

BUCKET = "__bucket"
ALL = "all"


def bucket_of(key: str, many: int = 256) -> str:
    """The bucket of a row by its key alone: the month that the key names, or else one of `many` by hash."""
    text = f"cast(`{key}` as string)"
    month = f"substr(regexp_extract({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0), 1, 7)"
    return f"coalesce(nullif({month}, ''), concat('h', pmod(xxhash64({text}), {many})))"


def _bucket(by: str | None) -> F.Column:
    """A bucket's name, fit for a folder."""
    return F.lit(ALL) if by is None else F.coalesce(F.nullif(F.regexp_replace(F.expr(by).cast("string"), "[^0-9A-Za-z_-]", "_"), F.lit("")), F.lit("none"))


def bucket_column(key: str) -> F.Column:
    """bucket_of(key) as a column, named as the table's buckets are."""
    return _bucket(bucket_of(key))


def state(spark: SparkSession, path: str) -> Commit:
    state = commits.newest(spark, path)
    if state is None:
        raise TableNotFound(path)
    return state


def current(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the table now."""
    return [f"{path}/{name}" for name in state(spark, path).schemas]


def rows(spark: SparkSession, path: str, of: Commit, buckets=None) -> DataFrame:
    """The rows of some buckets (None: all); only their files are listed. Folders of one schema are one scan."""
    by_schema: dict[str, list[str]] = {}
    for name, schema in of.schemas.items():
        held = [b for b, names in of.parts.items() if name in names and (buckets is None or b in buckets)]
        paths = [f"{path}/{name}" if b == ALL else f"{path}/{name}/{BUCKET}={b}" for b in held]
        by_schema.setdefault(schema, []).extend(paths)
    frames = []
    for schema, paths in by_schema.items():
        kind = StructType.fromJson(json.loads(schema))
        reader = spark.read.schema(kind)
        frames.append((reader.parquet(*paths) if paths else spark.createDataFrame([], kind)).select(*(F.col(f"`{c}`") for c in kind.names)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def changed_buckets(spark: SparkSession, path: str, since: int) -> set[str] | None:
    """The buckets whose files aren't those of an earlier commit; None where that can't be told."""
    now, before = commits.newest(spark, path), commits.at(spark, path, since)
    if now is None or before is None or (now.by, now.key) != (before.by, before.key):
        return None
    return {b for b in {*now.parts, *before.parts} if now.parts.get(b) != before.parts.get(b)}


def replace_buckets(df: DataFrame, path: str, buckets: set[str], done: dict[str, int]) -> None:
    """Rows of whole buckets in place of those that are there, in one step with the numbers of what they were made from."""
    spark, base = df.sparkSession, state(df.sparkSession, path)
    folder, found, schema = _store(df, path, base.by)

    def change(now: Commit) -> Commit:
        made = now.replaced(buckets, folder, found, schema)
        return Commit(**(vars(made) | {"done": made.done | done}))

    commits.commit(spark, path, base, change, buckets)


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark, path, state(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    return commits.newest(spark, path) is not None


def _store(df: DataFrame, path: str, by: str | None, partition_by: str | None = None) -> tuple[str, list[str], str]:
    """(folder, buckets, schema) of rows written beside the table; they are no part of it yet.

    Rows of a bucket go to one file or, by adaptive execution, a large bucket's to several.
    """
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    if by is None:
        (df.write if partition_by is None else df.write.partitionBy(partition_by)).parquet(f"{path}/{name}")
        return name, [ALL], df.schema.json()
    df.withColumn(BUCKET, _bucket(by)).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{name}")
    files, folder = commits.fs(spark, f"{path}/{name}")
    found = [n.split("=", 1)[1] for s in files.listStatus(folder) if (n := s.getPath().getName()).startswith(f"{BUCKET}=")]
    if len(found) > commits.MOST_BUCKETS:
        raise ValueError(f"{len(found)} buckets by {by}")
    return name, sorted(found), df.schema.json()


@dataclass
class Prepared:
    """New content of a table that is written but not the table's yet. Several tables are prepared first and then published one right after the other, so that a failure on the way leaves all as they were."""

    spark: SparkSession
    path: str
    commit: Commit

    def rows(self) -> DataFrame:
        return rows(self.spark, self.path, self.commit)

    def publish(self) -> None:
        made = self.commit
        commits.commit(self.spark, self.path, None, lambda now: Commit(now.number + 1, made.by, made.key, made.parts, made.schemas, now.done | made.done))


def prepare(df: DataFrame, path: str, partition_by: str | None = None, by: str | None = None, key: str | None = None, done: dict[str, int] | None = None) -> Prepared:
    """Write `df` beside the table; see write()."""
    by = bucket_of(key) if key is not None and by is None else by
    folder, found, schema = _store(df, path, by, partition_by)
    return Prepared(df.sparkSession, path, Commit(0, by, key, {b: [folder] for b in found}, {folder: schema}, done or {}))


def write(df: DataFrame, path: str, partition_by: str | None = None, by: str | None = None, key: str | None = None, done: dict[str, int] | None = None) -> None:
    """`df` as the table's new content; what was there before stays until vacuum().

    `by` is the layout: an expression over the columns with few values. With `key`
    and no `by` it is bucket_of(key). `done` are numbers to keep with it.
    """
    prepare(df, path, partition_by, by, key, done).publish()


def append(df: DataFrame, path: str, once: tuple[str, int] | None = None) -> bool:
    """The table and `df` behind it; nothing is rewritten. `once` names a writer and the number of its batch: a batch that is already in is left out. Whether rows were added."""
    spark = df.sparkSession
    base = commits.newest(spark, path) or Commit()
    if once is not None and base.done.get(once[0], -1) >= once[1]:
        return False
    folder, found, schema = _store(df, path, base.by)
    added = []

    def change(now: Commit) -> Commit:
        if now.by != base.by:
            raise commits.Conflict(path)
        added.append(once is None or now.done.get(once[0], -1) < once[1])
        made = now.replaced([], folder, found, schema) if added[-1] else now.replaced([], None, [], None)
        return Commit(**(vars(made) | {"done": made.done | ({once[0]: max(once[1], made.done.get(once[0], -1))} if once else {})}))

    try:
        commits.commit(spark, path, base, change)
    except commits.Conflict:  # the table has another layout now
        return append(df, path, once)
    return added[-1]


_TURNS: dict[str, RLock] = defaultdict(RLock)


def turn(path: str) -> RLock:
    """Writers of one session that rewrite a table wait for each other instead of doing their work again; those of other sessions are found by their commits."""
    return _TURNS[path]


def _merge(fresh: DataFrame | None, gone: DataFrame, path: str, key: str, where: str | None = None) -> None:
    """Rows whose `key` is in `gone` leave the table and the rows of `fresh` come, in the buckets that either touches."""
    spark = gone.sparkSession

    def work() -> None:
        base = state(spark, path)
        named = base.by is not None and base.key == key
        touched: set[str] = {ALL} if base.by is None else set()
        if base.by is not None:
            old = gone.select(_bucket(base.by).alias("b")) if named else rows(spark, path, base).join(gone, key, "left_semi").select(_bucket(base.by).alias("b"))
            new = [] if fresh is None else [fresh.select(_bucket(base.by).alias("b"))]
            touched = {r["b"] for r in reduce(DataFrame.union, [old, *new]).distinct().collect()}
        if not touched:
            return
        held = rows(spark, path, base, touched)
        kept = held.join(gone, key, "left_anti").select(held.columns)
        merged = kept if fresh is None else kept.unionByName(fresh, allowMissingColumns=True)
        folder, found, schema = _store(merged, path, base.by)
        commits.commit(spark, path, base, lambda now: now.replaced(touched, folder, found, schema), touched if named or base.by is None else commits.EVERY)

    with turn(path):
        commits.attempt(work)


def _add_absent(fresh: DataFrame, path: str, key: str, of) -> None:
    """Of the rows of `fresh` those that `of` leaves, given the rows of the table that may have their keys, are added."""
    spark = fresh.sparkSession

    def work() -> None:
        base = state(spark, path)
        named = base.by is not None and base.key == key
        touched = {r["b"] for r in fresh.select(_bucket(base.by).alias("b")).distinct().collect()} if named else None
        folder, found, schema = _store(of(rows(spark, path, base, touched)), path, base.by)
        commits.commit(spark, path, base, lambda now: now.replaced([], folder, found, schema), touched if named else commits.EVERY)

    commits.attempt(work)


def _created(df: DataFrame, path: str, key: str | None) -> bool:
    """Whether there was no table and now there is one of these rows, laid out by `key` if it is given."""
    spark, by = df.sparkSession, None if key is None else bucket_of(key)
    if exists(spark, path):
        return False
    folder, found, schema = _store(df, path, by)
    try:
        commits.commit(spark, path, None, lambda now: Commit(1, by, key, {b: [folder] for b in found}, {folder: schema}), commits.EVERY)
    except commits.Conflict:
        return False
    return True


def staged(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Changes written once beside the table, as they are read several times and may cost much to make."""
    name = f"{path}/s-{uuid.uuid4().hex}"
    df.write.parquet(name)
    return df.sparkSession.read.schema(df.schema).parquet(name), name


def clear(spark: SparkSession, folder: str) -> None:
    files, name = commits.fs(spark, folder)
    files.delete(name, True)


def compact(spark: SparkSession, path: str, most: int = 8) -> int:
    """Rewrite the buckets that more than `most` folders hold, each into one; how many there were."""

    def work() -> int:
        base = state(spark, path)
        many = {b for b, names in base.parts.items() if len(names) > most}
        if many:
            folder, found, schema = _store(rows(spark, path, base, many), path, base.by)
            commits.commit(spark, path, base, lambda now: now.replaced(many, folder, found, schema), many)
        return len(many)

    return commits.attempt(work)


def vacuum(spark: SparkSession, path: str, older: float = 0.0) -> None:
    """Merge a table into one folder, and delete older descriptions and the folders that aren't part of it any more.

    Where others write at the same time, `older` says how many seconds a folder must have been left alone.
    """

    def merge() -> None:
        base = state(spark, path)
        if len(base.schemas) > 1:
            folder, found, schema = _store(rows(spark, path, base), path, base.by)
            commits.commit(spark, path, base, lambda now: now.replaced(base.parts, folder, found, schema), base.parts)

    commits.attempt(merge)
    final = state(spark, path)
    files, top = commits.fs(spark, path)
    before = spark._jvm.java.lang.System.currentTimeMillis() - int(1000 * older)
    for status in files.listStatus(top):
        name = status.getPath().getName()
        if name[:2] in ("v-", "s-") and name not in final.schemas and status.getModificationTime() <= before:
            files.delete(status.getPath(), True)
    for status in files.listStatus(commits.fs(spark, f"{path}/{commits.FOLDER}")[1]):
        name = status.getPath().getName()
        if name.isdigit() and int(name) < final.number:
            files.delete(status.getPath(), False)


def one_per_key(df: DataFrame, key: str, last: str | None = None) -> DataFrame:
    """One row of each key: that of the greatest value of `last`, else one that the rows' values decide."""
    order = ([F.desc(last)] if last else []) + [F.xxhash64(*(F.col(c).cast("string") for c in df.columns))]
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")


def upserted(old: DataFrame, new: DataFrame, key: str = "id", last: str | None = None) -> DataFrame:
    """New rows, one of each key, and old ones whose key is not among them."""
    kept = old.join(new.select(key), key, "left_anti").select(old.columns)
    return kept.unionByName(one_per_key(new, key, last), allowMissingColumns=True)


def absent(old: DataFrame, new: DataFrame, key: str = "id", last: str | None = None) -> DataFrame:
    """New rows, one of each key, whose key is not in the old table."""
    return one_per_key(new.join(old.select(key), key, "left_anti").select(new.columns), key, last)


def upsert(df: DataFrame, path: str, key: str = "id", last: str | None = None, by_key: bool = False) -> None:
    """Rows take the place of those with their key, or come new; of several with one key the last one stays.

    `by_key` lays out a new table by bucket_of(key); else it is one bucket, which suits small tables. A table keeps its layout.
    """
    fresh, stage = staged(one_per_key(df, key, last), path)
    if not _created(fresh, path, key if by_key else None):
        _merge(fresh, fresh.select(key), path, key)
    clear(df.sparkSession, stage)


def insert_absent(df: DataFrame, path: str, key: str = "id", last: str | None = None, by_key: bool = False) -> None:
    """Rows with new keys are added; nothing is rewritten. Where other writers add rows meanwhile, keys are looked up again."""
    fresh, stage = staged(one_per_key(df, key, last), path)
    if not _created(fresh, path, key if by_key else None):
        _add_absent(fresh, path, key, lambda old: absent(old, fresh, key))
    clear(df.sparkSession, stage)


def replace_sittings(speeches: DataFrame, path: str, replace: bool = True, key: str = "sitting_id", by_key: bool = False) -> None:
    """Store the speeches of some sittings: in place of those that are there, or only where a sitting has none."""
    fresh, stage = staged(speeches, path)
    if _created(fresh, path, key if by_key else None):
        pass
    elif replace:
        _merge(fresh, fresh.select(key).distinct(), path, key)
    else:
        _add_absent(fresh, path, key, lambda old: fresh.join(old.select(key), key, "left_anti").select(fresh.columns))
    clear(speeches.sparkSession, stage)


def deleted(df: DataFrame, keys: DataFrame, key: str = "sitting_id", of: str = "id") -> DataFrame:
    """`df` without the rows that belong to `keys` (column `of`): a delete by key, or by the keys of what was deleted elsewhere."""
    return df.join(keys.select(F.col(of).alias(key)), key, "left_anti").select(df.columns)


def delete_sittings(ids: DataFrame, path: str) -> None:
    """Delete sittings (column id) and, with them, their speeches from the tables under `path`."""
    spark = ids.sparkSession
    for table, key in (("speeches", "sitting_id"), ("sittings", "id")):
        if exists(spark, f"{path}/{table}"):
            _merge(None, ids.select(F.col("id").alias(key)).distinct(), f"{path}/{table}", key)


def mirrored(df: DataFrame, ddl: str, **columns: F.Column) -> DataFrame:
    """The rows of one table as another one's (a schema of schema.py): its own columns, and those given by expressions."""
    names = [part.split()[0] for part in ddl.split(", ")]
    return conform(df.withColumns(columns), ddl).select(*names)


def filled_from(df: DataFrame, target: str, source: str) -> DataFrame:
    """`target` from `source` where it is missing; a table without that column gets it."""
    value = F.coalesce(target, source) if target in df.columns else F.col(source)
    return df.withColumn(target, value)


def write_quoted(df: DataFrame, path: str, text: str, n: str) -> None:
    """A report of texts: each in quotation marks with its number of uses, one a line, the most frequent first."""
    line = F.concat(F.lit('"'), F.coalesce(text, F.lit("")), F.lit('" ('), F.col(n).cast("string"), F.lit(")"))
    df.orderBy(F.desc(n), text).select(line.alias("value")).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small document as one JSON file that takes the old one's place in one step."""
    folder, name = path.rsplit("/", 1)
    commits.put(spark, folder, name, json.dumps(value, ensure_ascii=False, indent=2), overwrite=True)


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 30.0) -> Iterator[None]:
    """Hold the lock file beside `path`, which one writer at a time can create; TimeoutError where another holds it for `wait` seconds."""
    folder, name = path.rsplit("/", 1)
    until = time.monotonic() + wait
    while not commits.put(spark, folder, f"{name}.lock", str(uuid.uuid4()), overwrite=False):
        if time.monotonic() > until:
            raise TimeoutError(f"{path}.lock")
        time.sleep(0.05)
    try:
        yield
    finally:
        files, lock = commits.fs(spark, f"{path}.lock")
        files.delete(lock, False)


def update_json(spark: SparkSession, path: str, change, wait: float = 30.0):
    """Replace a small JSON document by `change` of it (None where there is none) under its lock; the new one."""
    with locked(spark, path, wait):
        files, name = commits.fs(spark, path)
        value = change(json.loads(commits.text_of(spark, path)) if files.exists(name) else None)
        write_json(spark, value, path)
    return value


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(table, position, column, type) of the tables under a folder; tables that nothing was written to are left out."""
    fs, top = commits.fs(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory())
    rows = [(n, i, f.name, f.dataType.simpleString()) for n in names if exists(spark, f"{path}/{n}") for i, f in enumerate(read(spark, f"{path}/{n}").schema)]
    return spark.createDataFrame(rows, "`table` string, position int, `column` string, type string")


FAILURES = "happened timestamp, kind string, what string, message string"


def log_failures(failed: DataFrame, path: str) -> None:
    """Add rows (kind, what, message) to the table of failures, with the time."""
    append(failed.select(F.current_timestamp().alias("happened"), *(F.col(c).cast("string").alias(c) for c in ("kind", "what", "message"))), path)


def changed(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of `new` whose value differs from the old one's: what an update would touch."""
    before = old.select(*keys, F.col(column).alias("before"))
    return new.join(before, keys).where(~F.col("before").eqNullSafe(F.col(column))).drop("before")


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """CSV with header, quotes where a value needs them, doubled quotes inside, nothing for null; with a mark for spreadsheets if asked for."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first) if byte_order_mark else df
    out.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def subset(sittings: DataFrame, speeches: DataFrame, persons: DataFrame, since: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sittings from a day on, their speeches, and the persons who speak in them, by link or by name."""
    kept = sittings.where(F.col("activity_date") >= since)
    said = speeches.join(kept.select(F.col("id").alias("sitting_id")), "sitting_id", "left_semi")
    ids = said.where("mep_id is not null").select(F.col("mep_id").alias("id")).distinct()
    names = said.where("mep_id is null").select(F.lower(F.trim("speaker_name")).alias("key")).distinct()
    forms = ("label", F.concat_ws(" ", "givenName", "familyName"), F.concat_ws(" ", "familyName", "givenName"))
    by_name = persons.select("id", F.explode(F.array(*(F.lower(F.trim(x)) for x in forms))).alias("key")).join(names, "key", "left_semi").select("id")
    return kept, said, persons.join(ids.union(by_name).distinct(), "id", "left_semi")


def stamp(spark: SparkSession, path: str, **values: str) -> None:
    write(spark.createDataFrame(sorted(values.items()), "key string, value string"), path)


def seed(df: DataFrame, path: str) -> bool:
    """Write the table only if it isn't there or has no rows; whether it was written."""
    spark = df.sparkSession
    if exists(spark, path) and not read(spark, path).isEmpty():
        return False
    write(df, path)
    return True
