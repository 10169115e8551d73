"""What the corpus operators share: tables in the cluster's shared folder, text transport, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary folder in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="plenaria-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors.

    Lazy results read it later, so it stays until the folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plenaria/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u > v).

    Minima are aggregated before the shuffle, written and joined back: both sides of
    the join are plain shuffles, so that adaptive execution splits the partition of a
    node with very many neighbours. No node's neighbours are ever a list.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
        linked = edges.join(low, "u")
        out = linked.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of undirected `edges` (a, b); root is the smallest node of its component.

    Alternates large-star and small-star until the edge set stays the same; each
    round is a table in the shared folder. Empty edges give an empty result.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
            pairs = [(x, find(x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = stored(edges.select("a", "b").mapInArrow(fold, "u long, v long").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = stored(star_step(stored(star_step(now, True), "edges"), False), "edges")
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0+l1, ... of consecutive pieces."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class WordHashes(dict):
    """Raw word (bytes) -> 64-bit hash of the word lower-cased and without marks at its ends; 0 if nothing is left."""

    MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __missing__(self, word: bytes) -> int:
        bare = word.lower().strip(self.MARKS)
        value = self[word] = (xxhash.xxh64_intdigest(bare) or 1) if bare else 0
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 250_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of the k-grams of token hashes."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += tokens[j : j + n]
    return out ^ (out >> np.uint64(29))


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b or b"" for b in _bytes(column)]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of `least` rows or more that end where the sorted `keys` change (the last one where the input ends).

    Each batch is looked at once, so a long group costs its rows and no more.
    """
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        if rows + batch.num_rows >= least:
            change = np.zeros(batch.num_rows, bool)
            for i, v in enumerate(values):
                change[1:] |= v[1:] != v[:-1]
                change[0] |= last is not None and bool(v[0] != last[i])
            cuts = np.flatnonzero(change)
            if len(cuts):
                cut = int(cuts[-1])
                yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
        last = [v[-1] for v in values]
    if held:
        yield pa.Table.from_batches(held)


def pressed(df: DataFrame, column: str = "text") -> DataFrame:
    """`df` with a text column as compressed bytes: for a shuffle of whole texts. unpressed() undoes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in small(batches):
            at = batch.schema.get_field_index(column)
            data = [None if b is None else press.compress(b) for b in _bytes(batch.column(at))]
            yield batch.set_column(at, column, pa.array(data, pa.binary()))

    return df.mapInArrow(run, _retyped(df, column, BinaryType()))


def unpressed(df: DataFrame, column: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in small(batches):
            at = batch.schema.get_field_index(column)
            data = [None if b is None else unpress.decompress(b) for b in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(data, pa.binary()).cast(pa.string()))

    return df.mapInArrow(run, _retyped(df, column, StringType()))


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _retyped(df: DataFrame, column: str, kind) -> StructType:
    return StructType([StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema])
