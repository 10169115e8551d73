"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (3 to 6) of a lower-cased text, with word ends
as spaces, hashed to 2**18 buckets. A bucket gives up to three present-or-not
features: found once or more, twice or more, three times or more.

* Counts: every labelled training row adds to the number of toxic and of clean
  rows that hold a feature (summed per task, shuffled as compressed blocks). Their smoothed log ratio is
  the feature's scale. The `features` ones whose shares differ most significantly
  (two-sample z score) are kept.
* Fit: logistic regression on the scaled features, on a sample of the same rows
  (at most `sample` of each class, taken by hash of the id, weighted back to the
  class's size), by accelerated gradient steps on the driver. The sample is the
  one thing that is bounded; see `fit`.
* Score: a map over all texts with the few thousand weights in its closure.

Nulls: a null text scores like an empty one; labelled rows with a null id, label
or text, and labels without a document, teach nothing. A document that has
several labels counts as toxic if one of them says so. Repeated labelled rows count
each, and repeated rows score alike. Very long texts are features like any others, each
counted once a row. Extra columns are ignored; an empty table gives an empty result.
Without labelled rows of both classes every score is the smoothed share of toxic rows
(a third where there are none), and `drop_toxic` keeps all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blobs, small, stored

BITS = 18
GRAMS = (3, 4, 5, 6)
LEVELS = 3
BLOCK = 1 << 13  # features whose counts travel together


def grams(text: str | None) -> list[np.ndarray]:
    """Hash buckets of a text's n-grams, one array per n, repeats included."""
    data = " ".join(["", *(text or "").lower().split(), ""]).encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= codes[k : len(codes) - n + 1 + k]
            h *= np.uint32(0x9E3779B1)
            out.append(h >> np.uint32(32 - BITS))
    return out


def features(found: list[np.ndarray]) -> np.ndarray:
    """Feature ids (level * 2**BITS + bucket) of the buckets of a text."""
    if not found:
        return np.zeros(0, np.int32)
    bucket, n = np.unique(np.concatenate(found), return_counts=True)
    return np.concatenate([bucket[n > level].astype(np.int32) + (level << BITS) for level in range(LEVELS)])


@dataclass
class Model:
    """Weights (the fitted weight times the scale) of sorted feature ids, and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        """A function from a text to its score; buckets without weight are left out before they are counted."""
        known, table = np.zeros(1 << BITS, bool), np.zeros(LEVELS << BITS, np.float32)
        known[self.ids & ((1 << BITS) - 1)] = True
        table[self.ids] = self.weights

        def run(text: str | None) -> float:
            value = self.intercept + table[features([h[known[h]] for h in grams(text)])].sum(dtype=np.float64)
            return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))

        return run


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from, once per document."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    return known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _marks(ids: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """The two bits of each id in a Bloom filter of 2**bits bits."""
    mixed = (ids.view(np.uint64) ^ (ids.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return tuple((mixed * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for m in (1, 0xD6E8FEB86659FD93))


def _sieve(known: DataFrame, n: int, most: int = 25) -> tuple[int, np.ndarray]:
    """(bits, filter): a Bloom filter of the labelled ids, of about 16 bits each and 2**most at most (4 MB at any number of labels)."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(n, 1))), 10, most))
    blocks = 1 << max(0, bits - 16)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, own = zstandard.ZstdCompressor(level=1), np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _marks(batch.column(0).to_numpy(), bits):
                own[at] = True
        found = [(i, press.compress(np.packbits(x).tobytes())) for i, x in enumerate(own.reshape(blocks, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["block", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(unpress.decompress(data), np.uint8)
                sums[block] = sums[block] | own if block in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "data"])

    made = known.select("doc_id").mapInArrow(mark, "block int, data binary").repartition("block").mapInArrow(merge, "block int, data binary").toArrow()
    out = np.zeros((blocks, (1 << bits) // blocks // 8), np.uint8)
    for block, data in zip(made.column("block").to_pylist(), made.column("data").to_pylist()):
        out[block] = np.frombuffer(data, np.uint8)
    return bits, out.ravel()


def _labelled(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(doc_id, data, toxic): training rows. Documents whose id the filter of the `n` labelled ids can't hold end in the scan; the other texts are compressed and joined."""
    bits, sieve = _sieve(known, n)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in small(batches):
            first, second = _marks(batch.column(0).to_numpy(), bits)
            maybe = (sieve[first >> 3] >> (7 - (first & 7)) & sieve[second >> 3] >> (7 - (second & 7)) & 1).astype(bool)
            batch = batch.filter(pa.array(maybe))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(b) for b in blobs(batch.column(1))], pa.binary())], ["doc_id", "data"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # Labels may be as many as documents: a join that shuffles both sides, at any size.
    return texts.mapInArrow(squeeze, "doc_id long, data binary").join(known.hint("merge"), "doc_id")


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 3000, kept: int = 4096, smoothing: float = 1.0, ridge: float = 1e-4, steps: int = 300
) -> Model:
    """Train on the rows of `labels` that are not held out.

    All of them are counted. `sample` bounds the rows of each class whose features
    the driver holds for the regression: 2 * sample rows at any size of the corpus.
    """
    sizes, known = {0: 0, 1: 0}, _known(labels)
    for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect():
        sizes[r["toxic"]] += r["count"]
    # All of a class that fits; of a larger one a share by hash that stays below the bound.
    share = {k: 1.0 if n <= sample else 0.9 * sample / n for k, n in sizes.items()}
    total = LEVELS << BITS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kind 0 and 1: in how many clean and toxic rows of this task each feature of a block stands (block -1: n rows in all); 2 and 3: one sampled text.
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        counts, seen = np.zeros((2, total), np.int32), [0, 0]
        names = ["kind", "block", "n", "data"]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names)
        for batch in small(batches):
            taken: list[tuple] = []
            for doc, blob, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                label = int(label > 0)
                counts[label, features(grams(unpress.decompress(blob).decode("utf-8", "surrogatepass")))] += 1
                seen[label] += 1
                if (doc * 0x9E3779B97F4A7C15 >> 11) % 2**32 < share[label] * 2**32:
                    taken.append((2 + label, 0, 1, blob))
            if taken:
                yield table(taken)
        for label in (0, 1):
            if seen[label]:
                blocks = enumerate(counts[label].reshape(-1, BLOCK))
                yield table([(label, -1, seen[label], b""), *((label, i, 0, press.compress(x.tobytes())) for i, x in blocks if x.any())])

    rows = _labelled(docs, known, sum(sizes.values())).select("doc_id", "data", "toxic")
    gathered = stored(rows.mapInArrow(gather, "kind int, block int, n long, data binary"), "toxicity")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    clean, toxic = gathered.where("block = -1").agg(of(0), of(1)).first()
    prior = float(np.log((toxic + 1) / (clean + 2)))
    nothing = Model(np.zeros(0, np.int32), np.zeros(0, np.float32), prior)
    if not clean or not toxic:
        return nothing

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The blocks of a partition are summed as they come; a feature in all rows or of no significance is left out.
        unpress, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for kind, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums.setdefault(block, np.zeros((2, BLOCK), np.int64))[kind] += np.frombuffer(unpress.decompress(data), np.int32)
        for block, (c, t) in sums.items():
            both = (c + t) / (clean + toxic)
            spread = np.sqrt(both * (1 - both) * (1 / clean + 1 / toxic))
            z = np.abs(t / toxic - c / clean) / np.where(spread > 0, spread, np.inf)
            ratio = np.log((t + smoothing) / (toxic + 2 * smoothing)) - np.log((c + smoothing) / (clean + 2 * smoothing))
            found = np.flatnonzero(z >= 3)
            columns = (found + block * BLOCK).astype(np.int32), ratio[found], z[found]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["feature", "ratio", "z"])

    ranked = gathered.where("kind < 2 and block >= 0").select("kind", "block", "data").repartition("block").mapInArrow(rank, "feature int, ratio double, z double")
    best = ranked.orderBy(F.desc("z"), "feature").limit(kept).toPandas().sort_values("feature")
    ids, scale = best["feature"].to_numpy(np.int32), best["ratio"].to_numpy(np.float64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in small(batches):
            texts = [unpress.decompress(b).decode("utf-8", "surrogatepass") for b in batch.column(1).to_pylist()]
            held = [np.flatnonzero(np.isin(ids, features(grams(t)))).astype(np.int16).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["kind", "held"])

    chosen = gathered.where("kind >= 2").select("kind", "data").mapInArrow(narrow, "kind int, held binary").toArrow()
    label = chosen.column("kind").to_numpy() - 2.0
    if not len(best) or not len(label) or label.min() == label.max():
        return nothing
    held = [np.frombuffer(b, np.int16) for b in chosen.column("held").to_pylist()]
    weights, intercept = regress(held, label, {1: toxic, 0: clean}, scale, ridge, steps)
    return Model(ids, (weights * scale).astype(np.float32), intercept)


def regress(held: list[np.ndarray], label: np.ndarray, sizes: dict[int, int], scale: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression: row i has the value scale[j] at each j of held[i]. Nesterov steps; returns weights and intercept."""
    rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
    flat = np.concatenate(held)
    each = np.where(label > 0, sizes[1] / max(1, (label > 0).sum()), sizes[0] / max(1, (label == 0).sum()))
    each = each / each.sum()
    norm = np.bincount(rows, scale[flat] ** 2, len(held))
    rate = 4.0 / float((each * (norm + 1)).sum())
    w, b = np.zeros(len(scale)), float(np.log(sizes[1] / sizes[0]))
    w_old, b_old = w, b
    for step in range(steps):
        lead = step / (step + 3)
        w_now, b_now = w + lead * (w - w_old), b + lead * (b - b_old)
        z = np.bincount(rows, (w_now * scale)[flat], len(held)) + b_now
        error = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        gradient = np.bincount(flat, error[rows], len(scale)) * scale + ridge * w_now
        w_old, b_old = w, b
        w, b = w_now - rate * gradient, b_now - rate * float(error.sum())
    return w, b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.scorer()
        for batch in small(batches):
            values = [value(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; scored in the same pass, without a join. A model that learnt nothing tells nothing: all rows stay."""
    if not len(model.ids):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.scorer()
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([value(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
