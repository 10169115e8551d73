"""Quality rules with risk-controlled thresholds.

Measures of each whole text are one pass without a shuffle. The cutoff of each
rule is then chosen per stratum (language) on labelled documents:

* each rule's measure is cut into `STEPS` fixed steps; candidate cutoffs are tested
  from the laxest to the strictest and testing stops at the first that fails (a
  fixed sequence, so its many tests share one level);
* a cutoff passes if the exact binomial test rejects "the rule wrongly rejects more
  than `limit` / rules of the good documents" at level `level` / (strata * rules),
  the Bonferroni correction for all the sequences;
* of those that pass, the one that rejects most bad documents is taken, the laxest
  of equals; a rule that rejects no bad one is not used in that stratum.

With probability 1 - level, no stratum loses more than `limit` of its good
documents. A stratum with too few labels to prove that has no rule. The counts are
aggregated on the executors; each (stratum, rule) is a group of STEPS rows at most.

Nulls: a null text has no words; a null language is a stratum of its own; labels
with a null id or verdict are ignored; a document with several labels is good if
all say so. Very long texts are measured whole. Repeated rows give repeated results; extra columns are ignored; without
labels only the base rules hold; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blobs, small, stored

SYMBOLS = b"#*$%&|<>"
STEPS = 400
#: Measures between 0 and 1 where more is worse: per word character, per line, per word, and word length beyond 0 to 40.
RULES = {
    "symbols": "least(1, n_symbols / greatest(1, word_chars))",
    "dup_lines": "least(1, n_dup_lines / greatest(1, n_lines))",
    "repeats": "least(1, n_repeat_words / greatest(1, n_words))",
    "word_length": "least(1, word_chars / greatest(1, n_words) / 40)",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(data: bytes) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8."""
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    letters = b"".join(words)
    chars = int(np.count_nonzero((np.frombuffer(letters, np.uint8) & 0xC0) != 0x80))
    symbols = len(letters) - len(letters.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        wide = len(ids) ** 3 < 2**62
        if wide:
            keys = (number[:-2] * len(ids) + number[1:-1]) * len(ids) + number[2:]
            first, counts = np.unique(keys, return_inverse=True, return_counts=True)[1:]
        else:
            first, counts = np.unique(np.stack([number[:-2], number[1:-1], number[2:]], 1), axis=0, return_inverse=True, return_counts=True)[1:]
        twice = counts[first.ravel()] > 1
        if twice.any():
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : k + n - 2] |= twice
            repeated = int(np.count_nonzero(inside))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang) and MEASURES of each row."""
    names = ["doc_id", "lang", *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = np.array([measure(b) for b in blobs(batch.column(2))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names)

    schema = "doc_id long, lang string, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, schema)


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X(n, p): its exact terms from the one next to the mean outwards, until they no longer count."""
    if k >= n:
        return 1.0
    if k > (n + 1) * p:
        return 1.0 - tail(n - k - 1, n, 1 - p)
    first = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, first * total)


def choose(good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> int | None:
    """The cutoff step of one rule in one stratum (steps at or beyond it are rejected), from counts by step; None: no rule."""
    n = int(good.sum())
    wrong, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    best, most = None, 0
    for step in range(len(good) - 1, -1, -1):
        if wrong[step] > limit * n or not n or tail(int(wrong[step]), n, limit) > level:
            break
        if caught[step] > most:
            best, most = step, int(caught[step])
    return best


def _steps(rule: str) -> F.Column:
    return F.least(F.floor(F.expr(RULES[rule]) * STEPS), F.lit(STEPS - 1)).cast("int")


def thresholds(measured: DataFrame, labels: DataFrame, limit: float = 0.02, level: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the chosen rules; a document fails one if its step is the cutoff or more."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _steps(r).alias("step")) for r in RULES)))
    rows = measured.join(known, "doc_id").select(F.col("lang").alias("stratum"), "good", pairs.alias("x"))
    counts = rows.groupBy("stratum", "x.rule", "x.step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = stored(counts, "quality-counts")
    tests = max(1, counts.select("stratum").distinct().count() * len(RULES))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(group["step"], group[c], STEPS).astype(np.int64) for c in ("good", "bad"))
        cutoff = choose(good, bad, limit / len(RULES), level / tests)
        out = group[["stratum", "rule"]].head(1 if cutoff is not None else 0)
        return out.assign(cutoff=cutoff)

    return counts.groupBy("stratum", "rule").applyInPandas(pick, "stratum string, rule string, cutoff int")


def judge(docs: DataFrame, labels: DataFrame, limit: float = 0.02, level: float = 0.05, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """MEASURES of each row with base_failed, the rules it fails (comma-joined) and kept."""
    measured = stored(measures(docs), "quality")
    chosen = thresholds(measured, labels, limit, level).groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    judged = measured.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left").drop("stratum")
    failed = F.array_compact(F.array(*(F.when(_steps(r) >= F.col(r), F.lit(r)) for r in RULES)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return judged.select(
        "doc_id", "lang", *MEASURES, base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept")
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
