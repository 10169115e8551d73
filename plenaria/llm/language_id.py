"""Language identification with hyperdimensional profiles.

1. Every letter has a random vector of `DIMENSIONS` signs, drawn from its code point; the
   gap between words has one too. A trigram's vector binds its letters': the first one
   rotated by two places, the second by one, the third as it is, multiplied entry by
   entry. A text's vector bundles (adds up) those of its trigrams with their numbers.
2. A language's prototype bundles the vectors of all texts that teach it. Tasks add up
   integers, one vector a language, and give them in short rows that Spark adds up:
   as many as there are languages and dimensions, however large the vocabulary is.
   The mean of all prototypes, made equally long, is what languages share; it is left out.
3. A text gets the language whose prototype has the largest cosine with its vector,
   in one pass without a shuffle.

Letters are what Unicode calls so, in lower case; everything else is a gap. Trigrams of a
batch of texts are counted together, so each distinct one is bound once a batch, and
bundling is a product of a matrix of counts with one of signs.

Nulls: a null or letterless text is `und` with a score of 0; a null language teaches
nothing; a null id is neither learnt from nor held out. Where nothing was learnt, every text is
`und`. Ties go to the language that comes first. Very long texts are counted whole;
repeated rows count and come out each; extra columns are ignored; an empty table gives an
empty result. More than `MOST` languages are an error, as prototypes go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounds, small

DIMENSIONS = 1024
MOST = 4096
#: Columns of a row of sums, and trigrams that are bound at a time.
COLUMNS, AT_A_TIME = 16, 4096
#: Letters up to which trigrams are counted in a table instead of by sorting.
FEW = 160


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter's code point; 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def vector(letter: int) -> np.ndarray:
    """The signs of a letter; 0 stands for the gap."""
    return np.random.default_rng([12, letter]).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def spelled(text: str) -> np.ndarray:
    """The letters of a text with one gap between words and at both ends; empty without a letter."""
    found = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    found = np.concatenate([[0], found, [0]])
    found = found[np.r_[True, (found[1:] != 0) | (found[:-1] != 0)]]
    return found if len(found) > 1 else found[:0]


class Trigrams:
    """The trigrams of some texts: how often each occurs in each, and their bound vectors."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([max(0, len(t) - 2) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
        ends = bounds(np.array([len(t) for t in texts], np.int64))
        self.alphabet, number = np.unique(flat, return_inverse=True) if len(flat) and flat.max() > 0xFFFF else _ranked(flat)
        base = max(1, len(self.alphabet))
        codes = (number[:-2] * base + number[1:-1]) * base + number[2:] if len(flat) > 2 else np.zeros(0, np.int64)
        inside = np.ones(len(codes), bool)
        for end in ends[1:-1].tolist():
            inside[max(0, end - 2) : end] = False
        codes, self.text = codes[inside], np.repeat(np.arange(len(texts)), sizes)
        if base <= FEW:
            seen = np.flatnonzero(np.bincount(codes, minlength=1))
            place = np.zeros(base**3, np.int64)
            place[seen] = np.arange(len(seen))
            self.codes, self.which = seen if len(codes) else codes, place[codes]
        else:
            self.codes, self.which = np.unique(codes, return_inverse=True)
        self.base, self.n_texts = base, len(texts)

    def bound(self, low: int, high: int) -> np.ndarray:
        """The vectors of the trigrams from `low` to `high`."""
        signs = np.stack([vector(c) for c in self.alphabet.tolist()])
        some = self.codes[low:high]
        first, second, third = some // self.base**2, some // self.base % self.base, some % self.base
        return np.roll(signs, 2, 1)[first] * np.roll(signs, 1, 1)[second] * signs[third]

    def bundled(self, owner: np.ndarray, owners: int) -> np.ndarray:
        """The bundles of the texts of each owner (exact integers, as floats)."""
        whose = owner[self.text]
        # Sums below 2**24 are exact in single precision.
        kind = np.float32 if np.bincount(whose, minlength=1).max(initial=0) < 2**24 else np.float64
        out = np.zeros((owners, DIMENSIONS), kind)
        order = None if len(self.codes) <= AT_A_TIME else np.argsort(self.which, kind="stable")
        for low in range(0, len(self.codes), AT_A_TIME):
            high = min(len(self.codes), low + AT_A_TIME)
            if order is None:
                which, mine = self.which, whose
            else:
                at = order[np.searchsorted(self.which, low, sorter=order) : np.searchsorted(self.which, high, sorter=order)]
                which, mine = self.which[at] - low, whose[at]
            counts = np.bincount(mine * (high - low) + which, minlength=owners * (high - low)).reshape(owners, high - low)
            out += counts.astype(kind) @ self.bound(low, high).astype(kind)
        return out


def _ranked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like np.unique(return_inverse=True) for small numbers, in linear time."""
    alphabet = np.flatnonzero(np.bincount(flat, minlength=1))
    place = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[flat]


def texts_of(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [spelled(t or "") for t in batch.column(column).to_pylist()]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order and their prototypes: unit vectors of what each has beyond the mean of all."""
    names = ["lang", "part", *(f"v{j}" for j in range(COLUMNS))]
    parts = DIMENSIONS // COLUMNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches, 256):
            langs = batch.column(0).to_pylist()
            here = sorted(set(langs))
            number = {name: i for i, name in enumerate(here)}
            found = Trigrams(texts_of(batch, 1)).bundled(np.array([number[x] for x in langs], np.int64), len(here))
            for name, row in zip(here, found.astype(np.int64)):
                sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            columns = [pa.array([name] * parts), pa.array(np.arange(parts), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in row.reshape(parts, COLUMNS).T)], names)

    schema = "lang string, part int, " + ", ".join(f"v{j} long" for j in range(COLUMNS))
    taught = docs.select(F.col("lang").cast("string"), "text").where("lang is not null and text is not null")
    sums = taught.mapInArrow(run, schema).groupBy("lang", "part").agg(*(F.sum(x).alias(x) for x in names[2:]))
    rows = sums.limit(MOST * parts + 1).toArrow()
    if rows.num_rows > MOST * parts:
        raise ValueError(f"more than {MOST} languages")
    rows = rows.sort_by([("lang", "ascending"), ("part", "ascending")])
    langs = rows.column("lang").to_pylist()[::parts]
    found = np.stack([rows.column(x).to_numpy() for x in names[2:]], 1).astype(np.float64).reshape(len(langs), DIMENSIONS)
    some = np.flatnonzero(found.any(1))
    found = unit(found[some])
    return [langs[i] for i in some], unit(found - found.mean(0)) if len(some) > 1 else found


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def identify(docs: DataFrame, langs: list[str], profiles: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text; the score is the cosine, 0 where it is negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            texts = texts_of(batch, 1)
            found = Trigrams(texts).bundled(np.arange(len(texts)), len(texts)).astype(np.float64)
            cosine = unit(found) @ profiles.T if langs else np.zeros((len(texts), 1))
            best = cosine.argmax(1)
            told = [bool(langs) and len(t) > 0 for t in texts]
            score = np.where(told, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
            columns = [batch.column(0), pa.array([langs[i] if ok else "und" for i, ok in zip(best.tolist(), told)], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, *prototypes(docs.where("doc_id is not null").where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
