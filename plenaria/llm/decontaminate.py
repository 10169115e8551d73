"""Benchmark decontamination by greedy string tiling.

1. Benchmark items become word hashes; their `k`-word grams (Karp-Rabin hashes) are
   the seed index. Items are dealt into blocks of about `block` words, each of which
   goes to the tasks with the function. A larger benchmark means more passes over
   the documents, whose results are stored one after the other: one block is alive
   at a time.
2. A document's rolling k-gram hashes are joined to the seeds through a bit table
   first and by exact hash then, in the same pass that reads it. Tiles can cover no
   more words than the union of an item's shared grams does; items for which that is too
   few are refused before any tiling, so clean documents end there.
3. For a document and an item with shared seeds, greedy string tiling marks the
   longest match of unmarked words on both sides, again and again, until none of
   `k` words is left. As tiles may come in any order, passages that were reordered
   are still covered. Matches are found by running Karp-Rabin hashes of a length
   that falls from the longest possible to k.
4. An item is leaked into a document if its tiles cover `coverage` of its words.

With one block nothing is shuffled: a hot source or a very common passage is only more rows.

Words are split at white space, lower-cased (A-Z) and freed of marks at their ends.
Items of fewer than `k` words identify nothing and never match. Nulls: a null text
has no words; null ids stay null. Repeated items are reported each; repeated rows
give repeated results. Extra columns are ignored; empty tables give empty results. A
very long text is looked up in one pass; what tiling costs grows with its shared seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, blobs, bounds, gram_hashes, small, stored

TABLE_BITS = 22


def hashed(words: WordHashes, data: bytes) -> np.ndarray:
    """Hashes of a text's words without those that are marks only."""
    out = words.of(data.split())
    return out[out != 0]


class Seeds:
    """The inverted index of a block of items: gram hash -> places (item, position)."""

    def __init__(self, items: list[np.ndarray], k: int):
        self.items, self.k = items, k
        grams = [gram_hashes(t, k) for t in items]
        sizes = [len(g) for g in grams]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.which = flat[order], np.repeat(np.arange(len(items)), sizes)[order]
        self.at = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])[order]
        self.words = np.array([len(t) for t in items], np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True

    def candidates(self, tokens: np.ndarray, coverage: float = 0.0) -> dict[int, np.ndarray]:
        """By item: the sorted positions of the document where one of its grams starts.

        Tiles lie within the words of shared grams, on either side. Items whose shared
        grams, each place once, reach over less than `coverage` of their words, in the item
        or in the document, are refused here.
        """
        grams = gram_hashes(tokens, self.k)
        near = np.flatnonzero(self.table[grams >> np.uint64(64 - TABLE_BITS)])
        if not len(near):
            return {}
        low, high = (np.searchsorted(self.grams, found := np.unique(grams[near]), side) for side in ("left", "right"))
        found, low, high = found[high > low], low[high > low], high[high > low]
        if not len(found):
            return {}
        places = np.arange((high - low).sum()) + np.repeat(low - bounds(high - low)[:-1], high - low)
        item, at = self.which[places], self.at[places]
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        reach = np.minimum(np.diff(at, append=0), self.k)
        reach[np.append(starts[1:], len(at)) - 1] = self.k
        enough = np.add.reduceat(reach, starts) >= coverage * self.words[item[starts]]
        near = near[np.isin(grams[near], found)]
        out = {}
        for i in item[starts[enough]].tolist():
            mine = near[np.isin(grams[near], gram_hashes(self.items[i], self.k))]
            if np.minimum(np.diff(mine), self.k).sum() + self.k >= coverage * self.words[i]:
                out[i] = mine
        return out


def tiles(item: np.ndarray, doc: np.ndarray, k: int, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, words) of each tile, longest first, then by places.

    `starts` are the document positions of shared k-grams; every match of k words
    or more starts at one of them, so other positions are never looked at. For each
    length, from the item's own down to `k` by halves, all maximal matches of unmarked
    words come from Karp-Rabin hashes and are marked longest first; what an earlier tile
    leaves free of a match is put back in line by its own length.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    length, left = len(item), len(item)
    while length >= k:
        line = _matches(item, doc, length, starts, free_item, free_doc)
        heapify(line)
        while line and left >= length:
            n, p, q = heappop(line)
            free = free_item[p : p - n] & free_doc[q : q - n]
            if free.all():
                free_item[p : p - n] = free_doc[q : q - n] = False
                out.append((p, q, -n))
                left += n
                continue
            edge = np.flatnonzero(np.diff(free.astype(np.int8), prepend=0, append=0)).tolist()
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a >= length:
                    heappush(line, (a - b, p + a, q + a))
        length = k if k < length < 2 * k else length // 2
    return out


def _matches(item: np.ndarray, doc: np.ndarray, length: int, starts: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(-words, item position, document position) of the maximal matches of `length` unmarked words or more."""
    used_item, used_doc = (np.concatenate([[0], np.cumsum(~free)]) for free in (free_item, free_doc))
    here = np.flatnonzero(used_item[length:] == used_item[: len(item) - length + 1])
    there = starts[starts + length <= len(doc)]
    there = there[used_doc[there + length] == used_doc[there]]
    if not len(here) or not len(there):
        return []
    index: dict[int, list[int]] = {}
    for p, h in zip(here.tolist(), gram_hashes(item, length)[here].tolist()):
        index.setdefault(h, []).append(p)
    out = []
    for q, h in zip(there.tolist(), _roll(doc, there, length).tolist()):
        for p in index.get(h, ()):
            if p and q and item[p - 1] == doc[q - 1] and free_item[p - 1] and free_doc[q - 1] or not np.array_equal(item[p : p + length], doc[q : q + length]):
                continue
            n = length
            while p + n < len(item) and q + n < len(doc) and free_item[p + n] and free_doc[q + n] and item[p + n] == doc[q + n]:
                n += 1
            out.append((-n, p, q))
    return out


def _roll(doc: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """gram_hashes of `length` words at `starts` only."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += doc[starts + j]
    return out ^ (out >> np.uint64(29))


def blocks(benchmark: DataFrame, block: int) -> tuple[int, Iterator[tuple[list, list[np.ndarray]]]]:
    """How many blocks of about `block` words the items make, and the ids and word hashes of each, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-size // block)
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))

    def each() -> Iterator[tuple[list, list[np.ndarray]]]:
        for i in range(n):
            part, words = items.where(deal == i).toArrow(), WordHashes()
            yield part.column("item_id").to_pylist(), [hashed(words, b) for b in blobs(part.column("text").combine_chunks())]

    return n, each()


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.5, block: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, covered, item_words, n_tiles) of each document and item with enough coverage."""
    schema = "doc_id long, item_id long, covered int, item_words int, n_tiles int"
    names = [c.split()[0] for c in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def scan(ids: list, items: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds, words = Seeds(items, k), WordHashes()
            for batch in small(batches):
                rows = []
                for doc, data in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                    rows += [(doc, ids[i], *x) for i, x in covered_items(seeds, hashed(words, data), coverage)]
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        return texts.mapInArrow(run, schema)

    n, each = blocks(benchmark, block)
    if n < 2:
        return scan(*next(each, ([], [])))
    return reduce(DataFrame.union, [stored(scan(*x), "leaks") for x in each])


def covered_items(seeds: Seeds, tokens: np.ndarray, coverage: float) -> list[tuple[int, tuple[int, int, int]]]:
    """(item, (covered words, words, tiles)) of the items that a document covers enough."""
    out = []
    for item, starts in seeds.candidates(tokens, coverage).items():
        own = seeds.items[item]
        found = tiles(own, tokens, seeds.k, starts)
        covered = sum(n for _, _, n in found)
        if covered >= coverage * len(own):
            out.append((item, (covered, len(own), len(found))))
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.5, block: int = 1_000_000) -> DataFrame:
    """`docs` without the documents that cover an item: one pass without a join, or, for a benchmark of several blocks, a stored list of leaked texts for each, then one anti-join."""

    def chosen(rows: DataFrame, items: list[np.ndarray], leaked: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds, words = Seeds(items, k), WordHashes()
            for batch in small(batches):
                texts = blobs(batch.column(batch.schema.get_field_index("text")))
                yield batch.filter(pa.array([bool(covered_items(seeds, hashed(words, b), coverage)) == leaked for b in texts], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    n, each = blocks(benchmark, block)
    if n < 2:
        return chosen(docs, next(each, ([], []))[1], False)
    key = {"__text_hash": F.xxhash64("text"), "__other_hash": F.xxhash64(F.lit(1), "text")}
    keyed = docs.withColumns(key)
    parts = [stored(chosen(keyed.select("text", *key), items, True).select(*key).distinct(), "leaked") for _, items in each]
    return keyed.join(reduce(DataFrame.union, parts), [*key], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = leaks(docs, benchmark)
    return found.select("doc_id", "item_id", "covered", "item_words", "n_tiles", F.round(F.col("covered") / F.col("item_words"), 6).alias("coverage"))
