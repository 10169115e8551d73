"""Ranked lexical search, score-at-a-time over impact-ordered postings.

1. The items' terms are the vocabulary; items are dealt into blocks of about `block`
   words, so that what goes to the tasks has a bound. A larger item table means one
   more pass over the documents for each block.
2. One pass over whole texts counts every term of a document and keeps, for those of
   the vocabulary, how often each occurs: a stored table of one short row a document.
   Document count, length and document frequencies are sums over that table, of all
   documents, one row a term and task before they are shuffled.
3. Each task turns its rows into segments of about `segment` postings: postings of a
   term ordered by impact, those of equal impact in one group. For an item, groups of
   all its terms are taken in falling order of impact and added to the accumulators.
   It stops only once the sum of the terms' next impacts is below the k-th best
   accumulator, so that no document unseen can come in, and once the documents seen
   that still can have fewer terms than there are postings left; their scores are
   completed from the documents' own rows. Best results so far of the same task bound
   the next segments.
4. The k best of each task meet in one window per item, which Spark limits to k rows
   before the shuffle.

No posting is shuffled, so a very frequent term is only a longer array of each segment.

Nulls: a null text has no terms; documents with a null id are ranked behind others of
the same score; a null item id is an id like others. Repeated rows of an item are one
query, different texts under one id are ranked apart; repeated documents are ranked each.
Ties go to the smaller id. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blobs, bounds, small, stored

#: A-Z in lower case; digits, a-z and all beyond ASCII as they are; everything else parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
RESULT = "item_id long, rank int, doc_id long, score long"
NO_ID = 2**63 - 1


def terms(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def queries(items: DataFrame, block: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """The ids and distinct terms of the items, in blocks of about `block` words, one block at a time."""
    rows = items.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    size = rows.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    n = -(-size // block)
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        part = rows.where(deal == i).toArrow()
        yield part.column("item_id").to_pylist(), [sorted(set(terms(b))) for b in blobs(part.column("text").combine_chunks())]


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: n counts all its terms, the arrays hold those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep, sizes, numbers, counts = [], [], [], []
            for row, data in enumerate(blobs(batch.column(1))):
                words = terms(data)
                if words:
                    number, count = np.unique(np.array([vocabulary[w] for w in words if w in vocabulary], np.int32), return_counts=True)
                    keep.append(row)
                    sizes.append(len(words))
                    numbers.append(number.tobytes())
                    counts.append(count.astype(np.int32).tobytes())
            columns = [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


@dataclass
class Corpus:
    """Documents with a term, their terms with repeats, and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weights: np.ndarray


def corpus(rows: DataFrame, vocabulary: int) -> Corpus:
    """Statistics over all rows of counted(); each task gives one row a term that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, length = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            length += int(np.sum(batch.column(0).to_numpy()))
            seen += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32), minlength=vocabulary)
        some = np.flatnonzero(seen)
        columns = [np.append(some, -1), np.append(seen[some], n), np.append(np.zeros(len(some), np.int64), length)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "n", "length"])

    sums = rows.select("n", "terms").mapInArrow(run, "term long, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow()
    found = dict(zip(sums.column("term").to_pylist(), zip(sums.column("n").to_pylist(), sums.column("length").to_pylist())))
    documents, length = found.pop(-1, (0, 0))
    weights = np.zeros(vocabulary, np.int64)
    for term, (df, _) in found.items():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return Corpus(documents, length, weights)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. high[1] - 1, ..."""
    sizes = high - low
    return np.arange(sizes.sum()) + np.repeat(low - bounds(sizes)[:-1], sizes)


class Segment:
    """An impact-ordered index of some documents, and the documents' own rows."""

    def __init__(self, sizes: np.ndarray, numbers: list[bytes], counts: list[bytes], all_docs: Corpus):
        self.n_docs = len(sizes)
        held = np.array([len(b) // 4 for b in numbers], np.int64)
        term, count = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (numbers, counts))
        doc = np.repeat(np.arange(self.n_docs), held)
        wide = self.n_docs and 50 * int(sizes.max()) * all_docs.documents >= 2**63
        spread = (50 * sizes.astype(object if wide else np.int64) * all_docs.documents // all_docs.length).astype(np.int64)
        impact = all_docs.weights[term] * (1_000_000_000 * count // (1000 * count + 20 * (50 + spread)[doc]))
        some = impact > 0
        self.term, doc, self.impact = term[some], doc[some], impact[some]
        self.own = bounds(np.bincount(doc, minlength=self.n_docs))
        order = np.lexsort((doc, -self.impact, self.term))
        self.doc, term, value = doc[order], self.term[order], self.impact[order]
        start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (value[1:] != value[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.start, self.value = np.append(start, len(term)), value[start]
        self.groups = np.searchsorted(term[start], np.arange(len(all_docs.weights) + 1))
        self.sums = np.zeros(self.n_docs, np.int64)
        self.asked = np.zeros(len(all_docs.weights), bool)

    def search(self, asked: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) with all of the k best for the terms `asked`; rows that score below `floor` may be left out."""
        first, last = self.groups[asked], self.groups[asked + 1]
        line = _ranges(first, last)
        owner = np.repeat(np.arange(len(asked)), last - first)
        order = np.argsort(-self.value[line], kind="stable")
        line, owner = line[order], owner[order]
        cost = bounds(self.start[line + 1] - self.start[line])
        sums, at, budget = self.sums, 0, 16 * k
        sums[:] = 0
        taken = np.zeros(len(asked), np.int64)
        while True:
            to = min(len(line), max(at + 1, int(np.searchsorted(cost, cost[at] + budget))))
            now = line[at:to]
            postings = _ranges(self.start[now], self.start[now + 1])
            np.add.at(sums, self.doc[postings], np.repeat(self.value[now], self.start[now + 1] - self.start[now]))
            taken += np.bincount(owner[at:to], minlength=len(asked))
            at, budget = to, 2 * budget
            more = first + taken < last
            rest = int(self.value[(first + taken)[more]].sum())
            rows = np.flatnonzero(sums)
            least = max(floor, int(np.partition(sums[rows], len(rows) - k)[len(rows) - k]) if len(rows) >= k else 0)
            rows = rows[sums[rows] + rest >= least]
            if at == len(line):
                return rows, sums[rows]
            if rest < least and (self.own[rows + 1] - self.own[rows]).sum() <= cost[-1] - cost[at]:
                return rows, self.complete(rows, asked)

    def complete(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of some rows, from the rows' own terms."""
        self.asked[asked] = True
        low, high = self.own[rows], self.own[rows + 1]
        held = _ranges(low, high)
        at = np.where(self.asked[self.term[held]], self.impact[held], 0)
        self.asked[asked] = False
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, np.repeat(np.arange(len(rows)), high - low), at)
        return out


def best(rows: DataFrame, ids: list, asked: list[np.ndarray], all_docs: Corpus, k: int, segment: int) -> DataFrame:
    """(query, item_id, doc_id, score): the k best documents of each task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)

        def take(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            docs = table.column("doc_id").fill_null(NO_ID).to_numpy()
            index = Segment(table.column("n").to_numpy(), table.column("terms").to_pylist(), table.column("counts").to_pylist(), all_docs)
            for q, mine in enumerate(asked):
                if not len(mine):
                    continue
                old_docs, old_scores = top[q]
                found, scores = index.search(mine, k, int(old_scores[-1]) if len(old_scores) == k else 0)
                both, scores = np.r_[old_docs, docs[found]], np.r_[old_scores, scores]
                order = np.lexsort((both, -scores))[:k]
                top[q] = both[order], scores[order]

        held, postings = [], 0
        for batch in small(batches):
            held.append(batch)
            postings += sum(map(len, batch.column(2).to_pylist())) // 4
            if postings >= segment:
                take(held)
                held, postings = [], 0
        if held:
            take(held)
        sizes = [len(x[0]) for x in top]
        docs = np.concatenate([x[0] for x in top] or [np.zeros(0, np.int64)])
        number = np.repeat(np.arange(len(top)), sizes)
        columns = [pa.array(number, pa.int32()), pa.array([ids[i] for i in number.tolist()], pa.int64()), pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(np.concatenate([x[1] for x in top] or [docs]), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 1_000_000, segment: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item (all, if there are fewer)."""
    parts = []
    for ids, texts in queries(items, block):
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
        rows = stored(counted(docs, vocabulary), "search-terms")
        all_docs = corpus(rows, len(vocabulary))
        if all_docs.length:
            asked = [np.array([vocabulary[w] for w in words], np.int64) for words in texts]
            found = best(rows, ids, asked, all_docs, k, segment)
            nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            parts.append(found.withColumn("rank", nth).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], RESULT)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, benchmark)


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term
), spreads AS (
  SELECT doc_id, 100 - 50 + ((50 * n * docs) // total) AS m FROM sizes, totals
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN spreads USING (doc_id) GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
