"""SimHash near-duplicates: Golay-code keys on distinct fingerprints, verified links, components.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect
(23,12) Golay code decodes a segment to the one codeword within three bits. The
codewords of a segment and of its one-bit neighbours, six at most, are its keys:
two segments that differ in two bits or fewer have one in common. Three errors
over three segments leave either a segment without error, whose cyclic successor
then has two at most (or another such segment follows), or one error in each:

* key (segment i exactly, one key of segment i+1), for the three i;
* key (codeword 1, codeword 2, codeword 3), where one side lists the keys of
  segments 1 and 2 and the other side those of segment 3.

Every link of distance three or less therefore shares a bucket. Buckets hold
distinct fingerprints only, so copies cost nothing; inside one, a search from
each unvisited fingerprint emits a spanning forest of the verified links, never
all pairs. Buckets of over `block` rows are dealt out as pairs of blocks.

`keep_one` goes further, as copies whose word shingles are four fifths alike differ in
far more than three bits: see `similar`.

Nulls: a null text has no words. A null doc_id is a document without a name: it
takes part, and its group is named by the other ids, or null if there are none.
Repeated rows are rows of one group; extra columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blobs, components, gram_hashes, pressed, small, stored, unpressed, whole_groups

SEGMENTS = ((41, 23), (18, 23), (0, 18))
# Fixed value: a generator polynomial of the binary (23,12) Golay code.
GOLAY = 0b101011100011
#: Classes of shingles whose parities are kept, at least; a power of two.
BITS = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return int.from_bytes(np.packbits(2 * bit_counts(np.array(hashes, np.uint64)) > len(hashes)).tobytes(), "big")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, highest first; up to 255 rows are summed as bytes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        for row in range(0, len(bits), 255):
            total += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return total


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape, np.int64)
    for bit in range(23):
        rest = 1 << bit
        for k in range(bit, 10, -1):
            if rest >> k & 1:
                rest ^= GOLAY << (k - 11)
        out ^= np.where(words >> bit & 1, rest, 0)
    return out


def _error_patterns() -> np.ndarray:
    """By syndrome: the one pattern of three bits or fewer that leaves it."""
    bits = [1 << i for i in range(23)]
    patterns = {0, *bits} | {a | b for a in bits for b in bits} | {a | b | c for a in bits for b in bits for c in bits}
    ordered = np.array(sorted(patterns), np.int64)
    out = np.zeros(2048, np.int64)
    out[_syndrome(ordered)] = ordered
    return out


def golay_index(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword next to each 23-bit word."""
    return (words ^ errors[_syndrome(words)]) >> 11


def segment_keys(words: np.ndarray, width: int, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codeword indices of each word and of its one-bit neighbours, and a mask of the first of each value."""
    near = np.stack([words, *(words ^ (1 << b) for b in range(width))], axis=1)
    keys = np.sort(golay_index(near, errors), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket of every fingerprint (uint64)."""
    errors = _error_patterns()
    segs = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    own = [golay_index(s, errors) for s in segs]
    keyed = [segment_keys(s, width, errors) for s, (_, width) in zip(segs, SEGMENTS)]
    listed = []
    for keys, first in keyed:
        row, col = np.nonzero(first)
        listed.append((row, keys[row, col]))
    rows, out = [], []
    for i in range(3):
        row, key = listed[(i + 1) % 3]
        rows.append(row)
        out.append((np.int64(i) << 60) | (segs[i][row] << 12) | key)
    row1, key1 = listed[0]
    keys2, first2 = keyed[1]
    at, col = np.nonzero(first2[row1])
    rows.append(row1[at])
    out.append((np.int64(3) << 60) | (key1[at] << 24) | (keys2[row1[at], col] << 12) | own[2][row1[at]])
    row3, key3 = listed[2]
    rows.append(row3)
    out.append((np.int64(3) << 60) | (own[0][row3] << 24) | (own[1][row3] << 12) | key3)
    return np.concatenate(rows), np.concatenate(out)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs within `distance` do; fewer than there are fingerprints."""
    rest, links = fps.copy(), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= distance
            if near.any():
                found = rest[near]
                links += [(here, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def links(fps: DataFrame, distance: int = 3, block: int = 4096) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: pairs within `distance` that connect all such pairs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2000):
                part = values[at : at + 2000]
                row, key = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: np.ndarray, blk: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            found: list[tuple[int, int]] = []
            twos = starts[ends - starts == 2]
            hit = twos[(np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= distance) & (fp[twos] != fp[twos + 1])]
            found += zip(fp[hit], fp[hit + 1])
            many = ends - starts > 2
            for s, e in zip(starts[many], ends[many]):
                found += forest(np.unique(fp[s:e]), distance)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        held = None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if not len(new[0]):
                continue
            now = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield solve(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield solve(*held)

    keyed = fps.select("fp").mapInArrow(keys, "key long, fp long")
    return _dealt(keyed, block).repartition("key", "blk").sortWithinPartitions("key", "blk").mapInArrow(search, "a long, b long").distinct()


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    """`keyed` (key, fp and more) with blk: a bucket of over `block` rows becomes pairs of blocks, so that any two rows meet in one."""
    hot = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("n"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.least(mine, j) * F.col("n") + F.greatest(mine, j))
    blk = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("blk")
    return keyed.join(hot, "key", "left").select("key", blk, *[c for c in keyed.columns if c != "key"])


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, block: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id that links reach."""
    marked = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(links(distinct, distance, block))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(named, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    if not words:
        return np.zeros(0, np.uint64)
    return grams_of(word_hashes(words), size)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.unique(gram_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


@cache
def multipliers(anchors: int) -> np.ndarray:
    """Odd numbers, one for each min-hash."""
    return np.random.default_rng(2).integers(0, 2**63, anchors, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def parities(grams: np.ndarray, bits: int = BITS) -> bytes:
    """Of each of `bits` classes of shingles, whether their number is odd: two texts' bits differ in no more places than their sets of shingles do."""
    mixed = (grams ^ grams >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return np.packbits(np.bincount((mixed >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) % 2 == 1).tobytes()


def classes_for(size: int) -> int:
    """Two to four times as many classes as there are shingles, so that few classes hide a difference however long the texts are."""
    return max(BITS, 1 << (2 * size - 1).bit_length())


class Odds:
    """Parities of several texts, each of as many classes as suit its size. Halves of a longer one, added up, are the parities of half as many classes, so any two can be compared."""

    def __init__(self, data: list[bytes]):
        self.length = np.array([len(b) // 8 for b in data], np.int64)
        self.place = np.zeros(len(data), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            mine = np.flatnonzero(self.length == n)
            self.place[mine] = np.arange(len(mine))
            self.rows[n] = np.frombuffer(b"".join(data[i] for i in mine.tolist()), np.uint64).reshape(len(mine), n)

    def differ(self, one: int, others: np.ndarray) -> np.ndarray:
        """In how many classes each of `others` differs from `one`."""
        out = np.zeros(len(others), np.int64)
        n = int(self.length[one])
        own = self.rows[n][self.place[one]]
        for m in np.unique(self.length[others]).tolist():
            mine = np.flatnonzero(self.length[others] == m)
            rows, least = self.rows[m][self.place[others[mine]]], min(n, m)
            rows = np.bitwise_xor.reduce(rows.reshape(len(mine), m // least, least), axis=1)
            out[mine] = np.bitwise_count(rows ^ np.bitwise_xor.reduce(own.reshape(n // least, least), axis=0)).sum(axis=1, dtype=np.int64)
        return out


def sketch(words: list[bytes], shingle: int, anchors: int) -> tuple[int, bytes, bytes, int, bytes, int, int]:
    """(node, anchors, segments, fp, parities, size, twin): hash of all words (twin: another one); min-hashes of the shingles; 23-bit segments and 64 bits of a SimHash over word pairs; parities and number of the shingles."""
    joined = b" ".join(words)
    node = xxhash.xxh64_intdigest(joined)
    own_words = word_hashes(words)
    grams, pairs = grams_of(own_words, shingle), grams_of(own_words, 2)
    if not len(grams):
        return node, b"", b"", 0, b"", 0, 0
    low = [((grams * m) ^ (grams * m) >> np.uint64(32)).min() for m in multipliers(anchors)]
    n = -(-(64 + 23 * anchors) // 64)
    total = np.zeros(64 * n, np.int64)
    for i in range(n):
        own = (pairs ^ pairs >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15 + 2 * (i + 1) * 0x632BE59BD9B4E019 & 2**64 - 1 | 1)
        total[64 * i : 64 * i + 64] = bit_counts((own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9))
    bits = 2 * total > len(pairs)
    segments = (bits[64 : 64 + 23 * anchors].reshape(anchors, 23) * (1 << np.arange(23))).sum(axis=1)
    return node, np.array(low, np.uint64).tobytes(), segments.astype(np.int32).tobytes(), int.from_bytes(np.packbits(bits[:64]).tobytes(), "big"), parities(grams, classes_for(len(grams))), len(grams), xxhash.xxh3_64_intdigest(joined)


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, anchors: int = 8, near: int = 18, block: int = 4096) -> DataFrame:
    """(doc_id, node, component_id): documents whose sets of word shingles have a Jaccard similarity of `similarity` or more are linked.

    Such copies differ in 10 to 15 of 64 SimHash bits, beyond any pigeonhole over few
    segments. So a longer SimHash (over word pairs, which edits disturb less) is cut
    into `anchors` segments of 23 bits; each one's nearby Golay codewords (two errors
    are forgiven) are keys together with a min-hash of the shingles, which keeps
    buckets small at any number of documents. A pair at 0.8 meets under one anchor
    with probability 0.8 * 0.6; under 8, all but one in a hundred meet. Inside a
    bucket any two fingerprints within `near` bits are candidates, in three rounds:

    1. a search links them as a spanning forest; each such link is verified by the exact
       similarity of the two whole texts. That is all for buckets of two, and joins
       large groups of copies by few links;
    2. where a forest left pairs out, the same among those that aren't joined yet and
       that sizes and parities of their shingles (see `alike`) don't refuse;
    3. all pairs that are neither joined nor refused after that.

    Parities are of more classes than a text has shingles, so at any length they refuse nearly
    all pairs but those just below `similarity`: of a family of texts that are alike to
    a lesser degree, few pairs are ever compared whole.
    So each candidate is joined, or refused by its exact similarity or a bound of it.
    Texts of equal words, by two hashes of them, are one node from the start.
    """
    found = _classes(docs, shingle, similarity, anchors, near, block)
    return found.select("doc_id", "node", "component_id")


def _classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, anchors: int = 8, near: int = 18, block: int = 4096) -> DataFrame:
    """(doc_id, text_hash, node, root, component_id): see `similar`; root is a node that names the component, also without a doc_id."""
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "node", "anchors", "segments", "fp", "odd", "size", "twin"]
        for batch in small(batches):
            found = [sketch(words_of(b), shingle, anchors) for b in blobs(batch.column(1))]
            node, fp, twin = (pa.array(np.array([x[i] for x in found], np.uint64).view(np.int64)) for i in (0, 3, 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, *(pa.array([x[i] for x in found], pa.binary()) for i in (1, 2)), fp, pa.array([x[4] for x in found], pa.binary()), pa.array([x[5] for x in found], pa.int64()), twin], names)

    marked = stored(texts.mapInArrow(draw, "doc_id long, text_hash long, node long, anchors binary, segments binary, fp long, odd binary, size long, twin long"), "similar")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("twin").alias("own_twin"), F.first("anchors").alias("anchors"), *(F.first(c).alias(c) for c in ("segments", "fp", "odd", "size"))), "similar-nodes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = _error_patterns()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                node, low, segs, fp = batch.slice(at, 2000).columns
                full = np.flatnonzero([len(x) > 0 for x in low.to_pylist()])
                node, fp = (x.to_numpy()[full] for x in (node, fp))
                low = np.frombuffer(b"".join(low.to_pylist()), np.uint64).reshape(-1, anchors)
                segs = np.frombuffer(b"".join(segs.to_pylist()), np.int32).reshape(-1, anchors).astype(np.int64)
                for r in range(anchors):
                    own, first = segment_keys(segs[:, r], 23, errors)
                    row, col = np.nonzero(first)
                    key = (low[row, r] + own[row, col].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(2 * r + 0xBF58476D1CE4E5B9)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row]), pa.array(fp[row])], ["key", "node", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "blk"], 20_000):
            key, blk, node = (table.column(c).to_numpy() for c in ("key", "blk", "node"))
            fp = table.column("fp").to_numpy().view(np.uint64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            found: list[tuple[int, int]] = []
            trees: dict[int, np.ndarray] = {}
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                at = np.unique(node[s:e], return_index=True)[1] + s
                links = index_forest(fp[at], near, at)
                found += [(node[a], node[b]) for a, b in links]
                for tree in unlinked(links):
                    trees[xxhash.xxh3_64_intdigest(node[tree].tobytes())] = tree
            pairs = np.unique(np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1), axis=0)
            rest = np.concatenate(list(trees.values())) if trees else np.zeros(0, np.int64)
            name = np.repeat(np.array(list(trees), np.uint64).view(np.int64), [len(x) for x in trees.values()])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), *[pa.nulls(len(pairs), pa.int64())] * 3], names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rest), pa.int64())] * 2, pa.array(name), pa.array(node[rest]), pa.array(fp[rest].view(np.int64))], names)

    # Links (a, b), and the nodes of trees that leave pairs out, one row each. Trees of the same nodes in several buckets are one.
    names = ["a", "b", "key", "node", "fp"]
    keyed = nodes.select("node", "anchors", "segments", "fp").mapInArrow(keys, "key long, node long, fp long")
    met = _dealt(keyed, block).repartition("key", "blk").sortWithinPartitions("key", "blk")
    met = stored(met.mapInArrow(search, "a long, b long, key long, node long, fp long"), "similar-met")
    left = met.where("key IS NOT NULL").select("key", "node", "fp").distinct()
    # Written first: two Python functions in one stage would take two workers a core.
    sure = stored(verified(stored(met.where("key IS NULL").select("a", "b").distinct(), "similar-links"), texts, shingle, similarity), "similar-verified")
    roots = components(sure)
    for every in (False, True):
        more = stored(_open_pairs(left, nodes, roots, near, similarity, every), "similar-links")
        if more.isEmpty():
            break
        sure = sure.union(stored(verified(more, texts, shingle, similarity), "similar-verified"))
        roots = components(sure)
    placed = nodes.join(roots, "node", "left").select("node", "low", "own_twin", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(named, "root").select("node", "own_twin", "root", "component_id")
    # A text that has another's hash of words but not its second one is a class of its own, whatever that one is joined to.
    same, alone = F.col("twin") == F.col("own_twin"), F.xxhash64("node", "twin")
    found = marked.select("doc_id", "text_hash", "node", "twin").join(classes, "node")
    return found.select("doc_id", "text_hash", "node", F.when(same, F.col("root")).otherwise(alone).alias("root"), F.when(same, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def alike(odd: Odds | np.ndarray, size: np.ndarray, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Mask of `others` whose similarity to `one` may reach `similarity`: by sizes, and by parities, which differ no more than the sets do."""
    a, b = size[one], size[others]
    near = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
    some = others[near]
    differ = odd.differ(one, some) if isinstance(odd, Odds) else np.bitwise_count(odd[some] ^ odd[one]).sum(axis=1, dtype=np.int64)
    near[near] = differ * (1 + similarity) <= (1 - similarity) * (a + b[near]) + 1e-6
    return near


def _open_pairs(left: DataFrame, nodes: DataFrame, roots: DataFrame, near: int, similarity: float, every: bool) -> DataFrame:
    """(a, b): candidates in the trees `left` (key, node, fp) of two components that `alike` doesn't refuse; all, or a forest of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"], 20_000):
            key, node, root, size = (table.column(c).to_numpy() for c in ("key", "node", "root", "size"))
            fp = table.column("fp").to_numpy().view(np.uint64)
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                at = np.unique(node[s:e], return_index=True)[1] + s
                if (root[at] == root[at[0]]).all():
                    continue
                odd = Odds(table.column("odd").take(pa.array(at)).to_pylist())
                rest, queue = np.arange(len(at)), []
                found: list[np.ndarray] = []
                while len(rest):
                    if not queue:
                        queue, rest = [rest[0]], rest[1:]
                    here = queue.pop()
                    other = root[at[rest]] != root[at[here]]
                    open_ = rest[other & (np.bitwise_count(fp[at[rest]] ^ fp[at[here]]) <= near)]
                    close = open_[alike(odd, size[at], here, open_, similarity)]
                    found.append(np.sort(np.stack([np.full(len(close), node[at[here]]), node[at[close]]], axis=1), axis=1))
                    if not every:
                        reached = ~other | np.isin(rest, close)
                        queue += rest[reached].tolist()
                        rest = rest[~reached]
                    if sum(map(len, found)) > 100_000:
                        yield links(found)
                        found = []
                yield links(found)

    def links(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    rooted = left.join(roots, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = rooted.join(mixed, "key").join(nodes.select("node", "odd", "size"), "node").select("key", "node", "fp", "root", "odd", "size")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def index_forest(fps: np.ndarray, distance: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Labels of links that join the same fingerprints as all pairs within `distance` do."""
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            close = np.bitwise_count(fps[rest] ^ fps[here]) <= distance
            links += [(label[here], label[x]) for x in rest[close]]
            queue += list(rest[close])
            rest = rest[~close]
    return links


def unlinked(links: list[tuple[int, int]]) -> list[np.ndarray]:
    """Of each tree of a forest, its ends that aren't linked with all of its other ends: two or more, in order, or the tree isn't there."""
    parent: dict[int, int] = {}
    degree: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    trees: dict[int, list[int]] = {}
    for x in degree:
        trees.setdefault(find(x), []).append(x)
    open_ = (np.sort([x for x in tree if degree[x] < len(tree) - 1]) for tree in trees.values() if len(tree) > 2)
    return [x for x in open_ if len(x)]


def verified(links: DataFrame, texts: DataFrame, shingle: int, similarity: float, most: int = 1000) -> DataFrame:
    """The links (a, b) whose whole texts are similar enough.

    Of each link the end with more links is the owner. Texts travel compressed: an owner's once for up to about
    `most` of its links, which are compared with it one after the other, the other ends' once for each link.
    """

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in small(batches):
            # Copies in a batch are one text.
            joined = {xxhash.xxh64_intdigest(x): x for x in (b" ".join(words_of(b)) for b in blobs(batch.column(0)))}
            node = pa.array(np.array(list(joined), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([node, pa.array([squeeze.compress(x) for x in joined.values()], pa.binary())], ["node", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo, owned = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64)
        for batch in small(batches, 200):
            out = []
            for owner, member, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = shingle_hashes(undo.decompress(data).split(), shingle)
                if member is None:
                    owned = own
                    continue
                both = len(np.intersect1d(owned, own, assume_unique=True))
                if both >= similarity * (len(own) + len(owned) - both):
                    out.append(sorted((owner, member)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    degree = stored(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "similar-degrees")
    of = lambda end: degree.select(F.col("node").alias(end), F.struct("n", F.col("node").alias("owner")).alias(f"of_{end}"))
    both = links.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.greatest("of_a", "of_b").alias("x"))
    member = F.when(F.col("x.owner") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    owned = both.select("x.owner", member.alias("member"), F.pmod(F.xxhash64(member), F.ceil(F.col("x.n") / most)).alias("part"))
    owned = stored(owned, "similar-owned")
    heads = owned.select("owner", "part").distinct().select(F.col("owner").alias("node"), "owner", "part", F.lit(None).cast("long").alias("member"))
    asked = heads.union(owned.select(F.col("member").alias("node"), "owner", "part", "member"))
    known = texts.select("text").mapInArrow(press, "node long, data binary").join(asked.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("data").alias("data"))
    paired = asked.join(known, "node").select("owner", "part", "member", "data").repartition("owner", "part")
    return paired.sortWithinPartitions("owner", "part", F.asc_nulls_first("member")).select("owner", "member", "data").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies (see `similar`): that of the smallest doc_id (null: last), then of the smallest hash of its text."""
    found = _classes(docs, **options)
    mark = {"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "__unnamed": F.col("doc_id").isNull()}
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("x"))
    keep = first.select(F.coalesce("x.doc_id", F.lit(0).cast("long")).alias("__doc"), F.col("x.unnamed").alias("__unnamed"), F.col("x.text_hash").alias("__text_hash"))
    # Rows that repeat doc_id and text share a hash: one of them stays.
    packed = pressed(docs.withColumns(mark | {"__text_hash": F.xxhash64("text")}))
    kept = packed.join(keep, [*mark, "__text_hash"], "left_semi").dropDuplicates([*mark, "__text_hash"])
    return unpressed(kept.drop(*mark, "__text_hash"))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
