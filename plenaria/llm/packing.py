"""Best-fit packing: a configuration linear program over the length histogram.

1. Each document is tokenized once and cut into pieces of at most `capacity`
   tokens. The piece table is stored with, for each piece, the task that made it
   and its number among that task's pieces of the same length.
2. Only the histogram of lengths (at most `capacity` rows, whatever the corpus)
   reaches the driver. The configuration program (fewest sequences that cover the
   histogram) is solved by multiplicative weights: lengths covered least so far
   weigh most, and a knapsack dynamic program prices sequences under these weights.
   The fractional solution is rounded, what that leaves is solved again, and the last
   rest goes, still as a histogram, to best-fit decreasing, which is also the plan
   wherever it alone needs fewer sequences.
3. The result is a list of configurations with multiplicities. A piece's rank
   among all pieces of its length (its own number plus the counts of earlier
   tasks) fixes its sequence and offset, so assignment is a map, not a shuffle of
   sequences, and one very frequent length is dealt out by task.

Nulls and empty texts are documents of one token (the separator). A null doc_id
stays null. Repeated rows are packed like any others; extra columns are ignored; an
empty table gives an empty result. Very long texts, with or without white space, are
cut into pieces like any others.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blobs, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
# Words that need none of the vocabulary's normaliser but lower case: printable ASCII and the
# Latin letters up to U+017F, but for the one that becomes two characters.
SIMPLE = re.compile("[!-~À-ÖØ-öø-įıĲ-ſ]+")
# The vocabulary's pre-tokenizer (English endings, runs of letters, single digits, runs of other marks) for such words.
WORDS = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
#: Longer words are not kept for the next texts.
LONG = 200
# How the vocabulary spells bytes: printable ones as themselves, the others as the characters from U+0100 on.
BYTE_MARKS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def encoder(path: str, cached: int = 600_000) -> Callable[[list[str | bytes]], list[bytes]]:
    """A function from texts (bytes: UTF-8) to their ids as little-endian unsigned 32-bit bytes.

    The vocabulary's parts, and what it composes or lower-cases, never reach over ASCII
    white space, so each distinct word is put together once per task and looked up
    afterwards. Each distinct part of a simple word goes through the vocabulary's merges
    once; all other words (and special tokens) go through the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    merge = model.model.tokenize
    known: dict[bytes, bytes] = {}
    parts: dict[str, bytes] = {}

    def part(x: str) -> bytes:
        if (made := parts.get(x)) is None:
            spelt = x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_MARKS)
            made = parts[x] = array("I", [t.id for t in merge(spelt)]).tobytes()
        return made

    def learn(data: bytes) -> bytes:
        word = data.decode("utf-8", "surrogatepass")
        if len(word) > LONG or "<|" in word or not SIMPLE.fullmatch(word):
            return array("I", model.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        return part(word) if word.isalpha() else b"".join(map(part, WORDS.findall(word)))

    def encode(texts: list[str | bytes]) -> list[bytes]:
        if len(known) + len(parts) > cached:
            known.clear()
            parts.clear()
        texts = [text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text for text in texts]
        # Special tokens are told from their like by case, so such texts keep it for now.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        new = set().union(*split).difference(known)
        known.update((word, learn(word)) for word in new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > LONG:
                del known[word]
        return out

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; `ids` (array of int) too if asked for."""
    end = np.array([separator], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(",")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, data in zip(some.column(0).to_pylist(), encode(blobs(some.column(1)))):
                    data += end
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[start : start + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, k, start // 4, n, zlib.crc32(own), part, nth[n], np.frombuffer(own, "<i4")))
                        nth[n] += 1
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in range(len(names))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the greatest sum of weights that fills it to the last token (-inf: nothing does), and the length to take first.

    An unbounded knapsack by dynamic programming over the capacity.
    """
    best, choice = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        value = best[room - lengths[: fits[room]]] + weights[: fits[room]]
        top = int(value.argmax())
        if value[top] > -np.inf:
            best[room], choice[room] = value[top], top
    return best, choice


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: equal sequences are one entry with a multiplicity."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                config, n = {length: each}, left // each
                by_room.setdefault(capacity - each * length, []).append((config, n))
                left -= n * each
                continue
            config, n = by_room[room].pop()
            used = min(n, left)
            if used < n:
                by_room[room].append((config, n - used))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - length, []).append((config | {length: config.get(length, 0) + 1}, used))
            left -= used
    return [entry for group in by_room.values() for entry in group]


def cover(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float, slack: int) -> dict[tuple, float]:
    """The covering program over sequences, fractional: lengths (index, count) of a sequence -> how often it is used.

    In each round every length's cover grows by a share of 1 / `rounds` of its demand: from
    the longest on, a length takes the sequence of greatest weight that holds it, among the
    fullest. A length's weight falls by exp(-rate) with each round that its cover is ahead
    by, and no length may be ahead by more than one round, so none is covered much over
    its demand. Only sequences with at most `slack` free tokens are used.
    """
    done, used = np.zeros(len(lengths)), {}
    for now in range(1, rounds + 1):
        for banned in (-1e-3 * lengths, np.full(len(lengths), -10.0)):
            if not (done < now / rounds - 1e-9).any():
                break
            weights = lengths / capacity * np.exp(-rate * np.clip(done * rounds - now, -6, 2))
            best, choice = price(lengths, np.where(done * rounds >= now + 1 - 1e-6, banned, weights), capacity)
            fullest = np.maximum.accumulate(np.where(best > -np.inf, np.arange(capacity + 1), -1))
            for i in np.flatnonzero(done < now / rounds - 1e-9)[::-1].tolist():
                room = int(fullest[capacity - lengths[i]])
                if done[i] >= now / rounds or capacity - lengths[i] - room > slack:
                    continue
                config = Counter({i: 1})
                while room:
                    config[int(choice[room])] += 1
                    room -= int(lengths[choice[room]])
                step = min(((now + (j != i)) / rounds - done[j]) * demand[j] / x for j, x in config.items())
                if step > 1e-9:
                    key = tuple(sorted(config.items()))
                    used[key] = used.get(key, 0.0) + step
                    for j, x in config.items():
                        done[j] += step * x / demand[j]
    return used


def rounded(used: dict[tuple, float], lengths: np.ndarray, rest: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the sequences in `used`: running sums over neighbouring sequences, rounded, as far as `rest` (reduced here) allows."""
    out, total = [], 0.5
    for key in sorted(used, key=lambda x: [(-j, -n) for j, n in reversed(x)]):
        amount = int(total + used[key]) - int(total)
        total += used[key]
        config = {int(lengths[j]): x for j, x in key}
        if n := min([amount, *(rest[length] // x for length, x in config.items())]):
            out.append((config, n))
            for length, x in config.items():
                rest[length] -= n * x
    return out


def configurations(
    histogram: dict[int, int], capacity: int = 2048, rounds: int = 24, passes: int = 3, rate: float = 0.5, reserve: float = 0.03
) -> list[tuple[dict[int, int], int]]:
    """Sequences, as lengths with counts, and how often each is used; every piece is in one.

    The program is solved and rounded, again for what rounding left, and so on. It leaves the
    shortest pieces, a share of `reserve` of the tokens, to fill what best-fit decreasing does
    with the rest. The fewest sequences of three plans count: with full sequences only, with
    any, and best-fit alone. None of them can be fewer than the tokens over the capacity.
    """
    tokens = sum(length * n for length, n in histogram.items())
    fewest = best_fit(histogram, capacity)
    for slack in (0, capacity):
        rest, plan = dict(histogram), []
        for _ in range(passes):
            lengths = np.array(sorted(k for k, n in rest.items() if n), np.int64)
            demand = np.array([rest[int(k)] for k in lengths], np.int64)
            held = np.cumsum(lengths * demand)
            demand -= np.ceil(demand * np.clip((reserve * tokens - held + lengths * demand) / (lengths * demand), 0, 1)).astype(np.int64)
            lengths, demand = lengths[demand > 0], demand[demand > 0]
            if not len(lengths):
                break
            free = {int(k): int(n) for k, n in zip(lengths, demand)}
            made = rounded(cover(lengths, demand.astype(float), capacity, rounds, rate, slack), lengths, free)
            plan += made
            for config, n in made:
                for length, x in config.items():
                    rest[length] -= n * x
        plan += best_fit({k: n for k, n in rest.items() if n}, capacity)
        if sum(n for _, n in plan) <= sum(n for _, n in fewest):
            fewest = plan
        if sum(n for _, n in fewest) * capacity < tokens + capacity:
            break
    return fewest


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces per sequence and offset of each configuration that holds it."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter[int] = Counter()
    base = 0
    for config, n in plan:
        offset = 0
        for length, x in sorted(config.items()):
            out.setdefault(length, []).append((taken[length], base, x, offset))
            taken[length] += n * x
            offset += x * length
        base += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, rounds: int = 24, with_ids: bool = False) -> DataFrame:
    """The pieces of `docs` with their sequence_id and offset; offsets in a sequence are gapless from 0."""
    made = stored(pieces(docs, tokenizer, capacity, separator, with_ids), "pieces")
    counted = stored(made.groupBy("part", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = slots(configurations(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = made.join(earlier, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier")).drop("part", "nth", "earlier")
    names = [c for c in ranked.columns if c != "rank"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, base, each, start = places[int(n)]
                at = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[at]
                sequence[rows] = base[at] + inside // each[at]
                offset[rows] = start[at] + inside % each[at] * n
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
