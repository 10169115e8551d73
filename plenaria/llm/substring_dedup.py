"""Exact substring deduplication by prefix-free parsing.

A byte is removed if a string of `length` bytes covers it that also starts earlier
(smaller doc_id, or the same document at an earlier start), judged on the input.

1. Triggers. The rolling hashes of all grams of `gram` bytes are compared; in each
   window of `length` bytes the smallest hash (leftmost of equals) is the trigger.
   So every string has one trigger, chosen by its own bytes alone, and equal
   strings have equal triggers at equal offsets.
2. Phrases. Consecutive starts with the same trigger are one phrase: its strings
   overlap the next phrase by length - 1 bytes, which makes the parse prefix-free
   in the sense that no string reaches over a phrase's end.
3. Dictionary and parse. Phrases meet by trigger hash. Of equal phrases the
   earliest place is the dictionary's entry; all strings of the others are
   repeats. Highly repetitive text ends here: only dictionary entries go on, and of
   these only the ones whose trigger stands in another entry too.
4. Suffix array. The bytes of these entries are fetched. Equal strings have one trigger,
   so the dictionary's suffix array is built in parts, one for each range of triggers: the
   suffixes' ranks by their first `length` bytes come from prefix doubling (ranks by
   8 bytes, 16, 32, ...), on the bytes themselves. Suffixes of equal rank (a common
   prefix of `length` bytes or more) are put in corpus order by the places that the parse
   gives their phrases. All but the first are repeats.
5. Each document's repeated starts become spans, and the rest is what it keeps.

The parse needs no suffix array of its own: as no string reaches over its phrase's end,
the phrases that follow can't tell two equal suffixes apart, and corpus order is theirs
by place.

Copies inside a batch of documents are folded before the shuffle. A trigger of `often`
phrases or more (a common passage in many contexts) is hot, by an exact count over the stored
parse. In step 3 the first of its equal phrases is a minimum that each task takes
before the shuffle. In step 4 its suffixes are dealt by bands of how far they start before
the trigger, together with the bytes that all strings of the band have in common, which
equal strings agree on; where over `most` different pieces share these (a passage that is followed by
something else in each document), their strings are dealt one by one, by their own
hashes. Equal pieces and strings are folded before that shuffle. So at any size of the corpus a group
has fewer than `often` phrases or `most` pieces, or is one string, one row for each 100,000 of a
task. What is hot only decides the dealing, never the result. Equal phrases are found by
two 64-bit hashes (trigger and phrase), equal strings by their bytes.

Nulls: a null text has no bytes; null doc_ids come last. Documents that share a
doc_id are ordered by a hash of their texts; rows that repeat doc_id and text stand
at one place and get the same result. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blobs, bounds, small, stored, whole_groups

LENGTH, GRAM = 100, 24
SEGMENT = 1 << 22  # starts that are looked at together; places inside fit in the low bits of a hash
LOW = np.uint64((1 << 24) - 1)
STEP = 0x9E3779B97F4A7C15
FRESH, REPEAT, HOT = 0, 1, 2
SALTS = 8
PHRASE = "kind int, trigger long, phrase long, doc long, sub int, at long, n int"
P_NAMES = [c.split()[0] for c in PHRASE.split(", ")]
P_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed 64-bit hashes of all strings of `width` bytes: a polynomial, put together from powers of two."""
    values = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
    square, size, out, done = values[data], 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = square, size
            else:
                n = len(data) - done - size + 1
                out, done = out[:n] * np.uint64(pow(STEP, size, 2**64)) + square[done : done + n], done + size
        if done == width:
            break
        n = len(data) - 2 * size + 1
        square, size = square[:n] * np.uint64(pow(STEP, size, 2**64)) + square[size : size + n], 2 * size
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, now = 1, values
    while 2 * size <= width:
        now, size = np.minimum(now[:-size], now[size:]), 2 * size
    n = len(values) - width + 1
    return np.minimum(now[:n], now[width - size : width - size + n])


def triggers(data: bytes, length: int, gram: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, trigger hashes, first starts, ends of the starts) of the phrases of a text, by segments; starts count from the segment's own."""
    for base in range(0, len(data) - length + 1, SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        hashes = rolling(np.frombuffer(part, np.uint8), gram)
        ranked = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (sliding_min(ranked, length - gram + 1) & LOW).astype(np.int64)
        starts = np.flatnonzero(np.diff(chosen, prepend=-1))
        yield part, hashes[chosen[starts]], starts, np.append(starts[1:], len(chosen))


def phrases(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger hashes, phrase hashes, first starts, numbers of starts) of a text, by segments."""
    digest = xxhash.xxh3_64_intdigest
    for i, (part, trigger, starts, ends) in enumerate(triggers(data, length, gram)):
        own = np.fromiter((digest(part[s : e + length - 1]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
        yield trigger, own, starts + i * SEGMENT, ends - starts


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, sub): doc and sub order the documents; equal rows share them."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"))
    ids = keyed.select("doc", F.xxhash64("text").alias("hash"))
    twice = ids.groupBy("doc").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high").select("doc")
    if twice.isEmpty():
        return keyed.withColumn("sub", F.lit(0))
    place = (F.row_number().over(Window.partitionBy("doc").orderBy("hash")) - 1).alias("sub")
    subs = stored(ids.join(twice, "doc").distinct().select("doc", "hash", place), "substring-subs")
    joined = keyed.withColumn("hash", F.xxhash64("text")).join(subs, ["doc", "hash"], "left")
    return joined.select("doc_id", "text", "doc", F.coalesce("sub", F.lit(0)).alias("sub"))


def hot_triggers(fresh: DataFrame, often: int) -> DataFrame:
    """(trigger): triggers of `often` phrases or more, counted exactly; sums by task go before the shuffle."""
    return fresh.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") >= often).select("trigger")


def parse(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The phrases of all documents (PHRASE); copies inside a batch are REPEAT already, as long runs of starts."""

    def fold(doc: list, sub: list, parts: list) -> pa.RecordBatch:
        sizes = [len(p[0]) for p in parts]
        trigger, phrase = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (0, 1))
        at, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        doc, sub = np.repeat(np.array(doc, np.int64), sizes), np.repeat(np.array(sub, np.int32), sizes)
        order = np.lexsort((at, sub, doc, phrase, trigger))
        same = (trigger[order][1:] == trigger[order][:-1]) & (phrase[order][1:] == phrase[order][:-1])
        repeat = np.zeros(len(at), bool)
        repeat[order[1:][same]] = True
        kind = np.where(repeat, REPEAT, FRESH).astype(np.int32)
        # Repeats that follow each other become one run.
        opens = repeat.copy()
        opens[1:] &= ~(repeat[:-1] & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (at[1:] == at[:-1] + n[:-1]))
        heads = np.flatnonzero(opens)
        if len(heads):
            total = np.where(repeat, n, 0)
            n = n.copy()
            n[heads] = np.add.reduceat(total, heads)
        keep = ~repeat | opens
        columns = (kind, np.where(repeat, 0, trigger), np.where(repeat, 0, phrase), doc, sub, at, n)
        return pa.RecordBatch.from_arrays([pa.array(c[keep], t) for c, t in zip(columns, P_TYPES)], P_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, subs_, parts, held = [], [], [], 0
            for d, s, data in (row for x in small([batch]) for row in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), blobs(x.column(2)))):
                for part in phrases(data, length, gram):
                    docs_.append(d), subs_.append(s), parts.append(part)
                    held += len(part[0])
                    if held > 1_000_000:
                        yield fold(docs_, subs_, parts)
                        docs_, subs_, parts, held = [], [], [], 0
            if parts:
                yield fold(docs_, subs_, parts)

    return docs.select("doc", "sub", "text").mapInArrow(run, PHRASE)


def dictionary(cold: DataFrame) -> DataFrame:
    """PHRASE rows of triggers that aren't hot: REPEAT for starts that are repeats for sure; the rest are entries whose suffixes must be compared.

    Phrases are dealt by trigger and sorted; the first of equal phrases is the entry. An entry alone in its trigger is no repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["trigger"]):
            trigger, phrase = (table.column(x).to_numpy() for x in ("trigger", "phrase"))
            new_trigger = np.append(True, trigger[1:] != trigger[:-1])
            entry = new_trigger | np.append(True, phrase[1:] != phrase[:-1])
            group = np.cumsum(new_trigger) - 1
            further = entry & (np.bincount(group[entry], minlength=group[-1] + 1) > 1)[group]
            columns = [np.where(entry, FRESH, REPEAT), *(np.where(further, x, 0) for x in (trigger, phrase)), *(table.column(x).to_numpy() for x in P_NAMES[3:])]
            yield pa.RecordBatch.from_arrays([pa.array(x[~entry | further], t) for x, t in zip(columns, P_TYPES)], P_NAMES)

    return cold.repartition("trigger").sortWithinPartitions("trigger", "phrase", "doc", "sub", "at").mapInArrow(run, PHRASE)


def hot_dictionary(warm: DataFrame) -> DataFrame:
    """PHRASE rows of hot triggers, by `dictionary`'s rule; here all entries go on, as HOT.

    The first of equal phrases is a minimum, taken by task before the shuffle and written: both
    sides of the join are plain shuffles, so that the copies of one phrase are split among tasks.
    """
    first = stored(warm.groupBy("trigger", "phrase").agg(F.min(F.struct("doc", "sub", "at")).alias("first")), "substring-first")
    entry = (F.col("doc") == F.col("first.doc")) & (F.col("sub") == F.col("first.sub")) & (F.col("at") == F.col("first.at"))
    judged = warm.join(first, ["trigger", "phrase"]).withColumn("kind", F.when(entry, HOT).otherwise(REPEAT))
    return judged.select(P_NAMES)


def _pressed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, sub, data): texts are compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in small(batches):
            data = [press.compress(b) for b in blobs(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["doc_id", "doc", "sub", "data"])

    return docs.select("doc_id", "doc", "sub", "text").mapInArrow(run, "doc_id long, doc long, sub int, data binary")


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """By place: the rank of the `length` bytes from there on (zeros follow the end) among all of them, in order of their bytes; equal ones share it.

    Prefix doubling: ranks of 8 bytes make those of 16, and so on; the last step overlaps. A rank is the
    number of smaller strings, so one that is alone in its rank stays as it is, and each step sorts the others only.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)]).astype(np.uint64)
    size = 1
    while 2 * size <= min(8, length):
        padded = (padded << np.uint64(8 * size)) | np.append(padded[size:], np.zeros(size, np.uint64))
        size *= 2
    total = len(padded)
    order = np.argsort(padded)
    head = np.append(True, padded[order[1:]] != padded[order[:-1]])
    rank = np.empty(total, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    rest = order[~(head & np.append(head[1:], True))]
    while size < length and len(rest):
        step = min(size, length - size)
        key = rank[rest] * total + rank[np.minimum(rest + step, total - 1)]
        order = np.argsort(key)
        rest, key = rest[order], key[order]
        old = rank[rest]
        head = np.append(True, key[1:] != key[:-1])
        first = np.append(True, old[1:] != old[:-1])
        of = lambda opens: np.flatnonzero(opens)[np.cumsum(opens) - 1]
        rank[rest] = old + of(head) - of(first)
        rest, size = rest[~(head & np.append(head[1:], True))], size + step
    return rank[: len(data)]


def _places(doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Starts in order as runs (doc, sub, at, n)."""
    opens = np.append(True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (at[1:] != at[:-1] + 1))[: len(doc)]
    heads = np.flatnonzero(opens)
    cols = (doc[heads], sub[heads], at[heads], np.diff(np.append(heads, len(doc))))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, P_TYPES[3:])], P_NAMES[3:])


def suffix_repeats(entries: DataFrame, docs: DataFrame, length: int, gram: int, most: int | None) -> DataFrame:
    """(doc, sub, at, n): starts of the entries whose string stands in an earlier entry; where `most` is None, no entry is HOT."""
    # n is 0 for strings to compare, and the number of starts for a run that is known to repeat.
    schema = "trigger long, salt long, doc long, sub int, at long, n int, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    wide = -(-(length - gram + 1) // SALTS)

    def folded(rows: list[tuple]) -> pa.RecordBatch:
        # Of equal pieces of a hot trigger the earliest goes on; the others become runs of repeats.
        seen: set[tuple] = set()
        out: list[tuple] = []
        for row in sorted(rows, key=lambda x: x[2:5]):
            trigger, salt, doc, sub, at, _, data = row
            if salt and (trigger, salt, data) in seen:
                n, last = len(data) - length + 1, out[-1]
                if last[5] and last[2:4] == (doc, sub) and last[4] + last[5] == at:
                    out[-1] = (*last[:5], last[5] + n, b"")
                    continue
                row = (xxhash.xxh3_64_intdigest(b"%d %d" % (doc, at)) >> 1, 0, doc, sub, at, n, b"")
            elif salt:
                seen.add((trigger, salt, data))
            out.append(row)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        for batch in small(batches, 200):
            for doc, sub, blob, asked in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = unpress.decompress(blob)
                for x in asked:
                    trigger, at, n = x["trigger"], x["at"], x["n"]
                    if x["kind"] != HOT:
                        rows.append((trigger, 0, doc, sub, at, 0, data[at : at + n + length - 1]))
                        continue
                    here = np.frombuffer(data, np.uint8, n + length - 1, at)
                    before = int((rolling(here, gram).view(np.int64) == trigger).argmax())
                    for band in range((before - n + 1) // wide, before // wide + 1):
                        # All strings of a band hold the bytes from its last start to its first string's end.
                        low, high = at + before - band * wide - wide + 1, at + before - band * wide
                        first, last = max(at, low), min(at + n - 1, high)
                        core = data[high : low + length]
                        rows.append((trigger, xxhash.xxh3_64_intdigest(core, band) >> 1 | 1, doc, sub, first, 0, data[first : last + length]))
                if len(rows) > 20_000:
                    yield folded(rows)
                    rows = []
        if rows:
            yield folded(rows)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each string of a piece by itself, dealt by its own hash.
        rows: list[tuple] = []
        for batch in small(batches):
            for trigger, _, doc, sub, at, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                strings = (data[i : i + length] for i in range(len(data) - length + 1))
                rows += [(trigger, xxhash.xxh3_64_intdigest(x) >> 1 | 1, doc, sub, at + i, 0, x) for i, x in enumerate(strings)]
            if len(rows) > 100_000:
                yield folded(rows)
                rows = []
        if rows:
            yield folded(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["trigger", "salt"], 10_000):
            sure = pc.greater(table.column("n"), 0)
            yield from table.filter(sure).select(P_NAMES[3:]).to_batches()
            table = table.filter(pc.invert(sure))
            # A piece alone in its group repeats nothing: equal strings share trigger and salt, and inside a piece their places before the trigger differ.
            trigger, salt = (table.column(c).to_numpy() for c in ("trigger", "salt"))
            same = (trigger[1:] == trigger[:-1]) & (salt[1:] == salt[:-1])
            table = table.filter(pa.array(np.append(same, False) | np.append(False, same))) if len(same) else table.slice(0, 0)
            if not table.num_rows:
                continue
            doc, sub, at = (table.column(c).to_numpy() for c in ("doc", "sub", "at"))
            parts = table.column("bytes").to_pylist()
            lengths = np.array([len(p) for p in parts])
            offsets, strings = bounds(lengths), lengths - length + 1
            row = np.repeat(np.arange(len(parts)), strings)
            inside = np.arange(len(row)) - np.repeat(bounds(strings)[:-1], strings)
            rank = ranks(np.frombuffer(b"".join(parts), np.uint8), length)[offsets[row] + inside]
            doc, sub, place = doc[row], sub[row], at[row] + inside
            # The suffix array, equal suffixes in corpus order: all but the first are repeats.
            order = np.lexsort((place, sub, doc, rank))
            hit = order[1:][rank[order][1:] == rank[order][:-1]]
            hit = hit[np.lexsort((place[hit], sub[hit], doc[hit]))]
            yield _places(doc[hit], sub[hit], place[hit])

    asked = entries.groupBy("doc", "sub").agg(F.collect_list(F.struct("kind", "trigger", "at", "n")).alias("asked"))
    fetched = _pressed(docs).join(asked, ["doc", "sub"]).select("doc", "sub", "data", "asked").mapInArrow(fetch, schema)
    if most is not None:
        fetched = stored(fetched, "substring-pieces")
        crowded = fetched.where("salt <> 0").groupBy("trigger", "salt").agg(F.count("*").alias("pieces")).where(F.col("pieces") > most)
        crowded = stored(crowded.select("trigger", "salt"), "substring-crowded")
        if not crowded.isEmpty():
            keys = ["trigger", "salt"]
            fetched = fetched.join(crowded, keys, "left_anti").select(names).union(fetched.join(crowded, keys, "left_semi").select(names).mapInArrow(apart, schema))
    return fetched.repartition("trigger", "salt").sortWithinPartitions("trigger", "salt").mapInArrow(compare, "doc long, sub int, at long, n int")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, often: int = 1000, most: int = 256) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed spans of each row (bytes, end exclusive, maximal) and the bytes it keeps.

    A trigger of `often` phrases is hot; more than `most` pieces with the same bytes around a hot trigger are dealt string by string.
    """
    ordered = _ordered(docs)
    once = ordered
    if not ordered.groupBy("doc", "sub").count().where("count > 1").isEmpty():
        once = stored(ordered.dropDuplicates(["doc", "sub"]), "substring-texts")
    parsed = stored(parse(once, length, gram), "substring-parse")
    cold = parsed.where(F.col("kind") == FRESH)
    hot = stored(hot_triggers(cold, often), "substring-hot")
    some = not hot.isEmpty()
    known = dictionary(cold.join(hot, "trigger", "left_anti").select(P_NAMES) if some else cold)
    if some:
        known = known.union(hot_dictionary(cold.join(hot, "trigger", "left_semi").select(P_NAMES)))
    known = stored(known, "substring-dictionary")
    more = suffix_repeats(known.where(F.col("kind") != REPEAT), once, length, gram, most if some else None)
    repeats = parsed.union(known).where(F.col("kind") == REPEAT).select("doc", "sub", "at", "n").union(more)
    runs = repeats.groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in small(batches, 200):
            ids, sizes, spans, kept = [], [], [], []
            for doc_id, blob, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = unpress.decompress(blob)
                mark = np.zeros(len(data) + 1, np.int32)
                for x in runs or ():
                    mark[x["at"]] += 1
                    mark[x["at"] + x["n"] - 1 + length] -= 1
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                ids.append(doc_id), sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edge) else data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = _pressed(ordered).join(runs, ["doc", "sub"], "left").select("doc_id", "data", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,`end`:long>>, kept binary")


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
