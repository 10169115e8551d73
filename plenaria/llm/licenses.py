"""License scan: winnowed template fingerprints, an inverted index, banded alignment.

1. Templates become word hashes (lower case, marks at the ends dropped, so comment
   signs and punctuation don't matter). Of the hashes of their `k`-word grams, the
   smallest of each `window` neighbours (rightmost of equals) are fingerprints: any
   shared run of k + window - 1 words shares one of them.
2. The inverted index (fingerprint -> template, position) goes to the tasks. Its
   size is that of the templates, which are a parameter; more than `block` words of
   them are scanned in several passes.
3. Every gram of a document is looked up, since the text's own winnowing isn't
   needed to find the template's fingerprints. Hits are grouped by template and
   diagonal: each group is a candidate.
4. A candidate is aligned within a band around its diagonal (words match, or are
   replaced, left out or put in). The matched share of the template's words is its
   coverage; from the first to the last matched word is its span. Candidates under
   `coverage` are dropped; of overlapping ones the one with more matched words
   stays, then the one with the greater coverage.

5. A copy with more words than the band put in or left out at one place has its hits
   in several groups. Groups that follow each other in template and text, at most `gap`
   words (and the template's length) apart, are also aligned as one candidate, without
   the words put in between, which stay free for other templates.

One pass per block, nothing is shuffled: a hot source is only more rows.

A template of fewer than `k` words has no fingerprint and is refused with an error.

Nulls: a null text has no words; null ids stay null. A very long text is looked up in
one pass; what alignment costs grows with its candidates. Repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, blobs, gram_hashes, small

# Fixed texts: public licence notices and short statements.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (rightmost of equals) of each window."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


@dataclass
class Group:
    """Hits of a template: lowest and highest diagonal, first word and end in the template and in the text."""

    template: int
    low: int
    high: int
    first: int
    last: int
    begin: int
    end: int


class Index:
    """Templates as word hashes and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        words = WordHashes()
        self.names, self.k = list(templates), k
        self.tokens = [t[t != 0] for t in (words.of(text.encode().split()) for text in templates.values())]
        rows = []
        for i, tokens in enumerate(self.tokens):
            grams = gram_hashes(tokens, min(k, len(tokens)) or 1) if len(tokens) >= k else np.zeros(0, np.uint64)
            rows += [(int(grams[p]), i, int(p)) for p in winnow(grams, window)]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.which = np.array([r[1] for r in rows], np.int64)
        self.at = np.array([r[2] for r in rows], np.int64)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.prints >> np.uint64(44)] = True

    def band(self, template: int, band: int) -> int:
        """No wider than lets two copies of a short template, one after the other, be told apart."""
        return min(band, (len(self.tokens[template]) - 1) // 2)

    def candidates(self, tokens: np.ndarray, band: int) -> list[Group]:
        """Each group of hits whose diagonals are within `band` of the group's first."""
        grams = gram_hashes(tokens, self.k)
        near = np.flatnonzero(self.table[grams >> np.uint64(44)])
        if not len(near):
            return []
        low, high = (np.searchsorted(self.prints, grams[near], side) for side in ("left", "right"))
        hits = sorted({(int(self.which[j]), int(p - self.at[j]), int(self.at[j])) for p, a, b in zip(near, low, high) for j in range(a, b)})
        out: list[Group] = []
        for template, diagonal, at in hits:
            begin = at + diagonal
            if out and out[-1].template == template and diagonal - out[-1].low <= self.band(template, band):
                g = out[-1]
                g.high, g.first, g.last = diagonal, min(g.first, at), max(g.last, at + self.k)
                g.begin, g.end = min(g.begin, begin), max(g.end, begin + self.k)
            else:
                out.append(Group(template, diagonal, diagonal, at, at + self.k, begin, begin + self.k))
        return out

    def chains(self, groups: list[Group], gap: int) -> list[list[Group]]:
        """Groups of a template that follow each other in template and text, at most `gap` words and the template's length apart: the chains of two or more with the most template words."""
        ordered = sorted(groups, key=lambda g: (g.template, g.begin, g.end))
        best, before = [g.last - g.first for g in ordered], [-1] * len(ordered)
        for j, g in enumerate(ordered):
            size = len(self.tokens[g.template])
            most = min(gap, size)
            for i in range(j - 1, -1, -1):
                x = ordered[i]
                # A group's hits reach no farther than its template and the spread of its diagonals.
                if x.template != g.template or x.begin < g.begin - most - 2 * size:
                    break
                if x.end - self.k < g.begin <= x.end + most and x.last - self.k < g.first and x.begin < g.begin and (n := best[i] + g.last - g.first) > best[j]:
                    best[j], before[j] = n, i
        out = []
        for j in set(range(len(ordered))) - set(before):
            chain = []
            while j >= 0:
                chain.append(ordered[j])
                j = before[j]
            if len(chain) > 1:
                out.append(chain[::-1])
        return out


def chained(index: Index, tokens: np.ndarray, chain: list[Group], band: int) -> tuple[int, list[tuple[int, int]]]:
    """(matched words, stretches of the text) of a chain, aligned without the words that are put in between its groups."""
    own = index.tokens[chain[0].template]
    cuts = [max(0, chain[0].begin - chain[0].first - band)]
    for x, y in zip(chain, chain[1:]):
        side = max(0, y.first - x.last) + band
        if y.begin - x.end > 2 * side:
            cuts += [x.end + side, y.begin - side]
    cuts.append(min(len(tokens), chain[-1].end + len(own) - chain[-1].last + band))
    where = np.concatenate([np.arange(a, b) for a, b in zip(cuts[::2], cuts[1::2])])
    kept = tokens[where]
    diagonals = [int(np.searchsorted(where, g.begin)) - g.first for g in chain]
    _, begin, end = align(own, kept, min(diagonals), max(diagonals), index.band(chain[0].template, band))
    if begin < 0 or end <= begin:
        return 0, []
    at = where[begin:end]
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    return matched(own, kept, begin, end), [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, breaks)]


def align(template: np.ndarray, doc: np.ndarray, low: int, high: int, band: int) -> tuple[int, int, int]:
    """(matched words, first matched position, end) of the best alignment whose diagonals lie in low - band .. high + band.

    Row by row over the template; the matched words are the score, and a gap or a
    replaced word costs a little, so that the tightest of equal alignments wins.
    """
    first, width = low - band, high - low + 2 * band + 1
    cost = 1e-3
    score, begin, end = np.zeros(width), np.full(width, -1), np.full(width, -1)
    for i in range(len(template)):
        at = i + first + np.arange(width)
        inside = (at >= 0) & (at < len(doc))
        hit = np.zeros(width, bool)
        hit[inside] = doc[at[inside]] == template[i]
        straight = score + np.where(hit, 1.0, -cost)
        began, ended = np.where(hit & (begin < 0), at, begin), np.where(hit, at + 1, end)
        # A template word left out: from the next diagonal of the row above.
        left_out = np.append(score[1:] - cost, -np.inf)
        better = left_out > straight
        straight = np.where(better, left_out, straight)
        began = np.where(better, np.append(begin[1:], -1), began)
        ended = np.where(better, np.append(end[1:], -1), ended)
        # Document words put in: the best earlier diagonal of this row.
        slope = straight + cost * np.arange(width)
        best = np.maximum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope >= best, np.arange(width), 0))
        score, begin, end = best - cost * np.arange(width), began[source], ended[source]
    top = int(score.argmax())
    return int(round(float(score[top]) + 0.49)) if begin[top] >= 0 else 0, int(begin[top]), int(end[top])


def matched(template: np.ndarray, doc: np.ndarray, begin: int, end: int) -> int:
    """Longest common subsequence of the template and doc[begin:end]: the exact number of matched words."""
    before = np.zeros(end - begin + 1, np.int64)
    own = doc[begin:end]
    for word in template:
        now = before.copy()
        now[1:] = np.where(own == word, before[:-1] + 1, before[1:])
        before = np.maximum.accumulate(now)
    return int(before[-1])


def spans(index: Index, tokens: np.ndarray, band: int, coverage: float, gap: int) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end) of the accepted alignments of a document, by place."""
    found = []
    groups = index.candidates(tokens, band)
    for g in groups:
        own = index.tokens[g.template]
        _, begin, end = align(own, tokens, g.low, g.high, index.band(g.template, band))
        if begin >= 0 and end > begin and (n := matched(own, tokens, begin, end)) >= coverage * len(own):
            found.append((g.template, n, [(begin, end)]))
    for chain in index.chains(groups, gap):
        n, pieces = chained(index, tokens, chain, band)
        if n and n >= coverage * len(index.tokens[chain[0].template]):
            found.append((chain[0].template, n, pieces))
    found.sort(key=lambda x: (-x[1], -x[1] / len(index.tokens[x[0]]), x[2][0][0], x[0], x[2][-1][1]))
    taken: list[tuple[int, int]] = []  # by first word
    kept = []
    for template, n, pieces in found:
        places = [bisect(taken, a, key=lambda y: y[0]) for a, _ in pieces]
        if all((at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b) for at, (a, b) in zip(places, pieces)):
            for piece in pieces:
                insort(taken, piece)
            kept.append((template, n, pieces[0][0], pieces[-1][1]))
    return sorted(kept, key=lambda x: x[2])


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, k: int = 3, window: int = 3, band: int = 8, coverage: float = 0.8, block: int = 1_000_000, gap: int = 256
) -> DataFrame:
    """(doc_id, licenses): per row an array of (template, matched, words, start, end), start and end in code points."""
    templates = TEMPLATES if templates is None else templates
    if short := [name for name, text in templates.items() if np.count_nonzero(WordHashes().of(text.encode().split())) < k]:
        raise ValueError(f"templates of fewer than {k} words can't be found: {short}")
    parts: list[dict[str, str]] = [{}]
    for name, text in templates.items():
        if parts[-1] and sum(len(t.split()) for t in parts[-1].values()) + len(text.split()) > block:
            parts.append({})
        parts[-1][name] = text
    struct = pa.struct([("template", pa.string()), ("matched", pa.int32()), ("words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, words = [Index(p, k, window) for p in parts], WordHashes()
        for batch in small(batches):
            rows = []
            for data in blobs(batch.column(1)):
                raw = words.of(data.split())
                number = np.flatnonzero(raw)
                tokens = raw[number]
                found = [(i, x) for i in indexes for x in spans(i, tokens, band, coverage, gap)]
                offsets = [m.span() for m in WORD.finditer(data)] if found else []
                # Bytes before each place that don't begin a code point.
                inner = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)]) if found else []
                row = []
                for index, (template, n, begin, end) in found:
                    start, stop = (at - int(inner[at]) for at in (offsets[number[begin]][0], offsets[number[end - 1]][1]))
                    row.append({"template": index.names[template], "matched": n, "words": len(index.tokens[template]), "start": start, "end": stop})
                rows.append(sorted(row, key=lambda x: (x["start"], x["template"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "licenses"])

    kind = "array<struct<template:string,matched:int,words:int,start:long,`end`:long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, licenses {kind}")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["template"], x["start"], x["end"], x["matched"], x["words"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("spans"))
