"""Candidates of decontamination: refused by the union of their seeds, and never one that tiling would report."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from plenaria.llm import decontaminate, simhash_dedup
from plenaria.llm.shared import WordHashes, gram_hashes


def brute(items, doc, k, coverage):
    """Every item with a shared gram is tiled, without a bound."""
    out = []
    for i, own in enumerate(items):
        starts = np.flatnonzero(np.isin(gram_hashes(doc, k), gram_hashes(own, k)))
        if len(starts):
            found = decontaminate.tiles(own, doc, k, starts)
            if sum(n for *_, n in found) >= coverage * len(own):
                out.append((i, (sum(n for *_, n in found), len(own), len(found))))
    return out


@pytest.mark.parametrize("coverage", [0.2, 0.5, 0.9])
def test_bounds_refuse_nothing_that_is_covered(coverage):
    some = random.Random(11)
    for _ in range(150):
        k, alphabet = some.choice([2, 3, 5]), some.choice([3, 10, 40])
        words = lambda n: np.array([some.randrange(1, alphabet + 1) for _ in range(n)], np.uint64)
        items = [words(some.randint(0, 25)) for _ in range(12)]
        doc = np.concatenate([x for i in some.choices(items, k=4) for x in (i[some.randint(0, 6) : some.randint(5, 25)], words(some.randint(0, 9)))])
        seeds = decontaminate.Seeds(items, k)
        assert sorted(decontaminate.covered_items(seeds, doc, coverage)) == brute(items, doc, k, coverage)


def test_a_shared_opening_is_not_tiled(monkeypatch):
    """3,000 items with one opening: a document that has it costs no tiling, however often; a leaked one costs one."""
    opening = "read the passage and answer the question below"
    items = [f"{opening} {' '.join(f'q{i}x{j}' for j in range(30))}" for i in range(3000)]
    words = WordHashes()
    seeds = decontaminate.Seeds([decontaminate.hashed(words, t.encode()) for t in items], 5)
    tiled, tiles = [], decontaminate.tiles
    monkeypatch.setattr(decontaminate, "tiles", lambda *a: tiled.append(1) or tiles(*a))
    filler = lambda i: " ".join(f"f{i}w{j}" for j in range(100))
    began = time.monotonic()
    for i in range(200):
        clean = f"{filler(i)} {opening} {filler(i + 1)} {opening} {filler(i + 2)} {opening} {filler(i + 3)} {opening} {opening}"
        assert decontaminate.covered_items(seeds, decontaminate.hashed(words, clean.encode()), 0.5) == []
    assert not tiled and time.monotonic() - began < 20
    found = decontaminate.covered_items(seeds, decontaminate.hashed(words, f"{clean} {items[7]}".encode()), 0.5)
    assert [i for i, _ in found] == [7] and len(tiled) == 1


def test_parities_of_different_lengths_are_a_bound():
    """Folded parities never differ in more places than the sets do, and refuse pairs of long texts that are somewhat alike."""
    some = np.random.default_rng(3)
    for n in (0, 1, 40, 500, 1100, 5000, 20_000):
        base = some.integers(0, 2**63, n, dtype=np.uint64)
        sets = [base, *(np.unique(np.concatenate([base[: int(n * part)], some.integers(0, 2**63, int(n * (1 - part) * more), dtype=np.uint64)])) for part in (1.0, 0.9, 0.7) for more in (0.3, 1.0, 1.7))]
        odds = simhash_dedup.Odds([simhash_dedup.parities(x, simhash_dedup.classes_for(len(x))) for x in sets])
        size = np.array([len(x) for x in sets])
        others = np.arange(len(sets))
        for one in range(len(sets)):
            differ = odds.differ(one, others)
            assert all(d <= len(np.setxor1d(sets[one], x)) for d, x in zip(differ, sets))
            near = simhash_dedup.alike(odds, size, one, others, 0.8)
            exact = np.array([len(np.intersect1d(sets[one], x)) / max(1, len(np.union1d(sets[one], x))) for x in sets])
            assert near[exact >= 0.8].all()
            if n >= 1100:
                assert not near[exact < 0.74].any()


def test_a_family_of_long_texts_is_hardly_compared(spark, monkeypatch):
    """120 texts of 3,000 words, of whose shingles any two share about three quarters: one round of links, at most two for each anchor of a text, and none of all pairs."""
    some = random.Random(2)
    base = [f"w{some.randrange(5000)}" for _ in range(3000)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in some.sample(range(3000), 90):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    checked, verified = [], simhash_dedup.verified
    monkeypatch.setattr(simhash_dedup, "verified", lambda links, *a, **b: checked.append(links.count()) or verified(links, *a, **b))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = simhash_dedup.similar(docs).collect()
    assert len(found) == 120 and all(r.component_id == r.doc_id for r in found)
    assert len(checked) == 1 and sum(checked) <= 2 * 8 * 120
