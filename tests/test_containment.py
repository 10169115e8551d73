"""Containment, section matching and new persons against nested loops and a fold in sequence."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plenaria.functions import transcripts
from plenaria.operators import persons
from plenaria.operators.containment import contained

PERSONS = "id long, label string, givenName string, familyName string, country string"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("q", [1, 3, 4])
def test_contained_equals_nested_loops(spark, q):
    some = random.Random(q)
    text = lambda n: "".join(some.choice("abé ") for _ in range(some.randint(0, n)))
    texts = [(some.choice("xy"), text(14)) for _ in range(120)] + [("x", None), (None, "abab"), ("z", "é" * 40)]
    forms = [(some.choice("xy"), text(5)) for _ in range(120)] + [("x", None), (None, "ab"), ("z", "é" * 40), ("z", "éa"), ("y", "b" * 30)]
    left, right = spark.createDataFrame(forms, "k string, form string"), spark.createDataFrame(texts, "k string, text string")
    want = {(k, f, t) for k, f in forms for j, t in texts if k is not None and k == j and f and t and f in t}
    found = contained(left, right, ["k"], q)
    got = found.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    without = {(f, t) for _, f in forms for _, t in texts if f and t and f in t}
    assert {tuple(r) for r in contained(left, right, q=q).collect()} == without


def test_links_by_containment_equal_nested_loops(spark):
    some = random.Random(3)
    word = lambda: "".join(some.choice("anborsk") for _ in range(some.randint(1, 6)))
    known = [(i, " ".join(word() for _ in range(some.randint(1, 3)))) for i in range(60)]
    cut = [(label[some.randint(0, 4) : some.randint(3, 12)] if some.random() < 0.7 else " ".join(reversed(label.split()[-2:]))) for _, label in known] + ["", " ", "nobody here"]
    speakers = sorted(set(cut))
    got = {r["speaker_name"]: r["person_id"] for r in persons.link_speakers(spark.createDataFrame([(x,) for x in speakers], "speaker_name string"), spark.createDataFrame(known, "id long, label string")).collect()}
    for name in speakers:
        key = " ".join(name.lower().split())
        turned = " ".join(reversed(key.split()))
        labels = [(i, " ".join(label.lower().split())) for i, label in known]
        equal = [i for i, x in labels if key and key in (x, " ".join(reversed(x.split())))]
        inside = [i for i, x in labels if key and (key in x or turned in x)]
        assert got[name] == min(equal or inside, default=None), name


def fold(speakers, known):
    """One speaker after the other, as a loop: (links, made)."""
    lookup = {}
    for i, label, given, family, _ in known:
        for name in [label, *([f"{given} {family}", f"{family} {given}"] if given and family else [])]:
            if name and name.strip():
                lookup[name.strip().lower()] = max(i, lookup.get(name.strip().lower(), i))
    number = max([i for i, *_ in known], default=0) or 1_000_000
    links, made = {}, []
    for name, n in sorted(speakers.items(), key=lambda x: (-x[1], x[0])):
        parts = name.split()
        keys = [name.strip().lower()] + ([f"{parts[0]} {parts[-1]}".lower(), f"{parts[-1]} {parts[0]}".lower()] if len(parts) > 1 else [])
        found = next((lookup[k] for k in keys if k in lookup), None)
        if found is None:
            number += 1
            found = number
            made.append((number, name.strip(), parts[0], parts[-1], n))
            lookup |= dict.fromkeys(keys, number)
        links[name] = found
    return links, made


@pytest.mark.parametrize("seed", range(4))
def test_new_persons_equal_a_fold_in_sequence(spark, seed):
    some = random.Random(seed)
    words = ["Ann", "ann", "Lee", "Bo", "Wu", "Q.", "de"]
    name = lambda: " ".join(some.choice(words) for _ in range(some.randint(1, 3)))
    known = [] if seed == 3 else [(i, name(), *((some.choice(words), f"{some.choice(words)} {some.choice(words)}") if i % 3 else (some.choice(words), some.choice(words))), "SE") for i in range(1, 7)]
    speakers = {}
    for _ in range(60):
        key = name() + some.choice(["", "", " "])
        speakers[key] = some.randint(1, 4)
    said = spark.createDataFrame([(k, None) for k, n in speakers.items() for _ in range(n)] + [("Ann Lee", 5), (" ", None), (None, None)], "speaker_name string, mep_id long")
    links, made = persons.in_sequence(said, spark.createDataFrame(known, PERSONS))
    want_links, want_made = fold(speakers, known)
    assert {r["speaker_name"]: r["person_id"] for r in links.collect()} == want_links and links.count() == len(want_links)
    assert [tuple(r) for r in made.select("id", "label", "givenName", "familyName", "n").orderBy("id").collect()] == want_made


def test_sections_equal_nested_loops(spark):
    some = random.Random(5)
    words = ["fish", "fishing", "water", "energy", "of", "the", "policy", "tax", "xfishx", "a" * 90, "b" * 170, "climates"]
    text = lambda n: " ".join(some.choice(words) for _ in range(some.randint(0, n)))
    sections = [(s, i, f"T{i}", None, text(60)) for s in "pqr" for i in range(4)] + [("p", 9, "null", "d", None)]
    speeches = []
    for s in "pqrs":
        for i in range(15):
            own = [t for k, *_, t in sections if k == s and t]
            cut = some.choice(own)[some.randint(0, 30) :][: some.randint(60, 260)] if own and i % 2 else ""
            speeches.append((s, i, cut + some.choice(["", " " + text(12)])))
    speeches += [("p", 98, None), ("p", 99, ""), ("p", 5, speeches[5][2])]
    frame = spark.createDataFrame(speeches, "sitting_id string, speech_order int, speech_content string").withColumn("score", F.lit(1))
    got = transcripts.match_sections(frame, spark.createDataFrame(sections, "sitting_id string, ordinal int, title string, docIdentifier string, text string"))
    assert "NestedLoop" not in plan(got) and got.columns == [*frame.columns, "section"]
    clean = lambda t: " ".join((t or "").split())
    want = []
    for s, i, said in speeches:
        said = clean(said)
        distinct, best = set(said.split()), None
        for k, at, title, doc, body in sections:
            body = clean(body)
            if k != s or len(said) < 50:
                continue
            snippets = [x for x in (said[p : p + 160] for p in (0, 40, 80, 120)) if len(x) >= 80]
            score = 2.0 if len(body) >= 100 and any(x in body for x in snippets) else sum(len(w) > 3 and w in body for w in distinct) / max(1, len(distinct))
            if score >= 0.08 and (best is None or (score, -at) > best[:2]):
                best = (score, -at, title, doc)
        want.append((s, i, None if best is None else (best[2], best[3], min(1.0, best[0]))))
    made = [(r["sitting_id"], r["speech_order"], None if r["section"] is None else tuple(r["section"])) for r in got.collect()]
    assert sorted(made, key=str) == sorted(want, key=str)
