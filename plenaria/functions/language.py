"""Language of a text: by script, by a scorer at once, by a vote over chunks, and a decision among them.

The scorer is a parameter: a function from a series of texts to a data frame of
language and confidence. The default counts frequent short words. Everything that needs
it is one Arrow pass over the texts: no explode, no join, no text scored twice.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenaria.settings import bounded_batches

from .columns import cleaned

Scorer = Callable[[pd.Series], pd.DataFrame]

# A few of the most frequent words of each language, as it is commonly written.
FREQUENT = {
    "EN": "the of and to in is that for", "FR": "le la les des et est que dans", "DE": "der die und das den ist von mit", "ES": "el los las del que por una es",
    "IT": "il di che della per sono con gli", "PT": "o os da do em não uma com", "NL": "de het een van en dat niet voor", "PL": "w i nie na się jest do że",
    "SV": "och att det som en för är på", "DA": "og at det en er til af ikke", "FI": "ja on ei että se oli mutta ovat", "CS": "a je se na že to ve jsou",
    "HU": "a az és hogy nem egy is van", "RO": "și în de la cu care este nu", "BG": "и на за да се от не са", "EL": "και το του της να με για η",
    "ET": "ja on ei et see oli ka ning", "GA": "agus an na ar is go le bhí", "HR": "i je u na da se za su", "LV": "un ir ar par uz kas no tika",
    "LT": "ir yra kad į su tai iš bei", "MT": "u li ta il fil huwa minn dwar", "SK": "a je na sa že to vo sú", "SL": "in je na da se za so ki",
}
ISO3 = {
    "bul": "BG", "ces": "CS", "dan": "DA", "deu": "DE", "ell": "EL", "eng": "EN", "est": "ET", "fin": "FI", "fra": "FR", "gle": "GA", "hrv": "HR", "hun": "HU",
    "ita": "IT", "lav": "LV", "lit": "LT", "mlt": "MT", "nld": "NL", "pol": "PL", "por": "PT", "ron": "RO", "slk": "SK", "slv": "SL", "spa": "ES", "swe": "SV",
}
LANGUAGES = tuple(sorted(ISO3.values()))
#: What script_language() of columns.py looks for.
SCRIPTS, SPACES = (("EL", 0.999, re.compile("[Ͱ-Ͽ]")), ("BG", 0.995, re.compile("[Ѐ-ӿ]"))), re.compile(r"[ \t\n\v\f\r]")
ONE_SHOT, VOTE, CHUNK, LONGEST, FALLBACK_LENGTH = 0.60, 0.72, 600, 50_000, 20


def iso2(code: str | Column) -> Column:
    """A two-letter code of an ISO code of two or three letters (with or without region); null if it is none of the 24."""
    low = F.lower(F.get(F.split(code, "[-_]"), F.lit(0)))
    out = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ISO3.items() for x in pair)), low), F.upper(low))
    return F.when(out.isin(*LANGUAGES), out)


WORD_CODES = {w: [c for c, words in FREQUENT.items() if w in words.split()] for words in FREQUENT.values() for w in words.split()}


def frequent_words(texts: pd.Series) -> pd.DataFrame:
    """The language of most frequent words; confidence is its share of all frequent words found, less where few words are."""

    def one(text: str | None) -> tuple[str | None, float]:
        words = (text or "").lower().split()
        votes: dict[str, float] = {}
        for word, n in Counter(words).items():
            codes = WORD_CODES.get(word.strip(".,;:!?"), ())
            for code in codes:
                votes[code] = votes.get(code, 0.0) + n / len(codes)
        if not votes:
            return None, 0.0
        best = min(votes, key=lambda c: (-votes[c], c))
        found = sum(votes.values())
        return best, votes[best] / found * min(1.0, 5 * found / len(words))

    return pd.DataFrame([one(t) for t in texts], columns=["language", "confidence"])


def trained(labelled: DataFrame, language: str = "language", text: str = "text", size: int = 3, top: int = 1000) -> Scorer:
    """A scorer from labelled texts: the `top` character n-grams of each language with their shares (a multinomial model).

    The n-grams of all rows are counted on the executors; what is collected is bounded by
    languages * top. All n-grams of a text decide; confidence is
    the best language's share of the likelihood of an average stretch of 20 n-grams.
    """
    body = F.lower(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[\s\d]+", " "))
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("body") - size + 1, F.lit(1))), lambda i: F.substring("body", i, F.lit(size)))).alias("gram")
    counts = labelled.select(F.col(language).alias("code"), body.alias("body")).where("code is not null and body is not null").select("code", grams)
    counts = counts.where(F.length("gram") == size).groupBy("code", "gram").agg(F.count("*").alias("n"))
    best = Window.partitionBy("code").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top).select("code", "gram", "n").collect()
    codes = sorted({r["code"] for r in kept})
    totals = Counter()
    for r in kept:
        totals[r["code"]] += r["n"]
    floor = {c: math.log(0.5 / (totals[c] + top)) for c in codes}
    gains: dict[str, list[tuple[int, float]]] = {}
    for r in kept:
        c = r["code"]
        gains.setdefault(r["gram"], []).append((codes.index(c), math.log((r["n"] + 0.5) / (totals[c] + top)) - floor[c]))

    def one(value: str | None) -> tuple[str | None, float]:
        clean = re.sub(r"[\s\d]+", " ", f" {value or ''} ").lower()
        found = Counter(clean[i : i + size] for i in range(len(clean) - size + 1))
        n = sum(found.values())
        if not any(g in gains for g in found):
            return None, 0.0
        score = [floor[c] * n for c in codes]
        for gram, times in found.items():
            for i, gain in gains.get(gram, ()):
                score[i] += times * gain
        top_score = max(score)
        weight = [math.exp((x - top_score) / n * min(n, 20)) for x in score]
        return codes[score.index(top_score)], 1 / sum(weight)

    return lambda texts: pd.DataFrame([one(t) for t in texts], columns=["language", "confidence"])


def profiles(labelled: DataFrame, language: str = "language", text: str = "text", top: int = 400, longest: int = 4) -> Scorer:
    """A scorer by rank order: a text's most frequent character n-grams against those of each language, by how far each is out of its place.

    Profiles are the `top` n-grams of one to `longest` letters, the most frequent first. They are
    learnt from all labelled texts; their n-grams are counted on the executors, and what is
    collected is bounded by languages * top. All of a text is scored. An n-gram that a profile lacks
    is `top` places out; confidence is how much nearer the best language is than the second one
    (than none at all where there is only one).
    """
    rows = labelled.select(F.col(language).alias("code"), F.col(text).alias("body")).where("code is not null and body is not null")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for code, some in frame.groupby("code"):
                for block in _blocks(some["body"], LEARNT_AT_ONCE):
                    grams, n = _ngrams_of_all(block, longest)
                    yield pd.DataFrame({"code": code, "gram": grams, "n": n})

    counts = rows.mapInPandas(count, "code string, gram string, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("place", place).where(F.col("place") <= top).select("code", "gram", "place").collect()
    codes = sorted({r["code"] for r in kept})
    # A row of places for each n-gram; the last one is of n-grams that no profile has.
    index = {g: i for i, g in enumerate(sorted({r["gram"] for r in kept}))}
    places, none = np.full((len(index) + 1, len(codes)), -1, np.int64), len(index)
    for r in kept:
        places[index[r["gram"]], codes.index(r["code"])] = r["place"] - 1

    def score(block: list[str]) -> list[tuple[str | None, float]]:
        said: list[tuple[str | None, float]] = [(None, 0.0)] * len(block)
        owner, nth, grams = _first_ngrams_of_each(block, top, longest)
        if not codes or not grams:
            return said
        own = np.fromiter((index.get(g, none) for g in grams), np.int64, len(grams))
        there = places[own]
        texts, first, size = np.unique(owner, return_index=True, return_counts=True)
        out = np.add.reduceat(np.where(there < 0, top, np.abs(there - nth[:, None])), first)
        best = out.argmin(1)
        second = np.partition(out, 1)[:, 1] if len(codes) > 1 else top * size
        for i in np.flatnonzero(np.logical_or.reduceat(own < none, first)):
            said[texts[i]] = codes[best[i]], 1 - int(out[i, best[i]]) / max(int(second[i]), 1)
        return said

    return lambda texts: pd.DataFrame([x for block in _blocks(texts, SCORED_AT_ONCE) for x in score(block)], columns=["language", "confidence"])


LETTERS = re.compile(r"[^\W\d_]+")
#: Characters, and texts, whose n-grams are counted in one call; a text of more than ALONE characters is counted by _ngrams().
SCORED_AT_ONCE, LEARNT_AT_ONCE, TEXTS_AT_ONCE, ALONE = 1 << 17, 1 << 19, 256, 1 << 21


def _blocks(texts: Iterable[str | None], most: int) -> Iterator[list[str]]:
    """Texts in their order, up to `most` characters at a time; a longer text is alone."""
    block, n = [], 0
    for text in texts:
        text = text or ""
        if block and (n + len(text) > most or len(block) == TEXTS_AT_ONCE):
            yield block
            block, n = [], 0
        block.append(text)
        n += len(text)
    if block:
        yield block


def _numbered(texts: list[str], longest: int, apart: bool) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]] | None:
    """The n-grams of _ngrams() as numbers, each once a text (once for all texts if not `apart`), how often they are found, and what spells numbers.

    A number is its text, then the places of its characters in the alphabet of all texts, where the filling of
    shorter n-grams and the gap come first, so numbers are in the order of texts and n-grams. None where that
    is too long a number or a text is too long.
    """
    low = [f" {t.lower()} " for t in texts]
    sizes = [len(t) for t in low]
    if max(sizes) > ALONE:
        return None
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters = np.array([c for c in np.flatnonzero(seen).tolist() if LETTERS.match(chr(c))], np.uint32)
    bits = (len(letters) + 1).bit_length()
    shift = bits * longest
    if shift + len(texts).bit_length() > 63:
        return None
    alphabet = np.concatenate([np.array([0, ord(" ")], np.uint32), letters])
    place = np.ones(len(seen), np.int64)
    place[letters] = np.arange(2, len(alphabet))
    at, owner = place[points], np.repeat(np.arange(len(texts)), sizes)
    # Between two words there is one gap; between two texts there are two.
    keep = at > 1
    keep[1:] |= (at[:-1] > 1) | (owner[1:] != owner[:-1])
    keep[0] = True
    at, owner = at[keep], owner[keep] << shift if apart else np.zeros(int(keep.sum()), np.int64)
    gap = at == 1
    found, value, inside = [(owner | at << shift - bits)[~gap]], at, gap
    for size in range(2, min(longest, len(at)) + 1):
        value = value[:-1] << bits | at[size - 1 :]
        # Gaps are ends only, and never both of two characters.
        inside = inside[:-1] & ~gap[size - 2 : -1] if size > 2 else ~(gap[:-1] & gap[1:])
        found.append((owner[: len(value)] | value << shift - bits * size)[inside])
    numbers, n = np.unique(np.concatenate(found), return_counts=True)

    def spell(numbers: np.ndarray) -> list[str]:
        return alphabet[numbers[:, None] >> bits * np.arange(longest - 1, -1, -1) & (1 << bits) - 1].view(f"<U{longest}").ravel().tolist()

    return numbers >> shift, numbers, n, spell


def _ngrams_of_all(texts: list[str], longest: int) -> tuple[list[str], list[int] | np.ndarray]:
    """The n-grams of all texts, and how often they are found."""
    found = _numbered(texts, longest, apart=False)
    if found is None:
        plain = sum((_ngrams(t, longest) for t in texts), Counter())
        return list(plain), list(plain.values())
    _, numbers, n, spell = found
    return spell(numbers), n


def _first_ngrams_of_each(texts: list[str], top: int, longest: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """first_ngrams() of each text: the number of the text, the place from 0, the n-gram."""
    found = _numbered(texts, longest, apart=True)
    if found is None:
        plain = [first_ngrams(t, top, longest) for t in texts]
        sizes = [len(p) for p in plain]
        return np.repeat(np.arange(len(texts)), sizes), np.concatenate([np.arange(k) for k in sizes]), list(chain.from_iterable(plain))
    owner, numbers, n, spell = found
    order = np.lexsort((-n, owner))
    nth = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
    first = nth < top
    return owner[first], nth[first], spell(numbers[order[first]])


@lru_cache(1 << 15)
def _grams_of(word: str, longest: int) -> tuple[str, ...]:
    word = f" {word} "
    return tuple(word[i : i + size] for size in range(1, longest + 1) for i in range(len(word) - size + 1))


def _ngrams(text: str, longest: int) -> Counter:
    """N-grams of 1 to `longest` characters of the words, each between two gaps; gaps alone are none."""
    out = Counter(chain.from_iterable(_grams_of(w, longest) for w in LETTERS.findall(text.lower())))
    del out[" "]
    return out


def first_ngrams(text: str, top: int, longest: int) -> list[str]:
    """The `top` most frequent n-grams, ties by themselves; only those that may be among them are sorted."""
    found = _ngrams(text, longest)
    if len(found) > top:
        least = heapq.nlargest(top, found.values())[-1]
        found = {g: n for g, n in found.items() if n >= least}
    return sorted(sorted(found), key=found.get, reverse=True)[:top]


ANSWER = "struct<language:string,confidence:double>"


def votes(texts: list[str | None], scorer: Scorer = frequent_words) -> list[tuple[str, float] | None]:
    """For each text, chunks of 600 characters of the first 50,000 vote; the best mean confidence wins, a missing one counts 0.5. The chunks of all texts are scored in one call."""
    chunks, owner = [], []
    for nth, text in enumerate(texts):
        body = (text or "")[:LONGEST]
        mine = [body[i : i + CHUNK] for i in range(0, max(len(body), 1), CHUNK)]
        chunks += mine
        owner += [nth] * len(mine)
    said: list[dict[str, list[float]]] = [{} for _ in texts]
    got = scorer(pd.Series(chunks)) if chunks else pd.DataFrame({"language": [], "confidence": []})
    for nth, code, confidence in zip(owner, got["language"], got["confidence"]):
        if code is not None and code == code:
            said[nth].setdefault(code, []).append(0.5 if confidence is None or confidence != confidence else float(confidence))
    out: list[tuple[str, float] | None] = []
    for found in said:
        means = {code: sum(c) / len(c) for code, c in found.items()}
        best = min(means, key=lambda c: (-means[c], c), default=None)
        out.append(None if best is None else (best, means[best]))
    return out


def vote(text: str | None, scorer: Scorer = frequent_words) -> tuple[str, float] | None:
    return votes([text], scorer)[0]


def script_of(text: str | None) -> tuple[str, float] | None:
    """script_language() of one text, where it is in Python already."""
    n = len(SPACES.sub("", text or ""))
    if n < 20:
        return None
    return next(((code, sure) for code, sure, letters in SCRIPTS if len(letters.findall(text)) / n >= 0.3), None)


def answers(text: Column, scorer: Scorer = frequent_words, fallback: Scorer | None = None) -> Column:
    """struct(by_script, at_once, second, vote) of texts, which are cleaned once for all of them.

    The second scorer sees texts of FALLBACK_LENGTH; only texts that neither their script nor the first answer settles are voted on.
    """

    @F.pandas_udf(f"by_script {ANSWER}, at_once {ANSWER}, second {ANSWER}, vote {ANSWER}")
    def run(texts: pd.Series) -> pd.DataFrame:
        def pack(pairs) -> list[dict]:
            return [{"language": None if x is None or x[0] != x[0] else x[0], "confidence": None if x is None or x[1] is None or x[1] != x[1] else float(x[1])} for x in pairs]

        of = lambda found: list(zip(found["language"], found["confidence"]))
        script = [script_of(t) for t in texts]
        first = of(scorer(texts))
        second = of(fallback(texts)) if fallback else [None] * len(texts)
        second = [x if t is not None and len(t) >= FALLBACK_LENGTH else None for x, t in zip(second, texts)]
        open_ = [i for i, ((_, c), s) in enumerate(zip(first, script)) if s is None and not (c is not None and c == c and c >= ONE_SHOT)]
        voted: list[tuple[str, float] | None] = [None] * len(texts)
        for i, found in zip(open_, votes([texts.iloc[i] for i in open_], scorer)):
            voted[i] = found
        return pd.DataFrame({"by_script": pack(script), "at_once": pack(first), "second": pack(second), "vote": pack(voted)})

    return run(cleaned(text))


def decide(docs: DataFrame, text: str, scorer: Scorer = frequent_words, fallback: Scorer | None = None) -> DataFrame:
    """`docs` with detected struct(language, confidence, how): by script, at once, by vote, by agreement, or the first answer that there is."""
    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("said", answers(F.col(text), scorer, fallback))
    rows = rows.withColumns({c: F.col(f"said.{c}") for c in ("by_script", "at_once", "second", "vote")})
    answer = lambda c, how: F.struct(F.col(f"{c}.language").alias("language"), F.col(f"{c}.confidence").alias("confidence"), F.lit(how).alias("how"))
    agree = (F.col("at_once.language") == F.col("vote.language")) | (F.col("at_once.language") == F.col("second.language"))
    decision = (
        F.when(F.col("by_script.language").isNotNull(), answer("by_script", "script"))
        .when(F.col("at_once.confidence") >= ONE_SHOT, answer("at_once", "one_shot"))
        .when(F.col("vote.confidence") >= VOTE, answer("vote", "vote"))
        .when(agree, answer("at_once", "agreement"))
        .when(F.col("vote.language") == F.col("second.language"), answer("vote", "agreement"))
        .when(F.col("at_once.language").isin("EL", "MT"), answer("at_once", "nudge"))
        .when(F.col("at_once.language").isNotNull(), answer("at_once", "first"))
        .when(F.col("vote.language").isNotNull(), answer("vote", "first"))
        .when(F.col("second.language").isNotNull(), answer("second", "first"))
    )
    return rows.withColumn("detected", decision).drop("by_script", "said", "at_once", "second", "vote")


def fill_language(speeches: DataFrame, key: str = "id", text: str = "speech_content", only_missing: bool = True, scorer: Scorer = frequent_words, fallback: Scorer | None = None) -> DataFrame:
    """Speeches with their language: only where it is missing, or for all."""
    wanted = speeches.where("language is null") if only_missing else speeches
    found = decide(wanted.select(key, text), text, scorer, fallback).select(key, F.col("detected.language").alias("found"))
    value = F.coalesce("language", "found") if only_missing else F.coalesce("found", "language")
    return speeches.join(found, key, "left").withColumn("language", value).drop("found")


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("language").agg(F.count("*").alias("n"))


def one_per_language(rows: DataFrame, key: str, language: str = "language") -> DataFrame:
    w = Window.partitionBy(language).orderBy(key)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
