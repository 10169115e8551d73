"""Political groups: from free text to (std, kind, reason), and from that to a label for display.

The decision list is a chain of column expressions; `normalise_groups` evaluates it
once per distinct text and joins the answers back.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The valid groups, in the order in which they are tried.
CANONICAL = ("PPE", "S&D", "ECR", "ID", "Verts/ALE", "Renew", "The Left", "NI", "PfE", "EFDD", "ESN")
# Other names of groups, in the order in which they are tried.
SYNONYMS = {
    "EPP": "PPE", "PSE": "S&D", "ALDE": "Renew", "RENEW EUROPE": "Renew", "GREENS/EFA": "Verts/ALE", "GREENS": "Verts/ALE", "EFA": "Verts/ALE",
    "GUE/NGL": "The Left", "GUE": "The Left", "NGL": "The Left", "ENF": "ID", "PATRIOTS FOR EUROPE": "PfE", "PATRIOTS": "PfE", "EUL/NGL": "The Left",
    "UEN": "NI", "IND/DEM": "NI", "EDD": "NI", "ITS": "NI", "PPE-DE": "PPE", "EFD": "EFDD", "GROUP": "NI", "GRUPO": "NI", "S-D": "S&D",
    "BRITISH CONSERVATIVE DELEGATION": "ECR",
}
# Phrases that speak for a group without its name.
GENERIC = (
    "on behalf of the group", "in the name of the group", "for the group", "em nome do grupo", 'au nom du groupe, question "carton bleu"',
    "εξ ονόματος της ομάδας", "on behalf of more than 38 members", "on behalf of jean lambert",
    "on behalf of a number of members reaching at least the low threshold", "on behalf of a number of members sufficient to reach the low threshold",
)
# What marks an institution; phrases that contain another one of the list are left out, as the shorter one finds them.
INSTITUTION = (
    "member of the commission", "vice-president of the commission", "vice—president of the commission", "vice president of the commission",
    "high representative", "union for foreign affairs", "president-in-office of the council", "president-inoffice of the council",
    "president of the eurogroup", "executive vice-president", "executive vice—president", "vp/hr", "vpc/hr", "vpt/hr", "vice-president of the council",
    "mitglied der kommission", "vizepräsident", "hohen vertreterin", "hoher vertreter", "vice-président de la commission",
    "vice-présidente de la commission", "haut représentant", "haute représentante", "haute représentant", "président en exercice du conseil",
    "vicepresidente de la comisión", "alto representante", "vice ordförande för kommissionen", "formand for rådet",
)
# What marks a parliamentary role; likewise without phrases that contain another one.
ROLE = (
    "rapporteur", "chair of the delegation", "chairman of the delegation", "european parliament's delegation", "committee on", "special committee",
    "blue-card question", "blue card question", "deputising for", "deputizing for", "winner of the", "sakharov prize", "author of the motion",
    "draftsman of the opinion", "draftsman for the committee", "draftsperson of the opinion", "draftsperson for the opinion",
    "on behalf of the draftsman", "on behalf of the questioner", "on behalf of the envi committee", "on behalf of the committee",
    "delegation for relations with", "delegation for observation", "spokesman for the opinion of the committee",
    "candidate for president of the commission", "asked for an opinion", "föredragande", "utskottet för", "ordfører for udtalelse", "udvalget",
    "formand for rådet", "commission", "comissão das", "em nome da comissão", "komisji", "odbora za", "u ime odbora", "autorului",
    "voorzitter van de commissie",
)
# What decides about texts of more than eight words.
LONG_INSTITUTION = (
    "union for foreign affairs and security policy", "member of the commission, on behalf of", "vice-president of the commission",
    "vice president of the commission", "high representative of the union", "president-in-office of the council",
)
LONG_ROLE = ("rapporteur for the opinion of the committee", "deputising for the", "deputizing for the", "on behalf of the committee on")
# Endings that say a speech was given in writing, in the order in which they are dropped.
ENDINGS = (
    ", in writing", ", skriftlig", ", por escrito", ", írásban", ", în scris", ", kirjalikult", ", písemně", ", per iscritto", ", schriftlich",
)
# Fixed values: "on behalf of" in 14 languages, in the order in which they are tried; the group is what is captured.
ON_BEHALF = (
    r"on behalf of (?:the )?(.+?)(?:\s+group)?$", "au nom du groupe (.+)$", "au nom de (?:la )?(.+)$", "a nome del gruppo (.+)$", "a nome della (.+)$",
    "en nombre del grupo (.+)$", "em nome do grupo (.+)$", "im namen der (.+?)(?:-fraktion)?$", "im namen der fraktion (.+)$",
    "namens de (.+?)(?:-fractie)?$", "namens de fractie (.+)$", "namens de groep (.+)$", "för (.+?)(?:-gruppen)?$", "for (.+?)(?:-gruppen)?$",
    "w imieniu grupy (.+)$", "za skupinu (.+)$", "în numele grupului (.+)$", "εξ ονόματος της ομάδας (.+)$", "thar ceann an ghrúpa (.+)$",
    "u ime kluba (.+?)(?:-a)?$", "u ime kluba zastupnika (.+?)(?:-a)?$", "f'isem il-grupp (.+)$",
)
# Raw names of groups as they are displayed.
DISPLAY = {
    "PPE-DE": "PPE", "EPP": "PPE", "PPE": "PPE", "PSE": "S&D", "S&D": "S&D", "ELDR": "Renew", "ALDE": "Renew", "Renew": "Renew",
    "GUE/NGL": "The Left", "EUL/NGL": "The Left", "The Left": "The Left", "Verts/ALE": "Verts/ALE", "Greens/EFA": "Verts/ALE",
    "Greens/ALE": "Verts/ALE", "ECR": "ECR", "ID": "ID", "NI": "Non-Attached", "EFDD": "EFDD", "ESN": "ESN", "PfE": "PfE",
    "UEN": "Non-Attached", "EDD": "Non-Attached", "EFD": "EFDD", "ENF": "ID", "IND/DEM": "Non-Attached", "ITS": "Non-Attached",
    "TDI": "Non-Attached", "rapporteur": "Committee Rapporteur", "Committee Chair": "Committee Chair", "European Commission": "European Commission",
    "Council of the EU": "Council of the EU", "High Representative": "High Representative", "EU Institution": "EU Institution",
}
# Titles that say how someone spoke, not for whom.
PROCEDURAL = (
    "in writing", "par écrit", "por escrito", "per iscritto", "írásban", "na piśmie", "în scris", "γραπτώς", "schriftlich", "písomne", "napisan",
    "schriftelijk", "kirjallinen", "kirjalikult", "pisno", "rakstiski", "skriftlig", "в писмена форма", "author", "autor", "auteur", "verfasser",
    "blue-card", "blue card", "carton bleu", "cartão azul", "cartellino blu", "tarjeta azul", "blauwe kaart", "modré karty", "niebieskiej kartki",
    "plave kartice", "γαλάζια κάρτα", "blått kort", "kékkártyás", "sinisen kortin", "mėlynąją", "albastru", "blauen karte", "blauen kaart",
    "creitem", "stellungnahme des mitberatenden",
)
RAPPORTEUR = ("rapporteur", "berichterstatter", "ponente", "relator", "sprawozdawca", "föredragande", "draftsman of the opinion")


def any_of(text: Column, phrases) -> Column:
    return text.rlike("|".join(re.escape(p) for p in phrases))


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unaccented(texts: pd.Series) -> pd.Series:
    """Lower case without combining accents."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not "̀" <= c <= "ͯ"))


def search_text(c: str | Column) -> Column:
    """Text as it is compared: lower case, no accents, other marks as single spaces."""
    plain = unaccented(F.regexp_replace(c, " ", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))


def tidy(text: Column) -> Column:
    """One kind of space, dash and quotation mark, and no ending about writing."""
    out = F.regexp_replace(compatible(text), "[ ​-‍﻿]", " ")
    out = F.translate(F.translate(out, "‐‑‒–—―−", "-------"), "‘’‚‛“”„‟", "''''" + '""""')
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return reduce(lambda x, e: F.trim(F.regexp_replace(x, f"(?i){re.escape(e)}$", "")), ENDINGS, out)


def _names(more: dict[str, str] | None = None) -> Column:
    """The synonyms (and `more` of them, which win) and then the groups as array<struct<name, grp, word>>, in the order in which they are tried; word is a pattern."""
    pairs = [*(SYNONYMS | (more or {})).items(), *((c, c) for c in CANONICAL)]
    word = lambda name: rf"(?i)(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(g).alias("grp"), F.lit(word(n)).alias("word")) for n, g in pairs))


def _first(names: Column, test) -> Column:
    return F.get(F.filter(names, test), F.lit(0))["grp"]


def group_code(text: Column, more: dict[str, str] | None = None) -> Column:
    """The group of a code: by its name, by a synonym, or by one that contains the other; null if none does."""
    code = F.trim(F.upper(text))
    exact = F.when(code.isin([c for c in CANONICAL if c == c.upper()]), code)
    part = _first(_names(more), lambda x: F.contains(code, x["name"]) | F.contains(x["name"], code))
    return F.when(code != "", F.coalesce(exact, _first(_names(more), lambda x: x["name"] == code), part))


def whole_word(text: Column, more: dict[str, str] | None = None) -> Column:
    """The first group, or else synonym, that stands in the text as a word of its own."""
    inside = lambda x: F.regexp_like(text, x["word"])
    n = len(SYNONYMS | (more or {}))
    return F.coalesce(_first(F.slice(_names(more), n + 1, len(CANONICAL)), inside), _first(F.slice(_names(more), 1, n), inside))


def group_decisions(raw: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """`raw` (column raw) with std, kind and reason. `more`: further synonyms, as records.synonyms() reads them."""
    df = raw.withColumn("t", tidy(F.col("raw"))).withColumn("low", F.lower("t")).withColumn("words", F.size(F.split("t", r"\s+")))
    in_brackets = F.coalesce(F.nullif(F.regexp_extract("t", r"\(([^)]+)\)|\s+([A-Z&/]+)\)$", 1), F.lit("")), F.regexp_extract("t", r"\(([^)]+)\)|\s+([A-Z&/]+)\)$", 2))
    first_behalf = reduce(
        lambda rest, p: F.when(F.col("t").rlike(f"(?i){p}"), F.regexp_extract("t", f"(?i){p}", 1)).otherwise(rest), reversed(ON_BEHALF), F.lit(None).cast("string")
    )
    df = df.withColumn("bracket", group_code(in_brackets, more)).withColumn("behalf", F.trim(first_behalf)).withColumn("behalf", group_code(F.col("behalf"), more))
    df = df.withColumn("word", whole_word(F.col("t"), more)).withColumn("bare", group_code(F.col("t"), more))
    low, long = F.col("low"), F.col("words") > 8
    answer = lambda std, kind, reason: F.struct(std.alias("std"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    ni = F.lit("NI")
    steps = (
        (F.coalesce(F.trim("raw"), F.lit("")) == "", answer(ni, "unknown", "empty_input")),
        (F.col("t").isin(*CANONICAL), answer(F.col("t"), "group", "direct_canonical")),
        (any_of(low, GENERIC), answer(ni, "group", "generic_group_phrase")),
        (any_of(low, INSTITUTION), answer(ni, "institution", "institutional_markers")),
        (any_of(low, ROLE), answer(ni, "role", "parliamentary_markers")),
        (F.col("bracket").isNotNull(), answer(F.col("bracket"), "group", "parentheses_extraction")),
        (F.col("behalf").isNotNull(), answer(F.col("behalf"), "group", "on_behalf_pattern")),
        (long & any_of(low, LONG_INSTITUTION), answer(ni, "institution", "institutional_markers")),
        (long & any_of(low, LONG_ROLE), answer(ni, "role", "parliamentary_markers")),
        (long, answer(ni, "unknown", "looks_like_sentence")),
        (F.col("word").isNotNull(), answer(F.col("word"), "group", "direct_token")),
        (F.col("bare").isNotNull(), answer(F.col("bare"), "group", "bare_code")),
    )
    decision = reduce(lambda rest, s: F.when(s[0], s[1]).otherwise(rest), reversed(steps), answer(ni, "unknown", "no_match"))
    return df.select(*raw.columns, decision.alias("d")).select(*raw.columns, "d.*")


def normalise_groups(speeches: DataFrame, overwrite_raw: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """Speeches with political_group_raw, _std, _kind and _reason; each distinct text is decided once.

    Speeches without a text have their answer at once; in the join each is a key of its own,
    so that they don't meet in one task. overwrite_raw also puts the standard group into political_group.
    """
    raw = F.coalesce("political_group_raw", "political_group") if "political_group_raw" in speeches.columns else F.col("political_group")
    rows = speeches.withColumn("political_group_raw", raw)
    texts = rows.where(F.coalesce("political_group_raw", F.lit("")) != "").select(F.col("political_group_raw").alias("raw")).distinct()
    names = ("std", "kind", "reason")
    found = group_decisions(texts, more).select(F.col("raw").alias("__raw"), *(F.col(c).alias(f"__{c}") for c in names))
    rows = rows.drop(*(f"political_group_{c}" for c in names))
    alone = F.concat(F.lit("\0"), F.xxhash64(*(F.col(c).cast("string") for c in rows.columns)).cast("string"))
    joined = rows.withColumn("__key", F.coalesce(F.nullif("political_group_raw", F.lit("")), alone)).join(found, F.col("__key") == F.col("__raw"), "left")
    empty = dict(zip(names, ("NI", "unknown", "empty_input")))
    out = joined.select(*rows.columns, *(F.coalesce(f"__{c}", F.lit(empty[c])).alias(f"political_group_{c}") for c in names))
    return out.withColumn("political_group", F.col("political_group_std")) if overwrite_raw else out


def mapping_report(decided: DataFrame) -> DataFrame:
    """(kind, std, reason, texts, n) of texts with `n` uses each: the counts by kind, group and reason in one table."""
    return decided.groupBy("kind", "std", "reason").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))


def suggestion(raw: Column) -> Column:
    """A hint about a text that no rule covers."""
    low = F.lower(raw)
    return (
        F.when(any_of(low, ("commission", "council", "representative", "minister")), "Institution")
        .when(any_of(low, ("rapporteur", "committee", "chair", "delegation")), "Parliamentary Role")
        .when(any_of(low, ("group", "behalf", "grup")), "Likely group")
        .otherwise("Unknown")
    )


def display_label(std: Column, kind: Column, raw: Column) -> Column:
    """The label of a decided text; case counts."""
    has = lambda word: F.coalesce(F.contains(raw, F.lit(word)), F.lit(False))
    institution = F.when(has("Commission"), "European Commission").when(has("Council"), "Council of the EU").when(has("High Representative"), "High Representative")
    role = F.when(has("rapporteur"), "Committee Rapporteur").when(has("Chair") | has("chair"), "Committee Chair").when(has("delegat"), "Delegation Member")
    label = (
        F.when(kind == "institution", institution.otherwise("EU Institution"))
        .when(kind == "role", role.otherwise("Parliamentary Role"))
        .when((std == "NI") & (kind == "group"), "Non-Attached")
        .otherwise(std)
    )
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown"))


def raw_label(raw: Column) -> Column:
    """The label of a raw group name: as it stands, in capitals, or else itself; empty for none."""
    names = F.create_map(*(F.lit(x) for pair in DISPLAY.items() for x in pair))
    text = F.trim(raw)
    return F.coalesce(F.try_element_at(names, text), F.try_element_at(names, F.regexp_replace(F.upper(text), r"\s+", " ")), text, F.lit(""))


def title_label(title: Column, legacy: bool = False) -> Column:
    """The label of a title: a known name, or a role; empty for titles about procedure. legacy: an unknown title is its own label."""
    text, low = F.trim(title), F.lower(F.trim(title))
    known = raw_label(title)
    role = (
        F.when(any_of(low, RAPPORTEUR), "Committee Rapporteur")
        .when(F.contains(low, F.lit("chair")) & any_of(low, ("delegation", "committee")), "Committee Chair")
        .when(F.contains(low, F.lit("delegat")), "Delegation Member")
        .when(any_of(low, ("high representative", "vp/hr", "alto representante")), "High Representative")
        .when(F.contains(low, F.lit("commission")), "European Commission")
        .when(any_of(low, ("council", "ratspräsident", "consejo")), "Council of the EU")
        .when(F.contains(low, F.lit("institution")), "EU Institution")
        .otherwise("Parliamentary Role")
    )
    found = known if legacy else F.when(known != text, known).when(text.isin(*DISPLAY), known).otherwise(role)
    return F.when(title.isNull() | (text == "") | any_of(low, PROCEDURAL), "").otherwise(found)


def affiliation(std: Column, kind: Column, raw: Column, group: Column, title: Column) -> Column:
    """The label of a speech: from its standard group, else its raw one, else its title."""
    return F.when(F.coalesce(std, F.lit("")) != "", display_label(std, kind, raw)).when(F.coalesce(F.trim(group), F.lit("")) != "", raw_label(group)).otherwise(title_label(title))
