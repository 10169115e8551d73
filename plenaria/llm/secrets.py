"""Secret scan: base patterns, and weak parts of credentials that are linked by an interval join.

A credential often has several parts: an identifier, a secret and an endpoint.

* Base kinds (always reported): `assign` (a secret given to a name), `access` (an
  access identifier), `hex` (a long run of hexadecimal digits).
* Weak kinds: `client` (a user or client name given to a key), `opaque` (a long
  token of letters and digits), `endpoint` (a URL). Alone they mean nothing. They
  are reported only where the complementary parts co-occur: an identifier with a
  secret, an endpoint with both.

The join is between intervals: each part reaches `reach` code points to both
sides, within its scope (text between blank lines); a weak part joins the nearest
part of each other role on either side, which is enough to tell whether any is in
reach. A document's parts are in its row, so the join is a sorted sweep inside the
row: nothing is shuffled, and a hot source or a large group of copies is only
more rows.

Every pattern takes time in proportion to a text's length, also in one long run
without white space.

Nulls: a null text is an empty one; a null doc_id stays null. Repeated rows give
repeated results. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small

KINDS = ("assign", "access", "hex", "client", "opaque", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "client": "identifier", "endpoint": "endpoint"}
NEEDS = {"client": ("secret",), "opaque": ("identifier",), "endpoint": ("identifier", "secret")}

# Fixed patterns of the base kinds. A run of 32 or more is the same as a maximal run that is 32 or longer.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CLIENT = re.compile(r"""(?:client_?id|user_?name|user|login|account|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}")
# An endpoint is a letter, more of SCHEME, "://" and a place.
SCHEME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-"
PLACE = re.compile(r"""[^\s"'<>]+""", re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")


def base_parts(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans, end exclusive."""
    out = [(*m.span(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def endpoints(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping endpoints: from each "://" back to the first letter of the run before it, so that no run is read twice."""
    out, done, at = [], 0, text.find("://")
    while at >= 0:
        run = text[done + len(text[done:at].rstrip(SCHEME)) : at].lstrip("0123456789+.-")
        place = PLACE.match(text, at + 3)
        done = at + 3
        if run and place:
            out.append((at - len(run), place.end(), "endpoint"))
            done = place.end()
        at = text.find("://", done)
    return out


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak spans that don't overlap base ones; none if the text has no identifier at all, as none could be linked."""
    clients = [(*m.span(), "client") for m in CLIENT.finditer(text)] if ":" in text or "=" in text else []
    if not clients and not any(kind == "access" for _, _, kind in base):
        return []
    found = clients + [(*m.span(), "opaque") for m in OPAQUE.finditer(text)]
    found += endpoints(text)
    taken, out = sorted((s, e) for s, e, _ in base), []
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    for s, e, kind in found:
        before = np.searchsorted(starts, e, "left")
        if before == 0 or ends[before - 1] <= s:
            out.append((s, e, kind))
    return out


def linked(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], reach: int) -> list[tuple[int, int, str]]:
    """The weak parts whose complements are within `reach` in the same scope.

    For each role, parts sorted by start with running maxima of the ends: the last
    one that starts by `end + reach` and the farthest end before it decide.
    """
    if not weak:
        return []
    cuts = np.array([m.start() for m in BLANK.finditer(text)], np.int64)
    scope = lambda at: int(np.searchsorted(cuts, at, "right"))
    roles: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for s, e, kind in base + weak:
        roles.setdefault((ROLE[kind], scope(s)), []).append((s, e))
    sorted_by = {}
    for key, spans in roles.items():
        spans.sort()
        sorted_by[key] = np.array([s for s, _ in spans], np.int64), np.maximum.accumulate(np.array([e for _, e in spans], np.int64))

    def near(s: int, e: int, role: str) -> bool:
        starts, ends = sorted_by.get((role, scope(s)), (np.zeros(0, np.int64),) * 2)
        n = np.searchsorted(starts, e + reach, "right")
        return bool(n and ends[n - 1] >= s - reach)

    return [(s, e, kind) for s, e, kind in weak if all(near(s, e, role) for role in NEEDS[kind])]


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, parts): per row an array of (kind, start, end, linked), by start and then kind; linked marks the weak parts."""
    part = "parts array<struct<kind:string,start:int,`end`:int,linked:boolean>>"
    order = {k: i for i, k in enumerate(KINDS)}
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_parts(text or "")
                more = linked(text or "", base, weak_parts(text or "", base), reach)
                spans = sorted(base + more, key=lambda x: (x[0], order[x[2]], x[1]))
                rows.append([{"kind": k, "start": s, "end": e, "linked": k in NEEDS} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "parts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {part}")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long")
    named = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(named(F.filter("parts", lambda p: ~p["linked"])), 256).alias("base_sha256"),
        named("parts").alias("spans"),
        F.size(F.filter("parts", lambda p: p["linked"])).cast("long").alias("n_linked"),
    )
