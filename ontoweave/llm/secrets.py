"""Multipart credentials: access identifiers, secrets and endpoints linked within scopes.

Strong parts are reported wherever they stand: assignments of a secret, access identifiers
and long hex runs. Weak parts (a bare 40-character key, an endpoint) say nothing alone; an
interval join inside each document reports them only where a complementary part lies in the
same scope: a key beside an access identifier, an endpoint beside an access identifier or
an assigned secret. A scope is a paragraph (text between blank lines), however long it is;
a ``reach`` joins only parts with at most that many code points between them. ``find`` has
none unless the caller gives one; ``linked_parts`` alone takes ``REACH``. The join sweeps the
parts in order of their starts, so it costs no more than sorting them, however many a text
holds.

Nothing crosses a document, so there is no shuffle. Positions are code points, ends are
exclusive. A null or empty text has no parts; repeated rows are answered one by one; other
columns pass through, except one that bears the new column's name, which is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The patterns of the strong parts, and the length from which a match counts.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("passw", "secret", "token", "api")
# The weak parts. A key may follow an assignment sign; "=" after 40 characters pads a longer value.
KEY = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"https?://[^\s\"'<>()]+|(?<![\w.-])(?:[a-z0-9-]+\.)+amazonaws\.com")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
REACH = 400
SPANS = "array<struct<kind:string,start:int,end:int,anchor:int>>"


def strong_parts(text: str) -> list[tuple[str, int, int]]:
    """Assignments, access identifiers and hex runs; leftmost, not overlapping per kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        matches = ((m, m.end(2) - m.start(2)) for m in ASSIGN.finditer(text))
        found += [("assign", m.start(), m.end()) for m, size in matches if size >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of 24 or more is the same whether the length is asked for now or afterwards.
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def furthest(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each of ``parts`` (sorted) the one with the largest end up to there."""
    return list(accumulate(parts, lambda held, p: p if p[1] > held[1] else held))


def nearest(
    parts: list[tuple[int, int]], ends: list[tuple[int, int]], start: int, end: int, low: int, high: int, reach: int | None
) -> int | None:
    """The start of the closest of ``parts`` (sorted) inside ``low`` to ``high`` and within
    reach; ``ends`` are their ``furthest``.

    Of all parts before, the one with the largest end is closest. No strong part holds a line
    break, so one inside the scope ends behind all those of earlier scopes.
    """
    at = bisect_left(parts, (start, end))
    best = None
    for other in [*parts[max(0, at - 1) : at + 1], *ends[max(0, at - 1) : at]]:
        gap = max(other[0] - end, start - other[1], 0)
        if low <= other[0] < high and (reach is None or gap <= reach) and (best is None or gap < best[0]):
            best = (gap, other[0])
    return best[1] if best else None


def linked_parts(text: str | None, reach: int | None = REACH) -> list[tuple[str, int, int, int | None]]:
    """All reported parts of one text by start, then kind: kind, start, end, and the start of
    the complementary part that a weak one was joined to."""
    strong = strong_parts(text) if text else []
    if not strong:
        return []
    spans = [(k, s, e, None) for k, s, e in strong]
    by_kind = {k: sorted((s, e) for kind, s, e in strong if kind == k) for k in BASE}
    rules = [("key", KEY, by_kind["access"]), ("endpoint", ENDPOINT, sorted(by_kind["access"] + by_kind["assign"]))]
    taken = sorted((s, e) for _, s, e in strong)
    ends = furthest(taken)
    bounds = None
    for kind, pattern, others in rules:
        if not others:
            continue
        others_ends = furthest(others)
        if bounds is None:
            bounds = [0, *(m.end() for m in BLANK.finditer(text))]
        for match in pattern.finditer(text):
            start, end = match.span()
            place = bisect_right(bounds, start)
            low, high = bounds[place - 1], bounds[place] if place < len(bounds) else len(text) + 1
            before = bisect_right(taken, (start, len(text)))
            if kind == "key" and before and end <= ends[before - 1][1]:
                continue  # already part of a strong one
            anchor = nearest(others, others_ends, start, end, low, high, reach)
            if anchor is not None:
                spans.append((kind, start, end, anchor))
    return sorted(spans, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))


def find(docs: DataFrame, reach: int | None = None, name: str = "spans") -> DataFrame:
    """Adds the reported parts of each text, sorted by start, then kind as listed."""
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("anchor", pa.int32())])

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = (linked_parts(t.as_py(), reach) for t in texts)
        return pa.array([[dict(zip(("kind", "start", "end", "anchor"), p)) for p in row] for row in rows], pa.list_(struct))

    return small_batches(docs).withColumn(name, found(F.col("text").cast("string")))


def redacted(text: str, spans: str) -> Column:
    """The text with every secret part, but not endpoints, replaced by ``[secret]``; parts that
    overlap or touch are replaced once. A text without such parts is left as it is."""

    @F.arrow_udf("string")
    def cut_out(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for value, found in zip(texts, parts, strict=True):
            plain, found = value.as_py(), found.as_py() or []
            pieces, at, last = [], 0, -1
            for start, end in sorted((p["start"], p["end"]) for p in found if p["kind"] != "endpoint"):
                if start > last:
                    pieces += [plain[at:start], "[secret]"]
                at = last = max(end, last)
            out.append("".join([*pieces, plain[at:]]) if pieces else plain)
        return pa.array(out, pa.string())

    return cut_out(F.col(text).cast("string"), F.col(spans))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each part, joined by commas."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")


def digest(found: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of the strong kinds, the hash of their spans and the text of all spans."""
    base = F.filter(F.col(spans), lambda p: p["kind"].isin(*BASE))

    def counted(kind: str) -> Column:
        return F.size(F.filter(F.col(spans), lambda p: p["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    hashed = F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(counted, BASE), hashed, spans_text(F.col(spans)).alias("spans"))
