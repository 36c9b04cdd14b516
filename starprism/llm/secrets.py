"""Secret scan with linking of multipart credentials."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import batches, id_and_text, parts_of, releasing, texts_of

# fixed values: the three base patterns
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE, WEAK = ("assign", "access", "hex"), ("weak_id", "weak_secret", "endpoint")
_KIND = {k: i for i, k in enumerate(BASE + WEAK)}

_WEAK_ID = re.compile(r"""\b(?ai:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""")
_WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# a run of letters is tried from its first one alone, so a text of letters is read once
_ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]{1,30}|(?<![a-z])[a-z]{1,30}db|amqp|redis|ssh)://[^\s"'<>]+|\b(?ai:host|endpoint|server|bucket|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base findings, leftmost and non-overlapping within each kind; offsets are code points, ends exclusive."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _random_looking(s: str) -> bool:
    """Letters and digits, at least 3.5 bits a character."""
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.5


class _Intervals:
    """Spans sorted by their starts; tells which lie within a stretch."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]

    def within(self, low: int, high: int) -> bool:
        i = bisect_left(self.starts, low)
        return i < len(self.starts) and self.starts[i] < high

    def nearest(self, at: int, low: int, high: int) -> int | None:
        """The start nearest to a place among those of a stretch, the earlier of two; None if there is none."""
        i = bisect_left(self.starts, at)
        near = [self.starts[j] for j in (i - 1, i) if 0 <= j < len(self.starts) and low <= self.starts[j] < high]
        return min(near, key=lambda x: (abs(x - at), x), default=None)


Link = tuple[int, int, int | None]


def linked(text: str, base: list[Span], reach: int | None = None) -> tuple[list[Span], list[Link]]:
    """Weak candidates that complementary parts make credible, and which parts belong together.

    A part's scope is its paragraph (up to blank lines), with ``reach`` at most so many code points to either side.
    Identifiers are base access spans and weak ones; secrets are base assign and hex spans and weak ones. This is a join
    of intervals: a weak identifier is reported if a secret begins in its scope, a weak secret if an identifier does, an
    endpoint if both do. A link (starts of an identifier, a secret, an endpoint or None) goes from each identifier to the
    nearest secret of its scope, and from each secret to its nearest identifier; the endpoint is that nearest to the
    identifier. Each part asks the sorted starts of the others, so no pairs are listed, however many parts a text holds.
    """
    ids = [(a, b) for k, a, b in base if k == "access"]
    weak_ids = [m.span() for m in _WEAK_ID.finditer(text)]
    if not ids and not weak_ids:
        return [], []
    taken = sorted((a, b) for _, a, b in base)
    first = [a for a, _ in taken]
    longest = 0
    ends = []
    for _, b in taken:
        longest = max(longest, b)
        ends.append(longest)

    def free(a: int, b: int) -> bool:
        i = bisect_left(first, b)
        return not i or ends[i - 1] <= a

    weak_ids = [s for s in weak_ids if free(*s)]
    strong = [(a, b) for k, a, b in base if k != "access"]
    weak = [m.span() for m in _WEAK_SECRET.finditer(text) if free(*m.span()) and _random_looking(m[0])]
    ends_ = [m.span() for m in _ENDPOINT.finditer(text) if free(*m.span())]
    breaks = [m.start() for m in _BLANK.finditer(text)]

    def scope(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_left(breaks, a), bisect_left(breaks, b)
        low, high = breaks[i - 1] if i else 0, breaks[j] if j < len(breaks) else len(text)
        return (low, high) if reach is None else (max(a - reach, low), min(b + reach, high))

    all_ids, secrets = _Intervals(ids + weak_ids), _Intervals(strong + weak)
    out: list[Span] = [("weak_id", *s) for s in weak_ids if secrets.within(*scope(*s))]
    out += [("weak_secret", *s) for s in weak if all_ids.within(*scope(*s))]
    kept_ends = [s for s in ends_ if all_ids.within(*scope(*s)) and secrets.within(*scope(*s))]
    places = _Intervals(kept_ends)
    pairs = {(a, secrets.nearest(a, *scope(a, b))) for a, b in all_ids.spans} | {(all_ids.nearest(a, *scope(a, b)), a) for a, b in secrets.spans}
    widest = {a: scope(a, b) for a, b in all_ids.spans}
    links = [(i, s, places.nearest(i, *widest[i])) for i, s in pairs if i is not None and s is not None]
    return out + [("endpoint", *s) for s in kept_ends], sorted(links, key=lambda x: x[:2])


def linked_spans(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """The spans of ``linked`` alone."""
    return linked(text, base, reach)[0]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _KIND[s[0]])))


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with each stretch that spans cover, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links (identifier>secret or
    identifier>secret>endpoint, by the places where the parts begin, comma-joined).

    A null text counts as empty. Rows are judged one by one, so null ids, repeated rows and ties need no care, and an
    empty table gives an empty one; a text of any length is scanned whole. Parts are linked over their whole paragraph.
    """

    def scanned(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for text in texts_of(batch).to_pylist():
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                more, links = linked(text, base, reach)
                joined = ",".join(">".join(str(x) for x in link if x is not None) for link in links)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), joined))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"])

    batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string")


def redact(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """The documents with every reported span masked in ``text``; null texts stay null, and n_chars, where there is such
    a column, follows the new text. All rows and columns are kept."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def masked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(found, 800):
            texts = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                spans = base + linked_spans(text, base, reach) if text else []
                texts.append(redacted(text, spans) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    batches(docs.sparkSession)
    out = docs.mapInArrow(releasing(masked), schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out
