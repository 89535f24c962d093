"""Secret scan: fixed patterns, and sliding windows of high Shannon entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and the least lengths of what they must catch.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Bits per character that a window of each class must reach. A random window of 20
# has about 3.4 bits in base 16 and 4.1 in base 64.
THRESHOLDS = {"hex": 3.0, "base36": 3.6, "base64": 3.8}
# Candidates that are never secrets, whatever their entropy.
ALLOWED = (
    re.compile(r"(?i).*(example|placeholder|changeme|dummy|sample|xxxx).*"),
    re.compile(r"[0-9_=+/-]+"),
    re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/=]*"),
    re.compile(r"([A-Za-z]+|[0-9]{1,8})([-_/+=]+([A-Za-z]+|[0-9]{1,8}))*[-_/+=]*"),
    re.compile(r"(.{1,6})\1{2,}.{0,5}"),
)
_HAS_DIGIT = re.compile(r"[0-9]")
_HAS_LETTER = re.compile(r"[A-Za-z]")
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_ONE_CASE = re.compile(r"[0-9a-z]+|[0-9A-Z]+")
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def character_class(candidate: str) -> str:
    if _HEX_ONLY.fullmatch(candidate):
        return "hex"
    return "base36" if _ONE_CASE.fullmatch(candidate) else "base64"


def allowed(candidate: str) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED)


def high_entropy_range(candidate: str, threshold: float, window: int = WINDOW) -> tuple[int, int] | None:
    """From the start of the first to the end of the last window at or above the threshold.

    The window's counts change by one character in and one out, and with them the sum of n log n, so
    a step costs the same whatever the window's length.
    """
    counts: dict[str, int] = {}
    total, first, last = 0.0, -1, -1
    scale = math.log2(window)
    for at, char in enumerate(candidate):
        held = counts.get(char, 0)
        total += _TERM[held + 1] - _TERM[held]
        counts[char] = held + 1
        if at >= window:
            gone = candidate[at - window]
            held = counts[gone]
            total += _TERM[held - 1] - _TERM[held]
            counts[gone] = held - 1
        if at >= window - 1 and scale - total / window >= threshold:
            first = at - window + 1 if first < 0 else first
            last = at + 1
    return None if first < 0 else (first, last)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of candidates with a window of high entropy that no base span touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        if not (_HAS_DIGIT.search(candidate) and _HAS_LETTER.search(candidate)) or allowed(candidate):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        span = high_entropy_range(candidate, THRESHOLDS[character_class(candidate)])
        if span:
            found.append((m.start() + span[0], 3, m.start() + span[1]))
    return found


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if spans else text


REPORT = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, "
          "base_sha256 string, spans string")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, spans = scan(text.as_py() or "")
            kinds = [k for _, k, _ in spans]
            rows.append((*(kinds.count(k) for k in range(4)),
                         hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]),
             *(pa.array(c, pa.string()) for c in columns[4:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans of every row's whole text.

    Null and empty texts have no spans; repeated rows and null ids are scanned like any other; an
    empty table gives an empty result. Only the two named columns are read.
    """
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(_report, REPORT)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret in the text replaced; null texts stay null."""
    at = docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([None if v is None else redacted(v, scan(v)[1], mark)
                               for v in (x.as_py() for x in batch.column(at))], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(rewrite, docs.schema)
