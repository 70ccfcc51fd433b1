"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

The allow-list silences the windows over what it matches, not the candidate around it.
Strings of letters alone are no candidates.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import documents, kind, map_batches, replace

#: Kinds in the order that ties of a start are listed in.
KINDS = ("assign", "access", "hex", "entropy")
_FLAGS = re.ASCII  # or else (?i:s) and (?i:k) also match two letters outside ASCII
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Width of the sliding window, and bits of entropy per character above which it is suspect, by class of characters.
WINDOW = 20
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.1), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.85))
#: Strings that look random and are no secret.
ALLOWED = re.compile(r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|x{6,}|0123456789|1234567890|abcdefghij|deadbeef|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
#: c * log2(c) of the counts a window can have, and of one more while it moves on.
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def hot_windows(s: str, threshold: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged stretches of ``s`` whose windows have more entropy than ``threshold``.

    A window's entropy is ``log2(w) - sum(c log2 c) / w``. Moving on by one character
    changes two counts, so each step adjusts the sum instead of counting anew.
    """
    if len(s) < width:
        return []
    most = (math.log2(width) - threshold) * width  # the sum of c log2 c must stay below
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOGC[c + 1] - _CLOGC[c]
        if i >= width:
            old = s[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += _CLOGC[c - 1] - _CLOGC[c]
        if i >= width - 1 and total < most - 1e-9:
            if out and out[-1][1] >= i - width + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - width + 1, i + 1))
    return out


def _quiet(s: str) -> list[tuple[int, int]]:
    """Stretches of ``s`` that the allow-list covers: each match, with the letters and digits that it is part of."""
    out = []
    for m in ALLOWED.finditer(s):
        a, b = m.span()
        while a and s[a - 1].isalnum():
            a -= 1
        while b < len(s) and s[b].isalnum():
            b += 1
        out.append((a, b))
    return out


def _audible(s: str) -> list[tuple[int, str]]:
    """What the allow-list leaves of a candidate, and where: no window lies over an allowed stretch."""
    out, at = [], 0
    for a, b in [*_merged(_quiet(s)), (len(s), len(s))]:
        if a - at >= WINDOW:
            out.append((at, s[at:a]))
        at = b
    return out


def _mixed(s: str) -> bool:
    """Keys mix letters and digits; a string of letters alone is never a candidate, as words and paths are."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of a text, by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for m in CANDIDATE.finditer(text):
        s, at = m[0], m.start()
        found += [(at + h.start(), 2, at + h.end()) for h in HEX.finditer(s)]
        if not _mixed(s):
            continue
        spans: list[tuple[int, int]] = []
        for part, piece in _audible(s):
            for _, pattern, threshold in CLASSES:
                for run in pattern.finditer(piece):
                    spans += [(part + run.start() + a, part + run.start() + b) for a, b in hot_windows(run[0], threshold) if _mixed(run[0][a:b])]
        for a, b in _merged(spans):
            found.append((at + a, 3, at + b))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch that spans cover replaced by a mark."""
    for a, b in reversed(_merged([(a, b) for a, b, _ in spans])):
        text = f"{text[:a]}[secret]{text[b:]}"
    return text


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts by kind, the base spans' hash and all spans, for every row.

    Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows
    don't depend on one another; repeated rows give repeated results.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t.as_py() or "") for t in batch.column(1)]
        base = [[x for x in r if x[2] != "entropy"] for r in rows]
        count = lambda kind: pa.array([sum(x[2] == kind for x in r) for r in rows], pa.int64())
        digests = pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base])
        columns = [batch.column(0), *map(count, KINDS), digests, pa.array([_joined(r) for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id {kind(docs, doc_id)}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with found secrets replaced by a mark; nulls stay null, other columns as they were."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [t if t is None else redacted(t, scan(t)) for t in batch.column(text).to_pylist()]
        return replace(batch, **{text: pa.array(clean, pa.string())})

    return map_batches(docs, run, docs.schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find(documents(spark, sf_dir))
