"""Document fingerprints from prefix polynomial hashes.

``H[i]`` is the sum of ``code[j] * base**j`` over ``j < i``, modulo a prime. The hash of
any span is a difference of two entries, moved to power 0 by an inverse power, so spans
are compared in constant time, and the longest common extension of two places is found by
binary search. A fingerprint keeps the least hashes of a text's windows; the likeness of
two fingerprints estimates the share of windows that the texts have in common.

Prefix arrays are made block by block, each from power 0, with the whole prefix's hash at
each block's start: tables of powers have a fixed size, and a text of any length needs its
code points (4 bytes each) and one block's arrays at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, kind
from millrace.session import bound_batches, materialize

PRIME = (1 << 31) - 1
#: A base for each of the two hashes that make up 62 bits.
BASES = (911_382_323, 972_663_749)
#: Code points of a window, least hashes that a fingerprint keeps, bytes of each.
WINDOW, KEPT, BYTES = 16, 48, 5
#: Windows of a block.
BLOCK = 1 << 16


_P, _SHIFT = np.uint64(PRIME), np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """x, below 2**64, brought below 2**31 + 8 in place, equal modulo the Mersenne prime."""
    for _ in range(2):
        high = x >> _SHIFT
        x &= _P
        x += high
    return x


def _mod(x: np.ndarray) -> np.ndarray:
    """x, below 2**64, modulo the prime, in place."""
    _fold(x)
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def _powers(base: int) -> np.ndarray:
    """The first powers of a base, as many as a block needs."""
    table = np.ones(1, np.uint64)
    while len(table) < BLOCK + WINDOW:
        table = np.concatenate([table, _mod(table * np.uint64(pow(base, len(table), PRIME)))])
    return table


_POWERS = [(_powers(b), _powers(pow(b, -1, PRIME))) for b in BASES]


class PrefixHashes:
    """Prefix arrays of a text's code points."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.n = len(self.codes)
        self.starts = [(0, 0)]  # hashes of the whole prefix at the starts of the blocks seen so far
        self._held: tuple[int, list[np.ndarray]] = (-1, [])

    def _block(self, b: int) -> list[np.ndarray]:
        """Prefix sums, one per base, from a block's start over it and the windows that begin in it."""
        if self._held[0] == b:
            return self._held[1]
        part = self.codes[b * BLOCK : (b + 1) * BLOCK + WINDOW - 1].astype(np.uint64)
        part += np.uint64(1)
        out = []
        for powers, _ in _POWERS:
            terms = part * powers[: len(part)]  # below 2**52
            high = terms >> _SHIFT
            terms &= _P
            terms += high  # below 2**32: sums of 2**32 of them fit
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(terms, out=sums[1:])
            out.append(sums)
        if b == len(self.starts) - 1 and self.n > (b + 1) * BLOCK:
            self.starts.append(tuple((x + pow(base, b * BLOCK, PRIME) * int(s[BLOCK])) % PRIME for x, base, s in zip(self.starts[b], BASES, out, strict=True)))
        self._held = b, out
        return out

    def prefix(self, i: int) -> tuple[int, ...]:
        """``H[i]`` for each base."""
        b = min(i, max(self.n - 1, 0)) // BLOCK
        while len(self.starts) <= b:
            self._block(len(self.starts) - 1)
        sums = self._block(b)
        if not b:
            return tuple(int(s[i]) % PRIME for s in sums)
        return tuple((x + pow(base, b * BLOCK, PRIME) * int(s[i - b * BLOCK])) % PRIME for x, base, s in zip(self.starts[b], BASES, sums, strict=True))

    def span(self, start: int, length: int) -> int:
        """The 62-bit hash of one span."""
        out = 0
        for low, high, base in zip(self.prefix(start), self.prefix(start + length), BASES, strict=True):
            out = out << 31 | (high - low) * (pow(base, -start, PRIME) if start else 1) % PRIME
        return out

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """Whether two spans are equal, but for a chance of about length / 2**62."""
        return self.span(start, length) == other.span(at, length)

    def extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """How far the texts agree from two places on; block by block, then by binary search in the first that differs."""
        done, left = 0, min(self.n - start, other.n - at)
        while left - done > BLOCK and self.equal(start + done, other, at + done, BLOCK):
            done += BLOCK
        low, high = 0, min(left - done, BLOCK)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start + done, other, at + done, middle) else (low, middle - 1)
        return done + low

    def count(self) -> int:
        """Windows of the text; a shorter text is one window, an empty one has none."""
        return max(self.n - WINDOW + 1, min(self.n, 1))

    def windows(self, b: int = 0) -> np.ndarray:
        """Mixed hashes of the windows that begin in a block."""
        k, here = min(WINDOW, self.n), min(self.count() - b * BLOCK, BLOCK)
        if here <= 0:
            return np.zeros(0, np.uint64)
        halves = []
        for sums, (_, inverse) in zip(self._block(b), _POWERS, strict=True):
            span = _fold(sums[k : k + here] - sums[:here])
            span *= inverse[:here]
            halves.append(_mod(span))
        first, second = halves
        first <<= _SHIFT
        first |= second
        return _mixed(first)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads hashes over the digits that fingerprints keep, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x >>= np.uint64(64 - 8 * BYTES)
    return x


def least(parts: list[np.ndarray], kept: int = KEPT) -> np.ndarray:
    """The ``kept`` least distinct hashes of all parts, sorted."""
    n = sum(map(len, parts))
    bound = 8 * kept
    while bound < n:
        limit = np.uint64((1 << 8 * BYTES) * bound // n)
        found = np.unique(np.concatenate([p[p < limit] for p in parts]))
        if len(found) >= kept:
            return found[:kept]
        bound *= 8
    return np.unique(np.concatenate(parts))[:kept] if parts else np.zeros(0, np.uint64)


def written(hashes: np.ndarray) -> bytes:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of windows in common, 0 to 1; texts without a window are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # The least hashes of the union are a fair sample of it; beyond the longer list's reach nothing is known of it.
    first, second = set(a.tolist()), set(b.tolist())
    union = sorted(first | second)[: max(len(a), len(b))]
    both = sum(h in first and h in second for h in union)
    return 2 * both / (len(union) + both)


class _Document:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.n = doc_id, text, len(text)
        self.prefix = PrefixHashes(text)
        # The least of every full block; the last, which may be cut anywhere, is kept if it is the only one.
        blocks = -(-self.prefix.count() // BLOCK)
        self.tops, self.only = [], None
        for b in range(blocks):
            found = self.prefix.windows(b)
            self.tops.append(least([found]))
            self.only = found if blocks == 1 else None
        self.least = least(self.tops)

    def first(self, windows: int) -> list[np.ndarray]:
        """Hashes with the least of the first so many windows among them."""
        full, rest = divmod(windows, BLOCK)
        part = [] if not rest else [(self.prefix.windows(full) if self.only is None else self.only)[:rest]]
        return self.tops[:full] + part

    def against(self, after: _Document) -> tuple:
        """The row of this document, given the next."""
        head = self.n - self.n // 2
        tail = min(self.n // 2, after.n)
        edited = self.text[:head] + after.text[:tail]
        if len(edited) < WINDOW or head < WINDOW or tail < WINDOW:
            parts = _Document(None, edited).tops
        else:
            # Its windows lie in the kept part, in the new part, or across the seam.
            seam = PrefixHashes(self.text[head - WINDOW + 1 : head] + after.text[: WINDOW - 1]).windows()
            parts = [*self.first(head - WINDOW + 1), *after.first(tail - WINDOW + 1), seam]
        found = least(parts)
        return (
            self.doc_id, self.n, hashlib.sha256(edited.encode()).hexdigest(), written(self.least), written(found),
            likeness(self.least, found), likeness(self.least, after.least), self.prefix.extension(0, after.prefix, 0),
        )


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix")
TYPES = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64())


def _consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``part, doc_id, text`` in order: results of all but the last, and the texts of the first and last (``edge`` 0 and 1)."""
    out, last, part, kinds = [], None, None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.string(), kinds, *TYPES]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "edge", "text", *COLUMNS])

    def edge(which: int, doc: _Document) -> tuple:
        return part, which, doc.text, doc.doc_id, *[None] * len(TYPES)

    for batch in batches:
        kinds = batch.schema.field("doc_id").type
        for part, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("part", "doc_id", "text")), strict=True):
            doc = _Document(doc_id, text or "")
            out.append(edge(0, doc) if last is None else (part, None, None, *last.against(doc)))
            last = doc
            if len(out) >= 256:
                yield batch_of(out)
                out = []
    if last is not None:
        yield batch_of([*out, edge(1, last)])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_Document(i, t).against(_Document(None, n)) for i, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field("doc_id").type, *TYPES), strict=True)], names=list(COLUMNS))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """``COLUMNS`` for every row, each against the next row by id.

    Order is by id (nulls first, ids of any type), then by the text's hash: rows that
    repeat an id are neighbours, equal ones next to each other. After the last row comes
    the first, which is itself where there is one row. Null texts are empty; an empty
    text has an empty fingerprint. Texts are dealt once, by range of (id, hash, place in
    the input), so no id and no text fills a task; a task keeps two texts at a time. The
    first and the last text of a range are written beside its results, and the last of
    each range is then compared with the first of the next.
    """
    bound_batches(docs.sparkSession)
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    dealt = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    results = f"doc_id {kind(docs, doc_id)}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_prefix long"
    done = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_consecutive, f"part int, edge int, text string, {results}")
    done = materialize(done, "fingerprints")
    first, last = (done.where(F.col("edge") == i).select("part", "doc_id", "text") for i in (0, 1))
    # One number per range: which range comes next, the first after the last.
    parts = done.where("edge = 0").select("part")
    then = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    follow = parts.select("part", then.alias("then"))
    seams = last.join(follow, "part").join(first.select(F.col("part").alias("then"), F.col("text").alias("after")), "then").select("doc_id", "text", "after").mapInArrow(_paired, results)
    both = done.where("edge is null").select(*COLUMNS).unionAll(seams)
    as_hex = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return both.withColumns(as_hex)


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, sf_dir))
