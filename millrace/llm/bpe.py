"""Byte-level BPE by a segment tree over adjacent pair ranks.

Leaf ``i`` of the tree holds the rank of the pair that starts at piece ``i`` (and ``i``
itself, so that the minimum at the root is the leftmost pair of lowest rank). A merge
changes three leaves, each with one walk to the root, until no pair can be merged.
``_merge_many`` keeps the trees of equally long strings side by side in one array;
``merge_one`` keeps one tree and serves strings of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import documents, map_batches
from millrace.session import spread

#: Strings up to this many bytes are merged side by side, longer ones alone.
SIDE_BY_SIDE = 64
#: Strings whose ids a worker remembers; the memory starts anew when it is full.
REMEMBERED = 600_000
REMEMBERED_CHARS = 40
_NONE = 1 << 62

#: The pattern of byte-level pre-tokenization.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: The same for texts whose characters beyond ASCII are all Latin-1 letters, in the faster engine.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NOT_PLAIN = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one vocabulary file; equals the library's own on all texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.of_byte = np.array([vocab[c] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self._made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._ranks = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self._known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where there is no merge."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, pair), len(self._keys) - 1)
        return np.where(self._keys[at] == pair, self._order[at], _NONE)

    def merge_one(self, data: bytes) -> np.ndarray:
        """The ids of one string."""
        n = len(data)
        width = 1 << max(n - 1, 1).bit_length()
        ids, ranks, made = self.of_byte[np.frombuffer(data, np.uint8)], self._ranks, self._made.tolist()
        tree = np.full(2 * width, _NONE, np.int64)
        first = self._rank(ids[:-1], ids[1:])
        tree[width : width + n - 1] = np.where(first < _NONE, first * width + np.arange(n - 1), _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[level : 2 * level] = tree[2 * level : 4 * level].reshape(-1, 2).min(1)
        tree, ids = tree.tolist(), ids.tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, right: int) -> None:
            rank = ranks.get(ids[i] << 32 | ids[right]) if 0 <= i and right < n else None
            i = max(i, 0) + width if rank is None else i + width
            tree[i] = _NONE if rank is None else rank * width + i - width
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] < _NONE:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            ids[i], after[j] = made[rank], -1
            put(j, n)
            put(i, k)
            if before[i] >= 0:
                put(before[i], i)
        return np.array([x for x, a in zip(ids, after, strict=True) if a >= 0], np.int64)

    def _merge_many(self, strings: list[bytes], width: int) -> list[bytes]:
        """Ids, as bytes, of strings of 2 to ``width`` bytes (a power of two)."""
        n, rows = np.array([len(s) for s in strings]), np.arange(len(strings))
        flat = self.of_byte[np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)]
        ids = np.zeros((len(strings), width + 1), np.int64)
        ids[:, :width] = flat.reshape(-1, width)
        at = np.arange(width + 1)
        after, before = np.tile(np.minimum(at + 1, width), (len(strings), 1)), np.tile(at - 1, (len(strings), 1))
        alive = at[:width] < n[:, None]
        tree = np.full((len(strings), 2 * width), _NONE, np.int64)
        first = self._rank(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(-1, width - 1)
        first = np.where((first < _NONE) & (at[1:width] < n[:, None]), first * width + at[: width - 1], _NONE)
        tree[:, width : 2 * width - 1] = first
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def put(r: np.ndarray, i: np.ndarray, key: np.ndarray) -> None:
            i = i + width
            tree[r, i] = key
            for _ in range(width.bit_length() - 1):
                i >>= 1
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

        while len(rows := rows[tree[rows, 1] < _NONE]):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            k = after[rows, j]
            after[rows, i], before[rows, k], alive[rows, j] = k, i, False
            ids[rows, i] = self._made[root // width]
            put(rows, j, np.full(len(rows), _NONE))
            rank = self._rank(ids[rows, i], ids[rows, k])
            put(rows, i, np.where((rank < _NONE) & (k < n[rows]), rank * width + i, _NONE))
            has = before[rows, i] >= 0
            r, i = rows[has], i[has]
            p = before[r, i]
            rank = self._rank(ids[r, p], ids[r, i])
            put(r, p, np.where(rank < _NONE, rank * width + p, _NONE))
        out = ids[:, :width][alive].astype("<u4").tobytes()
        ends = 4 * np.cumsum(alive.sum(1))
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        out = {}
        for w in words:
            b = w.encode()
            if len(b) == 1:
                out[w] = self.of_byte[b[0]].astype("<u4").tobytes()
            elif len(b) > SIDE_BY_SIDE:
                out[w] = self.merge_one(b).astype("<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((w, b))
        for width, pairs in by_width.items():
            for i in range(0, len(pairs), 1 << 15):
                part = pairs[i : i + (1 << 15)]
                out |= zip((w for w, _ in part), self._merge_many([b for _, b in part], width), strict=True)
        return out

    def _pieces(self, text: str) -> list[str]:
        return (PATTERN if _NOT_PLAIN.search(text) else _PLAIN).findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list[str | int]] = []
        for text in texts:
            pieces: list[str | int] = []
            end = 0
            for m in self._special.finditer(text) if self._special else ():
                pieces += [*self._pieces(text[end : m.start()]), self.special[m[0]]]
                end = m.end()
            parts.append(pieces + self._pieces(text[end:]) if pieces else self._pieces(text[end:]))
        known = self._known
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*parts)
        special = {i: int(i).to_bytes(4, "little") for i in new if isinstance(i, int)}
        learned = self._learn(w for w in new if isinstance(w, str))
        known |= special | {w: i for w, i in learned.items() if len(w) <= REMEMBERED_CHARS}
        long = {w: i for w, i in learned.items() if len(w) > REMEMBERED_CHARS}
        if not long:
            return [b"".join([known[p] for p in pieces]) for pieces in parts]
        return [b"".join([known[p] if p in known else long[p] for p in pieces]) for pieces in parts]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@cache
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for every row.

    Special tokens in a text are recognised, none are added; nothing is cut or padded.
    Null and empty texts have no ids. ``path`` names the vocabulary on every executor.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        encoded = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
        columns = [
            batch.column(0),
            pa.array([len(e) // 4 for e in encoded], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
            pa.array([hashlib.sha256(bpe.decode(e).encode()).hexdigest() for e in encoded]),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return tokenize(spread(documents(spark, sf_dir)))
