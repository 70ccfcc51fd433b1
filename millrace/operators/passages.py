"""Passages that texts share with a set of items: n-word grams, found by hash, joined by their words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import bound_batches

WORD = re.compile("[a-z0-9]+")
#: Grams of all items up to which their hashes (8 bytes each) go to every worker; beyond, all grams of texts are dealt.
KNOWN = 4_000_000


#: Words whose hashes a worker remembers; the memory starts anew when it is full.
REMEMBERED = 500_000
_HASHES: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashes(w: list[str], n: int) -> np.ndarray:
    """A 64-bit hash of each ``n``-word gram: a polynomial in the words' hashes."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    _HASHES.update((x, xxhash.xxh64_intdigest(x)) for x in set(w) if x not in _HASHES)
    h = np.array([_HASHES[x] for x in w], np.uint64)
    out, many = np.zeros(len(w) - n + 1, np.uint64), len(w) - n + 1
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + many]
    return out


def grams(text: str | None, n: int) -> list[str]:
    """Distinct ``n``-word grams of a text's lower-case words; a shorter text has none."""
    w = words(text)
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the hashes that are in a sorted array; only they are looked up, the array is not sorted anew."""
    if not len(known):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)


def _all_grams(rows: DataFrame, row_id: str, text: str, n: int, known=None) -> DataFrame:
    """``row_id, gram, h``: distinct grams with their hash; with ``known`` (a broadcast sorted array) those whose hash is in it."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, of = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = words(t)
                h = hashes(w, n)
                places = np.arange(len(h)) if known is None else _among(h, known.value)
                found = {" ".join(w[k : k + n]): h[k] for k in places.tolist()}
                at += [i] * len(found)
                out += found.keys()
                of += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(np.array(of, np.uint64).view(np.int64))], names=[row_id, "gram", "h"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, text).mapInArrow(run, f"{row_id} {kind}, gram string, h long")


def shared_passages(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", n: int = 13, most_known: int = KNOWN) -> DataFrame:
    """``item_id, doc_id, n_shared``: grams that an item and a document have in common.

    A hash only sorts out what can't match; grams meet by their words. Null and short
    texts share nothing. With few items' grams their hashes filter the documents where
    they are read, and only what may match is dealt.
    """
    theirs = _all_grams(items, item_id, text, n)
    spark, known = docs.sparkSession, None
    wanted = theirs.select("h").distinct().limit(most_known + 1).toPandas()["h"].to_numpy(np.int64)
    if len(wanted) <= most_known:
        known = spark.sparkContext.broadcast(np.unique(wanted.view(np.uint64)))
    mine = _all_grams(docs, doc_id, text, n, known)
    return mine.drop("h").join(theirs.drop("h"), "gram").groupBy(item_id, doc_id).agg(F.count("*").alias("n_shared"))
