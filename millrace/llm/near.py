"""Near-duplicates by five-word shingles: SimHash blocks, completed by MinHash bands; verified by exact Jaccard similarity of 0.8.

Candidates come from the SimHash operator's pigeonhole blocks over five-word fingerprints.
At a similarity of 0.8 two texts differ in about 10 of 64 bits, more than blocks can
promise to find, so texts also meet in MinHash bands. Every candidate is verified by the
sets of shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import kind, map_batches
from millrace.operators.graph import connected_components
from millrace.session import discard, fresh, materialize

SHINGLE = 5
#: Sets link when five times their common shingles are four times their union, or more. Whole numbers, so that 0.8 itself counts.
PART, WHOLE = 4, 5
#: A pair at 0.8 has no equal band with a probability of (1 - 0.8 ** 4) ** 32, or 5e-8.
BANDS, ROWS = 32, 4
#: Buckets up to this size are joined pair by pair; members of larger ones meet on rare shingles.
PAIRWISE = 32


def _constants(name: str) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(f"near-v1-{name}-{i}".encode()).digest()[:4] for i in range(BANDS * ROWS)), "<u4")[:, None]


MULTIPLIERS, OFFSETS = _constants("a") | np.uint32(1), _constants("b")


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles: A-Z lowered, words at ASCII blanks; fewer words are one shingle, none are the empty set."""
    words = text.lower().split()
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)] if len(words) >= size else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in shingles), np.uint64, len(shingles)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key per band of the MinHash signature."""
    least, high = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 2048):
        least = np.minimum(least, (high[None, i : i + 2048] * MULTIPLIERS + OFFSETS).min(1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x.view(np.int64) for x in values])))


def _named(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, h, text``: a row is told from others of its id by the hash of its text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("binary").alias("text"))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, fp, size, sim, bands`` for every row; equal sets have equal ``fp``; ``sim`` is the SimHash of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or b"" for t in batch.column(2)]
        sets = [shingle_set(t) for t in texts]
        sims = np.array([simhash.fingerprint(t, SHINGLE) for t in texts], np.uint64).view(np.int64)
        fps = np.array([_named(s) for s in sets], np.uint64).view(np.int64)
        size = pa.array([len(s) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), size, pa.array(sims), _lists([bands(s) for s in sets])], names=["doc_id", "h", "fp", "size", "sim", "bands"])

    return map_batches(_rows(docs, doc_id, text), run, f"doc_id {kind(docs, doc_id)}, h long, fp long, size long, sim long, bands array<long>")


def sets(rows: DataFrame) -> DataFrame:
    """``fp, hashes`` of ``doc_id, h, text``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t.as_py() or b"") for t in batch.column(2)]
        return pa.RecordBatch.from_arrays([pa.array(np.array([_named(s) for s in found], np.uint64).view(np.int64)), _lists(found)], names=["fp", "hashes"])

    return map_batches(rows, run, "fp long, hashes array<long>")


def _sized(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return WHOLE * F.least(a, b) >= PART * F.greatest(a, b)


def _enough(common: Column, a: Column, b: Column) -> Column:
    return (PART + WHOLE) * common >= PART * (a + b)


def _verified(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose sets are similar enough."""
    left, right = (hashed.select(F.col("fp").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    common = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(_enough(common, F.size("ha"), F.size("hb"))).select("a", "b")


def _by_rare_shingles(hashed: DataFrame) -> DataFrame:
    """``a, b``: a superset of the similar pairs of unlike ``c``, by prefixes of the sets (``fp, c, hashes``), rarest shingles first.

    In any one order of all shingles, sets similar enough share one among the first fifth
    of each, and one more; at the first that they share, what is left of both must suffice.
    Shingles of a single component come first: no pair asked for shares one.
    """
    shingles = hashed.select("fp", "c", F.size("hashes").cast("long").alias("size"), F.explode("hashes").alias("s"))
    counts = shingles.groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s", "n")
    own = Window.partitionBy("fp")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "s")) - 1
    prefix = shingles.join(counts, "s").withColumn("i", place).where(F.expr(f"i <= size - (size * {PART} + {WHOLE - 1}) div {WHOLE}"))
    prefix = materialize(prefix.select("s", "fp", "c", "size", "i"), "prefixes")
    left, right = (prefix.select("s", F.col("fp").alias(x), F.col("c").alias(f"c{x}"), F.col("size").alias(f"n{x}"), F.col("i").alias(f"i{x}")) for x in "ab")
    reach = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    met = left.join(right, "s").where("a < b and ca <> cb").where(_enough(reach, F.col("na"), F.col("nb"))).where(_sized(F.col("na"), F.col("nb")))
    return met.select("a", "b").distinct()


def _by_blocks(nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes (``fp, size, sim``) whose SimHashes are equal or linked by blocks, each by the least of its SimHash."""
    first = nodes.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("f"))
    equal = nodes.join(first, "sim").where("fp <> f.fp").select(F.least("fp", "f.fp").alias("a"), F.greatest("fp", "f.fp").alias("b"))
    one, other = (first.select(F.col("sim").alias(x), F.col("f.fp").alias(f"f{x}")) for x in "ab")
    linked = simhash.links(first.select(F.col("sim").alias("fp"))).join(one, "a").join(other, "b")
    return equal.unionAll(linked.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))).distinct()


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], pairwise: int = PAIRWISE) -> DataFrame:
    """``a, b``: verified links that join the same components as all similar pairs of close SimHashes or equal bands.

    ``nodes`` has distinct ``fp, size, sim, bands``; ``sets_of`` gives ``fp, hashes`` for
    a table of ``fp``. Nodes that share blocks are verified. In a bucket of a band of up to ``pairwise`` nodes all pairs are verified. In a
    larger one, each node is compared with the one that is in most such buckets, which is
    what a group of copies was made from, if anything; nodes that are still apart then
    meet by prefixes of their sets, which lose no similar pair. No bucket is cut.
    """
    keyed = nodes.select("fp", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, "key"), "members")
    blocks = materialize(_by_blocks(nodes.select("fp", "size", "sim")), "blocks")
    wanted = members.select("fp").unionAll(blocks.select("a")).unionAll(blocks.select("b"))
    hashed = materialize(sets_of(wanted.distinct()), "sets")
    small, large = members.where(F.col("n") <= pairwise), members.where(F.col("n") > pairwise)
    one, other = (small.select("key", F.col("fp").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
    pairs = one.join(other, "key").where("a < b").where(_sized(F.col("na"), F.col("nb"))).select("a", "b")
    often = large.groupBy("fp").agg(F.count("*").alias("often"))
    lead = large.join(often, "fp").groupBy("key").agg(F.max(F.struct("often", "fp", "size")).alias("l"))
    stars = large.join(lead, "key").where(F.col("fp") != F.col("l.fp")).where(_sized(F.col("size"), F.col("l.size")))
    stars = stars.select(F.least("fp", "l.fp").alias("a"), F.greatest("fp", "l.fp").alias("b"))
    found = materialize(_verified(pairs.unionAll(stars).unionAll(blocks).distinct(), hashed), "links")
    if large.limit(1).count():
        component = connected_components(found).withColumnRenamed("node", "fp")
        placed = materialize(large.select("key", "fp").join(component, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c")), "placed")
        mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        apart = placed.join(mixed, "key", "left_semi").select("fp", "c").distinct()
        found = found.unionAll(materialize(_verified(_by_rare_shingles(hashed.join(apart, "fp")), hashed), "links"))
    discard(members)
    discard(blocks)
    return found


def _order(doc_id: Column, h: Column) -> Column:
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), h.alias("h"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairwise: int = PAIRWISE) -> DataFrame:
    """``doc_id, h, fp, component`` for every row: texts of similar sets, directly or over others, share a component."""
    own = materialize(sketches(docs, doc_id, text), "sketches")
    first = own.groupBy("fp").agg(F.min(_order(F.col("doc_id"), F.col("h"))).alias("first"))

    def sets_of(fps: DataFrame) -> DataFrame:
        wanted = first.join(fps, "fp").select(F.col("first.doc_id").alias("d"), F.col("first.h").alias("k"))
        rows = _rows(docs, doc_id, text)
        return sets(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left_semi")).dropDuplicates(["fp"])

    graph = connected_components(links(own.select("fp", "size", "sim", "bands").dropDuplicates(["fp"]).where("size > 0"), sets_of, pairwise))
    by_fp = first.select("fp").join(graph.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return own.select("doc_id", "h", "fp").join(by_fp, "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairwise: int = PAIRWISE) -> DataFrame:
    """One row of each component: that of smallest id, null ids last, then by text; columns unchanged."""
    d, h, k, nth = fresh(docs.columns, "least_id", "least_hash", "text_hash", "nth")
    least = components(docs, doc_id, text, pairwise).groupBy("component").agg(F.min(_order(F.col("doc_id"), F.col("h"))).alias("m"))
    chosen = least.select(F.col("m.doc_id").alias(d), F.col("m.h").alias(h))
    rows = docs.withColumn(k, F.xxhash64(F.col(text)))
    kept = rows.join(chosen, F.col(doc_id).eqNullSafe(F.col(d)) & (F.col(k) == F.col(h)), "left_semi")
    # By the join's own keys, so that texts aren't dealt a second time; rows of one key are copies.
    first = F.row_number().over(Window.partitionBy(doc_id, k).orderBy(F.lit(0)))
    return kept.withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns)
