"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verified distance."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, kind, map_batches
from millrace.operators.graph import connected_components
from millrace.session import discard, fresh, materialize, spread

SHINGLE = 3
SEED = 42
BITS = 64
#: Fingerprints this many bits apart, or fewer, link.
DISTANCE = 2
#: Blocks of a fingerprint. Two bits spoil two blocks at most, so a close pair agrees on three of the five: ten keys of about 38 bits.
BLOCKS = 5
#: Buckets up to this size are joined pair by pair; larger ones meet on variants with bits flipped.
PAIRWISE = 16
#: Variants of a fingerprint in one bucket that are accepted; wider distances need more blocks.
VARIANTS = 4096


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: A-Z lowered, words, ``size``-word shingles."""
    words = text.lower().split()  # of bytes: lowers A-Z, and splits at the six ASCII blanks
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)] if len(words) >= size else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bits of a bounded number of hashes at a time
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row; null texts have no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py() or b"", size) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), run, f"doc_id {kind(docs, doc_id)}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(blocks: int) -> list[int]:
    """Masks of the blocks, whose sizes differ by one bit at most."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within ``distance``.

    ``fps`` has distinct fingerprints ``fp``. Each goes under one key for every choice of
    ``blocks - distance`` blocks; a close pair shares such a key. Keys that a single
    fingerprint has are gone after a combinable count. Fingerprints of a small bucket are
    joined with each other and their distance is verified. In a larger bucket no pairs
    are formed: of two fingerprints at most ``distance`` bits apart, one with half of
    those bits flipped (rounded up) is the other with the rest flipped, all in the blocks
    outside the key. So each goes under all its variants of that many flips; those that
    reach a variant with the lesser number too are close to all that reach it, and every
    one hangs on the least of those, which again is verified. That takes one row per
    member and variant, whatever the size of the bucket, and joins the same components.
    """
    if not 0 < distance < blocks:
        raise ValueError("a key takes one block at least")
    masks, far, close = _blocks(blocks), (distance + 1) // 2, distance // 2
    kept = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    free = [[b for b in range(BITS) if not m >> b & 1] for m in kept]
    if max(sum(comb(len(bits), f) for f in range(far + 1)) for bits in free) > VARIANTS:
        raise ValueError(f"distance {distance} with {blocks} blocks needs more than {VARIANTS} variants of a fingerprint")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(kept)])
    keyed = fps.select("fp", F.inline(keys))
    shared = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, ["k", "key"]), "members")
    small = members.where(F.col("n") <= pairwise).select("k", "key", "fp")
    other = small.withColumnRenamed("fp", "b")
    pairs = small.withColumnRenamed("fp", "a").join(other, ["k", "key"]).where("a < b").where(_near(F.col("a"), F.col("b"), distance)).select("a", "b")
    flips = [(k, f, _signed(sum(1 << b for b in c))) for k, bits in enumerate(free) for f in range(far + 1) for c in combinations(bits, f)]
    flips = members.sparkSession.createDataFrame(flips, "k int, flips int, flip long")  # at most VARIANTS a key
    variants = members.where(F.col("n") > pairwise).select("k", "fp").join(F.broadcast(flips), "k").select("k", "fp", "flips", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    least = variants.groupBy("k", "v").agg(F.min(F.when(F.col("flips") <= close, F.col("fp"))).alias("b"), F.count("*").alias("n")).where("n > 1 and b is not null").select("k", "v", "b")
    stars = variants.join(least, ["k", "v"]).where("fp <> b").where(_near(F.col("fp"), F.col("b"), distance)).select(F.col("fp").alias("a"), "b")
    found = materialize(pairs.unionAll(stars).distinct(), "links")
    discard(members)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``; ids of any type that has an order.

    The component is the smallest id reachable over links, the document itself included;
    texts with equal fingerprints (copies, and all texts without words) are one node, so
    copies are never paired. ``fingerprint`` has 16 lower-case hex digits. Null ids are
    never a smallest id; a component without any id has a null one. An empty table gives an empty table. Only narrow rows are
    shuffled, never texts.
    """
    fps = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    graph = connected_components(links(nodes.select("fp")))
    grouped = nodes.join(graph.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    smallest = grouped.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(smallest, "c").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one whose id names it; columns unchanged.

    Rows that repeat an id are copies of one another: the first by text stays. Rows
    without an id can't be told apart by it and stay.
    """
    keep, nth = fresh(docs.columns, "keep", "nth")
    found = near_duplicates(docs, doc_id, text).where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    with_id = docs.where(F.col(doc_id).isNotNull())
    kept = with_id.join(found, F.col(doc_id) == F.col(keep), "left_semi")
    # By the join's own key, so that texts aren't dealt a second time.
    first = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(F.col(text)), F.col(text)))
    kept = kept.withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spread(documents(spark, sf_dir)))
