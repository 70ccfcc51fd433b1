"""Near-duplicates by MinHash and bands, verified by exact Jaccard similarity."""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import TOKEN
from millrace.operators.graph import connected_components
from millrace.session import bound_batches, discard, fresh, materialize

SHINGLE, THRESHOLD = 5, 0.8
PERMUTATIONS, ROWS = 128, 4
PRIME = (1 << 61) - 1
#: Members of a band's bucket that are compared pair by pair; those of larger ones meet on rare shingles.
PAIRWISE = 64
_TOKEN = re.compile(TOKEN.replace(r"\x{4e00}-\x{9fff}", "一-鿿"))


def permutations(n: int = PERMUTATIONS, seed: str = "minhash") -> list[tuple[int, int]]:
    """Multipliers and offsets below the prime: successive 61-bit numbers of one extendable hash."""
    stream = np.frombuffer(hashlib.shake_128(seed.encode()).digest(16 * n), "<u8") >> np.uint64(3)
    return [(int(a) | 1, int(b)) for a, b in stream.reshape(n, 2) % np.uint64(PRIME)]


_P, _61 = np.uint64(PRIME), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1: the high bits are added to the low ones; of what is left and that less the prime, the lesser is right, as a negative number wraps."""
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)


def _mulmod(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo 2**61 - 1 of numbers below it, in 64-bit words: halves, then folding."""
    b = np.asarray(b, dtype=np.uint64)
    half, low = np.uint64(31), np.uint64(0x7FFFFFFF)
    lo, hi, bl, bh = a & low, a >> half, b & low, b >> half
    mid = lo * bh + hi * bl  # below 2**62
    out = (hi * bh << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half)  # below 2**63
    x = lo * bl
    return _reduced((out & _P) + (out >> _61) + (x & _P) + (x >> _61))


def signature(hashes: np.ndarray, perms: list[tuple[int, int]]) -> np.ndarray:
    """Minimum of ``(a * h + b) mod p`` over the hashes, for each permutation."""
    a, b = (np.array(x, dtype=np.uint64)[:, None] for x in zip(*perms, strict=True))
    least = np.full(len(perms), PRIME, np.uint64)
    for i in range(0, len(hashes), 256):  # all permutations of some hashes at a time, within a processor's cache
        out = _mulmod(_reduced(hashes[None, i : i + 256]), a) + b
        least = np.minimum(least, np.minimum(out, out - _P).min(1))
    return least


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-token shingles; fewer tokens are one shingle, none is ``<empty>``."""
    t = _TOKEN.findall(text.lower())
    grams = [" ".join(x) for x in zip(*(t[i:] for i in range(size)), strict=False)] if len(t) >= size else [" ".join(t) or "<empty>"]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g.encode(), 42) for g in grams), np.uint64, len(grams)))


def bands(hashes: np.ndarray, perms: list[tuple[int, int]]) -> list[int]:
    """A key per band of ``ROWS`` rows of the signature, with the band's number in it."""
    s = signature(hashes, perms)
    return [xxhash.xxh64_intdigest(s[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(perms), ROWS)]


def classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text", *also: str) -> DataFrame:
    """``doc_id, *also, node, hashes, bands``: rows with the same set of shingles share a node, the least id.

    Texts become hashes in one pass over Arrow batches; nulls are empty texts.
    """
    bound_batches(docs.sparkSession)
    perms, names = permutations(), ["doc_id", *also]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t or "") for t in batch.column("text").to_pylist()]
            keys = [hashlib.sha256(h.tobytes()).hexdigest() for h in found]
            lists = [pa.array([h.view(np.int64).tolist() for h in found], pa.list_(pa.int64())), pa.array([bands(h, perms) for h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(keys), *lists], names=[*names, "key", "hashes", "bands"])

    schema = ", ".join([f"doc_id {types[row_id]}", *[f"{c} {types[c]}" for c in also], "key string, hashes array<long>, bands array<long>"])
    rows = docs.select(F.col(row_id).alias("doc_id"), *also, F.col(text).alias("text"))
    keyed = materialize(rows.mapInArrow(run, schema), "shingles")
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("node"))
    return keyed.join(least, "key").select("doc_id", *also, "node", "hashes", "bands")


def _share(threshold: float) -> tuple[int, int]:
    """The threshold as whole numbers, so that it counts itself."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def _enough(common: Column, a: Column, b: Column, threshold: float) -> Column:
    part, whole = _share(threshold)
    return (part + whole) * common >= part * (a + b)


def _sized(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    part, whole = _share(threshold)
    return whole * F.least(a, b) >= part * F.greatest(a, b)


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, common, na, nb`` of the pairs whose shingle sets are similar enough."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    sizes = [F.size("ha").alias("na"), F.size("hb").alias("nb")]
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("common"), *sizes)
    return both.where(_enough(F.col("common"), F.col("na"), F.col("nb"), threshold))


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, size, n``: nodes in buckets that they share with others, ``n`` in all."""
    keyed = nodes.select("node", F.size("hashes").alias("size"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(keyed.join(shared, "key"), "buckets")


def _in_small(members: DataFrame, pairwise: int, threshold: float) -> DataFrame:
    small = members.where(F.col("n") <= pairwise)
    one, other = (small.select("key", F.col("node").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
    return one.join(other, "key").where("a < b").where(_sized(F.col("na"), F.col("nb"), threshold)).select("a", "b").distinct()


def by_rare_shingles(nodes: DataFrame, threshold: float, apart: str | None = None) -> DataFrame:
    """``a, b``: a superset of the similar pairs of ``nodes`` (``node, hashes``), by prefixes of their sets, rarest shingles first.

    In any one order of all shingles, sets similar enough share one among the first few of
    each (all but the share that must be common, and one more); at that one what is left
    of both must suffice. With ``apart`` (a column of ``nodes``) only pairs that differ in
    it are asked for, and shingles that have one value of it are passed over.
    """
    part, whole = _share(threshold)
    group = F.col(apart) if apart else F.col("node")
    shingles = nodes.select("node", group.alias("c"), F.size("hashes").cast("long").alias("size"), F.explode("hashes").alias("s"))
    counts = shingles.groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s", "n")
    own = Window.partitionBy("node")
    # Shingles that no two share come first, and are not listed.
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "s")) - 1
    prefix = shingles.join(counts, "s").withColumn("i", place).where(F.expr(f"i <= size - (size * {part} + {whole - 1}) div {whole}"))
    prefix = materialize(prefix.select("s", "node", "c", "size", "i"), "prefixes")
    left, right = (prefix.select("s", F.col("node").alias(x), F.col("c").alias(f"c{x}"), F.col("size").alias(f"n{x}"), F.col("i").alias(f"i{x}")) for x in "ab")
    reach = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    met = left.join(right, "s").where("a < b and ca <> cb").where(_enough(reach, F.col("na"), F.col("nb"), threshold)).where(_sized(F.col("na"), F.col("nb"), threshold))
    return met.select("a", "b").distinct()


def links(nodes: DataFrame, threshold: float = THRESHOLD, pairwise: int = PAIRWISE) -> DataFrame:
    """``a, b``: verified links that join the same components as all similar pairs of equal bands.

    Nodes (``node, hashes, bands``) meet in buckets of equal bands. In a bucket of up to
    ``pairwise`` nodes all pairs are verified. In a larger one each is compared with the
    one that is in most such buckets, which is what copies were made from, if anything;
    nodes still apart then meet by prefixes of their sets, which lose no similar pair.
    """
    nodes = materialize(nodes, "nodes")
    members = _buckets(nodes)
    large = members.where(F.col("n") > pairwise)
    often = large.groupBy("node").agg(F.count("*").alias("often"))
    lead = large.join(often, "node").groupBy("key").agg(F.max(F.struct("often", "node", "size")).alias("l"))
    stars = large.join(lead, "key").where(F.col("node") != F.col("l.node")).where(_sized(F.col("size"), F.col("l.size"), threshold))
    stars = stars.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"))
    found = materialize(verified(_in_small(members, pairwise, threshold).unionAll(stars).distinct(), nodes, threshold).select("a", "b"), "links")
    if large.limit(1).count():
        component = connected_components(found)
        of = component.select(F.col("node").alias("of"), "component")
        placed = materialize(large.select("key", "node").join(of, F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("component", "node").alias("c")), "placed")
        mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        apart = placed.join(mixed, "key", "left_semi").select("node", "c").distinct()
        more = by_rare_shingles(nodes.select("node", "hashes").join(apart, "node"), threshold, "c")
        found = found.unionAll(materialize(verified(more, nodes, threshold).select("a", "b"), "links"))
    discard(members)
    return found


def similar_pairs(nodes: DataFrame, threshold: float, pairwise: int = PAIRWISE, apart: str | None = None) -> DataFrame:
    """``a, b, common, na, nb``: all similar pairs of equal bands, once each; of unlike ``apart``, where that is given.

    One row per pair of unlike classes that are similar, which is what is asked for;
    candidates of large buckets are found by prefixes, not pair by pair.
    """
    nodes = materialize(nodes, "nodes")
    members = _buckets(nodes)
    crowded = members.where(F.col("n") > pairwise).select("node").distinct()
    pairs = _in_small(members, pairwise, threshold)
    if crowded.limit(1).count():
        pairs = pairs.unionAll(by_rare_shingles(nodes.join(crowded, "node", "left_semi"), threshold, apart)).distinct()
    return materialize(verified(pairs, nodes, threshold), "similar")


def distinct_nodes(own: DataFrame) -> DataFrame:
    """``node, hashes, bands`` of ``classes``' rows: one of each."""
    return own.where("doc_id = node").select("node", "hashes", "bands").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, node, component`` for every row: its class of equal shingle sets, and the
    component of classes that are similar, both named by their least id."""
    own = materialize(classes(docs, row_id, text), "classes")
    component = connected_components(links(distinct_nodes(own), threshold)).withColumnRenamed("node", "of")
    return own.select("doc_id", "node").join(component, F.col("node") == F.col("of"), "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def duplicate_report(docs: DataFrame, row_id: str, text: str, group: str, threshold: float = 0.85) -> DataFrame:
    """``kind, within, across, max_bp``: pairs of rows with equal shingle sets (``equal``) and with unlike, similar ones (``near``), within a group and across.

    Copies are counted, never paired: a class of n rows has n (n - 1) / 2 pairs, two
    similar classes as many as the product of their sizes.
    """
    own = materialize(classes(docs, row_id, text, group), "classes")
    per = own.groupBy("node", F.col(group).alias("g")).agg(F.count("*").alias("n"))
    sums = per.groupBy("node").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("inner"))
    equal = sums.agg(F.coalesce(F.sum("inner"), F.lit(0)).alias("within"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2 - inner")), F.lit(0)).alias("across"), F.when(F.max("n") > 1, 10_000).otherwise(0).alias("max_bp"))
    pairs = similar_pairs(distinct_nodes(own), threshold)
    one, other = (per.select(F.col("node").alias(x), F.col("g").alias(f"g{x}"), F.col("n").alias(f"m{x}")) for x in "ab")
    met = pairs.join(one, "a").join(other, "b").withColumn("same", F.col("ga").eqNullSafe(F.col("gb")))
    product = lambda same: F.coalesce(F.sum(F.when(F.col("same") == same, F.col("ma") * F.col("mb"))), F.lit(0))
    top = F.coalesce(F.max(F.bround(F.col("common") * 10_000 / (F.col("na") + F.col("nb") - F.col("common")))), F.lit(0)).cast("int")
    near = met.agg(product(True).alias("within"), product(False).alias("across"), top.alias("max_bp"))
    return equal.select(F.lit("equal").alias("kind"), "*").unionAll(near.select(F.lit("near").alias("kind"), "*"))


def cross_source_losers(docs: DataFrame, row_id: str, prompt: str, schema: str, source: str, threshold: float = 0.85) -> DataFrame:
    """Rows that a row of another source, earlier by (source, id), resembles in prompt and in schema: ``row_id, source``.

    Classes are compared, not rows: of each class and source the first row is enough to
    know what may win against a row of another source.
    """
    names = fresh([row_id, source], "schema_node")[0]
    own = classes(docs, row_id, prompt, schema, source)
    own = materialize(own.select("doc_id", schema, F.col(source).alias("s"), F.col("node").alias("p"), F.col("hashes").alias("ph"), F.col("bands").alias("pb")), "prompts")
    schemas = materialize(classes(own.withColumnRenamed("doc_id", "d"), "d", schema).select("doc_id", F.col("node").alias(names), "hashes"), "schemas")
    placed = materialize(own.select("doc_id", "s", "p").join(schemas.select("doc_id", F.col(names).alias("q")), "doc_id"), "placed")
    prompts = own.where("doc_id = p").select(F.col("p").alias("node"), F.col("ph").alias("hashes"), F.col("pb").alias("bands"))
    alike = similar_pairs(prompts, threshold).select("a", "b")
    alike = alike.unionAll(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(placed.select(F.col("p").alias("a"), F.col("p").alias("b")).distinct())
    firsts = materialize(placed.groupBy("p", "q", "s").agg(F.min("doc_id").alias("d")), "firsts")
    one, other = (firsts.select(F.col("p").alias(x), F.col("q").alias(f"q{x}"), F.col("s").alias(f"s{x}"), F.col("d").alias(f"d{x}")) for x in "ab")
    met = one.join(alike, "a").join(other, "b").where("sb < sa")
    kinds = schemas.where(F.col("doc_id") == F.col(names)).select(F.col(names).alias("node"), "hashes")
    close = verified(met.where("qa <> qb").select(F.col("qa").alias("a"), F.col("qb").alias("b")).distinct(), kinds, threshold).select(F.col("a").alias("qa"), F.col("b").alias("qb"))
    lost = met.where("qa = qb").select(F.col("a").alias("p"), F.col("qa").alias("q"), F.col("sa").alias("s")).unionAll(met.join(close, ["qa", "qb"]).select(F.col("a").alias("p"), F.col("qa").alias("q"), F.col("sa").alias("s"))).distinct()
    return placed.join(lost, ["p", "q", "s"], "left_semi").select(F.col("doc_id").alias(row_id), F.col("s").alias(source))


def contamination(docs: DataFrame, targets: DataFrame, row_id: str, text: str, target: str, threshold: float = 0.85) -> DataFrame:
    """``target, exact, near, max_bp`` per value of ``target``: pairs of a row and a target's item whose texts are equal, and pairs whose shingle sets are similar while the texts differ.

    Texts are equal by hash of the normalised text; both sides are counted per text before
    they meet, and classes are compared across the two sides only.
    """
    both = docs.select(F.col(row_id).alias("i"), F.col(text).alias("t"), F.lit(None).cast("string").alias("target")).unionAll(targets.select(F.col(row_id).alias("i"), F.col(text).alias("t"), F.col(target).cast("string").alias("target")))
    both = both.select("t", "target", F.sha2(F.btrim(F.regexp_replace(F.lower("t"), r"\s+", " ")), 256).alias("x"), F.struct(F.col("target").isNotNull().alias("is_target"), "i").alias("doc"))
    own = materialize(classes(both, "doc", "t", "target", "x").withColumnRenamed("doc_id", "doc"), "both")
    per = materialize(own.groupBy("node", "target", "x").agg(F.count("*").alias("n")), "counts")
    mine = per.where("target is null").drop("target")
    exact = mine.select("x", F.col("n").alias("m")).groupBy("x").agg(F.sum("m").alias("m")).join(per.where("target is not null").groupBy("target", "x").agg(F.sum("n").alias("n")), "x").groupBy("target").agg(F.sum(F.col("m") * F.col("n")).alias("exact"))
    nodes = own.where("doc = node").select("node", "hashes", "bands").dropDuplicates(["node"])
    pairs = similar_pairs(nodes, threshold)
    bp = F.bround(F.col("common") * 10_000 / (F.col("na") + F.col("nb") - F.col("common"))).cast("int")
    pairs = pairs.select("a", "b", bp.alias("bp"))
    same = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(10_000).alias("bp"))
    ways = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "bp")).unionAll(same)
    left = mine.groupBy(F.col("node").alias("a")).agg(F.sum("n").alias("m"))
    right = per.where("target is not null").groupBy(F.col("node").alias("b"), "target").agg(F.sum("n").alias("n"))
    similar = ways.join(left, "a").join(right, "b").groupBy("target").agg(F.sum(F.col("m") * F.col("n")).alias("similar"), F.max("bp").alias("max_bp"))
    every = targets.select(F.col(target).cast("string").alias("target")).distinct()
    out = every.join(exact, "target", "left").join(similar, "target", "left")
    return out.select("target", F.coalesce("exact", F.lit(0)).alias("exact"), (F.coalesce("similar", F.lit(0)) - F.coalesce("exact", F.lit(0))).alias("near"), F.coalesce("max_bp", F.lit(0)).alias("max_bp"))
