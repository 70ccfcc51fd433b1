"""Mixing sources to target weights by systematic sampling.

A source's target number of words comes from its weight; each of its documents is then
expected ``target / size of the source`` times. Expected copies are summed up within the
source, a random offset is added, and a document is emitted once per integer boundary
that its stretch of the sum crosses. Documents stand in order of size, so neighbours are
alike and the words taken miss the target by about one document's size at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, word_count
from millrace.session import fresh, materialize

#: Expected copies are whole multiples of 2**-24: sums are exact, whatever the order.
BITS = 24
UNIT = 1 << BITS
WEIGHTS = (5, 2, 1)
SHARE_HALVES = 3  # the mix has 3/2 of all words
CAP = 2  # times a source's size, and copies of a document
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_halves: int = SHARE_HALVES, cap: int = CAP) -> DataFrame:
    """``source, source_size, n, target`` for each source of ``source, size`` rows.

    Sources by code point, null last, weigh ``weights`` in turn. They share
    ``share_halves / 2`` of all words; a target over ``cap`` times the source's size
    stops there and the excess goes to the others by weight, until none is above. With
    sources sorted by cap per weight the stopped ones are a prefix, so that fixed point
    needs running sums only, in whole numbers up to the last division. It takes one row
    per source; a share beyond ``cap`` times all words leaves every source at its cap.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = per_source.withColumn("w", w)
    by_cap = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share_halves) * F.sum("source_size").over(everything) - F.lit(2 * cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = ranked.withColumns({"left": left, "w_from": F.sum("w").over(onward)})
    levels = levels.withColumn("stopped", F.col("left") * F.col("w") > F.lit(2 * cap) * F.col("source_size") * F.col("w_from"))
    # The first source that isn't stopped sets the level for it and all after it.
    first = Window.partitionBy().orderBy("stopped", (F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.col("w") * F.first("left").over(first) / (2 * F.first("w_from").over(first))
    return levels.withColumn("share", share).select(
        "source", "source_size", "n", F.when(F.col("stopped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("share")).cast("double").alias("target")
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's random offset in units, from a hash of the seed and its name."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("long")


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, partitions: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over a key's earlier rows.

    Rows are dealt by range of (key, order), so a hot key spreads over many tasks; each
    task sums its own stretch, and the stretches' totals (one row per key and task) carry
    over. The dealt rows are written once, as a range exchange samples anew each time.
    """
    part, of_key, at, total, carry, own = fresh(rows.columns, "part", "of_key", "at", "total", "carry", "own")
    dealt = materialize(rows.repartitionByRange(partitions, F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]).withColumn(part, F.spark_partition_id()), "dealt")
    totals = dealt.groupBy(part, key).agg(F.sum(value).alias(total))
    carried = totals.select(F.col(part).alias(at), F.col(key).alias(of_key), (F.sum(total).over(Window.partitionBy(key).orderBy(part)) - F.col(total)).alias(carry))
    stretch = Window.partitionBy(part, key).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.withColumn(own, F.sum(value).over(stretch) - F.col(value))
    on = (F.col(part) == F.col(at)) & F.col(key).eqNullSafe(F.col(of_key))
    return inner.join(carried, on).select(*rows.columns, (F.col(own) + F.col(carry)).alias("before"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **targets) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs``.

    Null texts and texts without a word have size 0; null sources are one source, the
    last; rows that tie in source, size and id are alike, whichever comes first. A row of
    a source of size 0 is never taken. Copies are at most the cap, as no expectation is
    above it. Reruns give equal rows. An empty table gives an empty table.
    """
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    per_source = source_targets(sized, **targets)
    expected = F.coalesce(F.floor(F.col("target") / F.col("source_size") * UNIT), F.lit(0)).cast("long")
    per_source = per_source.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, expected).otherwise(F.lit(0)).alias("e"))
    rows = sized.join(per_source, sized["source"].eqNullSafe(per_source["s"])).drop("s")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    summed = running_sum(rows, "source", ["size", "doc_id"], "e", n)
    at = F.col("before") + offset(F.col("source"), seed)
    copies = F.shiftright(at + F.col("e"), BITS) - F.shiftright(at, BITS)
    return summed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it, columns unchanged.

    Rows that share id, source and size share their copies: the first ones by row
    number get one more where copies don't divide evenly.
    """
    own, theirs = ["own_id", "own_source", "own_size"], ["mix_id", "mix_source", "mix_size"]
    names = fresh(docs.columns, *own, *theirs, "copies", "rows", "take", "nth", "copy")
    i, s, n, mi, ms, mn, copies, rows, take, nth, copy = names
    keyed = docs.withColumns({i: F.col(doc_id), s: F.col(source).cast("string"), n: word_count(F.col(text))})
    per_key = mixed.groupBy(F.col("doc_id").alias(mi), F.col("source").alias(ms), F.col("size").alias(mn)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    on = F.col(i).eqNullSafe(F.col(mi)) & F.col(s).eqNullSafe(F.col(ms)) & (F.col(n) == F.col(mn))
    joined = keyed.join(per_key.where(F.col(copies) > 0), on)
    single = joined.where(F.col(rows) == 1).withColumn(take, F.col(copies))
    again = joined.where(F.col(rows) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(i, s, n).orderBy(F.xxhash64(text), F.col(text))))
    again = again.withColumn(take, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(nth) <= F.col(copies) % F.col(rows), 1).otherwise(0)).drop(nth).where(F.col(take) > 0)
    both = single.unionByName(again)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(take).cast("int")))).select(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; a row per document, taken or not."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM per_source
), levels AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
    sum(w) OVER (ORDER BY source_size / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM ranked
), marked AS (
  SELECT *, budget * w > 4 * source_size * w_from AS stopped FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN 2.0::DOUBLE * source_size ELSE
    (w * first_value(budget) OVER o)::DOUBLE / (2 * first_value(w_from) OVER o)::DOUBLE END::DOUBLE AS target,
    ('0x' || substr(sha256('mix-1:' || coalesce('s' || source, 'null')), 1, 6))::BIGINT AS off
  FROM marked WINDOW o AS (ORDER BY stopped, source_size / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), expected AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size::DOUBLE * 16777216)::BIGINT ELSE 0 END AS e
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, (sum(e) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT + off AS upto FROM expected
), taken AS (
  SELECT *, (upto >> 24) - ((upto - e) >> 24) AS copies FROM summed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
"""
