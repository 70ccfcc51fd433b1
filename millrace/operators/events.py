"""Event logs: loops, gaps, expiry, idempotent creation, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sampling import folded, previous


def runs_of_equal(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Gaps and islands: ``key, value, first, last, n`` of consecutive equal values."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    marked = rows.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__i", value).agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n")).drop("__i")


def gaps(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Places where a key's sequence doesn't go on by one: ``key, after, before, missing``."""
    placed = previous(rows.select(key, sequence), key, sequence, "after")
    return placed.select(key, "after", F.col(sequence).alias("before")).where(F.col("before") - F.col("after") > 1).withColumn("missing", F.col("before") - F.col("after") - 1)


def idempotent(rows: DataFrame, key: list[str], body: str, order: list[str], row_id: str) -> DataFrame:
    """Each request's outcome: ``created`` (first of its key), ``same`` or ``conflict`` (another body)."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, F.col(body).alias("__body"), F.col(row_id).alias("__id"))).alias("__f"))
    joined = rows.join(first, key)
    outcome: Column = F.when(F.col(row_id) == F.col("__f.__id"), "created").when(F.col(body).eqNullSafe(F.col("__f.__body")), "same").otherwise("conflict")
    return joined.select(row_id, *key, outcome.alias("outcome"))


def rate_limit(rows: DataFrame, key: str, at: str, row_id: str, limit: int, seconds: int = 60) -> DataFrame:
    """``key, row_id, allowed``: allowed if fewer than ``limit`` allowed ones lie in the last ``seconds``.

    Denials don't count, so each decision depends on the ones before: a key's rows pass in
    order, and what is kept of them is ``limit`` times at most.
    """

    def step(kept, _key, t, _row):
        kept = [x for x in kept if x > t - seconds * 1_000_000]
        ok = len(kept) < limit
        return (kept + [t] if ok else kept), ok

    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return folded(rows.select(key, micros.alias("at"), row_id), key, ["at", row_id], list, step, "allowed boolean").drop("at")
