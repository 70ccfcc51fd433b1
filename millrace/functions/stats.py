"""Percentiles (six definitions that differ), rates, schedules."""

from __future__ import annotations

import random
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """A: for each key, values of ``x`` at the given shares, interpolated between the two nearest; 0.5 is the median.

    Exact, and by counts of distinct values as in ``by_index``: no group's values are held.
    """
    picks = {}
    for name, p in shares.items():
        picks |= {f"{name}_low": lambda n, p=p: F.floor((n - 1) * p), f"{name}_high": lambda n, p=p: F.ceil((n - 1) * p)}
    found = by_index(rows, keys, x, picks, "n_values")
    between = lambda name, p: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * ((F.col("n_values") - 1) * p - F.floor((F.col("n_values") - 1) * p))
    return found.select(*keys, *[between(name, p).alias(name) for name, p in shares.items()])


def percentile_floor(p: float):
    """B: index ``int((n - 1) * p)``."""
    return lambda n: F.floor((n - 1) * p)


def percentile_nearest(p: float):
    """C and F: index ``ceil(n * p) - 1``."""
    return lambda n: F.greatest(F.ceil(n * p) - 1, F.lit(0))


def percentile_clamped(p: float):
    """D: rank ``int(p * n + 0.999999999999)``, clamped to 1..n."""
    return lambda n: F.greatest(F.lit(1), F.least(n, F.floor(F.lit(p) * n + 0.999999999999))) - 1


def percentile_even(p: float):
    """E: index ``round((n - 1) * p)``, halves to even."""
    return lambda n: F.bround((n - 1) * p)


def by_index(rows: DataFrame, keys: list[str], x: str, indexes: dict[str, object], count: str | None = None) -> DataFrame:
    """For each key, the values of ``x`` at indexes that depend on the number of values, and that number as ``count``.

    Counts per (key, value) are combined first; positions are running sums over distinct
    values, dealt by range, so neither a list of a key's values is built nor are its
    distinct ones sorted in one task.
    """
    from millrace.operators.sampling import running

    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("c"))
    whole = counted.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.sum("c").alias("n"))
    placed = running(counted, keys, [x], "c").join(whole, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]))
    here = lambda f: (F.col("cum") > f(F.col("n"))) & (F.col("cum") - F.col("c") <= f(F.col("n")))
    number = [F.max("n").alias(count)] if count else []
    return placed.groupBy(*keys).agg(*[F.max(F.when(here(f), F.col(x))).alias(name) for name, f in indexes.items()], *number)


def warmup_cosine(step: Column, max_steps: int, warmup: int) -> Column:
    progress = (step - warmup) / F.lit(float(max(max_steps - warmup, 1)))
    return F.when(step >= max_steps, 0.0).when(step < warmup, (step + 1) / F.lit(float(max(warmup, 1)))).otherwise(0.5 * (1.0 + F.cos(F.pi() * progress)))


def cluster_bootstrap(clusters: DataFrame, total: str, size: str, key: str, seed: int, replicates: int = 10_000, confidence_bp: int = 9500) -> DataFrame:
    """One row: point, lower and upper basis points of a paired cluster bootstrap.

    ``clusters`` has one row per cluster: the summed paired difference and the items. The
    generator of the standard library defines the sample, so clusters, far fewer than
    items, are drawn in one task, sorted by key.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        pairs = list(zip(pdf[total].astype(int), pdf[size].astype(int), strict=True))
        rng, out, n = random.Random(seed), [], len(pairs)
        for _ in range(replicates):
            picked = [pairs[rng.randrange(n)] for _ in range(n)]
            out.append(round(sum(a for a, _ in picked) * 10_000 / sum(b for _, b in picked)))
        out.sort()
        tail = (1.0 - confidence_bp / 10_000) / 2
        at = lambda p: out[max(1, min(len(out), int(p * len(out) + 0.999999999999))) - 1]
        return pd.DataFrame({"point_bp": [round(sum(a for a, _ in pairs) * 10_000 / sum(b for _, b in pairs))], "lower_bp": [at(tail)], "upper_bp": [at(1.0 - tail)], "n_clusters": [n]})

    return clusters.groupBy(F.lit(1).alias("__one")).applyInPandas(draw, "point_bp long, lower_bp long, upper_bp long, n_clusters long")


def hashed_bootstrap(clusters: DataFrame, total: str, size: str, key: str, replicates: int = 200, seed: str = "boot") -> DataFrame:
    """``replicate, delta_bp``: each cluster counts as often as a hash of (replicate, key) says.

    Weights are Poisson-like (0 to 3), independent of one another, so replicates need no
    task that has all clusters: a combinable sum per replicate.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), F.col(key).cast("string")), 256), 1, 6), 16, 10).cast("long") % 1000
    weight = F.when(h < 368, 0).when(h < 736, 1).when(h < 920, 2).otherwise(3)
    drawn = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    sums = drawn.groupBy("replicate").agg(F.sum(F.col("w") * F.col(total)).alias("s"), F.sum(F.col("w") * F.col(size)).alias("n"))
    return sums.select("replicate", F.when(F.col("n") > 0, F.bround(F.col("s") * 10_000 / F.col("n"))).cast("long").alias("delta_bp"))
