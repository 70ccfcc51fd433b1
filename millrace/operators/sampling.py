"""Budgets, balance and packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import bound_batches, fresh, materialize


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), key.cast("string")), 256)


def dealt_by_range(rows: DataFrame, keys: list[str], order: list[str], part: str) -> DataFrame:
    """``rows`` dealt by range of (keys, order) and written, with the number of the range as ``part``.

    One large key is spread over many tasks; a range exchange samples anew each time it
    runs, so what it dealt is written once.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ends = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    return materialize(rows.repartitionByRange(n, *ends).withColumn(part, F.spark_partition_id()), "dealt")


def running(rows: DataFrame, key: str | list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``cum``, the running sum of ``value`` within ``key`` (one column or more) by ``order``.

    Rows are dealt by range of (key, order) and each stretch's total is carried over, so
    one large key is summed by many tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    part, at, total, carry, own, *theirs = fresh(rows.columns, "part", "at", "total", "carry", "own", *[f"of_{k}" for k in keys])
    dealt = dealt_by_range(rows, keys, order, part)
    totals = dealt.groupBy(part, *keys).agg(F.sum(value).alias(total))
    before = F.sum(total).over(Window.partitionBy(*keys).orderBy(part)) - F.col(total)
    carried = totals.select(F.col(part).alias(at), *[F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)], before.alias(carry))
    stretch = Window.partitionBy(part, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)], F.col(part) == F.col(at))
    return dealt.withColumn(own, F.sum(value).over(stretch)).join(carried, on).select(*rows.columns, (F.col(own) + F.col(carry)).alias("cum"))


def previous(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the ``order`` of the row before within ``key``; null for a key's first.

    Dealt by range as in ``running``: a stretch's first row takes the largest ``order`` of
    the stretches before.
    """
    part, at, most, carry, of_key = fresh([*rows.columns, name], "part", "at", "most", "carry", "of_key")
    dealt = dealt_by_range(rows, [key], [order], part)
    ends = dealt.groupBy(part, key).agg(F.max(order).alias(most))
    carried = ends.select(F.col(part).alias(at), F.col(key).alias(of_key), F.lag(most).over(Window.partitionBy(key).orderBy(part)).alias(carry))
    before = F.lag(order).over(Window.partitionBy(part, key).orderBy(F.col(order).asc_nulls_first()))
    on = (F.col(part) == F.col(at)) & F.col(key).eqNullSafe(F.col(of_key))
    return dealt.withColumn(name, before).join(carried, on).select(*rows.columns, F.coalesce(name, carry).alias(name))


def closest_prefix(rows: DataFrame, key: str, order: list[str], size: str, targets: DataFrame) -> DataFrame:
    """Rows of the prefix, within each key, whose total is closest to the key's ``target``.

    The shorter prefix wins a tie; the empty prefix doesn't take part.
    """
    summed = running(rows, key, order, size).join(targets, key)
    summed = summed.where(F.col("cum") - F.col(size) < F.col("target"))
    ends = summed.groupBy(key).agg(F.min(F.struct(F.abs(F.col("cum") - F.col("target")).alias("d"), F.col("cum").alias("c")))["c"].alias("end"))
    return summed.join(ends, key).where(F.col("cum") <= F.col("end")).drop("end")


def exact_budget(rows: DataFrame, key: str, order: list[str], size: str, targets: DataFrame, cap: int | None = None) -> DataFrame:
    """Whole epochs and a cut of each key's rows that take exactly its ``target``.

    Every row is used ``target div total`` times; rows then follow by ``order`` until the
    rest is used up, the last one trimmed: ``uses`` and ``trimmed`` (size of the part).
    With ``cap`` no row is used more often than that; keys whose target would need it are
    an error, found before anything is dealt.
    """
    totals = rows.groupBy(key).agg(F.sum(size).alias("total")).join(targets, key).where("total > 0")
    if cap is not None and (over := totals.where(F.col("target") > cap * F.col("total")).count()):
        raise ValueError(f"{over} keys need a row more than {cap} times")
    summed = running(rows, key, order, size).join(totals, key)
    rest = F.col("target") % F.col("total")
    before = F.col("cum") - F.col(size)
    part = F.greatest(F.lit(0), F.least(F.col(size), rest - before))
    epochs = F.floor(F.col("target") / F.col("total"))
    return summed.select(*rows.columns, epochs.alias("epochs"), part.cast("long").alias("trimmed"), (epochs * F.col(size) + part).cast("long").alias("taken"))


class _Rooms:
    """Bins by the room they have left: for each room, stretches of bin numbers in order."""

    def __init__(self):
        self.sizes: list[int] = []
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, end: int) -> None:
        if first < end and room:
            if room not in self.bins:
                insort(self.sizes, room)
                self.bins[room] = []
            insort(self.bins[room], (first, end))

    def take(self, need: int) -> tuple[int, int, int] | None:
        """The first stretch of the least room that suffices."""
        at = bisect_left(self.sizes, need)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        first, end = self.bins[room].pop(0)
        if not self.bins[room]:
            del self.bins[room], self.sizes[at]
        return room, first, end


def best_fit_stretches(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """``size, start, each, first``: where best-fit-decreasing puts items, given how many there are of each size.

    Items of a size are alike, so a bin that is chosen takes as many of them as it has
    room for, and then the next of its stretch: from place ``start`` (of all items by
    falling size) on, ``each`` items go into every bin from ``first`` on. A size cuts one
    stretch at most, so there are no more of them than sizes and bins' rooms, whatever the
    number of items.
    """
    rooms, made, place, out = _Rooms(), 0, 0, []
    for size, left in sorted(counts, reverse=True):
        while left:
            found = rooms.take(size)
            room, first, end = found or (capacity, made, made + -(-left // (capacity // size)))
            each = room // size
            used = min(end - first, -(-left // each))
            out.append((size, place, each, first))
            taken = min(left, used * each)
            short = used * each - taken  # the last bin may stay short of some
            whole = used - (short > 0)
            rooms.put(room - each * size, first, first + whole)
            if short:
                rooms.put(room - (each - short) * size, first + whole, first + used)
            if found:
                rooms.put(room, first + used, end)
            made, place, left = max(made, first + used), place + taken, left - taken
    return out


def pack_best_fit(rows: DataFrame, key: str, row_id: str, size: str, capacity: int) -> DataFrame:
    """``key, row_id, size, bin, reason``: best-fit-decreasing bins within each key, for every row.

    Rows go by falling size, then id; each goes into the fullest bin that still takes it,
    the earliest of equals. Choices are sequential, but rows of a size are alike: a task
    per key decides over counts by size (``capacity`` numbers at most), and rows find
    their bins by their place in the order. A row over the capacity has no bin and the
    reason ``sequence_too_long``, one without a positive size ``no_tokens``.
    """
    rows = rows.select(key, row_id, F.col(size).cast("long").alias(size))
    reason = F.when(F.col(size) > capacity, "sequence_too_long").when(F.coalesce(F.col(size) <= 0, F.lit(True)), "no_tokens")
    good = rows.where(reason.isNull())
    kind = rows.schema[key].dataType.simpleString()

    def plan(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = best_fit_stretches(list(zip(pdf["s"].tolist(), pdf["c"].tolist(), strict=True)), capacity)
        return pd.DataFrame([(k[0], *f) for f in found], columns=["k", "s", "start", "each", "first"])

    k, n, stretches, at, falling, one = fresh([*rows.columns, "cum"], "k", "n", "stretches", "at", "falling", "one")
    counts = good.groupBy(F.col(key).alias("k"), F.col(size).alias("s")).agg(F.count("*").alias("c"))
    plans = counts.groupBy("k").applyInPandas(plan, f"k {kind}, s long, start long, each long, first long")
    plans = plans.groupBy(F.col("k").alias(k), F.col("s").alias(n)).agg(F.collect_list(F.struct("start", "each", "first")).alias(stretches))
    placed = running(good.withColumns({falling: -F.col(size), one: F.lit(1)}), key, [falling, row_id], one).withColumn("cum", F.col("cum") - 1)
    joined = placed.join(plans, F.col(key).eqNullSafe(F.col(k)) & (F.col(size) == F.col(n)))
    joined = joined.withColumn(at, F.array_max(F.filter(stretches, lambda x: x["start"] <= F.col("cum"))))
    number = F.col(at)["first"] + F.floor((F.col("cum") - F.col(at)["start"]) / F.col(at)["each"])
    found = joined.select(key, row_id, size, number.alias("bin"), F.lit(None).cast("string").alias("reason"))
    return found.unionAll(rows.select(key, row_id, size, F.lit(None).cast("long").alias("bin"), reason.alias("reason")).where("reason is not null"))


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, out: str) -> DataFrame:
    """``rows`` with what ``step(state, *row) -> (state, value)`` gives, row by row within ``key`` by ``order``; ``out`` is ``name type``.

    For choices that hang on the ones before. A key's rows pass through one task in order,
    batch by batch: what is held is one batch and the state, never the key's rows.
    """
    name, kind = out.split()
    bound_batches(rows.sparkSession)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sort = [F.col(c).asc_nulls_first() for c in [key, *order]]
    dealt = rows.repartition(n, key).sortWithinPartitions(*sort)
    columns = rows.columns

    def run(batches):
        last, state, begun = None, None, False
        for batch in batches:
            values = []
            data = batch.to_pydict()
            for row in zip(*(data[c] for c in columns), strict=True):
                k = row[columns.index(key)]
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, value = step(state, *row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[kind])], names=[*columns, name])

    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {out}")


def next_fit(rows: DataFrame, key: str, order: list[str], size: str, capacity: int) -> DataFrame:
    """``rows`` with ``bin``: greedy bins that keep the order; a new bin starts where a row doesn't fit.

    A row over the capacity has a bin of its own. See ``folded`` for how keys are dealt.
    """
    at = rows.columns.index(size)

    def step(state, *row):
        b, used = state
        s = row[at] or 0
        if used and used + s > capacity:
            b, used = b + 1, 0
        return (b, used + s), b

    return folded(rows, key, order, lambda: (0, 0), step, "bin long")
