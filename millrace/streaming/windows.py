"""Windowed and stateful streams over an event source.

``events`` needs ``ts`` (timestamp), a key and a value. Late rows count while their
window is open: the watermark trails the latest event by ``delay``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import shared_dir


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as a stream of events, times as instants."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    if not status.isDirectory():  # a stream's source is a folder: take the file's, and this name in it
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def finish(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Runs a stream over what is there now and returns its result as a table.

    Each batch is written under its own number, so a repeated batch replaces itself; in
    complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    seen = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    where = f"{base}/out/batch={max(seen)}" if mode == "complete" else f"{base}/out"
    return spark.read.parquet(where).select(*stream.columns)


def tumbling(events: DataFrame, width: str, keys: list[str], slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and keys; ``slide`` makes the windows overlap."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select(F.unix_micros("w.start").alias("start_us"), *keys, "n", "cents")


def sessions(events: DataFrame, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.unix_micros("w.start").alias("start_us"), key, "n")


def first_requests(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state ends with it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, key: str, row_id: str, limit: int, seconds: int) -> DataFrame:
    """``key, row_id, allowed``: a sliding window of allowed requests is each key's state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", row_id])
        out = []
        for t in rows["at"]:
            while kept and kept[0] <= t - seconds * 1_000_000:
                kept.pop(0)
            ok = len(kept) < limit
            if ok:
                kept.append(int(t))
            out.append(ok)
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]] * len(rows), row_id: rows[row_id].tolist(), "allowed": out})

    rows = events.select(key, row_id, F.unix_micros("ts").alias("at"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {row_id} {types[row_id]}, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def sequenced(events: DataFrame, key: str, row_id: str, terminal: str, kind: str) -> DataFrame:
    """Appends to each key's log: ``key, row_id, sequence``, null after the key's terminal event."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, closed = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(["at", row_id])
        out = []
        for what in rows[kind]:
            out.append(None if closed else last + 1)
            if not closed:
                last, closed = last + 1, what == terminal
        state.update((int(last), bool(closed)))
        yield pd.DataFrame({key: [k[0]] * len(rows), row_id: rows[row_id].tolist(), "sequence": pd.array(out, dtype="Int64")})

    rows = events.select(key, row_id, kind, F.unix_micros("ts").alias("at"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {row_id} {types[row_id]}, sequence long", "last long, closed boolean", "append", GroupStateTimeout.NoTimeout)
