"""What the operators share: words, folds, Arrow batches of whole texts, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import bound_batches, materialize

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def kind(df: DataFrame, column: str) -> str:
    """A column's type as a schema string has it."""
    return df.schema[column].dataType.simpleString()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` one batch at a time, batches bounded in bytes as well as rows."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def bounded(rows: DataFrame, key: str, doc_id: str, most: int, total: int) -> DataFrame:
    """``k, i``: up to ``most`` distinct ids of each value ``k`` of ``key``, those of least hash.

    A value gets ``total`` divided by the number of values, if that is less; more values
    than ``total`` are an error. Null keys and ids take no part; rows that repeat an id
    count once. Distinct ids are estimated first, and only those below the hash that
    about 2.5 times ``most`` of them reach go on, so that a frequent value sends no more
    rows to a task than a rare one. The estimate errs by a few percent, and hashes are
    uniform: that a value comes short of ids it has is less likely than 1e-30.
    """
    pairs = rows.select(F.col(key).alias("k"), F.col(doc_id).alias("i")).where("k is not null and i is not null")
    counts = materialize(pairs.groupBy(F.col("k").alias("v")).agg(F.approx_count_distinct("i").alias("c")), "counts")
    values = counts.count()
    if values > total:
        raise ValueError(f"{values} values of {key}, more than the sample's {total} rows")
    most = min(most, total // max(values, 1))
    reach = F.least(F.lit(2.5 * (most + 30)) / F.col("c"), F.lit(1.0)) * 2 - 1
    near = pairs.withColumn("h", F.xxhash64(F.lit("sample"), "i")).join(counts, F.col("k") == F.col("v")).where(F.col("h") / float(1 << 63) <= reach)
    nth = F.row_number().over(Window.partitionBy("k").orderBy("h", "i"))
    return near.select("k", "i", "h").distinct().withColumn("n", nth).where(F.col("n") <= most).select("k", "i")


def sampled(rows: DataFrame, chosen: DataFrame) -> list:
    """``k, i, t`` of the chosen ``k, i``: whole texts of ``rows`` (``i, t``, or ``k, i, t``), in a fixed order.

    Of rows that repeat key and id the one whose text has the least hash is taken, by a
    combinable minimum. ``chosen`` is bounded, and so is what the driver gets.
    """
    met = rows.where("t is not null").join(F.broadcast(chosen), [c for c in ("k", "i") if c in rows.columns])
    return met.groupBy("k", "i").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t")))["t"].alias("t")).orderBy("k", "i").collect()


def replace(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with some of its columns replaced, types as they were."""
    arrays = [columns[n].cast(batch.schema.field(n).type) if n in columns else batch.column(i) for i, n in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
