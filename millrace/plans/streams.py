"""Sources, sinks and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.text import hash_bucket, split_of
from millrace.plans import events, records  # noqa: F401  (register what its SQL is taken from)
from millrace.plans.registry import ORACLES, register
from millrace.plans.tables import table
from millrace.session import shared_dir
from millrace.sources import files
from millrace.streaming import windows


def _path(spark, name):
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@register("q_jsonl_round_trip", "SELECT doc_id, lang, n_chars, sha256(text) AS text_sha256 FROM documents")
def q_jsonl_round_trip(spark, sf_dir):
    path = _path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents"), path, compression="gzip")
    rows = files.read_jsonl(spark, path, "doc_id long, text string, lang string, n_chars long")
    return rows.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@register("q_registered_dataset", "SELECT CASE WHEN b < 9800 THEN 'train' WHEN b < 9900 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT n_chars, ('0x' || substr(sha256('split-v1' || chr(0) || doc_id::VARCHAR), 1, 16))::UBIGINT % 10000 AS b FROM documents) GROUP BY 1")
def q_registered_dataset(spark, sf_dir):
    path = _path(spark, "dataset")
    rows = table(spark, sf_dir, "documents").withColumn("split", split_of(hash_bucket("split-v1", F.col("doc_id").cast("string"))))
    files.register(rows, path)
    return files.open_registered(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@register("q_sharded_sink", f"SELECT lang, bin::BIGINT AS shard, n, n_chars FROM ({ORACLES['q_shard_split']})")
def q_sharded_sink(spark, sf_dir):
    """Shards of 200 000 characters, written by language and read back."""
    path = _path(spark, "shards")
    files.write_shards(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), path, "lang", ["doc_id"], "n_chars", 200_000)
    back = spark.read.schema("doc_id long, n_chars long, lang string, shard long").parquet(path)
    return back.groupBy("lang", "shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@register("q_versioned_index", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def q_versioned_index(spark, sf_dir):
    """A table is published, replaced, and rolled back to what it was."""
    path, docs = _path(spark, "index"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    files.publish(docs, path)
    files.publish(docs.where("lang = 'en'"), path)
    files.rollback(spark, path)
    return files.current(spark, path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_CENTS = "sum(round(value * 100)::BIGINT)::BIGINT AS cents"


@register("q_stream_tumbling", f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, {_CENTS} FROM events GROUP BY 1, 2")
def q_stream_tumbling(spark, sf_dir):
    return windows.finish(windows.tumbling(windows.read_events(spark, f"{sf_dir}/events.parquet"), "1 hour", ["event_type"]), "complete", "tumbling")


@register("q_stream_sliding", f"SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR) AS start_us, event_type, count(*) AS n, {_CENTS} FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2")
def q_stream_sliding(spark, sf_dir):
    return windows.finish(windows.tumbling(windows.read_events(spark, f"{sf_dir}/events.parquet"), "24 hours", ["event_type"], "6 hours"), "complete", "sliding")


@register(
    "q_stream_sessions",
    """SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS gap FROM events)) GROUP BY user_id, s""",
)
def q_stream_sessions(spark, sf_dir):
    return windows.finish(windows.sessions(windows.read_events(spark, f"{sf_dir}/events.parquet"), "30 minutes", "user_id"), "complete", "sessions")


@register("q_stream_rate_limit", ORACLES["q_rate_limit"])
def q_stream_rate_limit(spark, sf_dir):
    return windows.finish(windows.rate_limited(windows.read_events(spark, f"{sf_dir}/events.parquet"), "user_id", "event_id", 2, 3600), "append", "limited")


@register(
    "q_stream_sequence",
    """WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CASE WHEN NOT closed THEN n END AS sequence FROM s""",
)
def q_stream_sequence(spark, sf_dir):
    return windows.finish(windows.sequenced(windows.read_events(spark, f"{sf_dir}/events.parquet"), "user_id", "event_id", "purchase", "event_type"), "append", "sequence")
