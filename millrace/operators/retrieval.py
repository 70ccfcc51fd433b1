"""Chunks and BM25 ranking."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

QUERY_WORD = r"[^\W_][\w.-]{1,63}"
K1, B = 1.2, 0.75


def chunks(docs: DataFrame, row_id: str, text: str, lines: int = 40, overlap: int = 5) -> DataFrame:
    """Overlapping chunks of lines: ``row_id, start_line, end_line, excerpt``, blank ones left out."""
    split = docs.select(row_id, F.split(text, "\n", -1).alias("l"))
    split = split.select(row_id, F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l")).alias("l")).where(F.size("l") > 0)
    step = lines - overlap
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 1, F.lit(step)), lambda s: (s == 0) | (s + overlap < F.size("l")))
    parts = split.select(row_id, "l", F.explode(starts).alias("s"))
    out = parts.select(row_id, (F.col("s") + 1).cast("long").alias("start_line"), F.least(F.size("l"), F.col("s") + lines).cast("long").alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, lines), "\n").alias("excerpt"))
    return out.withColumn("excerpt", F.btrim("excerpt", F.lit(" \t\n\r\f\x0b"))).where("excerpt <> ''")


def query_terms(query: str, most: int = 20) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in re.findall(QUERY_WORD, query)[:most]))


def bm25(docs: DataFrame, row_id: str, text: str, terms: list[str], limit: int = 8) -> DataFrame:
    """The best ``limit`` rows for any of ``terms``: ``row_id, score``, ties by id.

    Only counts of the query's terms leave a row, never its words; corpus figures are one
    aggregate row, the only thing that the driver gets.
    """
    # A term is a whole run of letters and digits: counted where it stands, so no list of words is built.
    low = F.lower(text)
    count = lambda t: F.regexp_count(low, F.lit(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])"))
    rows = docs.select(row_id, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("len"), F.array(*map(count, terms)).alias("tf"))
    rows = materialize(rows, "terms")  # texts are read once
    figures = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    both = rows.where(F.exists("tf", lambda c: c > 0))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (figures["n"] - figures[f"df{i}"] + 0.5) / (figures[f"df{i}"] + 0.5))
        tf = F.col("tf")[i]
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (figures["avg_len"] or 1.0)))
    return both.select(row_id, score.alias("score")).orderBy(F.desc("score"), row_id).limit(limit)
