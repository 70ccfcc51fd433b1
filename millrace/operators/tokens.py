"""Tokenising with rejects, masked context, and checks of token arrays against what is declared."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.render import label_mask
from millrace.session import bound_batches, let

Encoded = tuple[list[int], list[tuple[int, int]]]


def words(texts: list[str]) -> list[Encoded]:
    """A tokenizer for tests and checks: a token per word, numbered by its length."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    return [([len(m[0]) for m in ms], [m.span() for m in ms]) for ms in found]


def tokenize(rows: DataFrame, text: str, spans: str, encode: Callable[[list[str]], list[Encoded]], most: int) -> DataFrame:
    """``rows`` without their text and spans, with ``input_ids, labels, token_count, supervised_token_count, reason``.

    ``encode`` gives ids and offsets (code points) for a list of texts; it is called once
    per batch, in the workers, so a vocabulary is opened there. A token inside a span is
    its own label, one outside has -100; one that crosses a span's end is an error, as the
    render and the tokenizer don't fit then. Rows of more than ``most`` tokens are
    ``sequence_too_long``, rows without a label ``no_supervised_tokens``: they keep their
    counts and lose their arrays. Null texts are empty.
    """
    bound_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c not in (text, spans)]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            encoded = encode(texts)
            ids, offsets = [i for i, _ in encoded], [[{"start": a, "end": b} for a, b in o] for _, o in encoded]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], batch.column(spans), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=[*kept, "spans", "input_ids", "offsets"],
            )

    schema = ", ".join([*[f"{c} {fields[c]}" for c in kept], f"spans {fields[spans]}", "input_ids array<int>, offsets array<struct<start: int, end: int>>"])
    encoded = rows.select(*kept, text, spans).mapInArrow(run, schema)
    token = F.zip_with("input_ids", "offsets", lambda i, o: F.struct(i.alias("id"), o["start"].alias("start"), o["end"].alias("end")))
    marked = encoded.select(*kept, "input_ids", label_mask(token, F.col("spans")).alias("labels"))
    crossed = F.assert_true(~F.exists("labels", lambda x: x.isNull()), F.lit("a token crosses the end of a span"))
    supervised = F.size(F.filter("labels", lambda x: x != -100))
    checked = marked.select(*kept, "input_ids", "labels", F.coalesce(crossed.cast("int"), F.size("input_ids")).cast("long").alias("token_count"), supervised.cast("long").alias("supervised_token_count"))
    reason = F.when(F.col("token_count") > most, "sequence_too_long").when(F.col("supervised_token_count") == 0, "no_supervised_tokens")
    told = checked.withColumn("reason", reason)
    return told.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("input_ids", "labels")})


def masked_context(ids: Column, labels: Column, header: tuple[int, ...], context: tuple[int, ...]) -> Column:
    """``input_ids, labels, reason`` with ``context``, unsupervised, in front of every answer.

    An answer begins where labels go over from -100; ``header`` must stand right before
    it. Rows without an answer are ``no_supervision``, others ``missing_header``.
    """
    begins = lambda i: (F.get(labels, i) != -100) & ((i == 0) | (F.get(labels, i - 1) == -100))
    headed = lambda i: (i >= len(header)) & (F.slice(ids, F.greatest(i - len(header), F.lit(0)) + 1, F.lit(len(header))) == F.array(*map(F.lit, header))) if header else F.lit(True)
    starts = F.filter(F.transform(ids, lambda x, i: F.when(begins(i), i)), lambda i: i.isNotNull())
    add = lambda values, more: F.flatten(F.transform(values, lambda x, i: F.when(begins(i), F.concat(F.array(*map(F.lit, more)), F.array(x))).otherwise(F.array(x))))

    def out(s: Column) -> Column:
        reason = F.when(F.size(s) == 0, "no_supervision").when(~F.forall(s, headed), "missing_header")
        good = reason.isNull()
        return F.struct(F.when(good, add(ids, context)).alias("input_ids"), F.when(good, add(labels, (-100,) * len(context))).alias("labels"), reason.alias("reason"))

    return let(starts, out)


def row_faults(ids: Column, labels: Column, mask: Column, length: int) -> Column:
    """What is wrong with a padded row: shapes, a mask that isn't binary, labels on padding, labels that are neither -100 nor their id."""
    both = F.zip_with(labels, mask, lambda x, m: (m == 0) & (x != -100))
    own = F.zip_with(labels, ids, lambda x, i: (x == -100) | (x == i))
    sizes = F.array(F.size(ids), F.size(labels), F.size(mask))
    faults = [
        F.when(F.exists(sizes, lambda n: n != length), "invalid_shape"), F.when(F.exists(mask, lambda m: ~m.isin(0, 1)), "mask_not_binary"),
        F.when(F.exists(both, lambda x: F.coalesce(x, F.lit(False))), "padding_supervised"), F.when(~F.forall(own, lambda x: F.coalesce(x, F.lit(False))), "label_differs"),
    ]
    return F.array_compact(F.array(*faults))


def shifted_supervision(labels: Column) -> Column:
    """Labels that are learned: all but the first position's."""
    return F.size(F.filter(F.slice(labels, F.lit(2), F.greatest(F.size(labels), F.lit(1))), lambda x: x != -100)).cast("long")


def verify_mixture(rows: DataFrame, declared: DataFrame, strata: list[str], length: int) -> DataFrame:
    """``problem, key, declared, found``: faults of rows (``input_ids, labels, attention_mask``) by kind, and strata whose supervised tokens aren't those declared (``*strata, tokens``)."""
    faults = rows.select(F.explode(row_faults(F.col("input_ids"), F.col("labels"), F.col("attention_mask"), length)).alias("problem")).groupBy("problem").agg(F.count("*").alias("found"))
    counted = rows.groupBy(*strata).agg(F.sum(shifted_supervision(F.col("labels"))).alias("found"))
    on = [F.col(f"d_{s}").eqNullSafe(F.col(s)) for s in strata]
    both = declared.select(*[F.col(s).alias(f"d_{s}") for s in strata], F.col("tokens").alias("declared")).join(counted, on, "full")
    key = F.concat_ws(":", *[F.coalesce(s, f"d_{s}") for s in strata])
    strata_rows = both.where(~F.col("declared").eqNullSafe(F.col("found"))).select(F.lit("token_accounting").alias("problem"), key.alias("key"), F.col("declared").cast("long").alias("declared"), "found")
    return faults.select("problem", F.lit("").alias("key"), F.lit(0).cast("long").alias("declared"), "found").unionAll(strata_rows)


def dataset_manifest(rows: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """``*by, level, n, tokens, share_bp``: samples and tokens by each column and in all, shares rounded down; one pass."""
    sets = rows.groupingSets([[c] for c in by] + [[]], *by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    whole = rows.agg(F.sum(tokens)).first()[0] or 0  # one number
    share = F.expr(f"(tokens * 10000) div {whole}") if whole else F.lit(0).cast("long")
    return sets.select(*by, "level", "n", "tokens", share.alias("share_bp"))
