"""Choosing candidates: first acceptable ones whose traces are all different."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.records import call_from_json, visible_text
from millrace.operators.sampling import folded
from millrace.session import fresh, materialize


def first_distinct(candidates: DataFrame, task: str, index: str, trace: str) -> DataFrame:
    """``task, index, trace`` chosen as if tasks took turns in order.

    Each task takes its first candidate whose trace no earlier task has taken. Done in
    rounds: every task proposes its first candidate left; of equal proposals the earliest
    task keeps it for now, the others strike it out. As all traces prefer tasks in one
    order, the rounds end in the very choice of taking turns. A round is two combinable
    minima; a popular trace loses all but one proposer in one round. Tasks without a
    candidate left are not returned; null traces are never chosen.
    """
    left = materialize(candidates.where(F.col(trace).isNotNull()).groupBy(F.col(task).alias("t"), F.col(trace).alias("h")).agg(F.min(index).alias("i")), "candidates")
    while True:
        proposed = materialize(left.groupBy("t").agg(F.min(F.struct("i", "h")).alias("p")).select("t", "p.i", "p.h"), "proposals")
        winners = proposed.groupBy("h").agg(F.min("t").alias("w"))
        struck = materialize(proposed.join(winners, "h").where("t <> w").select("t", "h"), "struck")
        if not struck.limit(1).count():
            return proposed.select(F.col("t").alias(task), F.col("i").alias(index), F.col("h").alias(trace))
        left = materialize(left.join(struck, ["t", "h"], "left_anti"), "candidates")


def quota_gate(rows: DataFrame, stratum: str, order: list[str], quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first rows of each stratum by ``order``, as many as its quota (``stratum, quota``), and the gate over all strata: ``stratum, quota, available, passed``."""
    nth, of, most = fresh(rows.columns, "nth", "of", "most")
    asked = quotas.select(F.col(stratum).alias(of), F.col("quota").alias(most))
    ranked = rows.withColumn(nth, F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    top = quotas.agg(F.max("quota")).first()[0] or 0  # bounds what any stratum sends on
    chosen = ranked.where(F.col(nth) <= top).join(asked, F.col(stratum).eqNullSafe(F.col(of))).where(F.col(nth) <= F.col(most)).select(*rows.columns)
    there = rows.groupBy(F.col(stratum).alias(of)).agg(F.count("*").alias("available"))
    gate = quotas.join(there, F.col(stratum).eqNullSafe(F.col(of)), "left").select(stratum, "quota", F.coalesce("available", F.lit(0)).alias("available"))
    return chosen, gate.withColumn("passed", F.col("available") >= F.col("quota"))


def trace_reason(m: Column, most_tokens: int = 192, most_repeated_bp: int = 500, most_lines: int = 1, most_sequence: int = 1024, anchor: Column | None = None, others: Column | None = None) -> Column:
    """Why a reasoning trace is refused, or null; ``m``: tokens, repeated_bp, max_line_repeat, duplicate, sequence_tokens.

    ``anchor`` (whether the evidence is in it) and ``others`` (how many other labels it
    names) are asked before repetition, where they are given.
    """
    reason = F.when(m["tokens"] == 0, "empty_reasoning").when(m["tokens"] > most_tokens, f"reasoning_over_{most_tokens}_tokens")
    if anchor is not None:
        reason = reason.when(~anchor, "missing_evidence_anchor")
    if others is not None:
        reason = reason.when(others > 0, "other_label_mentioned")
    reason = reason.when(m["repeated_bp"] > most_repeated_bp, f"repeated_8gram_over_{most_repeated_bp}bp").when(m["max_line_repeat"] > most_lines, "identical_line_repetition")
    return reason.when(m["duplicate"], "duplicate_normalized_trace").when(m["sequence_tokens"] > most_sequence, f"sequence_over_{most_sequence}_tokens")


def solver_reason(status: Column, finish: Column, answer: Column, expected: Column) -> Column:
    """Why a solver's output is refused, or null: it failed, was cut, has no JSON answer, or another one than expected (canonical texts)."""
    return F.when(status == "failed", "solver_runtime_error").when(finish == "length", "solver_length_limit").when(answer.isNull(), "solver_invalid_output").when(answer != expected, "solver_answer_mismatch")


def first_accepted(candidates: DataFrame, task: str, index: str, reason: str) -> DataFrame:
    """``candidates`` with ``outcome``: the first without a reason is ``selected``, later ones ``unused``; a task without any has ``no_candidate_passed`` for those that fail no rule of their own."""
    of, won = fresh(candidates.columns, "of", "won")
    first = candidates.groupBy(F.col(task).alias(of)).agg(F.min(F.when(F.col(reason).isNull(), F.col(index))).alias(won))
    joined = candidates.join(first, F.col(task).eqNullSafe(F.col(of)))
    outcome = F.when(F.col(index) == F.col(won), "selected").when(F.col(index) > F.col(won), "unused").otherwise(F.coalesce(reason, F.lit("no_candidate_passed")))
    return joined.withColumn("outcome", outcome).drop(of, won)


def reassemble(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, number, frame, visible``: blank-line frames of each key's chunks, in order.

    ``visible`` is what a frame adds to the text outside the hidden block. What a key
    carries from chunk to chunk is its unfinished frame and what it has shown.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(frames(pdf.sort_values(order)[text]))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(rows), "number": range(len(rows)), "frame": [f for f, _ in rows], "visible": [v for _, v in rows]})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, order, text).groupBy(key).applyInPandas(fold, f"{key} {kind}, number long, frame string, visible string")


def frames(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Frames of a chunked text, each with the visible text it adds."""
    rest, told, shown = "", "", ""
    for chunk in [*chunks, None]:
        if chunk is None:
            whole, rest = ([rest] if rest else []), ""
        else:
            *whole, rest = (rest + chunk).split("\n\n")
        for frame in whole:
            if not frame:
                continue
            told += frame
            now = visible_text(told)
            more = now[len(shown) :] if now.startswith(shown) else ""
            shown = now if now.startswith(shown) else shown
            yield frame, more


def repair_stream(chunks: DataFrame, key: str, order: str, text: str, tools: frozenset[str], end: str = "[DONE]") -> DataFrame:
    """``chunks`` with ``out``: a call that is written as plain JSON, in pieces, comes out as one call where it is whole.

    Chunks before a call pass; from the first that starts with a brace on they are held
    back. Once they make a call of a known tool, that chunk gives the call and later ones
    nothing. At the ``end`` mark an unfinished call is an error. A key carries its pieces
    so far and whether it is done.
    """
    at = chunks.columns.index(text)

    def step(state, *row):
        pieces, done = state
        chunk = row[at]
        if chunk == end:
            return state, "error:tool_parser_error" if pieces and not done else end
        if done or not chunk:
            return state, None
        if not pieces and not chunk.lstrip().startswith("{"):
            return state, chunk
        call = call_from_json(pieces + chunk, tools)
        return (pieces + chunk, call is not None), call

    return folded(chunks, key, [order], lambda: ("", False), step, "out string")
