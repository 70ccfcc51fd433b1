"""Task sets by rule: categories of fixed size, languages in a fixed ratio, labels in turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks per category of the two evaluation sets and of the trajectories, and template families of these.
DEV = {"single_tool": 13, "no_tool": 10, "wrong_tool_irrelevance": 10, "missing_argument_clarification": 10, "sequential_multi_step": 15, "parallel_independent_tools": 5, "tool_failure_recovery": 10, "grounding_approval_security": 7}
RELEASE = {"single_tool": 25, "no_tool": 20, "wrong_tool_irrelevance": 20, "missing_argument_clarification": 20, "sequential_multi_step": 30, "parallel_independent_tools": 10, "tool_failure_recovery": 20, "grounding_approval_security": 15}
TRAJECTORIES = {"single_tool": 360, "no_tool": 360, "wrong_tool_irrelevance": 360, "missing_argument_clarification": 360, "sequential_multi_step": 360, "parallel_independent_tools": 120, "tool_failure_recovery": 240, "grounding_approval_security": 240}
FAMILIES = {"single_tool": 12, "no_tool": 6, "wrong_tool_irrelevance": 6, "missing_argument_clarification": 6, "sequential_multi_step": 12, "parallel_independent_tools": 1, "tool_failure_recovery": 2, "grounding_approval_security": 3}
#: Families of reasoning tasks, and labels of the two whose evidence varies.
REASONING = ("python", "json", "linux", "config", "log_diagnosis")
LABELS = {"config": ("forbidden_truncation", "missing_checkpoint", "unsupported_precision", "world_size_mismatch"), "log_diagnosis": ("collective_timeout", "cuda_oom", "disk_full", "non_finite_gradient")}

#: Items and English ones per category of the domain set, and tasks per category of the repair set.
DOMAIN = {"config": (40, 28), "json": (40, 28), "linux": (45, 32), "logs": (45, 31), "python": (50, 35), "refusal": (40, 28), "short_code": (40, 28)}
REPAIR = {"refusal": 300, "python": 120, "json": 80, "linux": 60, "log": 60, "short_code": 60}
#: Offsets that keep the values of the generalisation batches apart.
OFFSETS = (401, 449, 497)


def interleaved(nth: Column, part: int, whole: int) -> Column:
    """``zh`` for exactly ``part`` of every ``whole``, evenly; ``nth`` counts from 1."""
    steps = lambda x: F.floor(x * part / whole)
    return F.when(steps(nth) > steps(nth - 1), "zh").otherwise("en")


def by_category(spark: SparkSession, counts: dict[str, int], zh: int, families: dict[str, int] | None = None) -> DataFrame:
    """``nth, category, nth_of_category, lang, family`` of a set whose categories stand one after the other.

    ``zh`` of all are Chinese, evenly over the whole set; with ``families`` evenly within
    each category instead, and a task's family goes by its number.
    """
    ends = [sum(list(counts.values())[: i + 1]) for i in range(len(counts))]
    place = reduce(lambda rest, x: F.when(F.col("id") < x[1], F.lit(x[0])).otherwise(rest), reversed(list(enumerate(ends))), F.lit(None).cast("int"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("c") + 1)
    rows = spark.range(ends[-1]).withColumn("c", place)
    own = F.col("id") - pick([0, *ends[:-1]]) + 1
    family = F.lit(None).cast("long") if families is None else (F.col("id") + 1) % pick([families[c] for c in counts]) + 1
    lang = interleaved(F.col("id") + 1, zh, ends[-1]) if families is None else interleaved(own, zh, ends[-1])
    return rows.select((F.col("id") + 1).alias("nth"), pick(list(counts)).alias("category"), own.alias("nth_of_category"), lang.alias("lang"), family.cast("long").alias("family"))


def by_family(spark: SparkSession, families: tuple[str, ...], each: int, en: int, seed: str) -> DataFrame:
    """``family, nth, lang, label, variant, reference`` of ``each`` tasks per family, the first ``en`` English; labels take turns.

    References are six digits of a hash of the seed, the family and the number.
    """
    rows = spark.range(len(families) * each).select(F.element_at(F.array(*map(F.lit, families)), F.floor(F.col("id") / each).cast("int") + 1).alias("family"), (F.col("id") % each).alias("nth"))
    labels = F.coalesce(*[F.when(F.col("family") == f, F.array(*map(F.lit, LABELS[f]))) for f in families if f in LABELS], F.array().cast("array<string>"))
    reference = F.lpad((F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "family", F.col("nth").cast("string")), 256), 1, 8), 16, 10).cast("long") % 1_000_000).cast("string"), 6, "0")
    rows = rows.withColumn("labels", labels)
    label = F.when(F.size("labels") > 0, F.try_element_at("labels", (F.col("nth") % F.greatest(F.size("labels"), F.lit(1)) + 1).cast("int")))
    return rows.select("family", "nth", F.when(F.col("nth") < en, "en").otherwise("zh").alias("lang"), label.alias("label"), F.when(F.size("labels") > 0, F.floor(F.col("nth") / F.size("labels"))).alias("variant"), reference.alias("reference"))


def domain_set(spark: SparkSession, offsets: tuple[int, ...] = (0,)) -> DataFrame:
    """``batch, offset, category, nth, lang`` of the domain set, once per offset; a category's English items come first."""
    totals, english = ({c: pair[i] for c, pair in DOMAIN.items()} for i in (0, 1))
    rows = by_category(spark, totals, 0).select("category", (F.col("nth_of_category") - 1).alias("nth"))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in english.items() for x in pair]), F.col("category"))
    batches = F.array(*[F.struct(F.lit(i + 1).alias("batch"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)])
    return rows.select(F.inline(batches), "category", "nth", F.when(F.col("nth") < limit, "en").otherwise("zh").alias("lang"))


def synthetic_generations(tasks: DataFrame, nth: str, answer: str, candidates: int, seed: int) -> DataFrame:
    """``nth, candidate, seed, raw_output`` for every task: its answer after a think block; every fifth task's first candidate has none."""
    rows = tasks.select(nth, answer, F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("candidate"))
    bad = (F.col("candidate") == 0) & (F.col(nth) % 5 == 0)
    output = F.when(bad, "<think>rejected path</think>\n\nnot-json").otherwise(F.concat(F.lit("<think>fixed reasoning, no model's output</think>\n\n"), answer))
    return rows.select(nth, "candidate", ((F.lit(seed).cast("long") + F.col(nth) * 2 + F.col("candidate")) % (1 << 32)).alias("seed"), output.alias("raw_output"))
