"""Redaction, differences, aliases, metrics and gates, logs, answers, generated sets."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.functions import stats
from millrace.functions import text as X
from millrace.operators import generators, selection
from millrace.plans import calls, sampling  # noqa: F401  (registers what its SQL is taken from)
from millrace.plans.registry import ORACLES, register
from millrace.plans.tables import table
from millrace.session import shared_dir
from millrace.sources import files

_NESTED = """'{"a":[{"apiKey":"' || event_type || '","k":' || event_id || '}],"my_secret":' || event_id || ',"page":"' || event_type || '","z":{"Authorization":"x","token_":"y"}}'"""


@register("q_redact_json", f"""SELECT event_id, regexp_replace({_NESTED}, '"([^"]*(?i:token|secret|password|api[_-]?key|authorization)[^"]*)":("[^"]*"|[0-9]+)', '"\\1":"[REDACTED]"', 'g') AS redacted FROM events""")
def q_redact_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.redact_json(F.expr(_NESTED)).alias("redacted"))


@register(
    "q_changed_paths",
    """SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'a.x' END, CASE WHEN event_type = 'click' THEN 'a.y' END, CASE WHEN event_id % 3 = 0 THEN 'b' END, CASE WHEN user_id % 2 = 1 THEN 'c' END], lambda x: x IS NOT NULL) AS paths FROM events""",
)
def q_changed_paths(spark, sf_dir):
    old = F.to_json(F.struct(F.struct(F.lit(1).alias("x"), F.lit("click").alias("y")).alias("a"), F.lit(1).alias("b"), F.lit(2).alias("c")))
    a = F.struct((F.col("event_id") % 2).alias("x"), F.when(F.col("event_type") == "click", "other").otherwise("click").alias("y"))
    new = F.struct(a.alias("a"), F.when(F.col("event_id") % 3 > 0, 1).alias("b"), F.when(F.col("user_id") % 2 == 0, 2).otherwise(3).alias("c"))
    return table(spark, sf_dir, "events").select("event_id", R.json_changes(old, F.to_json(new)).alias("paths"))


@register("q_alias_columns", "SELECT p_partkey, coalesce(nullif(trim(a), ''), nullif(trim(b), '')) AS value, coalesce(nullif(trim(a), '') <> nullif(trim(b), ''), false) AS conflict FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_brand END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand END AS b FROM part)")
def q_alias_columns(spark, sf_dir):
    k = F.col("p_partkey")
    value, conflict = files.alias(F.when(k % 3 == 0, None).when(k % 7 == 0, " ").otherwise(F.col("p_brand")), F.when(k % 5 == 0, F.col("p_type")).when(k % 2 == 0, F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("value"), conflict.alias("conflict"))


@register("q_record_fingerprint", """SELECT fingerprint, count(*) AS n, min(conv_id) AS conv_id FROM (SELECT conv_id, sha256('[' || string_agg('{"role":"' || role || '","content":' || to_json(text) || '}', ',' ORDER BY turn) || ']') AS fingerprint FROM conversations GROUP BY conv_id) GROUP BY 1""")
def q_record_fingerprint(spark, sf_dir):
    """What a conversation says, whatever its and its calls' ids are."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    body = F.to_json(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m")).select("conv_id", F.sha2(body, 256).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))


@register(
    "q_failure_control",
    """WITH r AS (SELECT source, n_chars, quality = 0 AS failed FROM documents JOIN labels USING (doc_id) WHERE toxic = 0), f AS (SELECT DISTINCT source FROM r WHERE failed) SELECT failed, count(*) AS n, min(n_chars) AS least, list_sort(list(n_chars))[(round_even((count(*) - 1) * 0.5, 0) + 1)::INT] AS middle, max(n_chars) AS most, round_even(sum(n_chars) * 1000 / count(*), 0)::BIGINT AS mean_milli FROM r SEMI JOIN f ON r.source IS NOT DISTINCT FROM f.source GROUP BY failed""",
)
def q_failure_control(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id").select("source", "n_chars", (F.col("quality") == 0).alias("failed"))
    failing = rows.where("failed").select(F.col("source").alias("of")).distinct()
    matched = rows.join(failing, F.col("source").eqNullSafe(F.col("of")), "left_semi")
    middle = stats.by_index(matched, ["failed"], "n_chars", {"middle": stats.percentile_even(0.5)}).withColumnRenamed("failed", "f")
    figures = matched.groupBy("failed").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.bround(F.sum("n_chars") * 1000 / F.count("*")).cast("long").alias("mean_milli"))
    return figures.join(middle, F.col("failed") == F.col("f")).drop("f")


@register(
    "q_cluster_key",
    """SELECT p_partkey, CASE WHEN len(p) = 1 THEN 'pair:' || p_type || ':' || substr(p[1], 16) WHEN len(p) = 0 AND list_contains(tags, 'english-only') THEN 'singleton:' || p_partkey ELSE 'invalid' END AS cluster FROM (SELECT *, list_filter(tags, lambda t: starts_with(t, 'bilingual-pair-')) AS p FROM (SELECT p_partkey, p_type, string_split(CASE p_partkey % 5 WHEN 0 THEN 'english-only' WHEN 1 THEN 'bilingual-pair-' || p_size || ',x' WHEN 2 THEN 'bilingual-pair-1,bilingual-pair-2' WHEN 3 THEN 'y,bilingual-pair-' || p_size ELSE 'z' END, ',') AS tags FROM part))""",
)
def q_cluster_key(spark, sf_dir):
    k, pair = F.col("p_partkey") % 5, F.concat(F.lit("bilingual-pair-"), F.col("p_size").cast("string"))
    tags = F.split(F.when(k == 0, "english-only").when(k == 1, F.concat(pair, F.lit(",x"))).when(k == 2, "bilingual-pair-1,bilingual-pair-2").when(k == 3, F.concat(F.lit("y,"), pair)).otherwise("z"), ",")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", tags.alias("tags"))
    pairs = F.filter("tags", lambda t: F.startswith(t, F.lit("bilingual-pair-")))
    cluster = F.when(F.size(pairs) == 1, F.concat(F.lit("pair:"), "p_type", F.lit(":"), F.substring(pairs[0], 16, 1000))).when((F.size(pairs) == 0) & F.array_contains("tags", "english-only"), F.concat(F.lit("singleton:"), F.col("p_partkey").cast("string"))).otherwise("invalid")
    return rows.select("p_partkey", cluster.alias("cluster"))


_RESULT = """'{"task":"' || p_brand || '","acc":' || CASE WHEN p_partkey % 11 = 0 THEN '1.5' WHEN p_partkey % 13 = 0 THEN '"high"' ELSE '0.25' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ',"samples":' || p_size END || '}'"""


@register("q_external_results", f"""SELECT p_partkey, CASE WHEN try_cast(json_extract(raw, '$.acc') AS DOUBLE) IS NULL OR json_type(raw, '$.acc') = 'VARCHAR' THEN 'invalid_metric' WHEN json_extract(raw, '$.acc')::DOUBLE NOT BETWEEN 0 AND 1 THEN 'metric_out_of_range' WHEN json_extract(raw, '$.samples') IS NULL THEN 'missing_samples' WHEN json_extract(raw, '$.samples')::INT <> 20 THEN 'sample_count_mismatch' ELSE 'ok' END AS status FROM (SELECT p_partkey, {_RESULT} AS raw FROM part)""")
def q_external_results(spark, sf_dir):
    v = F.try_parse_json(F.expr(_RESULT))
    acc, samples = F.try_variant_get(v, "$.acc", "double"), F.try_variant_get(v, "$.samples", "int")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.acc", "variant"))
    status = F.when(acc.isNull() | (kind == "STRING"), "invalid_metric").when(~acc.between(0, 1), "metric_out_of_range").when(samples.isNull(), "missing_samples").when(samples != 20, "sample_count_mismatch").otherwise("ok")
    return table(spark, sf_dir, "part").select("p_partkey", status.alias("status"))


@register("q_benchmark_evidence", "SELECT event_id, event_type, user_id FROM events WHERE value > 0")
def q_benchmark_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"), F.when(F.col("value") > 0, "pass").otherwise("fail").alias("status"))
    return files.benchmark_evidence(rows, ["event_id"]).select("event_id", "event_type", "user_id")


@register("q_event_log", "SELECT user_id, event_id, event_type FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id > 50 AND (last IS NULL OR event_id <= last)")
def q_event_log(spark, sf_dir):
    """Two appends to a log, then what follows the cursor up to each user's first purchase."""
    path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    files.append_log(rows.where("user_id % 2 = 0"), path)
    files.append_log(rows.where("user_id % 2 <> 0"), path)
    log = files.read_jsonl(spark, path, rows.schema)
    return files.follow(log, "user_id", "event_id", F.col("event_type") == "purchase", 50)


_RATES = {"tool_selection": "tool_selection", "arguments": "arguments", "schema_valid": "schema_valid", "no_tool": "no_tool", "multi_step": "multi_step", "success": "success", "hallucination": "hallucination", "recovery": "recovery", "grounding": "grounding", "approval_safe": "approval_safe"}
_RATES_SQL = ", ".join(f"coalesce(round_even(avg({c}::INT) * 10000, 0), 10000)::BIGINT AS {c}_bp" for c in _RATES)


def _rates(spark, sf_dir):
    rate = lambda c: F.coalesce(F.bround(F.avg(F.col(c).cast("int")) * 10_000), F.lit(10_000)).cast("long").alias(f"{c}_bp")
    return calls.q_task_scoring(spark, sf_dir).agg(F.count("*").alias("n"), *map(rate, _RATES))


@register("q_agent_metrics", f"SELECT count(*) AS n, {_RATES_SQL} FROM ({ORACLES['q_task_scoring']})")
def q_agent_metrics(spark, sf_dir):
    """Ten rates, each over the runs that it is asked of."""
    return _rates(spark, sf_dir)


#: (metric, kind of check, limit): thirteen checks of one gate.
CHECKS = [
    ("n", "gte", 100), ("tool_selection_bp", "gte", 5000), ("arguments_bp", "gte", 2000), ("schema_valid_bp", "gte", 6000), ("no_tool_bp", "gte", 9000), ("multi_step_bp", "gt", 1000), ("success_bp", "gt", 0),
    ("hallucination_bp", "lte", 5000), ("recovery_bp", "gte", 5000), ("grounding_bp", "gte", 6000), ("approval_safe_bp", "eq", 10_000), ("approval_safe_bp", "lt", 10_000), ("missing_bp", "gte", 0),
]
_CHECKS_SQL = ", ".join(f"('{m}', '{k}', {x})" for m, k, x in CHECKS)


@register(
    "q_agent_gate",
    f"""WITH v AS (SELECT count(*) AS n, {_RATES_SQL} FROM ({ORACLES['q_task_scoring']})), u AS (UNPIVOT v ON COLUMNS(*) INTO NAME metric VALUE value), c(metric, kind, limit_) AS (VALUES {_CHECKS_SQL}), j AS (SELECT metric, kind, limit_, value, coalesce(CASE kind WHEN 'gte' THEN value >= limit_ WHEN 'gt' THEN value > limit_ WHEN 'lte' THEN value <= limit_ WHEN 'lt' THEN value < limit_ ELSE value = limit_ END, false) AS passed FROM c LEFT JOIN u USING (metric))
    SELECT metric, kind, limit_, value, passed, (SELECT bool_and(passed) FROM j) AS all_passed FROM j""",
)
def q_agent_gate(spark, sf_dir):
    """A missing metric fails its check."""
    values = _rates(spark, sf_dir)
    long = values.unpivot([], values.columns, "metric", "value")
    limits = spark.createDataFrame(CHECKS, "metric string, kind string, limit_ int")
    v, x = F.col("value"), F.col("limit_")
    ok = F.when(F.col("kind") == "gte", v >= x).when(F.col("kind") == "gt", v > x).when(F.col("kind") == "lte", v <= x).when(F.col("kind") == "lt", v < x).otherwise(v == x)
    checked = limits.join(long, "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))
    return checked.select("metric", "kind", "limit_", "value", "passed", F.every("passed").over(Window.partitionBy()).alias("all_passed"))  # a row per check


_SAID = "replace(replace(text, ', ', CASE WHEN turn % 3 = 0 THEN ', ' ELSE '<think>' END), '. ', CASE WHEN turn % 2 = 0 THEN '</think>  ' ELSE '. ' END)"
_MARK = "list_min(list_filter([instr({0}, '<think>'), instr({0}, '</think>')], lambda x: x > 0))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


@register(
    "q_final_answer",
    f"""WITH r AS (SELECT conv_id, turn, {_SAID} AS raw FROM conversations), p AS (SELECT *, trim(raw, {_BLANKS}) AS whole, CASE WHEN instr(raw, '</think>') > 0 THEN trim(substr(raw, instr(raw, '</think>') + 8), {_BLANKS}) ELSE '' END AS tail, (len(raw) - len(replace(raw, '</think>', ''))) // 8 AS n FROM r),
    a AS (SELECT conv_id, turn, whole AS plain, CASE WHEN {_MARK.format('raw')} IS NULL THEN whole ELSE trim(substr(raw, 1, {_MARK.format('raw')} - 1), {_BLANKS}) END AS stopped, CASE WHEN n = 1 THEN tail ELSE '' END AS thought, CASE WHEN {_MARK.format('tail')} IS NULL THEN tail ELSE trim(substr(tail, 1, {_MARK.format('tail')} - 1), {_BLANKS}) END AS cut FROM p)
    SELECT conv_id, turn, sha256(plain) AS plain, plain <> '' AND {_MARK.format('plain')} IS NULL AS plain_valid, {_MARK.format('plain')} IS NOT NULL AS leaked, sha256(stopped) AS stopped, sha256(thought) AS thought, thought <> '' AND {_MARK.format('thought')} IS NULL AS thought_valid, sha256(cut) AS cut, cut <> '' AS cut_valid FROM a""",
)
def q_final_answer(spark, sf_dir):
    raw = F.expr(_SAID)
    ways = [R.final_answer(raw, thinking, stop).alias(n) for n, thinking, stop in (("a", False, False), ("b", False, True), ("c", True, False), ("d", True, True))]
    h = lambda c: F.sha2(f"{c}.answer", 256)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *ways).select("conv_id", "turn", h("a").alias("plain"), F.col("a.valid").alias("plain_valid"), F.col("a.leaked").alias("leaked"), h("b").alias("stopped"), h("c").alias("thought"), F.col("c.valid").alias("thought_valid"), h("d").alias("cut"), F.col("d.valid").alias("cut_valid"))


_JSON_SAID = """CASE event_id % 4 WHEN 0 THEN '{"k": ' || (event_id % 100) || '.0}' WHEN 1 THEN props WHEN 2 THEN '[1]' ELSE 'x' END"""


@register(
    "q_five_scorers",
    f"""SELECT event_id, kind, CASE kind WHEN 'exact' THEN lower(trim(event_type)) = 'click' WHEN 'choice' THEN event_type = 'view' WHEN 'json' THEN coalesce(json_type(ok) = 'OBJECT' AND json_extract(ok, '$.k')::DOUBLE = json_extract(props, '$.k')::DOUBLE, false) WHEN 'terms' THEN contains(event_type, 'c') AND NOT contains(event_type, 'k') END AS correct, kind = 'rubric' AS review
    FROM (SELECT *, CASE WHEN json_valid({_JSON_SAID}) THEN {_JSON_SAID} END AS ok, (['exact', 'choice', 'json', 'terms', 'rubric'])[(user_id % 5 + 1)::INT] AS kind FROM events)""",
)
def q_five_scorers(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["exact", "choice", "json", "terms", "rubric"])), (F.col("user_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.expr(_JSON_SAID).alias("said"), kind.alias("kind"))
    t = F.col("event_type")
    equal = F.coalesce(R.same_json("said", "props"), F.lit(False))
    correct = F.when(F.col("kind") == "exact", F.lower(X.strip(t)) == "click").when(F.col("kind") == "choice", X.strip(t) == "view").when(F.col("kind") == "json", equal).when(F.col("kind") == "terms", t.contains("c") & ~t.contains("k"))
    return rows.select("event_id", "kind", correct.alias("correct"), (F.col("kind") == "rubric").alias("review"))


@register(
    "q_repetition_distribution",
    f"""SELECT lang, min(unique_bp) AS least, list_sort(list(unique_bp))[(ceil(count(*) * 0.5))::INT] AS p50, list_sort(list(unique_bp))[(ceil(count(*) * 0.9))::INT] AS p90, max(unique_bp) AS most FROM ({ORACLES['q_repetition_metrics']}) JOIN documents USING (doc_id) GROUP BY lang""",
)
def q_repetition_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", X.repetition(F.col("text"))["unique_bp"].alias("u"))
    at = stats.by_index(rows, ["lang"], "u", {"least": lambda n: F.lit(0), "p50": stats.percentile_nearest(0.5), "p90": stats.percentile_nearest(0.9), "most": lambda n: n - 1})
    return at.select("lang", "least", "p50", "p90", "most")


_PIECE = """CASE WHEN turn = last THEN '[DONE]' WHEN conv_id % 4 = 0 THEN 'hi ' || turn ELSE substr('{"name": "' || CASE WHEN conv_id % 5 = 0 THEN 'none' ELSE 'look' END || '", "arguments": {"a": ' || conv_id || '}}', CAST(turn * 12 + 1 AS INT), 12) END"""


@register(
    "q_stream_repair",
    f"""WITH c AS (SELECT conv_id, turn, {_PIECE} AS chunk FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)),
    s AS (SELECT *, string_agg(CASE WHEN chunk <> '[DONE]' THEN chunk ELSE '' END, '') OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM c), v AS (SELECT *, starts_with(so_far, '{{') AS held, json_valid(so_far) AND conv_id % 5 <> 0 AS whole FROM s),
    w AS (SELECT *, coalesce(bool_or(whole) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM v)
    SELECT conv_id, turn, CASE WHEN chunk = '[DONE]' THEN CASE WHEN held AND NOT done THEN 'error:tool_parser_error' ELSE chunk END WHEN done OR chunk = '' THEN NULL WHEN NOT held THEN chunk WHEN whole THEN '{{"arguments":{{"a":' || conv_id || '}},"id":"call_' || substr(sha256(so_far), 1, 24) || '","name":"look"}}' END AS out FROM w""",
)
def q_stream_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = rows.groupBy(F.col("conv_id").alias("of")).agg(F.max("turn").alias("last"))
    chunks = rows.join(last, F.col("conv_id") == F.col("of")).select("conv_id", "turn", F.expr(_PIECE).alias("chunk"))
    return selection.repair_stream(chunks, "conv_id", "turn", "chunk", frozenset(["look"])).select("conv_id", "turn", "out")


def _set_sql(counts, zh, families=None):
    total, start, parts = sum(counts.values()), 0, []
    for c, n in counts.items():
        i = "g" if families is None else "o"
        parts.append(f"SELECT {start} + o AS nth, '{c}' AS category, o AS nth_of_category, CASE WHEN ({i} * {zh}) // {total} > (({i} - 1) * {zh}) // {total} THEN 'zh' ELSE 'en' END AS lang, {f'({start} + o) % {families[c]} + 1' if families else 'NULL'}::BIGINT AS family FROM (SELECT o, {start} + o AS g FROM (SELECT unnest(range(1, {n + 1})) AS o))")
        start += n
    return " UNION ALL ".join(parts)


@register("q_agent_suite_dev", _set_sql(generators.DEV, 24))
def q_agent_suite_dev(spark, sf_dir):
    return generators.by_category(spark, generators.DEV, 24)


@register("q_agent_suite_release", _set_sql(generators.RELEASE, 48))
def q_agent_suite_release(spark, sf_dir):
    return generators.by_category(spark, generators.RELEASE, 48)


@register("q_trajectory_set", _set_sql(generators.TRAJECTORIES, 720, generators.FAMILIES))
def q_trajectory_set(spark, sf_dir):
    return generators.by_category(spark, generators.TRAJECTORIES, 720, generators.FAMILIES)


def _family_sql(families, each, en, seed):
    parts = []
    for f in families:
        labels = generators.LABELS.get(f)
        label = f"({list(labels)})[(nth % {len(labels)} + 1)::INT]" if labels else "NULL"
        variant = f"nth // {len(labels)}" if labels else "NULL"
        parts.append(f"SELECT '{f}' AS family, nth, CASE WHEN nth < {en} THEN 'en' ELSE 'zh' END AS lang, {label}::VARCHAR AS label, {variant}::BIGINT AS variant, lpad((('0x' || substr(sha256('{seed}:{f}:' || nth), 1, 8))::BIGINT % 1000000)::VARCHAR, 6, '0') AS reference FROM (SELECT unnest(range(0, {each})) AS nth)")
    return " UNION ALL ".join(parts)


_FAMILY_SETS = {"q_reasoning_dev_set": (generators.REASONING, 40, 28, "dev"), "q_pilot_set": (generators.REASONING, 100, 70, "pilot"), "q_evidence_set": (tuple(generators.LABELS), 20, 14, "p0"), "q_formal_set": (tuple(generators.LABELS), 120, 84, "formal")}


def _family_set(name):
    families, each, en, seed = _FAMILY_SETS[name]

    @register(name, _family_sql(families, each, en, seed))
    def made(spark, sf_dir):
        return generators.by_family(spark, families, each, en, seed)

    return made


for _name in _FAMILY_SETS:
    _family_set(_name)


def _domain_sql(offsets):
    parts = [f"SELECT {i + 1} AS batch, {o} AS \"offset\", '{c}' AS category, nth, CASE WHEN nth < {en} THEN 'en' ELSE 'zh' END AS lang FROM (SELECT unnest(range(0, {n})) AS nth)" for i, o in enumerate(offsets) for c, (n, en) in generators.DOMAIN.items()]
    return " UNION ALL ".join(parts)


@register("q_domain_set", _domain_sql((0,)))
def q_domain_set(spark, sf_dir):
    return generators.domain_set(spark)


@register("q_generalization_set", _domain_sql(generators.OFFSETS))
def q_generalization_set(spark, sf_dir):
    return generators.domain_set(spark, generators.OFFSETS)


@register("q_repair_set", _set_sql(generators.REPAIR, 204))
def q_repair_set(spark, sf_dir):
    return generators.by_category(spark, generators.REPAIR, 204)


@register(
    "q_synthetic_generations",
    """SELECT event_id, c::INT AS candidate, (4294967290 + event_id * 2 + c) % 4294967296 AS seed, CASE WHEN c = 0 AND event_id % 5 = 0 THEN '<think>rejected path</think>' || chr(10) || chr(10) || 'not-json' ELSE '<think>fixed reasoning, no model''s output</think>' || chr(10) || chr(10) || props END AS raw_output FROM events, (SELECT unnest([0, 1]) AS c)""",
)
def q_synthetic_generations(spark, sf_dir):
    return generators.synthetic_generations(table(spark, sf_dir, "events"), "event_id", "props", 2, 4_294_967_290)
