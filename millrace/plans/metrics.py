"""Percentiles, rates, matrices, gates, scorers, parsers, retrieval, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import parsing, stats
from millrace.functions.text import even_bp
from millrace.operators import retrieval
from millrace.plans.registry import register
from millrace.plans.tables import table
from millrace.session import let, spread

_IDX = "list_sort(list(value))[({i} + 1)::INT]"


@register(
    "q_percentiles",
    f"""SELECT event_type, quantile_cont(value, 0.95) AS a, {_IDX.format(i='floor((count(*) - 1) * 0.95)')} AS b, {_IDX.format(i='ceil(count(*) * 0.95) - 1')} AS c,
    {_IDX.format(i='greatest(1, least(count(*), floor(0.975 * count(*) + 0.999999999999))) - 1')} AS d, {_IDX.format(i='round_even((count(*) - 1) * 0.975, 0)')} AS e, {_IDX.format(i='ceil(count(*) * 0.9) - 1')} AS f, median(value) AS med FROM events GROUP BY event_type""",
)
def q_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    picks = {"b": stats.percentile_floor(0.95), "c": stats.percentile_nearest(0.95), "d": stats.percentile_clamped(0.975), "e": stats.percentile_even(0.975), "f": stats.percentile_nearest(0.9)}
    smooth = stats.quantiles(events, ["event_type"], "value", {"a": 0.95, "med": 0.5})
    return stats.by_index(events, ["event_type"], "value", picks).join(smooth, "event_type").select("event_type", "a", "b", "c", "d", "e", "f", "med")


@register("q_timing_summary", "SELECT event_type, count(*) AS n, sum(round(v * 100)::BIGINT)::BIGINT AS total_cents, min(v) AS least, median(v) AS med, max(v) AS most FROM (SELECT event_type, value AS v FROM events WHERE value > 0 AND isfinite(value)) GROUP BY event_type")
def q_timing_summary(spark, sf_dir):
    v = table(spark, sf_dir, "events").where("value > 0 AND NOT isnan(value) AND abs(value) < double('Infinity')").select("event_type", F.col("value").alias("v"))
    figures = v.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("v") * 100).cast("long")).alias("total_cents"), F.min("v").alias("least"), F.max("v").alias("most"))
    return figures.join(stats.quantiles(v, ["event_type"], "v", {"med": 0.5}), "event_type")


@register(
    "q_metric_rates",
    """SELECT source, count(*) AS n_items, coalesce(round_even(avg(quality) * 10000, 0), 10000)::BIGINT AS quality_bp, coalesce(round_even(avg(toxic) * 10000, 0), 10000)::BIGINT AS toxic_bp, coalesce(round_even(avg(CASE WHEN quality = 1 THEN toxic END) * 10000, 0), 10000)::BIGINT AS toxic_of_good_bp, round_even(sum(n_chars) * 1000 / count(*), 0)::BIGINT AS mean_chars_milli
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def q_metric_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rate = lambda c: F.coalesce(F.bround(F.avg(c) * 10_000), F.lit(10_000)).cast("long")
    return rows.groupBy("source").agg(F.count("*").alias("n_items"), rate(F.col("quality")).alias("quality_bp"), rate(F.col("toxic")).alias("toxic_bp"), rate(F.when(F.col("quality") == 1, F.col("toxic"))).alias("toxic_of_good_bp"), F.bround(F.sum("n_chars") * 1000 / F.count("*")).cast("long").alias("mean_chars_milli"))


@register("q_macro_average", "SELECT round_even(avg(r) * 10000, 0)::BIGINT AS macro_bp, count(*) AS n_tasks FROM (SELECT source, avg(quality) AS r FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def q_macro_average(spark, sf_dir):
    per = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("r"))
    return per.agg(F.bround(F.avg("r") * 10_000).cast("long").alias("macro_bp"), F.count("*").alias("n_tasks"))


@register(
    "q_scaling_matrix",
    """WITH c AS (SELECT event_type, user_id % 4 AS world, count(*) AS n, median(value) AS med, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2 HAVING count(*) >= 3), b AS (SELECT event_type, med AS base FROM c WHERE world = 0)
    SELECT c.event_type, world, n, med, least, most, round_even(med * 10000 / base, 0)::BIGINT AS efficiency_bp FROM c JOIN b USING (event_type)""",
)
def q_scaling_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("world"), "value")
    cells = rows.groupBy("event_type", "world").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).where("n >= 3")
    cells = cells.join(stats.quantiles(rows, ["event_type", "world"], "value", {"med": 0.5}), ["event_type", "world"])
    base = F.first(F.when(F.col("world") == 0, F.col("med")), ignorenulls=True).over(Window.partitionBy("event_type"))
    return cells.withColumn("efficiency_bp", F.bround(F.col("med") * 10_000 / base).cast("long")).where("efficiency_bp is not null")


@register(
    "q_latency_cells",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, median(value) FILTER (event_type = 'click') AS click_med, median(value) FILTER (event_type = 'view') AS view_med,
    round_even(median(value) FILTER (event_type = 'click') * 10000 / median(value) FILTER (event_type = 'view'), 0)::BIGINT AS ratio_bp FROM events GROUP BY 1""",
)
def q_latency_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    of = lambda k: F.count_if(F.col("event_type") == k)
    counts = rows.groupBy("day").agg(of("click").alias("clicks"), of("view").alias("views"))
    middle = stats.quantiles(rows.where("event_type in ('click', 'view')"), ["day", "event_type"], "value", {"med": 0.5})
    med = lambda k: F.max(F.when(F.col("event_type") == k, F.col("med"))).alias(f"{k}_med")
    both = counts.join(middle.groupBy("day").agg(med("click"), med("view")), "day", "left")
    return both.withColumn("ratio_bp", F.bround(F.col("click_med") * 10_000 / F.col("view_med")).cast("long"))


@register(
    "q_threshold_projection",
    """SELECT t AS threshold, lang, count(*) FILTER (n_chars <= t) AS n_within, round_even(count(*) FILTER (n_chars <= t) * 10000 / count(*), 0)::BIGINT AS within_bp FROM documents, (SELECT unnest([500, 1000, 2000, 4000, 8000]) AS t) GROUP BY 1, 2""",
)
def q_threshold_projection(spark, sf_dir):
    limits = [500, 1000, 2000, 4000, 8000]
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col("n_chars") <= t).alias(f"t{t}") for t in limits])
    rows = counts.select("lang", "n", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_within")) for t in limits])))
    return rows.select("threshold", "lang", "n_within", even_bp(F.col("n_within"), F.col("n")).alias("within_bp"))


@register(
    "q_smallest_passing_threshold",
    """SELECT min(t) AS threshold FROM (SELECT t, bool_and(ok) AS ok FROM (SELECT t, lang, count(*) FILTER (n_chars <= t) * 10000 >= 9000 * count(*) AS ok FROM documents, (SELECT unnest(range(500, 20001, 500)) AS t) GROUP BY 1, 2) GROUP BY t) WHERE ok""",
)
def q_smallest_passing_threshold(spark, sf_dir):
    limits = F.explode(F.sequence(F.lit(500).cast("long"), F.lit(20000).cast("long"), F.lit(500).cast("long")))
    # The smallest limit that covers a document: one row per language and limit is left to sum up.
    need = table(spark, sf_dir, "documents").groupBy("lang", (F.ceil(F.col("n_chars") / 500) * 500).alias("need")).agg(F.count("*").alias("c"))
    per = need.groupBy("lang").agg(F.collect_list(F.struct("need", "c")).alias("x"), F.sum("c").alias("n"))
    rows = per.select("lang", "n", "x", limits.alias("t"))
    within = F.aggregate(F.filter("x", lambda e: e["need"] <= F.col("t")), F.lit(0).cast("long"), lambda a, e: a + e["c"])
    return rows.groupBy("t").agg(F.every(within * 10_000 >= F.col("n") * 9000).alias("ok")).where("ok").agg(F.min("t").alias("threshold"))


@register(
    "q_format_slices",
    """SELECT lang, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars >= 500 AND n_chars < 5000) AS medium, count(*) FILTER (n_chars >= 5000) AS long FROM documents GROUP BY lang""",
)
def q_format_slices(spark, sf_dir):
    kind = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return table(spark, sf_dir, "documents").select("lang", kind.alias("kind")).groupBy("lang").pivot("kind", ["short", "medium", "long"]).count().na.fill(0)


@register("q_rollup_accuracy", "SELECT source, lang, count(*) AS n, coalesce(sum(quality), 0)::BIGINT AS n_ok FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)")
def q_rollup_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("source", "lang").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("n_ok"))


def _clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.sum(F.col("quality") - F.col("toxic")).alias("delta"), F.count("*").alias("n"))


@register("q_cluster_bootstrap")
def q_cluster_bootstrap(spark, sf_dir):
    return stats.cluster_bootstrap(_clusters(spark, sf_dir), "delta", "n", "source", seed=42)


@register(
    "q_hashed_bootstrap",
    """WITH c AS (SELECT source, sum(quality - toxic) AS delta, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source), r AS (SELECT unnest(range(0, 200)) AS replicate),
    w AS (SELECT replicate, delta, n, ('0x' || substr(sha256('boot:' || replicate || ':' || source), 1, 6))::BIGINT % 1000 AS h FROM c, r), x AS (SELECT *, CASE WHEN h < 368 THEN 0 WHEN h < 736 THEN 1 WHEN h < 920 THEN 2 ELSE 3 END AS w FROM w)
    SELECT replicate::INT AS replicate, CASE WHEN sum(w * n) > 0 THEN round_even(sum(w * delta) * 10000 / sum(w * n), 0)::BIGINT END AS delta_bp FROM x GROUP BY replicate""",
)
def q_hashed_bootstrap(spark, sf_dir):
    return stats.hashed_bootstrap(_clusters(spark, sf_dir), "delta", "n", "source")


@register(
    "q_gate_checks",
    """WITH m AS (SELECT 'quality_bp' AS metric, round_even(avg(quality) * 10000, 0)::BIGINT AS v FROM labels UNION ALL SELECT 'toxic_bp', round_even(avg(toxic) * 10000, 0)::BIGINT FROM labels UNION ALL SELECT 'n_labels', count(*) FROM labels UNION ALL SELECT 'event_types', count(DISTINCT event_type) FROM events),
    t(metric, op, limit_) AS (VALUES ('quality_bp', 'gte', 8000), ('toxic_bp', 'lte', 1000), ('n_labels', 'gt', 10), ('event_types', 'gte', 5))
    SELECT metric, op, limit_, v AS value, CASE op WHEN 'gte' THEN v >= limit_ WHEN 'gt' THEN v > limit_ ELSE v <= limit_ END AS passed FROM t LEFT JOIN m USING (metric)""",
)
def q_gate_checks(spark, sf_dir):
    labels, events = table(spark, sf_dir, "labels"), table(spark, sf_dir, "events")
    bp = lambda c: F.bround(F.avg(c) * 10_000).cast("long")
    metrics = labels.agg(bp("quality").alias("quality_bp"), bp("toxic").alias("toxic_bp"), F.count("*").alias("n_labels")).unpivot([], ["quality_bp", "toxic_bp", "n_labels"], "metric", "value")
    metrics = metrics.unionByName(events.agg(F.count_distinct("event_type").alias("event_types")).unpivot([], ["event_types"], "metric", "value"))
    limits = spark.createDataFrame([("quality_bp", "gte", 8000), ("toxic_bp", "lte", 1000), ("n_labels", "gt", 10), ("event_types", "gte", 5)], "metric string, op string, limit_ int")
    ok = F.when(F.col("op") == "gte", F.col("value") >= F.col("limit_")).when(F.col("op") == "gt", F.col("value") > F.col("limit_")).otherwise(F.col("value") <= F.col("limit_"))
    return limits.join(metrics, "metric", "left").select("metric", "op", "limit_", "value", ok.alias("passed"))


@register(
    "q_ablation_select",
    """WITH a AS (SELECT (doc_id % 3)::INT AS arm, round_even(avg(quality) * 10000, 0)::BIGINT AS bp FROM labels GROUP BY 1), m AS (SELECT max(bp) AS best FROM a) SELECT min(arm) AS arm, any_value(best) AS best_bp FROM a, m WHERE best - bp < 100""",
)
def q_ablation_select(spark, sf_dir):
    arms = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 3).cast("int").alias("arm")).agg(F.bround(F.avg("quality") * 10_000).cast("long").alias("bp"))
    # Of (bp, arm) pairs the best goes along with each: an aggregate of few arms.
    found = arms.agg(F.max("bp").alias("best_bp"), F.collect_list(F.struct("arm", "bp")).alias("arms"))
    near = F.filter("arms", lambda a: F.col("best_bp") - a["bp"] < 100)
    return found.select(F.array_min(F.transform(near, lambda a: a["arm"])).alias("arm"), "best_bp")


@register("q_lr_schedule", "SELECT s AS step, round(1e9::DOUBLE * CASE WHEN s >= 1000 THEN 0.0 WHEN s < 50 THEN (s + 1) / 50.0::DOUBLE ELSE 0.5 * (1.0 + cos(pi() * ((s - 50) / 950.0::DOUBLE))) END)::BIGINT AS multiplier_nano FROM (SELECT unnest(range(0, 1010)) AS s)")
def q_lr_schedule(spark, sf_dir):
    return spark.range(0, 1010).select(F.col("id").alias("step"), F.round(1e9 * stats.warmup_cosine(F.col("id"), 1000, 50)).cast("long").alias("multiplier_nano"))


@register(
    "q_scorers",
    """SELECT doc_id, trim(text) = trim(first_line) AS exact_match, (list_has_all(w, ['the', 'and']) AND NOT list_contains(w, 'idiot')) AS terms_match, CASE WHEN starts_with(text, 'The') THEN 0 WHEN starts_with(text, 'De') THEN 1 END::INT AS choice FROM
    (SELECT doc_id, text, split_part(text, chr(10), 1) AS first_line, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""",
)
def q_scorers(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    terms = let(words, lambda w: F.array_contains(w, "the") & F.array_contains(w, "and") & ~F.array_contains(w, "idiot"))
    choice = F.when(F.col("text").startswith("The"), 0).when(F.col("text").startswith("De"), 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", (F.trim("text") == F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("exact_match"), terms.alias("terms_match"), choice.alias("choice"))


_RAW = """CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '<think>' || role || '</think> ' || text || ' <|im_end|>' WHEN 2 THEN '<think></think>' || text ELSE ' <think> a </think>' END"""


@register(
    "q_think_parse",
    f"""SELECT conv_id, turn, CASE WHEN reason IS NULL THEN reasoning END AS reasoning, CASE WHEN reason IS NULL THEN answer END AS answer, reason FROM (SELECT *, CASE WHEN NOT contains(raw, '<think>') THEN 'missing_think_block' WHEN reasoning = '' THEN 'empty_reasoning' WHEN answer = '' THEN 'empty_final_answer' END AS reason FROM (
    SELECT conv_id, turn, raw, trim(regexp_extract(raw, '(?s)<think>(.*)</think>', 1)) AS reasoning, regexp_replace(regexp_replace(regexp_extract(raw, '(?s)</think>(.*)$', 1), '<\\|im_end\\|>$', ''), '^[\\s]+|[\\s]+$', '', 'g') AS answer FROM (SELECT conv_id, turn, {_RAW} AS raw FROM conversations)))""",
)
def q_think_parse(spark, sf_dir):
    raw = F.expr(_RAW)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(F.array(parsing.think_block(raw))))
    return rows.select("conv_id", "turn", "reasoning", "answer", "reason")


@register(
    "q_call_parse",
    r"""WITH r AS (SELECT conv_id, turn, '[search(query=' || chr(39) || regexp_replace(text, '[\x27\\\n]', '', 'g') || chr(39) || ', limit=' || turn || '), open(id=[1, 2])' || CASE WHEN turn % 3 = 2 THEN '' ELSE ']' END AS raw FROM conversations), p AS (SELECT *, regexp_matches(raw, '(?s)^\[search\(query=\x27[^\x27]*\x27, limit=[0-9]+\), open\(id=\[1, 2\]\)\]$') AS ok FROM r)
    SELECT conv_id, turn, CASE WHEN ok THEN '[{"arguments":{"limit":' || regexp_extract(raw, ', limit=([0-9]+)\), open', 1) || ',"query":' || to_json(regexp_extract(raw, '(?s)query=\x27([^\x27]*)\x27', 1)) || '},"name":"search"},{"arguments":{"id":[1,2]},"name":"open"}]' END AS value, CASE WHEN ok THEN 'ok' ELSE 'malformed_tool_call' END AS status FROM p""",
)
def q_call_parse(spark, sf_dir):
    text = F.concat(F.lit("[search(query='"), F.regexp_replace("text", r"['\\\n]", ""), F.lit("', limit="), F.col("turn").cast("string"), F.lit("), open(id=[1, 2])")) 
    raw = F.when(F.col("turn") % 3 == 2, text).otherwise(F.concat(text, F.lit("]")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.parse_calls(raw).alias("p")).select("conv_id", "turn", "p.value", "p.status")


@register("q_props_json", "SELECT event_id, json_extract_string(props, '$.page') AS page, list_sort(json_keys(props)) AS keys FROM events")
def q_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.array_sort(F.json_object_keys("props")).alias("keys"))


@register(
    "q_chunks",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), m AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM l), s AS (SELECT doc_id, l, unnest(range(0, len(l), 35)) AS s FROM m WHERE len(l) > 0),
    e AS (SELECT doc_id, s + 1 AS start_line, least(len(l), s + 40)::BIGINT AS end_line, regexp_replace(array_to_string(l[s + 1:s + 40], chr(10)), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS excerpt FROM s WHERE s = 0 OR s + 5 < len(l)) SELECT * FROM e WHERE excerpt <> ''""",
)
def q_chunks(spark, sf_dir):
    return retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


_TERMS = ["license", "the", "general", "public"]


@register(
    "q_bm25",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), q AS (SELECT unnest({_TERMS}) AS t), f AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
    c AS (SELECT doc_id, t, len(w) AS l, len(list_filter(w, lambda x: x = t)) AS tf FROM d, q), x AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM c GROUP BY t)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 9) AS score FROM c JOIN x USING (t), f GROUP BY doc_id HAVING sum(tf) > 0 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def q_bm25(spark, sf_dir):
    return retrieval.bm25(spread(table(spark, sf_dir, "documents")), "doc_id", "text", retrieval.query_terms("license THE general, public the"), 20).select("doc_id", F.round("score", 9).alias("score"))


@register("q_runs_list", "SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def q_runs_list(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@register("q_metrics_tail", "SELECT event_id, epoch_us(ts) AS at_us, value FROM (SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def q_metrics_tail(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).orderBy("ts", "event_id").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "value")


@register("q_run_id_parse", "SELECT event_id, run_id, regexp_extract(run_id, '^([0-9]{8}T[0-9]{6})Z-([a-z0-9-]+)-([0-9a-f]{8})$', 2) AS slug, epoch_us(strptime(regexp_extract(run_id, '^([0-9]{8}T[0-9]{6})Z-', 1), '%Y%m%dT%H%M%S')) AS at_us FROM (SELECT event_id, strftime(date_trunc('second', ts), '%Y%m%dT%H%M%S') || 'Z-' || rtrim(substr(trim(regexp_replace(lower(trim(event_type || ' #' || user_id)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') || '-' || substr(sha256(event_id::VARCHAR), 1, 8) AS run_id FROM events)")
def q_run_id_parse(spark, sf_dir):
    slug = F.rtrim(F.substring(F.btrim(F.regexp_replace(F.lower(F.trim(F.concat("event_type", F.lit(" #"), F.col("user_id").cast("string")))), "[^a-z0-9]+", "-"), F.lit("-")), 1, 48), F.lit("-"))
    run_id = F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z-"), slug, F.lit("-"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8))
    rows = table(spark, sf_dir, "events").select("event_id", run_id.alias("run_id"))
    pattern = "^([0-9]{8}T[0-9]{6})Z-([a-z0-9-]+)-([0-9a-f]{8})$"
    return rows.select("event_id", "run_id", F.regexp_extract("run_id", pattern, 2).alias("slug"), F.unix_micros(F.to_timestamp(F.regexp_extract("run_id", pattern, 1), "yyyyMMdd'T'HHmmss")).alias("at_us"))


@register("q_config_diff", """SELECT coalesce(a.k, b.k) AS path, a.v AS old_value, b.v AS new_value FROM (SELECT p_brand AS k, min(p_type) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT p_brand AS k, min(p_type) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def q_config_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = lambda odd, name: part.where(F.col("p_partkey") % 2 == odd).groupBy(F.col("p_brand").alias("path")).agg(F.min("p_type").alias(name))
    return side(0, "old_value").join(side(1, "new_value"), "path", "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
