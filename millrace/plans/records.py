"""Checks between tables, candidate cascades, messages and calls, generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.functions import render
from millrace.functions import text as X
from millrace.operators import selection
from millrace.plans.registry import register
from millrace.plans.sampling import _NEXT_FIT
from millrace.plans.tables import table
from millrace.session import let


@register(
    "q_judgment_join",
    """SELECT d.doc_id, quality, toxic, CASE WHEN d.lang = 'en' AND l.doc_id IS NULL THEN 'missing_judgment' WHEN d.lang = 'es' AND l.doc_id IS NOT NULL THEN 'unexpected_judgment' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def q_judgment_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    status = F.when((F.col("lang") == "en") & F.col("has").isNull(), "missing_judgment").when((F.col("lang") == "es") & F.col("has"), "unexpected_judgment").otherwise("ok")
    return docs.join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", status.alias("status"))


@register(
    "q_pairing_check",
    """SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CASE WHEN a.conv_id IS NULL THEN 'missing_base' WHEN b.conv_id IS NULL THEN 'missing_candidate' WHEN a.role <> b.role THEN 'mismatch' ELSE 'paired' END AS status FROM (SELECT conv_id, role FROM conversations WHERE turn = 1) a FULL JOIN (SELECT conv_id, role FROM conversations WHERE turn = 5) b ON a.conv_id = b.conv_id""",
)
def q_pairing_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    side = lambda t, name: rows.where(F.col("turn") == t).select("conv_id", F.col("role").alias(name))
    status = F.when(F.col("a").isNull(), "missing_base").when(F.col("b").isNull(), "missing_candidate").when(F.col("a") != F.col("b"), "mismatch").otherwise("paired")
    return side(1, "a").join(side(5, "b"), "conv_id", "full").select("conv_id", status.alias("status"))


_OVERLAP = """SELECT '{k}' AS kind, count(*) AS n FROM (SELECT {e} AS x FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {e} FROM documents WHERE doc_id % 2 = 1)"""
_KEYS = {"exact": "text", "masked": "regexp_replace(lower(text), '[0-9]+', '#', 'g')", "first_line": "split_part(text, chr(10), 1)"}


@register("q_overlap_counts", " UNION ALL ".join(_OVERLAP.format(k=k, e=e) for k, e in _KEYS.items()))
def q_overlap_counts(spark, sf_dir):
    keys = {"exact": F.col("text"), "masked": F.regexp_replace(F.lower("text"), "[0-9]+", "#"), "first_line": F.split_part("text", F.lit("\n"), F.lit(1))}
    # One pass: each key's digest with the sides that have it.
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.sha2(e, 256).alias("h")) for k, e in keys.items()])))
    both = rows.groupBy("kind", "h").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = 0 AND b = 1")
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@register("q_fallback_select", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, f.total) AS value, CASE WHEN o_orderstatus <> 'P' THEN 'parent' WHEN f.total IS NOT NULL THEN 'fallback' ELSE 'missing' END AS origin FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS total FROM lineitem GROUP BY 1) f ON l_orderkey = o_orderkey")
def q_fallback_select(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    fallback = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("total"))
    own = F.col("o_orderstatus") != "P"
    return orders.join(fallback, "o_orderkey", "left").select("o_orderkey", F.when(own, F.col("o_totalprice")).otherwise(F.col("total")).alias("value"), F.when(own, "parent").when(F.col("total").isNotNull(), "fallback").otherwise("missing").alias("origin"))


@register(
    "q_referential_check",
    """SELECT 'unknown_parent' AS problem, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'no_child', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'gap_in_index', count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 <> count(DISTINCT turn))""",
)
def q_referential_check(spark, sf_dir):
    lines, orders, turns = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "conversations"))
    on = F.col("l_orderkey") == F.col("o_orderkey")
    count = lambda rows, name: rows.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    broken = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("k")).where("span <> k")
    return count(lines.join(orders, on, "left_anti"), "unknown_parent").unionAll(count(orders.join(lines, on, "left_anti"), "no_child")).unionAll(count(broken, "gap_in_index"))


@register("q_semantic_identity", "SELECT sha256(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}]+', ' ', 'g'))) AS identity, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def q_semantic_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.nfkc_casefold("text"), 256).alias("identity"))
    return rows.groupBy("identity").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@register(
    "q_first_accepted",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN len(text) < 40 THEN 'too_short' WHEN role <> 'assistant' THEN 'unsupported_role' WHEN NOT regexp_matches(text, '[.]$') THEN 'truncated' END AS reason FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (reason IS NULL) AS won FROM c GROUP BY conv_id)
    SELECT conv_id, turn, CASE WHEN won IS NULL THEN coalesce(reason, 'no_candidate_passed') WHEN turn = won THEN 'selected' WHEN turn > won THEN 'unused' ELSE reason END AS outcome FROM c JOIN f USING (conv_id)""",
)
def q_first_accepted(spark, sf_dir):
    reason = F.when(F.length("text") < 40, "too_short").when(F.col("role") != "assistant", "unsupported_role").when(~F.col("text").rlike(r"[.]\z"), "truncated")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))
    won = rows.groupBy("conv_id").agg(F.min(F.when(F.col("reason").isNull(), F.col("turn"))).alias("won"))
    outcome = F.when(F.col("won").isNull(), F.coalesce("reason", F.lit("no_candidate_passed"))).when(F.col("turn") == F.col("won"), "selected").when(F.col("turn") > F.col("won"), "unused").otherwise(F.col("reason"))
    return rows.join(won, "conv_id").select("conv_id", "turn", outcome.alias("outcome"))


@register("q_failing_batches", "SELECT DISTINCT (doc_id // 4) * 4 AS batch FROM labels WHERE quality = 0")
def q_failing_batches(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality = 0").select(F.expr("(doc_id div 4) * 4").alias("batch")).distinct()


@register("q_distribution_check", "SELECT coalesce(a.lang, c.lang) AS lang, c.n AS expected, coalesce(a.n, 0) AS found FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (VALUES ('en', 620), ('de', 129), ('zz', 1)) c(lang, n) ON a.lang = c.lang WHERE a.n IS DISTINCT FROM c.n")
def q_distribution_check(spark, sf_dir):
    wanted = spark.createDataFrame([("en", 620), ("de", 129), ("zz", 1)], "lang string, expected int")
    found = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("found"))
    return wanted.join(found, "lang", "full").where(~F.col("expected").cast("long").eqNullSafe(F.col("found"))).select("lang", "expected", F.coalesce("found", F.lit(0)).alias("found"))


@register(
    "q_domain_summary",
    """SELECT lang, count(*) AS n_items, count(*) FILTER (quality IS NULL) AS pending, count(*) FILTER (quality = 1) AS correct, CASE WHEN count(quality) = 0 THEN 10000 ELSE round_even(count(*) FILTER (quality = 1) * 10000 / count(quality), 0) END::BIGINT AS score_bp FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def q_domain_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    correct = F.count_if(F.col("quality") == 1)
    return rows.groupBy("lang").agg(F.count("*").alias("n_items"), F.count_if(F.col("quality").isNull()).alias("pending"), correct.alias("correct"), X.even_bp(correct, F.count("quality")).alias("score_bp"))


@register(
    "q_review_sample",
    """WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS f, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source) AS k FROM r WHERE f = 1) SELECT lang, doc_id, 'family' AS why FROM a WHERE k <= 5 UNION ALL SELECT lang, doc_id, 'quartile' FROM r WHERE i - 1 IN (0, (n - 1) // 4, (n - 1) // 2, (n - 1) * 3 // 4, n - 1)""",
)
def q_review_sample(spark, sf_dir):
    from millrace.functions.stats import by_index

    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    firsts = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    families = firsts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).where("k <= 5").select("lang", "doc_id", F.lit("family").alias("why"))
    places = {"a": lambda n: F.lit(0), "b": lambda n: F.floor((n - 1) / 4), "c": lambda n: F.floor((n - 1) / 2), "d": lambda n: F.floor((n - 1) * 3 / 4), "e": lambda n: n - 1}
    quartiles = by_index(docs, ["lang"], "doc_id", places).select("lang", F.explode(F.array_distinct(F.array(*places))).alias("doc_id"), F.lit("quartile").alias("why"))
    return families.unionByName(quartiles)


@register(
    "q_unpack",
    """SELECT conv_id, turn, sha256(array_to_string(list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: len(w)::VARCHAR), ',')) AS ids_sha256, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM conversations""",
)
def q_unpack(spark, sf_dir):
    from millrace.plans.sampling import q_pack_arrays

    packs = q_pack_arrays(spark, sf_dir).select("conv_id", "input_ids")
    counts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n"))
    ends = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    parts = counts.withColumn("end", ends).join(packs, "conv_id").select("conv_id", "turn", F.slice("input_ids", (F.col("end") - F.col("n") + 1).cast("int"), F.col("n").cast("int")).alias("ids"))
    return parts.select("conv_id", "turn", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"), F.size("ids").cast("long").alias("n_tokens"))


@register(
    "q_trim_supervision",
    """WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: CASE WHEN len(w) % 3 = 0 THEN -100 ELSE len(w) END::INT) AS l FROM documents), u AS (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS x FROM s),
    n AS (SELECT *, sum(CASE WHEN x <> -100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM u) SELECT s.doc_id, coalesce(list(CASE WHEN x = -100 OR k <= 10 THEN x ELSE -100 END::INT ORDER BY p) FILTER (p IS NOT NULL), []::INT[]) AS labels FROM s LEFT JOIN n ON s.doc_id = n.doc_id GROUP BY s.doc_id""",
)
def q_trim_supervision(spark, sf_dir):
    return _trimmed(spark, sf_dir, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def _trimmed(spark, sf_dir, words):
    ids = F.transform(words, lambda w: F.when(F.length(w) % 3 == 0, -100).otherwise(F.length(w)))
    return table(spark, sf_dir, "documents").select("doc_id", let(ids, lambda x: R.trim_supervision(x, F.lit(10))).alias("labels"))


@register("q_safe_tool_names", "SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN 'tool_' || n ELSE n END AS name FROM (SELECT p_partkey, lower(trim(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9_-]+', '_', 'g'), '_')) AS n FROM part)")
def q_safe_tool_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.safe_tool_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))


@register("q_tool_pairing", "SELECT conv_id, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role = 'assistant') AS results, count(*) FILTER (role = 'assistant' AND prev IS DISTINCT FROM 'user') AS unpaired FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def q_tool_pairing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev"))
    answered = (F.col("role") == "assistant") & ~F.col("prev").eqNullSafe(F.lit("user"))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("calls"), F.count_if(F.col("role") == "assistant").alias("results"), F.count_if(answered).alias("unpaired"))


@register("q_json_limits", "SELECT event_id, strlen(props)::INT AS bytes, max(len(fullkey) - len(replace(replace(fullkey, '.', ''), '[', '')) + 1)::INT AS depth, count(*)::INT AS nodes FROM events, json_tree(events.props) GROUP BY event_id, props")
def q_json_limits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.json_limits("props").alias("p")).select("event_id", "p.bytes", "p.depth", "p.nodes")


@register("q_toy_sequences", "SELECT i AS sequence_id, list_transform(range(0, 16), lambda p: ((i * 7 + (1 + i % 5) * p) % 97)::INT) AS input_ids FROM (SELECT unnest(range(0, 500)) AS i)")
def q_toy_sequences(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: ((F.col("id") * 7 + (1 + F.col("id") % 5) * p) % 97).cast("int"))
    return spark.range(0, 500).select(F.col("id").alias("sequence_id"), ids.alias("input_ids"))


@register(
    "q_generated_tasks",
    """SELECT 'task-' || lpad(i::VARCHAR, 4, '0') AS task_id, ['arithmetic', 'sorting', 'lookup', 'dates', 'logic'][(i % 5 + 1)::INT] AS family, CASE WHEN ((i // 5 + 1) * 3) // 10 > ((i // 5) * 3) // 10 THEN 'zh' ELSE 'en' END AS lang,
    ('0x' || substr(sha256('task-v1:' || i), 1, 6))::BIGINT % 90 + 10 AS a, ('0x' || substr(sha256('task-v1:' || i), 7, 6))::BIGINT % 90 + 10 AS b FROM (SELECT unnest(range(0, 400)) AS i)""",
)
def q_generated_tasks(spark, sf_dir):
    digest = F.sha2(F.concat(F.lit("task-v1:"), F.col("id").cast("string")), 256)
    number = lambda at: F.conv(F.substring(digest, at, 6), 16, 10).cast("long") % 90 + 10
    family = F.element_at(F.array(*map(F.lit, ["arithmetic", "sorting", "lookup", "dates", "logic"])), (F.col("id") % 5 + 1).cast("int"))
    lang = F.expr("CASE WHEN ((id div 5 + 1) * 3) div 10 > ((id div 5) * 3) div 10 THEN 'zh' ELSE 'en' END")
    return spark.range(0, 400).select(F.concat(F.lit("task-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("task_id"), family.alias("family"), lang.alias("lang"), number(1).alias("a"), number(7).alias("b"))


@register(
    "q_vulnerability_audit",
    "SELECT p_brand, count(*) AS n, count(*) FILTER (s.quality = 0) AS open, count(*) FILTER (s.doc_id IS NULL) AS unassessed FROM part LEFT JOIN labels s ON s.doc_id = p_partkey GROUP BY p_brand",
)
def q_vulnerability_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(table(spark, sf_dir, "labels"), F.col("p_partkey") == F.col("doc_id"), "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("open"), F.count_if(F.col("doc_id").isNull()).alias("unassessed"))


@register(
    "q_registry_resolve",
    """WITH v AS (SELECT o_custkey AS alias, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT alias, max(version) FILTER (n = 1) AS current, max(version) FILTER (n = 2) AS rollback_to FROM v GROUP BY alias""",
)
def q_registry_resolve(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderkey").alias("version"), newest.alias("n")).where("n <= 2")
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("version")))
    return rows.groupBy("alias").agg(pick(1).alias("current"), pick(2).alias("rollback_to"))


def _messages(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), F.concat(F.lit("\nstep "), F.col("turn").cast("string"), F.lit("\n")).alias("reasoning"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))


_HEAD = "'<|im_start|>' || role || chr(10)"


def _render_sql(head: str, body: str) -> str:
    return f"""WITH p AS (SELECT conv_id, turn, role, {head} AS head, {body} || '<|im_end|>' AS body FROM conversations),
    q AS (SELECT *, coalesce(sum(len(head) + len(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(head) AS s FROM p)
    SELECT conv_id, sha256(string_agg(head || body || chr(10), '' ORDER BY turn)) AS text_sha256, coalesce(list(s::BIGINT ORDER BY turn) FILTER (role = 'assistant'), []::BIGINT[]) AS starts, coalesce(list((s + len(body))::BIGINT ORDER BY turn) FILTER (role = 'assistant'), []::BIGINT[]) AS ends FROM q GROUP BY conv_id"""


def _rendered(spark, sf_dir, mode):
    rows = _messages(spark, sf_dir).select("conv_id", F.inline(F.array(render.render(F.col("messages"), mode))))
    places = lambda n: F.transform("spans", lambda s: s[n].cast("long"))
    return rows.select("conv_id", F.sha2("text", 256).alias("text_sha256"), places("start").alias("starts"), places("end").alias("ends"))


@register("q_render_no_thinking", _render_sql(_HEAD + " || CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END", "text"))
def q_render_no_thinking(spark, sf_dir):
    return _rendered(spark, sf_dir, "no_thinking")


@register("q_render_thinking", _render_sql(_HEAD, "CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || 'step ' || turn || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(text, chr(10)) ELSE text END"))
def q_render_thinking(spark, sf_dir):
    return _rendered(spark, sf_dir, "thinking")


@register(
    "q_label_mask",
    "SELECT conv_id, count(*) AS n_roles, count(*) FILTER (role = 'assistant') AS n_spans FROM conversations GROUP BY conv_id",
)
def q_label_mask(spark, sf_dir):
    """Every mark ``<|im_end|>`` and every role is one token here; the mask must tell them apart."""
    rows = _messages(spark, sf_dir).select("conv_id", "messages", F.inline(F.array(render.render(F.col("messages")))))
    ends = F.transform("spans", lambda s: F.struct(F.lit(1).alias("id"), (s["end"] - len(render.END)).alias("start"), s["end"].alias("end")))
    heads = F.transform(F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.substring("text", i + 1, F.lit(len(render.START))) == render.START), lambda i: F.struct(F.lit(2).alias("id"), i.alias("start"), (i + len(render.START)).alias("end")))
    labels = rows.select("conv_id", render.label_mask(ends, F.col("spans")).alias("e"), render.label_mask(heads, F.col("spans")).alias("h"))
    return labels.select("conv_id", F.size(F.filter("h", lambda x: x == -100)).cast("long").alias("n_roles"), F.size(F.filter("e", lambda x: x == 1)).cast("long").alias("n_spans"))


@register(
    "q_candidate_selection",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, sha256(lower(text)) AS trace FROM conversations), o AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS i, list(struct_pack(u := turn, h := trace) ORDER BY turn) AS x FROM c GROUP BY conv_id),
    p(i, conv_id, pick, taken) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::STRUCT(u BIGINT, h VARCHAR), []::VARCHAR[] UNION ALL SELECT i, conv_id, free[1], CASE WHEN len(free) > 0 THEN list_append(taken, free[1].h) ELSE taken END FROM (SELECT o.i, o.conv_id, p.taken, list_filter(o.x, lambda e: NOT list_contains(p.taken, e.h)) AS free FROM p JOIN o ON o.i = p.i + 1))
    SELECT conv_id, pick.u AS turn, pick.h AS trace FROM p WHERE pick IS NOT NULL""",
)
def q_candidate_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.lower("text"), 256).alias("trace"))
    return selection.first_distinct(rows, "conv_id", "turn", "trace")


@register(
    "q_frames",
    """WITH c AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 1 THEN '<think>' ELSE '</think>' END || text || chr(10) || chr(10) || 'next', '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, unnest(list_filter(string_split(t, chr(10) || chr(10)), lambda x: x <> '')) AS frame, generate_subscripts(list_filter(string_split(t, chr(10) || chr(10)), lambda x: x <> ''), 1) - 1 AS number FROM c),
    s AS (SELECT *, ltrim(substr(string_agg(frame, '') OVER (PARTITION BY conv_id ORDER BY number), 9), ' ' || chr(10) || chr(9)) AS now FROM f) SELECT conv_id, number, frame, substr(now, coalesce(len(lag(now) OVER (PARTITION BY conv_id ORDER BY number)), 0) + 1) AS visible FROM s""",
)
def q_frames(spark, sf_dir):
    text = F.concat(F.when(F.col("turn") % 2 == 1, "<think>").otherwise("</think>"), F.col("text"), F.lit("\n\nnext"))
    return selection.reassemble(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("chunk")), "conv_id", "turn", "chunk")


@register(
    "q_canonical_rows",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"messages":[{"content":' || to_json(event_type) || ',"role":"user"},{"content":null,"role":"assistant","tool_calls":[{"arguments":{"q":1},"id":"call_' || event_id || '_1_0","name":"look_up"}]},{"content":"ok","role":"tool","tool_call_ids":["call_' || event_id || '_1_0"]},{"content":"done","role":"assistant"}],"tools":["look_up"]}' END AS value, CASE WHEN event_id % 3 > 0 THEN 'malformed_tool_call' END AS reason FROM events""",
)
def q_canonical_rows(spark, sf_dir):
    call = F.when(F.col("event_id") % 3 == 0, "[look up(q=1)]").when(F.col("event_id") % 3 == 1, "[look up(q=]").otherwise("fine")
    message = lambda role, value: F.struct(F.lit(role).alias("from"), value.alias("value"))
    turns = F.array(message("user", F.col("event_type")), message("assistant", call), message("tool", F.lit("ok")), message("assistant", F.lit("done")))
    row = F.to_json(F.struct(F.array(F.struct(F.lit("look up").alias("name"))).alias("tools"), turns.alias("messages")))
    return table(spark, sf_dir, "events").select("event_id", R.canonical_row(row, F.col("event_id")).alias("p")).select("event_id", "p.value", "p.reason")


@register("q_line_excerpt", "SELECT doc_id, list_min([len(l), 8])::BIGINT AS end_line, array_to_string(l[3:8], chr(10)) AS excerpt FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 3")
def q_line_excerpt(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l")).where("size(l) >= 3")
    return rows.select("doc_id", F.least(F.size("l"), F.lit(8)).cast("long").alias("end_line"), F.array_join(F.slice("l", 3, 6), "\n").alias("excerpt"))


@register("q_script_language", "SELECT conv_id, CASE WHEN regexp_matches(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS lang FROM conversations GROUP BY conv_id")
def q_script_language(spark, sf_dir):
    zh = F.max((F.col("role") == "user") & F.col("text").rlike(r"[\x{4e00}-\x{9fff}]"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(zh, "zh").otherwise("en").alias("lang"))


@register("q_redact_props", """SELECT event_id, regexp_replace(props, '"(page|token|secret)": *"[^"]*"', '"\\1": "[redacted]"', 'g') AS props FROM events""")
def q_redact_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", '"(page|token|secret)": *"[^"]*"', '"$1": "[redacted]"').alias("props"))


@register("q_shard_split", f"WITH RECURSIVE {_NEXT_FIT.format(key='lang', cap=200_000)} SELECT k AS lang, bin, count(*) AS n, sum(s)::BIGINT AS n_chars, min(doc_id) AS first FROM p GROUP BY 1, 2")
def q_shard_split(spark, sf_dir):
    from millrace.operators.sampling import next_fit

    rows = next_fit(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", ["doc_id"], "n_chars", 200_000)
    return rows.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first"))


@register(
    "q_epoch_plan",
    "SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256('epoch-' || epoch || chr(0) || doc_id), doc_id) - 1 AS position FROM documents, (SELECT unnest([0, 1, 2])::INT AS epoch)",
)
def q_epoch_plan(spark, sf_dir):
    from millrace.operators.sampling import running

    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("epoch"))
    rows = rows.select("epoch", "doc_id", F.sha2(F.concat(F.lit("epoch-"), F.col("epoch").cast("string"), F.lit("\0"), F.col("doc_id").cast("string")), 256).alias("k"), F.lit(1).alias("one"))
    return running(rows, "epoch", ["k", "doc_id"], "one").select("epoch", "doc_id", (F.col("cum") - 1).alias("position"))


@register("q_prompt_prefix", "SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first_supervised, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (turn < f)) AS prefix_sha256 FROM (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM conversations) GROUP BY conv_id")
def q_prompt_prefix(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_supervised"))
    before = F.filter("m", lambda t: t["turn"] < F.col("first_supervised"))
    joined = F.array_join(F.transform(before, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return rows.select("conv_id", "first_supervised", F.when(F.size(before) > 0, F.sha2(joined, 256)).alias("prefix_sha256"))


@register("q_family_gate", "SELECT source, count(*) AS n, round_even(avg(quality) * 10000, 0)::BIGINT AS pass_bp, avg(quality) >= 0.8 AND count(*) >= 5 AS passed FROM documents JOIN labels USING (doc_id) GROUP BY source")
def q_family_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    share = F.avg("quality")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.bround(share * 10_000).cast("long").alias("pass_bp"), ((share >= 0.8) & (F.count("*") >= 5)).alias("passed"))


@register("q_lineage_gate", "SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS n_failed FROM (SELECT o_totalprice > 0 AND c.c_custkey IS NOT NULL AND o_orderstatus IN ('O', 'F', 'P') AS ok FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey)")
def q_lineage_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    ok = (F.col("o_totalprice") > 0) & F.col("c_custkey").isNotNull() & F.col("o_orderstatus").isin("O", "F", "P")
    return rows.select(ok.alias("ok")).agg(F.every("ok").alias("passed"), F.count_if(~F.col("ok")).alias("n_failed"))


@register("q_nested_user_text", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user_text FROM conversations GROUP BY conv_id")
def q_nested_user_text(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(turns.alias("messages")).alias("body"))).alias("j"))
    return rows.select("conv_id", R.user_text("j").alias("user_text"))


@register(
    "q_replace_block",
    """SELECT doc_id, CASE WHEN a > 0 AND b > a THEN list_concat(list_concat(w[1:a - 1], ['<>']), w[b + 1:len(w)]) ELSE w END AS tokens FROM (SELECT doc_id, w, list_position(w, 'the') AS a, list_position(w, 'and') AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))""",
)
def q_replace_block(spark, sf_dir):
    return _block_replaced(spark, sf_dir, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))


def _block_replaced(spark, sf_dir, words):
    def cut(w):
        a, b = F.array_position(w, "the").cast("int"), F.array_position(w, "and").cast("int")
        return F.when((a > 0) & (b > a), F.concat(F.slice(w, F.lit(1), a - 1), F.array(F.lit("<>")), F.slice(w, b + 1, F.size(w)))).otherwise(w)

    return table(spark, sf_dir, "documents").select("doc_id", let(words, cut).alias("tokens"))


@register("q_request_timing", "SELECT event_id, round(value * 1000)::BIGINT AS latency_us, round(value * 200)::BIGINT AS ttft_us, CASE WHEN user_id > 1 THEN (round(value * 1000)::BIGINT - round(value * 200)::BIGINT) // (user_id - 1) END AS tpot_us FROM events")
def q_request_timing(spark, sf_dir):
    us = lambda k: F.round(F.col("value") * k).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", us(1000).alias("latency_us"), us(200).alias("ttft_us"))
    return rows.select("event_id", "latency_us", "ttft_us", F.expr("CASE WHEN user_id > 1 THEN (latency_us - ttft_us) div (user_id - 1) END").alias("tpot_us"))


@register("q_failure_class", "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN starts_with(text, '{') AND NOT ends_with(text, '}') THEN 'truncated_json' WHEN contains(text, '<think>') THEN 'leaked_reasoning' WHEN len(text) > 400 THEN 'overlong' ELSE 'none' END AS failure FROM conversations")
def q_failure_class(spark, sf_dir):
    t = F.col("text")
    failure = F.when(F.trim(t) == "", "empty").when(t.startswith("{") & ~t.endswith("}"), "truncated_json").when(t.contains("<think>"), "leaked_reasoning").when(F.length(t) > 400, "overlong").otherwise("none")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", failure.alias("failure"))


@register("q_text_clean", "SELECT page_id, replace(regexp_replace(replace(trim(url) || ' [title] x  [a]', ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS cleaned FROM pages")
def q_text_clean(spark, sf_dir):
    marked = F.replace(F.concat(F.trim("url"), F.lit(" [title] x  [a]")), F.lit(" [title]"), F.lit(". "))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(F.regexp_replace(marked, r"\[.*?\]", ""), F.lit("  "), F.lit(" ")).alias("cleaned"))
