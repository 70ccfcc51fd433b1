"""Tool calls, scores, protocol lines and JSON shells.

Inputs are made from the tables' own texts, and the SQL parses them anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import calls, parsing
from millrace.functions import records as R
from millrace.plans.registry import register
from millrace.plans.tables import table

# Expected calls are an order's lines; what was called are the same lines in another order, or one less.
_CALLS = """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i, l_returnflag AS name, l_quantity::INT::VARCHAR AS q, l_linestatus AS s, l_linestatus = 'O' AS band, l_linenumber % 2 = 0 AS subset,
      CASE WHEN l_tax > 0.06 THEN 'failed' WHEN l_tax > 0.04 THEN 'not_executed' ELSE 'ok' END AS status FROM lineitem),
    c AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY CASE k % 4 WHEN 1 THEN -i WHEN 3 THEN q::INT * 100 + i ELSE i END) - 1 AS j FROM l),
    st AS (SELECT k, i, sum(CASE WHEN band AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS stage FROM (SELECT k, i, band, lag(band) OVER (PARTITION BY k ORDER BY i) AS prev FROM c)),
    e AS (SELECT c.*, st.stage, row_number() OVER (PARTITION BY c.k, st.stage ORDER BY c.name, c.i) AS r FROM c JOIN st ON c.k = st.k AND c.i = st.i),
    a AS (SELECT c.*, st.stage, row_number() OVER (PARTITION BY c.k, st.stage ORDER BY c.name, c.j) AS r FROM c JOIN st ON c.k = st.k AND c.j = st.i WHERE NOT (c.k % 4 = 2 AND c.j = c.n - 1)),
    m AS (SELECT e.k, bool_and(coalesce(a.name = e.name, false)) AS names, bool_and(coalesce(a.name = e.name AND a.q = e.q AND (e.subset OR a.s = e.s) AND (a.status IN ('ok', 'not_executed')), false)) AS matched FROM e LEFT JOIN a ON a.k = e.k AND a.stage = e.stage AND a.r = e.r GROUP BY e.k)"""


def _trajectories(spark, sf_dir):
    """``k, expected, actual`` per order."""
    lines = table(spark, sf_dir, "lineitem")
    q, even = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 2 == 0
    status = F.when(F.col("l_tax") > 0.06, "failed").when(F.col("l_tax") > 0.04, "not_executed").otherwise("ok")
    whole = F.create_map(F.lit("q"), q.cast("string"), F.lit("s"), F.col("l_linestatus"))
    part = F.map_filter(whole, lambda k, v: (k == "q") | ~even)
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", q.alias("q"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("s"), even.alias("even"), status.alias("status"))
    rows = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    args = lambda x, all_: F.map_from_arrays(F.when(all_, F.array(F.lit("q"), F.lit("s"))).otherwise(F.array(F.lit("q"))), F.when(all_, F.array(x["q"].cast("string"), x["s"])).otherwise(F.array(x["q"].cast("string"))))
    expected = F.transform("x", lambda x: F.struct(x["name"].alias("name"), args(x, ~x["even"]).alias("args"), F.when(x["even"], "subset").otherwise("exact").alias("mode"), F.when(x["s"] == "O", 1).alias("band"), F.lit("ok").alias("status")))
    place = lambda x, i: F.when(F.col("k") % 4 == 1, -i).when(F.col("k") % 4 == 3, x["q"] * 100 + i).otherwise(i)
    order = F.array_sort(F.transform("x", lambda x, i: F.struct(place(x, i).alias("p"), i.alias("i"))))
    kept = F.slice(order, F.lit(1), F.size("x") - F.when(F.col("k") % 4 == 2, 1).otherwise(0))
    one = lambda x: F.struct(x["name"].alias("name"), args(x, F.lit(True)).alias("args"), x["status"].alias("status"), (x["q"] != 13).alias("valid"), F.lit(1).alias("attempts"), x["even"].alias("approved"))
    return rows.select("k", expected.alias("expected"), F.transform(kept, lambda p: one(F.get("x", p["i"]))).alias("actual"))


@register("q_call_match", _CALLS + " SELECT k AS order_key, names AND k % 4 <> 2 AS names, matched AND k % 4 <> 2 AS matched FROM m")
def q_call_match(spark, sf_dir):
    """Every order's lines as a trajectory."""
    e, a = F.col("expected"), F.col("actual")
    return _trajectories(spark, sf_dir).select(F.col("k").alias("order_key"), calls.names_match(e, a).alias("names"), calls.calls_match(e, a).alias("matched"))


@register(
    "q_task_scoring",
    _CALLS + """, o AS (SELECT o_orderkey AS k, o_orderpriority AS answer, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'no_tool' WHEN '2' THEN 'sequential_multi_step' WHEN '3' THEN 'tool_failure_recovery' WHEN '4' THEN 'grounding_approval_security' ELSE 'single' END AS category FROM orders),
    u AS (SELECT k, count(*) > 0 AS used, bool_or(name = 'R') AS odd, bool_and(q <> '13') AS valid, bool_or(subset) AS approved FROM a GROUP BY k),
    p AS (SELECT o.k, category, answer, coalesce(used, false) AS used, CASE WHEN used THEN names AND o.k % 4 <> 2 ELSE true END AS selected, CASE WHEN used THEN matched AND o.k % 4 <> 2 ELSE true END AS correct, coalesce(valid, true) AND o.k % 11 <> 0 AS valid, coalesce(odd, false) AS odd, coalesce(approved, false) AS approved FROM o JOIN m USING (k) LEFT JOIN u USING (k)),
    t AS (SELECT *, odd OR (used AND NOT selected) AS invented, CASE WHEN category = 'grounding_approval_security' THEN k % 7 <> 0 AND (k % 5 <> 0 OR approved) END AS safe,
      contains(lower(answer), '-') AND NOT contains(lower(answer), 'urgent') AND (k % 9 <> 0 OR contains(answer, '?')) AND (k % 2 <> 0 OR k % 3 <> 0) AND k % 10 <> 0 AS holds FROM p)
    SELECT k AS order_key, selected AS tool_selection, correct AS arguments, valid AS schema_valid, invented AS hallucination, CASE WHEN category = 'no_tool' THEN NOT used END AS no_tool, CASE WHEN category IN ('sequential_multi_step', 'tool_failure_recovery') THEN correct END AS multi_step,
    CASE WHEN category = 'tool_failure_recovery' THEN false END AS recovery, CASE WHEN k % 2 = 0 THEN k % 3 <> 0 END AS grounding, safe AS approval_safe, selected AND correct AND valid AND NOT invented AND holds AND coalesce(safe, true) AS success FROM t""",
)
def q_task_scoring(spark, sf_dir):
    k = F.col("k")
    category = F.col("o_orderpriority").substr(1, 1)
    category = F.when(category == "1", "no_tool").when(category == "2", "sequential_multi_step").when(category == "3", "tool_failure_recovery").when(category == "4", "grounding_approval_security").otherwise("single")
    rows = _trajectories(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), k == F.col("o_orderkey"))
    words = lambda *x: F.array(*map(F.lit, x))
    task = F.struct(
        category.alias("category"), F.array("expected", F.slice("expected", 1, 0)).alias("trajectories"), words("A", "N").alias("tools"), words("-").alias("required"), words("URGENT").alias("forbidden"),
        (k % 9 == 0).alias("clarification"), (k % 2 == 0).alias("citation"), (k % 5 == 0).alias("approval"), F.lit("succeeded").alias("terminal"),
    )
    run = F.struct(
        F.when(k % 10 == 0, "failed").otherwise("succeeded").alias("status"), F.col("actual").alias("calls"), F.col("o_orderpriority").alias("answer"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(words("line 1")).alias("citations"), F.when(k % 7 == 0, 1).otherwise(0).alias("breaches"), (k % 11 == 0).alias("model_failed"),
    )
    scored = rows.select("k", task.alias("task"), run.alias("run"))
    return scored.select(F.col("k").alias("order_key"), F.inline(F.array(calls.score(F.col("task"), F.col("run")))))


# Tags and think marks take the place of commas and full stops: some are left open, some are empty.
_TAGGED = "replace(replace(text, '. ', ' </tool_call>.'), ', ', ' <tool_call> ')"


@register("q_tag_calls", f"SELECT conv_id, turn, list_transform(regexp_extract_all({_TAGGED}, '(?s)<tool_call>(.*?)</tool_call>', 1), lambda x: trim(x)) AS calls FROM conversations")
def q_tag_calls(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.tag_calls(F.expr(_TAGGED)).alias("calls"))


_THOUGHT = "replace(replace(text, ', ', '<think>'), '. ', CASE WHEN turn % 2 = 0 THEN '</think>  ' ELSE '. ' END)"


@register("q_visible_content", f"SELECT conv_id, turn, CASE WHEN contains(raw, '</think>') THEN ltrim(substr(raw, instr(raw, '</think>') + 8)) WHEN contains(raw, '<think>') THEN '' ELSE raw END AS visible FROM (SELECT conv_id, turn, {_THOUGHT} AS raw FROM conversations)")
def q_visible_content(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.visible_content(F.expr(_THOUGHT)).alias("visible"))


_LINE = "CASE event_id % 5 WHEN 0 THEN 'data: [DONE]' WHEN 1 THEN 'event: ' || props WHEN 2 THEN 'data:' || props || ' ' ELSE 'data: ' || substr(props, 1, length(props) - CAST(event_id % 2 AS INT)) END"


@register("q_sse_usage", f"SELECT event_id, CASE WHEN starts_with(line, 'data:') AND json_valid(trim(substr(line, 6))) THEN json_extract(trim(substr(line, 6)), '$.k')::BIGINT END AS k FROM (SELECT event_id, {_LINE} AS line FROM events)")
def q_sse_usage(spark, sf_dir):
    parsed = F.from_json(R.sse_data(F.expr(_LINE)), "k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


_ROW = """CAST(p_partkey AS VARCHAR(20)) || ',"' || replace(p_name, ' ', ', ') || '",' || CASE WHEN p_partkey % 7 = 0 THEN '[N/A]' WHEN p_partkey % 7 = 1 THEN p_type ELSE ' ' || CAST(p_size AS VARCHAR(9)) END"""


@register("q_csv_inventory", f"SELECT regexp_extract(line, '^[0-9]+')::BIGINT AS p_partkey, regexp_extract(line, '\"([^\"]*)\"', 1) AS name, try_cast(trim(regexp_extract(line, '\",(.*)$', 1)) AS INT) AS memory FROM (SELECT {_ROW} AS line FROM part)")
def q_csv_inventory(spark, sf_dir):
    parsed = F.from_csv(F.expr(_ROW), "p_partkey bigint, name string, memory string")
    return table(spark, sf_dir, "part").select(parsed.alias("p")).select("p.p_partkey", "p.name", F.expr("try_cast(trim(p.memory) AS INT)").alias("memory"))


_BROKEN = """CASE event_id % 11 WHEN 0 THEN '{"kind": "' || event_type || '", "k": 1}' WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN '"kind": "' || event_type || '", "in": ' || props WHEN 3 THEN '{"kind": "' || event_type || '", "in": ' || props WHEN 4 THEN '```json' || chr(10) || '{"kind": "' || event_type || '"}' || chr(10) || '```'
    WHEN 5 THEN '{kind: "' || event_type || '", in: ' || props || '}' WHEN 6 THEN '["kind"] => ' || props WHEN 7 THEN event_type WHEN 8 THEN '{"in": {"kind": "' || event_type || '"}}' WHEN 9 THEN '{"in": {"kind": "' || event_type || '"}' ELSE 'no ' || props END"""


@register(
    "q_json_repair",
    rf"""WITH r AS (SELECT event_id, raw, regexp_extract(raw, '(?s)^```(?:json)?\s*(.*?)\s*```$', 1) AS fence, regexp_extract(raw, '^\["kind"\]\s*=>\s*(.*)$', 1) AS arrow, regexp_replace(raw, '([{{,]\s*)([A-Za-z_]\w*)(\s*:)', '\1"\2"\3', 'g') AS quoted FROM (SELECT event_id, {_BROKEN} AS raw FROM events)),
    t AS (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind, CASE WHEN json_valid(raw || '}}') THEN raw || '}}' END AS closed FROM r),
    s AS (SELECT *, CASE WHEN kind = 'OBJECT' THEN CASE WHEN list_contains(json_keys(raw), 'kind') THEN 'none' WHEN json_extract(raw, '$.in.kind') IS NOT NULL THEN 'promote_required_keys' ELSE 'none' END WHEN kind IS NOT NULL THEN 'wrap_single_key' WHEN fence <> '' AND json_valid(fence) THEN 'unwrap_json_fence' WHEN arrow <> '' AND json_valid(arrow) THEN 'arrow_single_key'
      WHEN regexp_full_match(raw, '[A-Za-z_][A-Za-z0-9_-]*') THEN 'wrap_bareword_single_key' WHEN json_valid(quoted) THEN 'quote_bare_keys' WHEN json_valid('{{' || raw || '}}') THEN 'brace_member_fragment' WHEN closed IS NULL THEN 'none' WHEN list_contains(json_keys(closed), 'kind') THEN 'close_object' WHEN json_extract(closed, '$.in.kind') IS NOT NULL THEN 'close_object_promote_required_keys' ELSE 'none' END AS status FROM t)
    SELECT event_id, status, json_extract_string(CASE status WHEN 'none' THEN CASE WHEN json_valid(raw) THEN raw END WHEN 'promote_required_keys' THEN json_extract(raw, '$.in') WHEN 'wrap_single_key' THEN '{{"kind":' || raw || '}}' WHEN 'unwrap_json_fence' THEN fence WHEN 'arrow_single_key' THEN '{{"kind":' || json(arrow) || '}}' WHEN 'wrap_bareword_single_key' THEN '{{"kind":"' || raw || '"}}'
      WHEN 'quote_bare_keys' THEN quoted WHEN 'brace_member_fragment' THEN '{{' || raw || '}}' WHEN 'close_object' THEN closed ELSE json_extract(closed, '$.in') END, '$.kind') AS kind FROM s""",
)
def q_json_repair(spark, sf_dir):
    repaired = parsing.repair_json(F.expr(_BROKEN.replace("chr(10)", "'\n'")), ("kind",), 3)
    return table(spark, sf_dir, "events").select("event_id", repaired.alias("p")).select("event_id", "p.status", F.get_json_object("p.value", "$.kind").alias("kind"))


@register("q_json_shape", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"additionalProperties":false,"properties":{"k":{"type":"integer"}},"required":["k"],"type":"object"}' WHEN 1 THEN '{"items":{"anyOf":[{"type":"number"},{"type":"string"}]},"type":"array"}' END AS shape FROM events""")
def q_json_shape(spark, sf_dir):
    value = F.concat((F.floor("value") + 0.5).cast("string"), F.lit(""))
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), value, F.lit(', "'), "event_type", F.lit('", '), value, F.lit("]"))).otherwise(F.concat("event_type", F.lit(":")))
    return table(spark, sf_dir, "events").select("event_id", parsing.shape_of_json(raw).alias("shape"))


def _tag_rows(spark, sf_dir):
    """Events as rows of tagged calls, some with a broken tag, a missing field or a result that answers nothing."""
    k = F.col("event_id")
    call = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.when(k % 7 == 3, "").otherwise("}"), F.lit("</tool_call>"))
    say = F.when(k % 5 == 2, F.lit("nothing")).otherwise(call)
    message = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    turns = [message("system", F.lit("s")), message("human", F.lit("h")), message("gpt", say), message("tool", F.concat(F.lit("<tool_response>"), "props", F.lit("</tool_response>")))]
    tools = F.concat(F.lit('[{"type": "function", "function": {"name": "'), F.when(k % 11 == 5, "other").otherwise(F.col("event_type")), F.lit('"}}]'))
    fields = [F.lit("x").alias(c) for c in ("category", "id", "subcategory", "task")]
    row = F.struct(*fields, tools.alias("tools"), F.array(*turns).alias("conversations"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(k % 13 == 0, F.to_json(F.struct(tools.alias("tools")))).otherwise(F.to_json(row)).alias("line"))


_TAG_REASON = "CASE WHEN event_id % 13 = 0 THEN 'invalid_row_shape' WHEN event_id % 5 = 2 THEN 'unpaired_tool_result' WHEN event_id % 7 = 3 OR event_id % 11 = 5 THEN 'malformed_tool_call' END"


@register("q_canonical_tag_rows", f"SELECT event_id, {_TAG_REASON} AS reason, CASE WHEN ({_TAG_REASON}) IS NULL THEN event_type END AS name, CASE WHEN ({_TAG_REASON}) IS NULL THEN json_extract(props, '$.k')::BIGINT END AS k, CASE WHEN ({_TAG_REASON}) IS NULL THEN 'call_' || event_id || '_2_0' END AS answered FROM events")
def q_canonical_tag_rows(spark, sf_dir):
    rows = _tag_rows(spark, sf_dir).select("event_id", R.canonical_tag_row("line", "event_id").alias("p"))
    at = lambda path: F.get_json_object("p.value", path)
    return rows.select("event_id", "p.reason", at("$.messages[2].tool_calls[0].name").alias("name"), at("$.messages[2].tool_calls[0].arguments.k").cast("long").alias("k"), at("$.messages[3].tool_call_ids[0]").alias("answered"))


@register(
    "q_row_profile",
    f"""WITH p AS (SELECT {_TAG_REASON} AS reason, event_id % 13 = 0 AS shapeless, event_id % 5 = 2 AS silent, event_id % 7 = 3 OR event_id % 11 = 5 AS bad FROM events)
    SELECT reason, CASE WHEN shapeless THEN 'invalid' ELSE 'system>human>gpt>tool' END AS path, count(*) AS n, count(*) FILTER (NOT shapeless) AS tools, count(*) FILTER (NOT shapeless AND NOT silent AND NOT bad) AS calls, count(*) FILTER (NOT shapeless AND NOT silent AND bad) AS malformed, round_even(count(*) FILTER (NOT shapeless) * 1000 / count(*), 0)::BIGINT AS tools_milli FROM p GROUP BY 1, 2""",
)
def q_row_profile(spark, sf_dir):
    rows = _tag_rows(spark, sf_dir).select(R.profile_tag_row("line").alias("p")).select("p.*")
    sums = [F.sum(c).alias(c) for c in ("tools", "calls", "malformed")]
    return rows.groupBy("reason", "path").agg(F.count("*").alias("n"), *sums, F.bround(F.sum("tools") * 1000 / F.count("*")).cast("long").alias("tools_milli"))


@register(
    "q_row_profile_brackets",
    """SELECT CASE WHEN event_id % 3 > 0 THEN 'malformed_tool_call' END AS reason, 'user>assistant>tool>assistant' AS path, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS calls, count(*) FILTER (event_id % 3 = 1) AS malformed FROM events GROUP BY 1""",
)
def q_row_profile_brackets(spark, sf_dir):
    k = F.col("event_id")
    message = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    say = F.when(k % 3 == 0, F.concat(F.lit("[look up(q="), "props", F.lit(")]"))).when(k % 3 == 1, F.concat(F.lit("[look up(q="), "props", F.lit("]"))).otherwise("fine")
    turns = F.array(message("user", F.col("event_type")), message("assistant", say), message("tool", F.lit("ok")), message("assistant", F.lit("done")))
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(F.struct(F.lit("look up").alias("name"))).alias("tools"), turns.alias("messages"))).alias("line"))
    profile = rows.select(R.profile_bracket_row("line").alias("p")).select("p.*")
    return profile.groupBy("reason", "path").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("malformed").alias("malformed"))
