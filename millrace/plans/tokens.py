"""Tokens, token arrays and what is declared of them; candidates and their reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import render
from millrace.functions import text as X
from millrace.operators import sampling, selection
from millrace.operators import tokens as K
from millrace.plans.registry import ORACLES, register
from millrace.plans.tables import table

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _conversations(spark, sf_dir, content=None):
    turn = F.struct("turn", "role", (F.col("text") if content is None else content).alias("content"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))


@register(
    "q_tokenize_rejects",
    f"""WITH m AS (SELECT conv_id, turn, role, {_WORDS.format("text || '<|im_end|>'")} AS w, {_WORDS.format("'<|im_start|>' || role || ' ' || text || '<|im_end|>'")} AS a FROM conversations),
    c AS (SELECT conv_id, sum(len(a))::BIGINT AS token_count, coalesce(sum(len(w)) FILTER (role = 'assistant'), 0)::BIGINT AS supervised_token_count, sha256(string_agg(array_to_string(list_transform(a, lambda x: len(x)::VARCHAR), ','), ',' ORDER BY turn)) AS ids_sha256,
      sha256(string_agg(array_to_string(list_transform(a, lambda x, i: CASE WHEN role = 'assistant' AND i > 1 THEN len(x) ELSE -100 END::VARCHAR), ','), ',' ORDER BY turn)) AS labels_sha256 FROM m GROUP BY conv_id),
    r AS (SELECT *, CASE WHEN token_count > 400 THEN 'sequence_too_long' WHEN supervised_token_count = 0 THEN 'no_supervised_tokens' END AS reason FROM c) SELECT conv_id, token_count, supervised_token_count, reason, CASE WHEN reason IS NULL THEN ids_sha256 END AS ids_sha256, CASE WHEN reason IS NULL THEN labels_sha256 END AS labels_sha256 FROM r""",
)
def q_tokenize_rejects(spark, sf_dir):
    rows = _conversations(spark, sf_dir).select("conv_id", F.inline(F.array(render.render(F.col("messages")))))
    out = K.tokenize(rows, "text", "spans", K.words, 400)
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256)
    return out.select("conv_id", "token_count", "supervised_token_count", "reason", digest("input_ids").alias("ids_sha256"), digest("labels").alias("labels_sha256"))


_ROLE = "CASE WHEN turn % 4 = 2 OR (turn % 4 = 3 AND conv_id % 2 = 0) THEN 'tool' ELSE role END"
_CALL = """'{"arguments":{"turn":' || turn || '},"name":"look"}'"""


@register(
    "q_agent_render",
    f"""WITH m AS (SELECT conv_id, turn, {_ROLE} AS role, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS content, CASE WHEN conv_id % 3 = 0 THEN [] ELSE ['{{"name":"look"}}', '{{"name":"open"}}'] END AS tools, CASE turn % 3 WHEN 0 THEN [] WHEN 1 THEN [{_CALL}] ELSE [{_CALL}, {_CALL}] END AS calls FROM conversations),
    l AS (SELECT *, row_number() OVER w = 1 AND role = 'system' AS lead_, lag(role) OVER w AS before, lead(role) OVER w AS after FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, '<|im_start|>system' || chr(10) || coalesce(nullif(max(content) FILTER (lead_), ''), '{render.TOOL_SYSTEM}') || CASE WHEN len(any_value(tools)) > 0 THEN chr(10) || chr(10) || '{{intro}}' || array_to_string(any_value(tools), chr(10)) || '{{outro}}' ELSE '' END || '<|im_end|>' || chr(10) AS head FROM l GROUP BY conv_id),
    p AS (SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) WHEN 'tool' THEN CASE WHEN before = 'tool' THEN chr(10) ELSE '<|im_start|>user' || chr(10) END ELSE '<|im_start|>' || role || chr(10) END AS a,
      CASE role WHEN 'assistant' THEN array_to_string(list_concat(CASE WHEN content = '' THEN [] ELSE [content] END, list_transform(calls, lambda c: '<tool_call>' || chr(10) || c || chr(10) || '</tool_call>')), chr(10)) || '<|im_end|>' WHEN 'tool' THEN '<tool_response>' || chr(10) || content || chr(10) || '</tool_response>' ELSE content END AS b,
      CASE role WHEN 'assistant' THEN chr(10) WHEN 'tool' THEN CASE WHEN after = 'tool' THEN '' ELSE '<|im_end|>' || chr(10) END ELSE '<|im_end|>' || chr(10) END AS c FROM l WHERE NOT lead_),
    o AS (SELECT p.*, head, len(head) + coalesce(sum(len(a) + len(b) + len(c)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(a) AS start FROM p JOIN s USING (conv_id))
    SELECT s.conv_id, sha256(s.head || coalesce(string_agg(a || b || c, '' ORDER BY turn), '')) AS text_sha256, coalesce(list(start::BIGINT ORDER BY turn) FILTER (role = 'assistant'), []::BIGINT[]) AS starts, coalesce(list((start + len(b))::BIGINT ORDER BY turn) FILTER (role = 'assistant'), []::BIGINT[]) AS ends FROM s LEFT JOIN o USING (conv_id) GROUP BY s.conv_id, s.head""".replace("{intro}", render.TOOL_INTRO).replace("{outro}", render.TOOL_OUTRO),
)
def q_agent_render(spark, sf_dir):
    call = F.expr(_CALL)
    calls = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).when(F.col("turn") % 3 == 1, F.array(call)).otherwise(F.array(call, call))
    turn = F.struct("turn", F.expr(_ROLE).alias("role"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("content"), calls.alias("calls"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    tools = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit('{"name":"look"}'), F.lit('{"name":"open"}')))
    out = rows.select("conv_id", F.inline(F.array(render.render_tools(F.col("m"), tools))))
    places = lambda n: F.transform("spans", lambda s: s[n].cast("long"))
    return out.select("conv_id", F.sha2("text", 256).alias("text_sha256"), places("start").alias("starts"), places("end").alias("ends"))


_IDS = _WORDS.format("text")


@register(
    "q_masked_context",
    f"""WITH s AS (SELECT conv_id, turn, role, list_transform({_IDS}, lambda w: len(w)::INT) AS ids, CASE WHEN role <> 'assistant' THEN [] WHEN conv_id % 7 = 0 THEN [1]::INT[] ELSE [1, 2]::INT[] END AS head FROM conversations),
    g AS (SELECT conv_id, flatten(list(list_concat(head, CASE WHEN role = 'assistant' AND len(ids) > 0 THEN [7, 8]::INT[] ELSE [] END, ids) ORDER BY turn)) AS input_ids, flatten(list(list_concat(list_transform(head, lambda x: -100), CASE WHEN role = 'assistant' AND len(ids) > 0 THEN [-100, -100] ELSE [] END, CASE WHEN role = 'assistant' THEN ids ELSE list_transform(ids, lambda x: -100) END) ORDER BY turn)) AS labels,
      count(*) FILTER (role = 'assistant' AND len(ids) > 0) AS n FROM s GROUP BY conv_id), r AS (SELECT *, CASE WHEN n = 0 THEN 'no_supervision' WHEN conv_id % 7 = 0 THEN 'missing_header' END AS reason FROM g) SELECT conv_id, CASE WHEN reason IS NULL THEN input_ids END AS input_ids, CASE WHEN reason IS NULL THEN labels END AS labels, reason FROM r""",
)
def q_masked_context(spark, sf_dir):
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.length(w))
    assistant = F.col("role") == "assistant"
    head = F.when(~assistant, F.array().cast("array<int>")).when(F.col("conv_id") % 7 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    turn = F.struct("turn", F.concat(head, ids).alias("i"), F.concat(F.transform(head, lambda x: F.lit(-100)), F.when(assistant, ids).otherwise(F.transform(ids, lambda x: F.lit(-100)))).alias("l"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    rows = rows.select("conv_id", F.flatten(F.transform("t", lambda t: t["i"])).alias("i"), F.flatten(F.transform("t", lambda t: t["l"])).alias("l"))
    return rows.select("conv_id", F.inline(F.array(K.masked_context(F.col("i"), F.col("l"), (1, 2), (7, 8)))))


_MIX = f"""SELECT doc_id, source, lang, list_concat(t, list_transform(range(0, 2048 - len(t)), lambda x: 0::INT)) AS input_ids, list_concat(list_transform(t, lambda x: CASE WHEN x % 2 = 0 THEN -100 WHEN doc_id % 97 = 5 THEN x + 1 ELSE x END::INT), list_transform(range(0, 2048 - len(t)), lambda x: CASE WHEN doc_id % 89 = 3 THEN 0 ELSE -100 END::INT)) AS labels,
    list_concat(list_transform(t, lambda x: CASE WHEN doc_id % 83 = 4 THEN 2 ELSE 1 END::INT), list_transform(range(0, 2048 - len(t)), lambda x: 0::INT)) AS mask FROM (SELECT doc_id, source, lang, list_transform({_WORDS.format('text')}, lambda w: len(w)::INT) AS t FROM documents) WHERE len(t) BETWEEN 2 AND 2047"""


@register(
    "q_mixture_check",
    f"""WITH m AS ({_MIX}), c AS (SELECT source, lang, sum(len(list_filter(labels[2:], lambda x: x <> -100)))::BIGINT AS found FROM m GROUP BY 1, 2), d AS (SELECT source, lang, CASE WHEN lang = 'de' THEN found + 1 ELSE found END AS declared FROM c WHERE lang <> 'fr' OR lang IS NULL)
    SELECT 'mask_not_binary' AS problem, '' AS key, 0::BIGINT AS declared, count(*) AS found FROM m WHERE len(list_filter(mask, lambda x: x NOT IN (0, 1))) > 0 HAVING count(*) > 0 UNION ALL SELECT 'padding_supervised', '', 0, count(*) FROM m WHERE len(list_filter(list_zip(labels, mask), lambda x: x[2] = 0 AND x[1] <> -100)) > 0 HAVING count(*) > 0
    UNION ALL SELECT 'label_differs', '', 0, count(*) FROM m WHERE len(list_filter(list_zip(labels, input_ids), lambda x: x[1] <> -100 AND x[1] <> x[2])) > 0 HAVING count(*) > 0
    UNION ALL SELECT 'token_accounting', concat_ws(':', c.source, c.lang), declared, found FROM c LEFT JOIN d ON c.source IS NOT DISTINCT FROM d.source AND c.lang IS NOT DISTINCT FROM d.lang WHERE declared IS DISTINCT FROM found""",
)
def q_mixture_check(spark, sf_dir):
    t = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.length(w))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", t.alias("t")).where("size(t) between 2 and 2047")
    pad = lambda x: F.array_repeat(x, F.lit(2048) - F.size("t"))
    odd = lambda m, n: F.col("doc_id") % m == n
    labels = F.concat(F.transform("t", lambda x: F.when(x % 2 == 0, -100).when(odd(97, 5), x + 1).otherwise(x)), pad(F.when(odd(89, 3), 0).otherwise(-100)))
    mask = F.concat(F.transform("t", lambda x: F.when(odd(83, 4), 2).otherwise(1)), pad(F.lit(0)))
    rows = docs.select("source", "lang", F.concat("t", pad(F.lit(0))).alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"))
    true = rows.groupBy("source", "lang").agg(F.sum(K.shifted_supervision(F.col("labels"))).alias("n"))
    declared = true.where("lang <> 'fr' or lang is null").select("source", "lang", (F.col("n") + F.when(F.col("lang") == "de", 1).otherwise(0)).alias("tokens"))
    return K.verify_mixture(rows, declared, ["source", "lang"], 2048)


@register(
    "q_dataset_manifest",
    """WITH d AS (SELECT lang, source, CASE WHEN b < 9800 THEN 'train' WHEN b < 9900 THEN 'validation' ELSE 'test' END AS split, n_chars FROM (SELECT *, ('0x' || substr(sha256('split-v1' || chr(0) || doc_id::VARCHAR), 1, 16))::UBIGINT % 10000 AS b FROM documents))
    SELECT split, source, lang, grouping(split, source, lang)::BIGINT AS level, count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS tokens, (coalesce(sum(n_chars), 0) * 10000 // (SELECT sum(n_chars) FROM d))::BIGINT AS share_bp FROM d GROUP BY GROUPING SETS ((split), (source), (lang), ())""",
)
def q_dataset_manifest(spark, sf_dir):
    split = X.split_of(X.hash_bucket("split-v1", F.col("doc_id").cast("string")))
    return K.dataset_manifest(table(spark, sf_dir, "documents").select(split.alias("split"), "source", "lang", "n_chars"), ["split", "source", "lang"], "n_chars")


@register("q_pack_efficiency", f"SELECT lang, max(bin) + 1 AS bins, sum(n_chars)::BIGINT AS tokens, (sum(n_chars) * 10000 // ((max(bin) + 1) * 4096))::BIGINT AS efficiency_bp FROM ({ORACLES['q_pack_best_fit']}) WHERE bin IS NOT NULL GROUP BY lang")
def q_pack_efficiency(spark, sf_dir):
    packed = sampling.pack_best_fit(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", 4096).where("bin is not null")
    return packed.groupBy("lang").agg((F.max("bin") + 1).alias("bins"), F.sum("n_chars").alias("tokens")).select("*", F.expr("(tokens * 10000) div (bins * 4096)").alias("efficiency_bp"))


@register(
    "q_capped_budget",
    """WITH o AS (SELECT doc_id, source, n_chars, sha256('balance-1' || chr(0) || doc_id::VARCHAR) AS k FROM documents), t AS (SELECT source, (sum(n_chars) * 5) // 2 AS target, sum(n_chars) AS total FROM documents GROUP BY source), c AS (SELECT o.*, t.target, t.total, sum(n_chars) OVER (PARTITION BY source ORDER BY k, doc_id) AS cum FROM o JOIN t USING (source))
    SELECT source, doc_id, (2 + CASE WHEN target % total - (cum - n_chars) > 0 THEN 1 ELSE 0 END)::BIGINT AS uses, (2 * n_chars + greatest(0, least(n_chars, target % total - (cum - n_chars))))::BIGINT AS taken FROM c""",
)
def q_capped_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", sampling.hash_order("balance-1", F.col("doc_id")).alias("k"))
    targets = docs.groupBy("source").agg(F.expr("(sum(n_chars) * 5) div 2").alias("target"))
    taken = sampling.exact_budget(docs, "source", ["k", "doc_id"], "n_chars", targets, cap=3)
    return taken.select("source", "doc_id", (F.col("epochs") + F.when(F.col("trimmed") > 0, 1).otherwise(0)).alias("uses"), "taken")


_QUOTAS = [("en", 56), ("de", 24), ("fr", 24), ("xx", 5)]


@register(
    "q_quota_gate",
    """WITH q(lang, quota) AS (VALUES ('en', 56), ('de', 24), ('fr', 24), ('xx', 5)), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS n FROM documents) SELECT q.lang, quota, count(doc_id) AS available, count(doc_id) >= quota AS passed, coalesce(sum(CASE WHEN n <= quota THEN doc_id END), 0)::BIGINT AS chosen_ids, count(*) FILTER (n <= quota) AS chosen FROM q LEFT JOIN r ON q.lang = r.lang GROUP BY q.lang, quota""",
)
def q_quota_gate(spark, sf_dir):
    quotas = spark.createDataFrame(_QUOTAS, "lang string, quota int")
    chosen, gate = selection.quota_gate(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", ["n_chars", "doc_id"], quotas)
    sums = chosen.groupBy(F.col("lang").alias("of")).agg(F.sum("doc_id").alias("chosen_ids"), F.count("*").alias("chosen"))
    return gate.join(sums, F.col("lang") == F.col("of"), "left").select("lang", "quota", "available", "passed", F.coalesce("chosen_ids", F.lit(0)).alias("chosen_ids"), F.coalesce("chosen", F.lit(0)).alias("chosen"))


_METRICS = ORACLES["q_repetition_metrics"].replace("FROM documents", "FROM (SELECT conv_id * 100 + turn AS doc_id, text FROM conversations)")
_NORMAL = "trim(regexp_replace(lower(text), '[ \\n]+', ' ', 'g'))"
_TRACES = f"""m AS ({_METRICS}), e AS (SELECT DISTINCT {_NORMAL} AS t FROM conversations WHERE conv_id % 5 = 0),
    c AS (SELECT conv_id, turn, text, n_words AS tokens, repeated_bp, max_line_repeat, conv_id % 5 <> 0 AND {_NORMAL} IN (SELECT t FROM e) AS dup, n_words + len({_WORDS.format("role || ' x'")}) AS seq, position('er' IN lower(text)) > 0 AS anchor, (CASE WHEN contains(lower(text), 'quez') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ichen') THEN 1 ELSE 0 END) AS others FROM conversations JOIN m ON m.doc_id = conv_id * 100 + turn)"""
_TAIL = "WHEN repeated_bp > 500 THEN 'repeated_8gram_over_500bp' WHEN max_line_repeat > 1 THEN 'identical_line_repetition' WHEN dup THEN 'duplicate_normalized_trace' WHEN seq > 90 THEN 'sequence_over_90_tokens' END"


def _traces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    normal = F.trim(F.regexp_replace(F.lower("text"), "[ \n]+", " "))
    known = rows.where("conv_id % 5 = 0").select(F.sha2(normal, 256).alias("h")).distinct().withColumn("known", F.lit(True))
    told = rows.select("conv_id", "turn", "text", X.repetition(F.col("text")).alias("r"), F.sha2(normal, 256).alias("h")).join(known, "h", "left")
    duplicate = (F.col("conv_id") % 5 != 0) & F.coalesce("known", F.lit(False))
    m = F.struct(F.col("r.tokens").alias("tokens"), F.col("r.repeated_bp").alias("repeated_bp"), F.col("r.max_line_repeat").alias("max_line_repeat"), duplicate.alias("duplicate"), (F.col("r.tokens") + 2).alias("sequence_tokens"))
    return told.select("conv_id", "turn", "text", m.alias("m"))


@register(
    "q_candidate_cascade",
    f"""WITH {_TRACES}, r AS (SELECT *, CASE WHEN tokens = 0 THEN 'empty_reasoning' WHEN tokens > 80 THEN 'reasoning_over_80_tokens' {_TAIL} AS reason FROM c), w AS (SELECT conv_id, min(turn) FILTER (reason IS NULL) AS won FROM r GROUP BY conv_id)
    SELECT conv_id, turn, reason, CASE WHEN turn = won THEN 'selected' WHEN turn > won THEN 'unused' ELSE coalesce(reason, 'no_candidate_passed') END AS outcome FROM r JOIN w USING (conv_id)""",
)
def q_candidate_cascade(spark, sf_dir):
    told = _traces(spark, sf_dir).select("conv_id", "turn", selection.trace_reason(F.col("m"), 80, 500, 1, 90).alias("reason"))
    return selection.first_accepted(told, "conv_id", "turn", "reason")


@register(
    "q_solver_cascade",
    f"""WITH {_TRACES}, s AS (SELECT *, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'solver_runtime_error' WHEN (conv_id + turn) % 11 = 0 THEN 'solver_length_limit' WHEN (conv_id + turn) % 7 = 0 THEN 'solver_invalid_output' WHEN (conv_id + turn) % 5 = 0 THEN 'solver_answer_mismatch' END AS solver FROM c)
    SELECT conv_id, turn, solver, coalesce(solver, CASE WHEN tokens = 0 THEN 'empty_reasoning' WHEN tokens > 80 THEN 'reasoning_over_80_tokens' WHEN NOT anchor THEN 'missing_evidence_anchor' WHEN others > 0 THEN 'other_label_mentioned' {_TAIL}) AS reason FROM s""",
)
def q_solver_cascade(spark, sf_dir):
    n, low = F.col("conv_id") + F.col("turn"), F.lower("text")
    rows = _traces(spark, sf_dir)
    answer = F.when(n % 7 == 0, None).when(n % 5 == 0, '{"a":2}').otherwise('{"a":1}')
    solver = selection.solver_reason(F.when(n % 13 == 0, "failed").otherwise("ok"), F.when(n % 11 == 0, "length").otherwise("stop"), answer, F.lit('{"a":1}'))
    others = F.when(F.contains(low, F.lit("quez")), 1).otherwise(0) + F.when(F.contains(low, F.lit("ichen")), 1).otherwise(0)
    trace = selection.trace_reason(F.col("m"), 80, 500, 1, 90, F.contains(low, F.lit("er")), others)
    return rows.select("conv_id", "turn", solver.alias("solver"), F.coalesce(solver, trace).alias("reason"))
