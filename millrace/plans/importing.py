"""Importers over JSON rows that are made from the tables, with defects by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import importing
from millrace.plans.registry import register
from millrace.plans.tables import table

_TREE = """SELECT conv_id * 100 + turn AS place, conv_id, turn,
    CASE WHEN conv_id % 19 = 3 AND turn = 3 THEN 'm' || conv_id || '-2' ELSE 'm' || conv_id || '-' || turn END AS message_id,
    CASE WHEN turn = 0 THEN NULL WHEN conv_id % 23 = 5 AND turn = 2 THEN 'gone' WHEN conv_id % 29 = 7 AND turn = 1 THEN 'm' || conv_id || '-3' ELSE 'm' || conv_id || '-' || (turn - 1) END AS parent_id,
    CASE role WHEN 'user' THEN 'prompter' ELSE role END AS role, CASE WHEN conv_id % 13 = 2 AND turn = 1 THEN ' ' ELSE text END AS text,
    CASE WHEN conv_id % 11 = 4 THEN 'DE' ELSE 'En' END AS lang, NOT (conv_id % 17 = 1 AND turn = 1) AS review_result, conv_id % 31 = 6 AND turn = 1 AS deleted,
    CASE WHEN conv_id % 37 = 8 THEN 'growing' ELSE 'ready_for_export' END AS tree_state, CASE WHEN conv_id % 41 = 9 AND turn > 0 THEN 'other' ELSE 't' || conv_id END AS message_tree_id, conv_id % 43 = 10 AND turn = 0 AS broken FROM conversations"""

_TREE_SQL = f"""WITH RECURSIVE s AS ({_TREE}), g AS (SELECT *, count(*) OVER (PARTITION BY message_id) AS c FROM s WHERE NOT broken),
    n AS (SELECT * FROM g WHERE c = 1 AND role IN ('prompter', 'assistant')),
    w(leaf, here, parent, role, hops, path, bad, lost) AS (SELECT message_id, message_id, parent_id, role, 0, [message_id], [message_tree_id, CASE WHEN tree_state <> 'ready_for_export' THEN 's' END, CASE WHEN deleted THEN 'd' END, CASE WHEN NOT review_result THEN 'r' END, CASE WHEN lower(lang) <> 'en' THEN 'l' END, CASE WHEN trim(text) = '' THEN 'e' END], '' FROM n WHERE role = 'assistant'
      UNION ALL SELECT w.leaf, n.message_id, n.parent_id, n.role, w.hops + 1, list_append(w.path, n.message_id),
        list_transform(range(1, 7), lambda i: CASE WHEN i = 1 THEN CASE WHEN w.bad[1] = n.message_tree_id THEN w.bad[1] ELSE '!' END ELSE coalesce(w.bad[i], CASE i WHEN 2 THEN CASE WHEN n.tree_state <> 'ready_for_export' THEN 's' END WHEN 3 THEN CASE WHEN n.deleted THEN 'd' END WHEN 4 THEN CASE WHEN NOT n.review_result THEN 'r' END WHEN 5 THEN CASE WHEN lower(n.lang) <> 'en' THEN 'l' END ELSE CASE WHEN trim(n.text) = '' THEN 'e' END END) END),
        w.lost || CASE WHEN n.role = w.role THEN 'x' ELSE '' END || CASE WHEN list_contains(w.path, n.message_id) THEN 'o' ELSE '' END FROM w JOIN n ON n.message_id = w.parent WHERE NOT contains(w.lost, 'o')),
    f AS (SELECT leaf, max_by(struct_pack(p := parent, r := role, b := bad, l := lost, h := hops), hops) AS e FROM w GROUP BY leaf),
    j AS (SELECT leaf, e.h AS hops, CASE WHEN contains(e.l, 'o') THEN 'invalid_conversation:parent_id' WHEN e.p IS NOT NULL THEN 'missing_parent:parent_id' WHEN contains(e.l, 'x') OR e.r <> 'prompter' THEN 'invalid_conversation:role'
      WHEN e.b[1] = '!' THEN 'invalid_conversation:message_tree_id' WHEN e.b[2] IS NOT NULL THEN 'not_ready:tree_state' WHEN e.b[3] IS NOT NULL THEN 'deleted:deleted' WHEN e.b[4] IS NOT NULL THEN 'review_not_positive:review_result' WHEN e.b[5] IS NOT NULL THEN 'unsupported_language:lang' WHEN e.b[6] IS NOT NULL THEN 'empty_content:text' END AS why FROM f)"""


@register(
    "q_import_tree",
    _TREE_SQL + """ SELECT leaf AS record_id, coalesce(split_part(why, ':', 1), 'accepted') AS outcome, split_part(why, ':', 2) AS field, CASE WHEN why IS NULL THEN hops + 1 END::BIGINT AS n_messages, CASE WHEN why IS NULL THEN 'tree:' || substr(sha256(leaf), 1, 24) END AS id FROM j
    UNION ALL SELECT message_id, CASE WHEN c > 1 THEN 'duplicate_source_id' ELSE 'unsupported_role' END, CASE WHEN c > 1 THEN 'message_id' ELSE 'role' END, NULL, NULL FROM g WHERE c > 1 OR role NOT IN ('prompter', 'assistant')
    UNION ALL SELECT message_id, 'malformed_row', 'review_result', NULL, NULL FROM s WHERE broken""",
)
def q_import_tree(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    rows = spark.sql(_TREE)
    # A broken row says yes instead of true.
    fields = [F.col(c) for c in ("message_id", "parent_id", "role", "text", "lang", "deleted", "tree_state", "message_tree_id")]
    line = lambda review: F.to_json(F.struct(*fields, review.alias("review_result")))
    lines = rows.select("place", F.when(F.col("broken"), line(F.lit("yes"))).otherwise(line(F.col("review_result"))).alias("line"))
    accepted, rejected = importing.import_tree(lines, languages=("en",))
    good = accepted.select("record_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("field"), F.size("messages").cast("long").alias("n_messages"), "id")
    return good.unionAll(rejected.select("record_id", F.col("reason").alias("outcome"), "field", F.lit(None).cast("long").alias("n_messages"), F.lit(None).cast("string").alias("id")))


_EDITS = """SELECT p_partkey AS place, CASE WHEN p_partkey % 13 = 1 THEN ' ' ELSE 'c' || p_partkey END AS "commit", CASE WHEN p_partkey % 5 = 1 THEN 'Ruby' ELSE ' Python' END AS lang,
    CASE p_partkey % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache_2.0' ELSE 'gpl-3.0' END AS license, CASE WHEN p_partkey % 7 = 2 THEN ' , ' ELSE p_brand || ' ,a/b,,' || p_type || ', a/b' END AS repos,
    CASE WHEN p_partkey % 11 = 3 THEN '' ELSE ' ' || p_name END AS subject, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS old_contents, CASE WHEN p_partkey % 17 = 4 THEN '  ' ELSE p_name || '!' END AS new_contents,
    CASE WHEN p_partkey % 3 = 0 THEN 'n.py' END AS new_file, CASE WHEN p_partkey % 19 <> 6 THEN 'o.py' END AS old_file FROM part"""
_EDITS_SQL = f"""WITH s AS ({_EDITS}), r AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(string_split(repos, ','), lambda x: trim(x)), lambda x: x <> ''))) AS l, replace(lower(trim(license)), '_', '-') AS lic, coalesce(new_file, old_file) AS file FROM s),
    j AS (SELECT *, CASE WHEN trim("commit") = '' THEN 'malformed_row:commit' WHEN file IS NULL THEN 'malformed_row:new_file|old_file' WHEN len(l) = 0 THEN 'missing_repository:repos' WHEN lower(trim(lang)) <> 'python' THEN 'not_python:lang'
      WHEN lic NOT IN ('apache-2.0', 'bsd-2-clause', 'bsd-3-clause', 'cc0-1.0', 'isc', 'mit', 'unlicense') THEN 'unsupported_license:license' WHEN trim(subject) = '' THEN 'empty_instruction:subject' WHEN trim(new_contents) = '' THEN 'empty_content:new_contents' END AS why FROM r)"""


def _edits(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_EDITS.replace('"commit"', "`commit`"))
    lines = rows.select("place", F.to_json(F.struct(*[c for c in rows.columns if c != "place"])).alias("line"))
    return lines, *importing.import_code_edits(lines)


@register(
    "q_import_code_edits",
    _EDITS_SQL + """ SELECT CASE WHEN trim("commit") = '' THEN 'row-' || lpad(place::VARCHAR, 8, '0') ELSE "commit" END AS record_id, coalesce(split_part(why, ':', 1), 'accepted') AS outcome, split_part(why, ':', 2) AS field,
    CASE WHEN why IS NULL THEN l END AS repositories, CASE WHEN why IS NULL THEN 'Update ' || file || ' according to this instruction:' || chr(10) || trim(subject) || chr(10) || chr(10) || 'Current file:' || chr(10) || coalesce(old_contents, '') END AS prompt FROM j""",
)
def q_import_code_edits(spark, sf_dir):
    _, accepted, rejected = _edits(spark, sf_dir)
    good = accepted.select("record_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("field"), "repositories", "prompt")
    return good.unionAll(rejected.select("record_id", F.col("reason").alias("outcome"), "field", F.lit(None).cast("array<string>").alias("repositories"), F.lit(None).cast("string").alias("prompt")))


@register(
    "q_import_counts",
    _EDITS_SQL + """, o AS (SELECT split_part(why, ':', 1) AS w, lic FROM j) SELECT 'rows' AS kind, '' AS key, count(*) AS n FROM o UNION ALL SELECT 'candidates', '', count(*) FROM o UNION ALL SELECT 'accepted', '', count(*) FROM o WHERE w IS NULL UNION ALL SELECT 'rejected', '', count(*) FROM o WHERE w IS NOT NULL
    UNION ALL SELECT 'reason', w, count(*) FROM o WHERE w IS NOT NULL GROUP BY w UNION ALL SELECT 'license', lic, count(*) FROM o WHERE w IS NULL GROUP BY lic""",
)
def q_import_counts(spark, sf_dir):
    return importing.import_manifest(*_edits(spark, sf_dir), "license")


@register(
    "q_registration_audit",
    _EDITS_SQL + """, d(reason, n) AS (VALUES ('not_python', 1), ('malformed_row', 2), ('deleted', 3)), f AS (SELECT split_part(why, ':', 1) AS reason, count(*) AS found FROM j WHERE why IS NOT NULL GROUP BY 1) SELECT reason, n AS declared, found FROM d FULL JOIN f USING (reason) WHERE n IS DISTINCT FROM found""",
)
def q_registration_audit(spark, sf_dir):
    declared = spark.createDataFrame([("not_python", 1), ("malformed_row", 2), ("deleted", 3)], "reason string, n int")
    return importing.registration_audit(_edits(spark, sf_dir)[2], declared)
