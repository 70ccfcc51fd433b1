"""Import, filter, normalise, dedup, split, manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import dedup
from millrace.plans.registry import register
from millrace.plans.tables import table

_BLANK = r"[\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = rf"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '^\x{{FEFF}}', ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_CASCADE_SQL = rf"""
  SELECT doc_id, lang, source, t, CASE WHEN t IS NULL OR t = '' THEN 'empty_after_normalization'
    WHEN regexp_matches(t, '[\x00-\x08\x0B-\x1F\x7F-\x9F]') THEN 'forbidden_control_character'
    WHEN len(t) > 12000 THEN 'message_too_long'
    WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported_language'
    WHEN len(t) < 100 THEN 'empty_content' END AS reason
  FROM (SELECT doc_id, lang, source, {_NORM} AS t FROM documents)"""


def cascade(docs):
    """Rows with their normalised text ``t`` and the first rule they fail, null if none."""
    t = F.col("t")
    reason = (
        F.when(t.isNull() | (t == ""), "empty_after_normalization")
        .when(t.rlike(X.FORBIDDEN), "forbidden_control_character")
        .when(F.length(t) > 12_000, "message_too_long")
        .when(~F.col("lang").isin("en", "de", "fr"), "unsupported_language")
        .when(F.length(t) < 100, "empty_content")
    )
    return docs.select("doc_id", "lang", "source", X.normalise(F.col("text")).alias("t")).withColumn("reason", reason)


@register("q_normalize_text", f"SELECT doc_id, len(t)::BIGINT AS norm_chars, sha256(t) AS norm_sha256, len(t) > 131072 AS too_long FROM (SELECT doc_id, {_NORM} AS t FROM documents)")
def q_normalize_text(spark, sf_dir):
    t = X.normalise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("norm_chars"), F.sha2("t", 256).alias("norm_sha256"), (F.length("t") > 131_072).alias("too_long"))


@register("q_reject_cascade", f"SELECT doc_id, lang, reason, reason IS NULL AS accepted FROM ({_CASCADE_SQL})")
def q_reject_cascade(spark, sf_dir):
    return cascade(table(spark, sf_dir, "documents")).select("doc_id", "lang", "reason", F.col("reason").isNull().alias("accepted"))


@register(
    "q_import_manifest",
    f"""SELECT lang, reason, count(*) AS n_rows, count(*) FILTER (reason IS NULL) AS n_accepted, coalesce(sum(len(t)), 0)::BIGINT AS n_chars, grouping(lang, reason) AS level
    FROM (SELECT lang, coalesce(reason, 'accepted') AS r, reason AS reason, t FROM ({_CASCADE_SQL})) GROUP BY GROUPING SETS ((lang), (reason), ())""",
)
def q_import_manifest(spark, sf_dir):
    cascade(table(spark, sf_dir, "documents")).createOrReplaceTempView("imported")
    return spark.sql("""SELECT lang, reason, count(*) AS n_rows, count_if(reason IS NULL) AS n_accepted, coalesce(sum(length(t)), 0) AS n_chars, grouping_id() AS level
        FROM (SELECT lang, reason, t FROM imported) GROUP BY GROUPING SETS ((lang), (reason), ())""")


@register(
    "q_license_allowlist",
    """SELECT doc_id, license, license IN ('apache-2.0', 'bsd-2-clause', 'bsd-3-clause', 'cc0-1.0', 'isc', 'mit', 'unlicense') AS allowed FROM (
    SELECT doc_id, replace(lower(trim(regexp_extract(text, '(?:under the|license:) *([A-Za-z0-9_.-]+)', 1))), '_', '-') AS license FROM documents) WHERE license <> ''""",
)
def q_license_allowlist(spark, sf_dir):
    name = X.normalise_license(F.regexp_extract("text", "(?:under the|license:) *([A-Za-z0-9_.-]+)", 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("license")).where("license <> ''")
    return rows.withColumn("allowed", F.col("license").isin(*X.LICENSES))


#: Patterns of credentials in published files.
SECRETS = {
    "AWS access key": r"\bAKIA[A-Z0-9]{16}\b",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "Hugging Face token": r"\bhf_[A-Za-z0-9]{20,}\b",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


@register("q_secret_scan", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label FROM documents WHERE regexp_matches(text, '{p}')" for k, p in (SECRETS | {"hex token": r"\b[0-9a-f]{40}\b"}).items()))
def q_secret_scan(spark, sf_dir):
    patterns = SECRETS | {"hex token": r"\b[0-9a-f]{40}\b"}
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("label"))


_PATHS_SQL = """SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS path, count(*) AS n_turns, regexp_matches(string_agg(role, '>' ORDER BY turn), '^(system>)?user>assistant(>user>assistant)*$') AS valid FROM conversations GROUP BY conv_id"""


@register("q_role_path_valid", _PATHS_SQL)
def q_role_path_valid(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    paths = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("path"), F.count("*").alias("n_turns"))
    return paths.withColumn("valid", F.col("path").rlike("^(system>)?user>assistant(>user>assistant)*$"))


@register(
    "q_message_tree_paths",
    """WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS node, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations),
    t(node, root, depth) AS (SELECT node, node, 0 FROM n WHERE parent IS NULL UNION ALL SELECT n.node, t.root, t.depth + 1 FROM n JOIN t ON n.parent = t.node)
    SELECT node, root, depth::BIGINT AS depth, 'ok' AS status FROM t""",
)
def q_message_tree_paths(spark, sf_dir):
    node = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(node.alias("node"), F.lag(node).over(Window.partitionBy("conv_id").orderBy("turn")).alias("parent"))
    return dedup.root_paths(rows, "node", "parent")


_HASHED = f"SELECT doc_id, source, sha256({_NORM}) AS content FROM documents"


@register("q_exact_dedup", f"SELECT content, min(struct_pack(s := source, d := doc_id)).s AS source, min(struct_pack(s := source, d := doc_id)).d AS doc_id, count(*) AS n_copies FROM ({_HASHED}) GROUP BY content")
def q_exact_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(X.normalise(F.col("text")), 256).alias("content"))
    return dedup.exact_winners(rows, "content", ["source", "doc_id"])


@register(
    "q_exact_dedup_rejects",
    f"SELECT doc_id, duplicate_of, 'exact_duplicate' AS reason FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content ORDER BY source, doc_id) AS duplicate_of FROM ({_HASHED})) WHERE doc_id <> duplicate_of",
)
def q_exact_dedup_rejects(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(X.normalise(F.col("text")), 256).alias("content"))
    return dedup.exact_rejects(rows, "content", ["source", "doc_id"], "doc_id").select("doc_id", "duplicate_of", F.lit("exact_duplicate").alias("reason"))


_BUCKET = "('0x' || substr(sha256('{seed}' || chr(0) || {key}), 1, 16))::UBIGINT % 10000"
_SPLIT = "CASE WHEN {b} < 9800 THEN 'train' WHEN {b} < 9900 THEN 'validation' ELSE 'test' END"


@register("q_split_bucket", f"SELECT doc_id, b::INT AS bucket, {_SPLIT.format(b='b')} AS split FROM (SELECT doc_id, {_BUCKET.format(seed='split-v1', key='doc_id::VARCHAR')} AS b FROM documents)")
def q_split_bucket(spark, sf_dir):
    bucket = X.hash_bucket("split-v1", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket")).withColumn("split", X.split_of(F.col("bucket")))


@register(
    "q_hash_order",
    "SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('order-1' || chr(0) || doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 3",
)
def q_hash_order(spark, sf_dir):
    key = F.sha2(F.concat(F.lit("order-1"), F.lit("\0"), F.col("doc_id").cast("string")), 256)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", key.alias("k"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("k", "doc_id")).cast("long")).where("rn <= 3").select("source", "doc_id", "rn")


@register(
    "q_components_split",
    f"""WITH RECURSIVE k AS (SELECT DISTINCT doc_id, unnest(['c:' || sha256(text), 'l:' || split_part(text, chr(10), 1)]) AS key FROM documents),
    e AS (SELECT k.doc_id AS a, m.m AS b FROM k JOIN (SELECT key, min(doc_id) AS m FROM k GROUP BY key) m USING (key) UNION SELECT m.m, k.doc_id FROM k JOIN (SELECT key, min(doc_id) AS m FROM k GROUP BY key) m USING (key)),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a),
    d AS (SELECT component, count(*) AS n_members, sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::UBIGINT::HUGEINT)::VARCHAR) AS component_id FROM c GROUP BY component),
    s AS (SELECT *, {_BUCKET.format(seed='split-v1', key='component_id')} AS b FROM d)
    SELECT doc_id, component, n_members, component_id, {_SPLIT.format(b='b')} AS split FROM c JOIN s USING (component)""",
)
def q_components_split(spark, sf_dir):
    keys = F.explode(F.array(F.concat(F.lit("c:"), F.sha2("text", 256)), F.concat(F.lit("l:"), F.split_part("text", F.lit("\n"), F.lit(1)))))
    rows = table(spark, sf_dir, "documents").select("doc_id", keys.alias("key"))
    return dedup.safe_split(dedup.group_components(rows, "doc_id", "key"), "doc_id")


_NORM_TURN = _NORM.replace("nfc_normalize(text)", "nfc_normalize(said)")
_SAID = "CASE WHEN conv_id % 9 = 2 AND turn = 1 THEN chr(10) || ' ' WHEN conv_id % 9 = 4 AND turn = 2 THEN text || chr(7) || 'x' ELSE text END"


@register(
    "q_normalize_sample",
    f"""WITH t AS (SELECT conv_id, turn, {_NORM_TURN} AS t FROM (SELECT conv_id, turn, {_SAID} AS said FROM conversations)), r AS (SELECT *, CASE WHEN t = '' THEN 'empty_after_normalization' WHEN regexp_matches(t, '[\x00-\x08\x0B-\x1F\x7F-\x9F]') THEN 'forbidden_control_character' WHEN len(t) > 500 THEN 'message_too_long' END AS reason FROM t),
    s AS (SELECT conv_id, min(turn) FILTER (reason IS NOT NULL) AS message_index, sum(len(t)) AS n FROM r GROUP BY conv_id) SELECT s.conv_id, coalesce(r.reason, CASE WHEN n > 1200 THEN 'sample_too_long' END) AS reason, message_index, CASE WHEN r.reason IS NULL AND n <= 1200 THEN n END::BIGINT AS n_chars FROM s LEFT JOIN r ON r.conv_id = s.conv_id AND r.turn = s.message_index""",
)
def q_normalize_sample(spark, sf_dir):
    """The first message of a sample that fails, with its place; then the sample's length."""
    k, turn = F.col("conv_id"), F.col("turn")
    said = F.when((k % 9 == 2) & (turn == 1), "\n ").when((k % 9 == 4) & (turn == 2), F.concat("text", F.lit("\x07x"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalise(said).alias("t"))
    return X.sample_reasons(rows, "conv_id", "turn", "t", 500, 1200)
