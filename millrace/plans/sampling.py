"""Similarity, contamination, budgets, packing, arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import passages, sampling, similarity
from millrace.plans.registry import register
from millrace.plans.tables import table
from millrace.session import let, spread

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_.:/-]+|[\\x{4e00}-\\x{9fff}]')"
_SHINGLES = f"""t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
 sh AS (SELECT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM t WHERE len(t) >= 5)
  UNION SELECT doc_id, CASE WHEN len(t) = 0 THEN '<empty>' ELSE array_to_string(t, ' ') END FROM t WHERE len(t) < 5)"""


@register("q_shingles", f"WITH {_SHINGLES} SELECT doc_id, count(DISTINCT s) AS n_shingles FROM sh GROUP BY doc_id")
def q_shingles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@register(
    "q_near_duplicates",
    f"""WITH RECURSIVE {_SHINGLES}, d AS (SELECT DISTINCT doc_id, s FROM sh), k AS (SELECT doc_id, string_agg(s, '|' ORDER BY s) AS k, count(*) AS n FROM d GROUP BY doc_id),
    c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS node FROM k),
    r AS (SELECT d.doc_id, d.s, c.n FROM d JOIN c USING (doc_id) WHERE c.doc_id = c.node),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM r x JOIN r y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.8),
    e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
    m AS (SELECT a AS node, min(least(a, b)) AS component FROM w GROUP BY a)
    SELECT c.doc_id, c.node, coalesce(m.component, c.node) AS component FROM c LEFT JOIN m USING (node)""",
)
def q_near_duplicates(spark, sf_dir):
    return similarity.near_duplicates(spread(table(spark, sf_dir, "documents")))


_LIKE = f"""{_SHINGLES}, d AS (SELECT DISTINCT doc_id, s FROM sh), z AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    like_ AS (SELECT a, b, x.n = y.n AND c = x.n AS same, c / (x.n + y.n - c) AS j FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 20 * c >= 17 * (x.n + y.n - c))"""


@register(
    "q_duplicate_report",
    f"""WITH {_LIKE}, p AS (SELECT same, j, x.source IS NOT DISTINCT FROM y.source AS inner_ FROM like_ JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b)
    SELECT 'equal' AS kind, count(*) FILTER (same AND inner_) AS within, count(*) FILTER (same AND NOT inner_) AS across, CASE WHEN count(*) FILTER (same) > 0 THEN 10000 ELSE 0 END AS max_bp FROM p UNION ALL SELECT 'near', count(*) FILTER (NOT same AND inner_), count(*) FILTER (NOT same AND NOT inner_), coalesce(round_even(max(j) FILTER (NOT same) * 10000, 0), 0)::INT FROM p""",
)
def q_duplicate_report(spark, sf_dir):
    return similarity.duplicate_report(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "source")


_HEAD = _SHINGLES.replace("t AS (", "ht AS (", 1).replace(" sh AS (", " hs AS (").replace("FROM t WHERE", "FROM ht WHERE").replace("FROM documents", "FROM (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents)")


@register(
    "q_cross_source_near",
    f"""WITH {_LIKE}, {_HEAD}, hd AS (SELECT DISTINCT doc_id, s FROM hs), hz AS (SELECT doc_id, count(*) AS n FROM hd GROUP BY doc_id),
    hl AS (SELECT l.a, l.b, any_value(x.n) + any_value(y.n) AS n, count(h.s) AS c FROM like_ l JOIN hz x ON x.doc_id = l.a JOIN hz y ON y.doc_id = l.b JOIN hd g ON g.doc_id = l.a JOIN hd h ON h.doc_id = l.b AND h.s = g.s GROUP BY 1, 2),
    w AS (SELECT a, b FROM hl WHERE 20 * c >= 17 * (n - c)), p AS (SELECT a AS x, b AS y FROM w UNION ALL SELECT b, a FROM w)
    SELECT DISTINCT d.doc_id, d.source FROM p JOIN documents d ON d.doc_id = x JOIN documents e ON e.doc_id = y WHERE e.source < d.source""",
)
def q_cross_source_near(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"))
    return similarity.cross_source_losers(docs, "doc_id", "text", "head", "source")


@register(
    "q_contam_near",
    f"""WITH {_LIKE}, x AS (SELECT doc_id, lang, doc_id % 5 = 0 AS target, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS t FROM documents), q AS (SELECT CASE WHEN m.target THEN m.lang ELSE n.lang END AS target, m.t = n.t AS equal, j FROM like_ JOIN x m ON m.doc_id = a JOIN x n ON n.doc_id = b WHERE m.target <> n.target)
    SELECT v.lang AS target, count(*) FILTER (equal) AS exact, count(*) FILTER (NOT equal) AS near, coalesce(round_even(max(j) * 10000, 0), 0)::INT AS max_bp FROM (SELECT DISTINCT lang FROM x WHERE target AND lang IS NOT NULL) v LEFT JOIN q ON q.target = v.lang GROUP BY v.lang""",
)
def q_contam_near(spark, sf_dir):
    """A fifth of the documents stands for evaluation sets, one per language; the query set is no cut of the rest."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang")
    return similarity.contamination(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0 and lang is not null"), "doc_id", "text", "lang")


@register(
    "q_repetition_metrics",
    """WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)) GROUP BY doc_id),
    l AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS l FROM documents) WHERE l <> '' GROUP BY doc_id, l) GROUP BY doc_id),
    u AS (SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN round_even(list_unique(w) * 10000 / len(w), 0)::BIGINT ELSE 10000 END AS unique_bp FROM t)
    SELECT u.doc_id, n_words, unique_bp, CASE WHEN g.n IS NULL THEN 0 ELSE round_even((g.n - g.u) * 10000 / g.n, 0) END::BIGINT AS repeated_bp, coalesce(l.m, 1)::BIGINT AS max_line_repeat FROM u LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)""",
)
def q_repetition_metrics(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.inline(F.array(X.repetition(F.col("text")))))
    return rows.withColumnRenamed("tokens", "n_words")


_FP = "sha256(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"


_PRINTS = "SELECT doc_id, source, unnest([{'kind': 'full_sequence', 'h': " + _FP.format(t="text") + "}, {'kind': 'prompt_prefix', 'h': " + _FP.format(t="split_part(text, chr(10), 1)") + "}], recursive := true) FROM documents"


@register(
    "q_contam_exact",
    f"""WITH p AS ({_PRINTS}), d AS (SELECT kind, h, count(*) AS n_docs, min(doc_id) AS first_doc FROM p WHERE source <> 'src0' GROUP BY 1, 2) SELECT doc_id AS item_id, kind, n_docs, first_doc FROM p JOIN d USING (kind, h) WHERE source = 'src0'""",
)
def q_contam_exact(spark, sf_dir):
    """Items (one source's documents) whose whole text, or whose prompt (the first line), a document of another source has: with the number of such, never as pairs."""
    fp = lambda t: F.sha2(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), 256)
    prompt = F.split_part("text", F.lit("\n"), F.lit(1))
    prints = F.array(F.struct(F.lit("full_sequence").alias("kind"), fp(F.col("text")).alias("h")), F.struct(F.lit("prompt_prefix").alias("kind"), fp(prompt).alias("h")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.inline(prints))
    docs = rows.where("source <> 'src0'").groupBy("kind", "h").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return rows.where("source = 'src0'").join(docs, ["kind", "h"]).select(F.col("doc_id").alias("item_id"), "kind", "n_docs", "first_doc")


@register(
    "q_contam_passages",
    """WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b)),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), h AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))
    SELECT g.item_id, h.doc_id, count(*) AS n_shared FROM g JOIN h USING (s) GROUP BY 1, 2""",
)
def q_contam_passages(spark, sf_dir):
    return passages.shared_passages(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@register("q_topk_quota", "SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn FROM documents WHERE n_chars <= 2000) WHERE rn <= CASE lang WHEN 'en' THEN 5 ELSE 3 END")
def q_topk_quota(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("n_chars <= 2000").select("lang", "doc_id", "n_chars")
    rn = F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")).cast("long")
    return rows.withColumn("rn", rn).where("rn <= 5").where(F.col("rn") <= F.when(F.col("lang") == "en", 5).otherwise(3)).select("lang", "doc_id", "rn")


_ORDERED = "SELECT doc_id, source, n_chars, sha256('balance-1' || chr(0) || doc_id::VARCHAR) AS k FROM documents"
_TARGETS = "SELECT source, (sum(n_chars) * 3) // 5 AS target, sum(n_chars) AS total FROM documents GROUP BY source"


@register(
    "q_closest_prefix",
    f"""WITH o AS ({_ORDERED}), t AS ({_TARGETS}), c AS (SELECT o.*, t.target, sum(n_chars) OVER (PARTITION BY source ORDER BY k, doc_id) AS cum FROM o JOIN t USING (source)),
    e AS (SELECT source, min(struct_pack(d := abs(cum - target), c := cum)).c AS e FROM c WHERE cum - n_chars < target GROUP BY source)
    SELECT source, doc_id, n_chars, cum::BIGINT AS cum FROM c JOIN e USING (source) WHERE cum <= e.e AND cum - n_chars < target""",
)
def q_closest_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", sampling.hash_order("balance-1", F.col("doc_id")).alias("k"))
    targets = docs.groupBy("source").agg(F.expr("(sum(n_chars) * 3) div 5").alias("target"))
    return sampling.closest_prefix(docs, "source", ["k", "doc_id"], "n_chars", targets).select("source", "doc_id", "n_chars", "cum")


@register(
    "q_balance",
    f"""WITH o AS ({_ORDERED}), a AS (SELECT source, sum(n_chars) AS avail FROM documents GROUP BY source), w AS (SELECT source, avail, CASE WHEN source IN ('src0', 'src1') THEN 3 ELSE 1 END AS want FROM a),
    s AS (SELECT min(avail * 10000 // want) AS scale FROM w), t AS (SELECT source, (want * scale) // 10000 AS target FROM w, s), c AS (SELECT o.*, t.target, sum(n_chars) OVER (PARTITION BY source ORDER BY k, doc_id) AS cum FROM o JOIN t USING (source)),
    e AS (SELECT source, min(struct_pack(d := abs(cum - target), c := cum)).c AS e FROM c WHERE cum - n_chars < target GROUP BY source)
    SELECT c.source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, any_value(target)::BIGINT AS target, abs(sum(n_chars) - any_value(target)) * 10000 <= 300 * any_value(target) AS within_tolerance FROM c JOIN e USING (source) WHERE cum <= e.e AND cum - n_chars < target GROUP BY c.source""",
)
def q_balance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", sampling.hash_order("balance-1", F.col("doc_id")).alias("k"))
    avail = docs.groupBy("source").agg(F.sum("n_chars").alias("avail"), F.when(F.col("source").isin("src0", "src1"), 3).otherwise(1).alias("want"))
    scale = avail.agg(F.min(F.expr("(avail * 10000) div want"))).first()[0] or 0
    targets = avail.select("source", F.expr(f"(want * {scale}L) div 10000").alias("target"))
    kept = sampling.closest_prefix(docs, "source", ["k", "doc_id"], "n_chars", targets)
    out = kept.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.max("target").alias("target"))
    return out.withColumn("within_tolerance", F.abs(F.col("n_chars") - F.col("target")) * 10_000 <= 300 * F.col("target"))


@register(
    "q_balance_rejects",
    f"""WITH o AS ({_ORDERED}), t AS ({_TARGETS}), c AS (SELECT o.*, t.target, sum(n_chars) OVER (PARTITION BY source ORDER BY k, doc_id) AS cum FROM o JOIN t USING (source)),
    e AS (SELECT source, min(struct_pack(d := abs(cum - target), c := cum)).c AS e FROM c WHERE cum - n_chars < target GROUP BY source) SELECT doc_id, source, 'balance_downsampled' AS reason FROM c JOIN e USING (source) WHERE NOT (cum <= e.e AND cum - n_chars < target)""",
)
def q_balance_rejects(spark, sf_dir):
    """What balancing leaves out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", sampling.hash_order("balance-1", F.col("doc_id")).alias("k"))
    targets = docs.groupBy("source").agg(F.expr("(sum(n_chars) * 3) div 5").alias("target"))
    kept = sampling.closest_prefix(docs, "source", ["k", "doc_id"], "n_chars", targets).select("doc_id")
    return docs.where("source is not null").join(kept, "doc_id", "left_anti").select("doc_id", "source", F.lit("balance_downsampled").alias("reason"))


@register(
    "q_exact_budget",
    f"""WITH o AS ({_ORDERED}), t AS (SELECT source, (total * 7) // 4 AS target, total FROM ({_TARGETS})), c AS (SELECT o.*, t.target, t.total, sum(n_chars) OVER (PARTITION BY source ORDER BY k, doc_id) AS cum FROM o JOIN t USING (source))
    SELECT source, doc_id, n_chars, (target // total)::BIGINT AS epochs, greatest(0, least(n_chars, target % total - (cum - n_chars)))::BIGINT AS trimmed, ((target // total) * n_chars + greatest(0, least(n_chars, target % total - (cum - n_chars))))::BIGINT AS taken FROM c""",
)
def q_exact_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", sampling.hash_order("balance-1", F.col("doc_id")).alias("k"))
    targets = docs.groupBy("source").agg(F.expr("(sum(n_chars) * 7) div 4").alias("target"))
    return sampling.exact_budget(docs, "source", ["k", "doc_id"], "n_chars", targets).drop("k")


_NEXT_FIT = """o AS (SELECT {key} AS k, doc_id, n_chars AS s, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS i FROM documents),
    p(k, i, doc_id, s, bin, used) AS (SELECT k, i, doc_id, s, 0::BIGINT, s FROM o WHERE i = 1 UNION ALL
    SELECT o.k, o.i, o.doc_id, o.s, p.bin + CASE WHEN p.used > 0 AND p.used + o.s > {cap} THEN 1 ELSE 0 END, CASE WHEN p.used > 0 AND p.used + o.s > {cap} THEN o.s ELSE p.used + o.s END FROM p JOIN o ON o.i = p.i + 1 AND o.k IS NOT DISTINCT FROM p.k)"""


@register(
    "q_pack_best_fit",
    """WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars AS s, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS i FROM documents WHERE n_chars BETWEEN 1 AND 4096),
    p(lang, i, doc_id, s, bin, rooms) AS (SELECT DISTINCT lang, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM o UNION ALL
    SELECT lang, i, doc_id, s, CASE WHEN best IS NULL THEN len(rooms) ELSE list_position(rooms, best) - 1 END::BIGINT, CASE WHEN best IS NULL THEN list_append(rooms, 4096 - s) ELSE list_concat(list_append(rooms[1:list_position(rooms, best) - 1], best - s), rooms[list_position(rooms, best) + 1:len(rooms)]) END
    FROM (SELECT o.lang, o.i, o.doc_id, o.s, p.rooms, list_min(list_filter(p.rooms, lambda r: r >= o.s)) AS best FROM p JOIN o ON o.i = p.i + 1 AND o.lang IS NOT DISTINCT FROM p.lang))
    SELECT lang, doc_id, s AS n_chars, bin, NULL::VARCHAR AS reason FROM p WHERE i > 0 UNION ALL SELECT lang, doc_id, n_chars, NULL, CASE WHEN n_chars > 4096 THEN 'sequence_too_long' ELSE 'no_tokens' END FROM documents WHERE n_chars NOT BETWEEN 1 AND 4096 OR n_chars IS NULL""",
)
def q_pack_best_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return sampling.pack_best_fit(rows, "lang", "doc_id", "n_chars", 4096)


@register("q_next_fit", f"WITH RECURSIVE {_NEXT_FIT.format(key='source', cap=8192)} SELECT k AS source, doc_id, s AS n_chars, bin FROM p")
def q_next_fit(spark, sf_dir):
    return sampling.next_fit(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 8192)


@register(
    "q_pack_arrays",
    """WITH s AS (SELECT conv_id, turn, role, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: len(w)::INT) AS ids FROM conversations)
    SELECT conv_id, flatten(list(ids ORDER BY turn)) AS input_ids, flatten(list(CASE WHEN role = 'assistant' THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY turn)) AS labels,
    flatten(list(list_transform(ids, lambda x: turn::INT) ORDER BY turn)) AS segment_ids, flatten(list(range(0, len(ids))::INT[] ORDER BY turn)) AS position_ids, sum(len(ids))::BIGINT AS token_count, coalesce(sum(len(ids)) FILTER (role = 'assistant'), 0)::BIGINT AS supervised_token_count FROM s GROUP BY conv_id""",
)
def q_pack_arrays(spark, sf_dir):
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.length(w))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), ids.alias("ids")).alias("s"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    flat = lambda f: F.flatten(F.transform("s", f))
    labels = flat(lambda s: F.when(s["role"] == "assistant", s["ids"]).otherwise(F.transform(s["ids"], lambda x: F.lit(-100))))
    out = turns.select("conv_id", flat(lambda s: s["ids"]).alias("input_ids"), labels.alias("labels"), flat(lambda s: F.transform(s["ids"], lambda x: s["turn"].cast("int"))).alias("segment_ids"), flat(lambda s: F.transform(s["ids"], lambda x, i: i)).alias("position_ids"))
    return out.select("*", F.size("input_ids").cast("long").alias("token_count"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("supervised_token_count"))


@register(
    "q_pad_mask",
    """SELECT doc_id, CASE WHEN ok THEN list_concat(t, list_transform(range(0, 2048 - len(t)), lambda x: 0::INT)) END AS input_ids, CASE WHEN ok THEN list_concat(list_transform(t, lambda x: 1::INT), list_transform(range(0, 2048 - len(t)), lambda x: 0::INT)) END AS attention_mask, CASE WHEN NOT ok THEN 'length_outside_contract' END AS reason
    FROM (SELECT doc_id, t, len(t) BETWEEN 2 AND 2048 AS ok FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: len(w)::INT) AS t FROM documents))""",
)
def q_pad_mask(spark, sf_dir):
    """Whole texts of 2 to 2048 words, padded; others are rejected, none is cut."""
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("t")).withColumn("ok", F.size("t").between(2, 2048))
    pad = F.array_repeat(F.lit(0), F.lit(2048) - F.size("t"))
    padded, mask = F.concat("t", pad), F.concat(F.transform("t", lambda x: F.lit(1)), pad)
    return rows.select("doc_id", F.when(F.col("ok"), padded).alias("input_ids"), F.when(F.col("ok"), mask).alias("attention_mask"), F.when(~F.col("ok"), "length_outside_contract").alias("reason"))


@register(
    "q_chatml_render",
    """SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""",
)
def q_chatml_render(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("r"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["r"]), "").alias("rendered"))


@register("q_bounded_view", "SELECT doc_id, k::INT AS part, substr(text, k * 512 + 1, 512) AS piece FROM (SELECT doc_id, text, unnest(range(0, (len(text) + 511) // 512)) AS k FROM documents)")
def q_bounded_view(spark, sf_dir):
    parts = F.expr("sequence(0, greatest(cast((length(text) + 511) div 512 as int), 1) - 1)")
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(parts).alias("part"))
    return rows.select("doc_id", "part", F.substring("text", F.col("part") * 512 + 1, F.lit(512)).alias("piece"))


@register("q_interleave", "SELECT i, CASE WHEN (i * 3) // 10 > ((i - 1) * 3) // 10 THEN 'zh' ELSE 'en' END AS lang FROM (SELECT unnest(range(1, 2401)) AS i)")
def q_interleave(spark, sf_dir):
    return spark.range(1, 2401).select(F.col("id").alias("i"), F.expr("CASE WHEN (id * 3) div 10 > ((id - 1) * 3) div 10 THEN 'zh' ELSE 'en' END").alias("lang"))


@register("q_rank_partition", "SELECT doc_id, rn, (rn % 4)::INT AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) WHERE rn >= 100")
def q_rank_partition(spark, sf_dir):
    rows = sampling.running(table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("g"), F.lit(1).alias("one")), "g", ["doc_id"], "one")
    return rows.select("doc_id", (F.col("cum") - 1).alias("rn"), ((F.col("cum") - 1) % 4).cast("int").alias("rank")).where("rn >= 100")
