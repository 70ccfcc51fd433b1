"""URL filters: rules by host and path, and a tree of path templates per host.

In Spark's own functions only. Variable segments of a path become wildcards; per host and
level, sibling branches that are shown to be alike are merged into one wildcard branch; a
template is rejected by its smoothed purity. Branches are alike if the confidence
intervals of their shares of blocked labels lie in one and the same band; a branch without
enough labels to show that stays apart, and without any it has purity one half. The
rules' own decisions are the labels, so what the tree learns is where the rules block.
All statistics are sums over distinct paths, aggregated before anything is joined.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

#: (verdict, host, path): a rule holds for its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels of a kind that a template is thought to have beforehand, and the share of blocked ones that rejects.
PRIOR, REJECT = 1.0, 0.85
#: Bounds of the bands of blocked shares, and half the width of a share's interval in standard errors.
CLEAN, MARGIN = 0.15, 1.645
#: Levels that the SQL spells out; the operator goes on as deep as paths differ.
SQL_LEVELS = 6

_CLASSES = ((r"^[0-9]+$", "<num>"), (r"^[0-9]+\.[a-zA-Z]+$", "<num.ext>"), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "<date>"), (r"^[0-9a-fA-F]*[0-9][0-9a-fA-F]*$", "<hex>"), (r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$", "<uuid>"), (r"[0-9]{3}", "<mix>"), (r"^[^-]+(-[^-]+){3,}$", "<slug>"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``; A-Z of the host are lowered."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule goes in front
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, variable ones as their class, literal ones after ``=``."""

    def general(s: Column) -> Column:
        out = F.concat(F.lit("="), s)
        for pattern, name in reversed(_CLASSES):
            out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)


def _band(bad: Column, labelled: Column) -> Column:
    """The band that the interval (Wilson's) of a branch's blocked share lies in; null where it lies in none."""
    n, z = labelled.cast("double"), MARGIN
    p = bad / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = middle - half, middle + half
    return F.when(labelled == 0, None).when(high <= CLEAN, "<*allow>").when(low >= REJECT, "<*block>").when((low >= CLEAN) & (high <= REJECT), "<*both>")


def templates(labelled: DataFrame) -> DataFrame:
    """``host, segs, template, purity`` from rows of ``host, segs, bad`` (1, 0 or null).

    Level by level, until no two paths that are still together differ: a round's table
    holds only the paths that went on, so rounds are as many as the deepest fork.
    """
    now = labelled.groupBy("host", "segs").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    now, level, ended = now.withColumn("template", F.lit("")), 0, []
    while True:
        rest = F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(0)))
        rows = now.withColumns({"child": F.coalesce(F.get("segs", F.lit(level)), F.lit("$")), "rest": rest})
        forks = rows.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high")).where("low <> high").select("host", "template", F.lit(True).alias("fork"))
        branches = rows.where("child <> '$'").groupBy("host", "template", "child").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
        branches = branches.withColumn("band", _band(F.col("b"), F.col("n"))).where("band is not null").select("host", "template", "child", "band")
        # A band with one branch merges nothing: the branch keeps its name.
        several = branches.groupBy("host", "template", "band").agg(F.count("*").alias("m")).where("m > 1").select("host", "template", "band")
        merged = branches.join(several, ["host", "template", "band"])
        joined = rows.join(forks, ["host", "template"], "left").join(merged, ["host", "template", "child"], "left")
        whole = F.concat("template", F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise(""))
        step = F.when(F.col("fork").isNull(), whole).when(F.col("child") == "$", F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("band", "child")))
        table = materialize(joined.select("host", "segs", "labelled", "bad", step.alias("template"), (F.col("fork").isNull() | (F.col("child") == "$")).alias("ended")), "templates")
        ended.append(table.where("ended").drop("ended"))
        now, level = table.where("not ended").drop("ended"), level + 1
        if not now.limit(1).count():
            break
    found = reduce(DataFrame.unionAll, ended)
    purity = found.groupBy("host", "template").agg(((F.sum("bad") + PRIOR) / (F.sum("labelled") + 2 * PRIOR)).alias("purity"))
    return found.select("host", "segs", "template").join(purity, ["host", "template"])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, learn_from: Column | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity, by_rule, by_tree`` for every row.

    The verdict is the rule's where one fits, else the tree's: ``block`` where the
    template's smoothed share of blocked labels reaches ``REJECT``, else ``allow``. Null
    urls and those without a scheme have an empty host, path and template, and are
    allowed unless a rule says otherwise. Repeated rows count as often as they are there.
    ``learn_from`` (a boolean column of ``pages``) says which rows' labels the tree sees.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    seen = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), seen.alias("seen"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("*", name.alias("rule"), verdict.alias("by_rule"), segments(F.col("path")).alias("segs")), "urls")
    bad = F.when(F.col("seen") & (F.col("by_rule") == "block"), 1).when(F.col("seen") & (F.col("by_rule") == "allow"), 0)
    found = templates(rows.select("host", "segs", bad.alias("bad")))
    by_tree = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.join(found, ["host", "segs"]).withColumn("by_tree", by_tree)
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_tree").alias("verdict"), "template", "purity", "by_rule", "by_tree")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql() -> str:
    case = lambda k: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if k else w}'" for w, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " END"
    general = "CASE " + " ".join(f"WHEN regexp_matches(seg, '{pattern}') THEN '{name}'" for pattern, name in _CLASSES) + " ELSE '=' || seg END"
    z = f"{MARGIN}::DOUBLE"
    levels = []
    for k in range(SQL_LEVELS):
        levels.append(f"""
, rows_{k} AS (SELECT *, coalesce(segs[{k + 1}], '$') AS child, segs[{k + 1}:] AS rest FROM t_{k} WHERE NOT ended)
, fork_{k} AS (SELECT host, template, min(rest) <> max(rest) AS fork FROM rows_{k} GROUP BY ALL)
, share_{k} AS (SELECT host, template, child, sum(labelled)::DOUBLE AS n, sum(bad) / sum(labelled)::DOUBLE AS p FROM rows_{k} WHERE child <> '$' GROUP BY ALL HAVING sum(labelled) > 0)
, span_{k} AS (SELECT *, (p + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) AS middle, {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n) AS half FROM share_{k})
, band_{k} AS (SELECT *, CASE WHEN middle + half <= {CLEAN} THEN '<*allow>' WHEN middle - half >= {REJECT} THEN '<*block>' WHEN middle - half >= {CLEAN} AND middle + half <= {REJECT} THEN '<*both>' END AS band FROM span_{k})
, merged_{k} AS (SELECT host, template, child, band FROM (SELECT *, count(*) OVER (PARTITION BY host, template, band) AS m FROM band_{k} WHERE band IS NOT NULL) WHERE m > 1)
, t_{k + 1} AS (SELECT r.host, r.segs, r.labelled, r.bad,
  CASE WHEN NOT f.fork THEN r.template || CASE WHEN len(r.rest) > 0 THEN '/' || array_to_string(r.rest, '/') ELSE '' END WHEN r.child = '$' THEN r.template ELSE r.template || '/' || coalesce(m.band, r.child) END AS template,
  NOT f.fork OR r.child = '$' AS ended
  FROM rows_{k} r JOIN fork_{k} f ON r.host = f.host AND r.template = f.template LEFT JOIN merged_{k} m ON r.host = m.host AND r.template = m.template AND r.child = m.child)""")
    done = " UNION ALL ".join(f"SELECT host, segs, labelled, bad, template FROM t_{k} WHERE ended" for k in range(1, SQL_LEVELS + 1))
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosted AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT row_number() OVER () AS rid, *, {case(1)} AS rule, {case(0)} AS by_rule FROM hosted
), split AS (
  SELECT rid, pos, seg FROM (SELECT rid, generate_subscripts(s, 1) AS pos, unnest(s) AS seg FROM (SELECT rid, string_split(path, '/') AS s FROM ruled)) WHERE seg <> ''
), listed AS (
  SELECT rid, list({general} ORDER BY pos) AS s FROM split GROUP BY rid
), segmented AS (
  SELECT r.*, coalesce(l.s, []::VARCHAR[]) AS segs FROM ruled r LEFT JOIN listed l USING (rid)
), t_0 AS (
  SELECT host, segs, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS bad, '' AS template, false AS ended FROM segmented GROUP BY host, segs
){"".join(levels)}
, found AS ({done})
, judged AS (
  SELECT host, template, (sum(bad) + 1) / (sum(labelled) + 2.0)::DOUBLE AS purity FROM found GROUP BY host, template
)
SELECT s.page_id, s.host, s.path, s.rule, coalesce(s.by_rule, CASE WHEN j.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM segmented s JOIN found t ON s.host = t.host AND s.segs = t.segs JOIN judged j ON t.host = j.host AND t.template = j.template
"""


OP5_SQL = _sql()
