"""Line-first quality rules, in Spark's own functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are
removed; a document that loses more than half of its characters, or fails the base rules
on words, is rejected. All is computed within the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, WORD, documents
from millrace.session import let, spread

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
#: A line with more than this share of markup symbols fails.
MAX_SYMBOL_PERCENT = 8
#: A line this long without any punctuation mark fails.
PLAIN_WORDS = 60
#: Phrases of pages' furniture fail lines up to this length; prose may mention them.
BOILERPLATE_CHARS = 200
#: Below this many lines with words, repeated lines reject nothing.
DUP_LINES_FROM = 4

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "clean")

SYMBOLS = r"[#*$%&|<>]"
#: Marks of navigation: separators that stand alone between words.
SEPARATORS = r" [|>»·•/] "
SHOUTS = r"[!?]{2,}"
PUNCTUATION = r"[.,;:!?…。،؟]"
#: Phrases of pages' furniture.
BOILERPLATE = r"(?i)(accept (all )?cookies|this site uses cookies|enable javascript|javascript is (disabled|required)|lorem ipsum|all rights reserved|terms of (use|service)|privacy policy|click here to|sign up for our newsletter|subscribe to our newsletter|skip to (main )?content)"


def _failing(line: Column) -> Column:
    """Of a struct of a line ``x``, its length ``n`` and its number of symbols ``k``; dearer tests come last."""
    x = line["x"]
    words, shouts = F.regexp_count(x, F.lit(WORD)), F.regexp_count(x, F.lit(SHOUTS))
    return (
        (line["k"] * 100 > line["n"] * MAX_SYMBOL_PERCENT)
        | ((line["n"] <= BOILERPLATE_CHARS) & x.rlike(BOILERPLATE))
        | (F.regexp_count(x, F.lit(SEPARATORS)) >= 4)
        | (~x.rlike(PUNCTUATION) & (words >= PLAIN_WORDS))
        | ((shouts >= 3) & (shouts * 4 >= words))
    )


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda v, i: F.coalesce(F.least(F.lit(3), F.get(starts, i + 1) - v), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda e, i: F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.when(i > 0, F.get(s, i - 1)["x"] == e["x"]), F.lit(False))
            return let(F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"])), covered)

        return let(pairs, starts)

    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # Equal windows have equal hashes: without a repeated hash nothing repeats; else the windows themselves are sorted.
    return F.when(F.size(words) < 3, F.lit(0)).when(F.size(F.array_distinct(hashes)) == F.size(words) - 2, F.lit(0)).otherwise(repeated(windows))


def judge(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``: measures, verdict and cleaned text.

    A null or empty text has no word: it fails the base rules, and its cleaned text is
    empty. A text that loses no line comes out as it was. Rows that repeat are judged
    alike. Columns of ``docs`` stay; the added names start with ``prefix``.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x).cast("long"))
    found = F.split(F.btrim(whole, F.lit(" \t\n\x0b\f\r")), SPACE, -1)
    words = F.filter(found, lambda x: x != "")
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), total(w, F.length).alias("chars"), _repeat_words(w).cast("long").alias("rep")))

    def lines(ls: Column) -> Column:
        judged = F.transform(ls, lambda y: F.struct(y["x"].alias("x"), y["n"].alias("n"), _failing(y).alias("f")))
        with_words = F.transform(F.filter(ls, lambda y: y["x"].rlike(WORD)), lambda y: y["x"])
        return F.struct(
            let(with_words, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("w"),
            total(ls, lambda y: y["k"]).alias("symbols"),
            total(ls, lambda y: y["n"]).alias("all"),
            let(judged, lambda j: F.struct(total(F.filter(j, lambda y: y["f"]), lambda y: y["n"]).alias("lost"), F.array_join(F.transform(F.filter(j, lambda y: ~y["f"]), lambda y: y["x"]), "\n").alias("clean"))).alias("j"),
        )

    split = F.transform(F.split(whole, "\n", -1), lambda x: F.struct(x.alias("x"), F.length(x).alias("n"), F.regexp_count(x, F.lit(SYMBOLS)).alias("k")))
    measures = F.struct(by_word.alias("w"), let(split, lines).alias("l"))

    def verdict(m: Column) -> Column:
        w, ls, lost = m["w"], m["l"], m["l"]["j"]["lost"]
        base = (w["n"] < MIN_WORDS) | (100 * w["rep"] > MAX_REPEAT_PERCENT * w["n"])
        lines_ok = (100 * lost <= MAX_LOST_PERCENT * ls["all"]) & ~((ls["w"]["n"] >= DUP_LINES_FROM) & (2 * ls["w"]["dup"] > ls["w"]["n"]))
        values = [w["n"], w["chars"], ls["symbols"], ls["w"]["dup"], w["rep"], base, ~base & lines_ok, lost, ls["j"]["clean"]]
        return F.struct(*[v.alias(prefix + n) for v, n in zip(values, MEASURES, strict=True)])

    # inline() stands between: a projection would be merged and computed anew for each column.
    return docs.select("*", F.inline(F.array(let(measures, verdict))))


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, without their failing lines; columns unchanged, whatever their names."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    judged = judge(docs, text, prefix).where(F.col(f"{prefix}kept"))
    return judged.withColumn(text, F.col(f"{prefix}clean")).select(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = judge(spread(documents(spark, sf_dir).select("doc_id", "text")))
    return judged.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in MEASURES if n != "clean"])


OP9_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, len(text) - len(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM docs
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM windows) WHERE c >= 2
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM repeated) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs
), marked AS (
  SELECT rid, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(l, '{SHOUTS}')) AS shouts,
    len(regexp_extract_all(l, '{SYMBOLS}')) * 100 > len(l) * {MAX_SYMBOL_PERCENT} OR len(regexp_extract_all(l, '{SEPARATORS}')) >= 4 AS marks,
    NOT regexp_matches(l, '{PUNCTUATION}') AS plain, len(l) <= {BOILERPLATE_CHARS} AND regexp_matches(l, '{BOILERPLATE}') AS furniture FROM lines
), by_line AS (
  SELECT rid, count(*) FILTER (words > 0) AS n, count(*) FILTER (words > 0) - count(DISTINCT l) FILTER (words > 0) AS dup, sum(len(l)) AS all_chars,
    coalesce(sum(len(l)) FILTER (marks OR (shouts >= 3 AND shouts * 4 >= words) OR (words >= {PLAIN_WORDS} AND plain) OR furniture), 0) AS lost
  FROM marked GROUP BY rid
), measured AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    l.dup::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, l.lost::BIGINT AS lost_chars, l.n, l.all_chars
  FROM worded w JOIN by_line l USING (rid) LEFT JOIN covered c USING (rid)
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * all_chars AND NOT (n >= {DUP_LINES_FROM} AND 2 * n_dup_lines > n) AS kept, lost_chars FROM based
"""
