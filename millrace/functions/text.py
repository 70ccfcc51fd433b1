"""Text functions: normalisation, predicates, words, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as string methods of Unicode-aware languages strip it.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Control characters other than line feed and tab.
FORBIDDEN = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
#: Fixed value: lower-case words and single CJK characters.
TOKEN = r"[a-z0-9_.:/-]+|[\x{4e00}-\x{9fff}]"
#: Licences that source code may come under.
LICENSES = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "isc", "mit", "unlicense")


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc_casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def strip(text: Column) -> Column:
    """Without white space at both ends; looks at the ends only, however many blanks are between."""
    return F.btrim(text, F.lit(BLANKS))


def normalise(text: Column) -> Column:
    """NFC, line ends as line feeds, no leading byte-order mark, no blank ends."""
    # Only texts outside ASCII, which alone can change, go through Python.
    composed = F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    lines = F.regexp_replace(composed, "\r\n?", "\n")
    return strip(F.regexp_replace(lines, r"\A\x{FEFF}", ""))


def normalise_license(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "_", "-")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct ``size``-token shingles; fewer tokens are one shingle, none is ``<empty>``."""
    from millrace.session import let

    def of(t: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(t) - size), lambda i: F.array_join(F.slice(t, i + 1, size), " ")))
        return F.when(F.size(t) == 0, F.array(F.lit("<empty>"))).when(F.size(t) < size, F.array(F.array_join(t, " "))).otherwise(many)

    return let(tokens(text), of)


def hash_bucket(seed: str, key: Column, buckets: int = 10_000) -> Column:
    """First 16 hex digits of SHA-256 of seed, NUL and key, as an unsigned number, modulo ``buckets``."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), key), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def split_of(bucket: Column, train: int = 9800, validation: int = 100) -> Column:
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def floor_bp(part: Column, whole: Column) -> Column:
    """Basis points, rounded down; null where the whole is 0."""
    return F.when(whole != 0, F.floor(part.cast("decimal(30,0)") * 10_000 / whole.cast("decimal(30,0)"))).cast("long")


def even_bp(part: Column, whole: Column) -> Column:
    """Basis points, halves to even; 10 000 where the whole is 0."""
    return F.when(whole != 0, F.bround(part * 10_000 / whole)).otherwise(10_000).cast("long")


def repetition(text: Column) -> Column:
    """``tokens, unique_bp, repeated_bp, max_line_repeat``: words, distinct ones, repeated 8-word grams, and the most frequent line."""
    from millrace.session import let

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    grams = lambda w: F.when(F.size(w) >= 8, F.transform(F.sequence(F.lit(0), F.size(w) - 8), lambda i: F.array_join(F.slice(w, i + 1, 8), " "))).otherwise(F.array().cast("array<string>"))
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).alias("u"), let(grams(w), lambda g: F.struct(F.size(g).alias("n"), F.size(F.array_distinct(g)).alias("u"))).alias("g")))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    # Runs of equal lines in the sorted list: the longest is the largest repeat.
    runs = let(F.array_sort(lines), lambda s: F.aggregate(s, F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(1).alias("m")), lambda a, x: let(F.when(a["last"] == x, a["n"] + 1).otherwise(1), lambda n: F.struct(x.alias("last"), n.alias("n"), F.greatest(a["m"], n).alias("m"))), lambda a: a["m"]))
    repeated = lambda w: F.when(w["g"]["n"] == 0, 0).otherwise(even_bp(w["g"]["n"] - w["g"]["u"], w["g"]["n"])).cast("long")
    return let(by_word, lambda w: F.struct(w["n"].alias("tokens"), even_bp(w["u"], w["n"]).alias("unique_bp"), repeated(w).alias("repeated_bp"), runs.cast("long").alias("max_line_repeat")))


def sample_reasons(messages: DataFrame, sample: str, index: str, text: str, most_message: int = 131_072, most_sample: int = 262_144) -> DataFrame:
    """``sample, reason, message_index, n_chars`` over normalised messages: the first that is empty, has a control character or is too long; else whether all of them are."""
    t = F.col(text)
    reason = F.when(F.coalesce(t, F.lit("")) == "", "empty_after_normalization").when(t.rlike(FORBIDDEN), "forbidden_control_character").when(F.length(t) > most_message, "message_too_long")
    first = F.min(F.when(reason.isNotNull(), F.struct(F.col(index).alias("i"), reason.alias("r")))).alias("first")
    found = messages.groupBy(sample).agg(first, F.sum(F.length(t)).alias("n"))
    why = F.coalesce("first.r", F.when(F.col("n") > most_sample, "sample_too_long"))
    return found.select(sample, why.alias("reason"), F.col("first.i").alias("message_index"), F.when(why.isNull(), F.col("n")).alias("n_chars"))
