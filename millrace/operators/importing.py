"""Importers of raw JSON rows: typed fields, ordered reasons, accepted samples and rejects.

Rows are JSON texts with their place in the input (``line, place``). A field's type is
checked as it is written: a number is no string. Every row ends as a sample, as a reject
with one reason and the field that gave it, or as an inner node of a conversation tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.parsing import canonical_json
from millrace.functions.text import LICENSES, normalise_license, strip
from millrace.operators.dedup import ancestors, root_paths
from millrace.session import materialize


class Fields:
    """Typed fields of a JSON row, with the name of the first that breaks its type."""

    def __init__(self, row: Column):
        self.row, self.values, self.bad = row, {}, []

    def _add(self, name: str, kind: str, stored: str, required: bool, blank: bool) -> None:
        found = F.schema_of_variant(F.try_variant_get(self.row, f"$.{name}", "variant"))
        value = F.try_variant_get(self.row, f"$.{name}", kind)
        ok = F.coalesce(found == stored, F.lit(False))
        if not blank:
            ok = ok & (strip(value) != "")
        if not required:
            ok = ok | found.isNull() | (found == "VOID")
        self.values[name] = F.when(found == stored, value)
        self.bad.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))

    def text(self, name: str, required: bool = True, blank: bool = False) -> Fields:
        self._add(name, "string", "STRING", required, blank)
        return self

    def flag(self, name: str) -> Fields:
        self._add(name, "boolean", "BOOLEAN", True, True)
        return self

    def columns(self) -> list[Column]:
        return [F.coalesce(*self.bad).alias("malformed"), *[v.alias(n) for n, v in self.values.items()]]


def sample_id(source: str, identity: Column) -> Column:
    """The source's name and 24 hexadecimal digits of the identity's SHA-256."""
    return F.concat(F.lit(f"{source}:"), F.substring(F.sha2(identity, 256), 1, 24))


def repositories(names: Column) -> Column:
    """A list of names from a text with commas: trimmed, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(names, ","), strip), lambda x: x != "")))


def raw_sha256(line: Column) -> Column:
    """The row's hash, whatever the order of its fields and the blanks between them."""
    return F.sha2(canonical_json(line), 256)


def _rejected(rows: DataFrame) -> DataFrame:
    return rows.select("record_id", "raw_sha256", "reason", "field")


def _record_id(value: Column, place: Column) -> Column:
    return F.when(F.coalesce(strip(value) != "", F.lit(False)), value).otherwise(F.concat(F.lit("row-"), F.lpad(place.cast("string"), 8, "0")))


def _first(*rules: tuple[Column, str, str]) -> tuple[Column, Column]:
    """Reason and field of the first rule that holds."""
    reason, field = F.lit(None).cast("string"), F.lit(None).cast("string")
    for broken, why, name in reversed(rules):
        reason, field = F.when(broken, why).otherwise(reason), F.when(broken, name).otherwise(field)
    return reason, field


def import_tree(rows: DataFrame, source: str = "tree", languages: tuple[str, ...] = ("en", "zh"), state: str = "ready_for_export", deleted: bool = False, reviewed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Samples (``id, record_id, language, group_id, messages, raw_sha256s``) and rejects of a conversation tree.

    Messages of an id that several have are all rejected, as are unknown roles. Every
    assistant's message then stands for the path from its root: rejected where a parent
    is missing, the path runs in a circle, roles don't take turns from a prompter on, or
    the path leaves its tree; then for the first of state, deletion, review, language and
    empty text that any message on it breaks. Other messages are neither. What a path
    breaks is gathered as bits while pointers double, never node by node.
    """
    fields = Fields(F.col("v"))
    for name in ("message_tree_id", "message_id"):
        fields.text(name)
    fields.text("parent_id", required=False).text("text", blank=True).text("role").text("lang").flag("review_result").flag("deleted").text("tree_state")
    parsed = rows.select("place", "line", raw_sha256(F.col("line")).alias("raw_sha256"), F.try_parse_json("line").alias("v")).select("place", "raw_sha256", *fields.columns())
    parsed = materialize(parsed.withColumn("record_id", _record_id(F.col("message_id"), F.col("place"))).withColumn("lang", F.lower("lang")), "parsed")
    malformed = _rejected(parsed.where("malformed is not null").withColumns({"reason": F.lit("malformed_row"), "field": F.col("malformed")}))
    good = parsed.where("malformed is null")
    twice = good.groupBy(F.col("message_id").alias("twice")).count().where("count > 1").drop("count")
    told = good.join(twice, F.col("message_id") == F.col("twice"), "left")
    reason, field = _first((F.col("twice").isNotNull(), "duplicate_source_id", "message_id"), (~F.col("role").isin("prompter", "assistant"), "unsupported_role", "role"))
    told = told.withColumns({"reason": reason, "field": field})
    nodes = materialize(told.where("reason is null").drop("reason", "field", "twice"), "nodes")
    above = nodes.select(F.col("message_id").alias("up"), F.col("role").alias("up_role"), F.col("message_tree_id").alias("up_tree"))
    turn = F.when(F.col("parent_id").isNull(), F.col("role") != "prompter").otherwise(F.coalesce(F.col("role") == F.col("up_role"), F.lit(False)))
    broken = {
        "turn": turn, "tree": F.coalesce(F.col("message_tree_id") != F.col("up_tree"), F.lit(False)), "state": F.col("tree_state") != state,
        "deleted": F.col("deleted") & F.lit(not deleted), "review": ~F.col("review_result") & F.lit(reviewed), "lang": ~F.col("lang").isin(*languages), "empty": strip(F.col("text")) == "",
    }
    bits = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(broken.values())])
    linked = nodes.join(above, F.col("parent_id") == F.col("up"), "left").select("message_id", "parent_id", bits.alias("bits"))
    paths = materialize(root_paths(linked, "message_id", "parent_id", flags="bits"), "roots")
    has = lambda name: F.col("flags").bitwiseAND(F.lit(1 << list(broken).index(name))) != 0
    reason, field = _first(
        (F.col("status") == "missing_parent", "missing_parent", "parent_id"), (F.col("status") == "cycle", "invalid_conversation", "parent_id"), (has("turn"), "invalid_conversation", "role"),
        (has("tree"), "invalid_conversation", "message_tree_id"), (has("state"), "not_ready", "tree_state"), (has("deleted"), "deleted", "deleted"),
        (has("review"), "review_not_positive", "review_result"), (has("lang"), "unsupported_language", "lang"), (has("empty"), "empty_content", "text"),
    )
    leaves = nodes.where("role = 'assistant'").join(paths, F.col("message_id") == F.col("node")).withColumns({"reason": reason, "field": field})
    rejected = malformed.unionAll(_rejected(told.where("reason is not null"))).unionAll(_rejected(leaves.where("reason is not null")))
    whole = paths.where("status = 'ok'").select("node")
    up = ancestors(nodes.join(whole, F.col("message_id") == F.col("node"), "left_semi").select("message_id", "parent_id"), "message_id", "parent_id")
    taken = leaves.where("reason is null").select("message_id", F.col("lang").alias("language"))
    steps = taken.join(up, F.col("message_id") == F.col("node")).select("message_id", "language", F.posexplode("path").alias("back", "step"))
    said = nodes.select(F.col("message_id").alias("at"), "role", "text", "raw_sha256", "message_tree_id", "parent_id")
    turn = F.struct((-F.col("back")).alias("n"), F.when(F.col("role") == "prompter", "user").otherwise("assistant").alias("role"), F.col("text").alias("content"), "raw_sha256")
    gathered = steps.join(said, F.col("step") == F.col("at")).groupBy("message_id", "language").agg(F.array_sort(F.collect_list(turn)).alias("m"), F.max(F.when(F.col("parent_id").isNull(), F.col("message_tree_id"))).alias("group_id"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    accepted = gathered.select(sample_id(source, F.col("message_id")).alias("id"), F.col("message_id").alias("record_id"), "language", "group_id", messages.alias("messages"), F.transform("m", lambda x: x["raw_sha256"]).alias("raw_sha256s"))
    return accepted, rejected


def import_code_edits(rows: DataFrame, source: str = "edits", language: str = "python", licenses: tuple[str, ...] = LICENSES) -> tuple[DataFrame, DataFrame]:
    """Samples (``id, record_id, license, repositories, prompt, answer, raw_sha256``) and rejects of code edits; one pass, nothing shuffled."""
    fields = Fields(F.col("v")).text("commit").text("lang").text("license").text("repos", blank=True).text("subject", blank=True)
    fields.text("old_contents", required=False, blank=True).text("new_contents", blank=True).text("new_file", required=False).text("old_file", required=False)
    parsed = rows.select("place", raw_sha256(F.col("line")).alias("raw_sha256"), F.try_parse_json("line").alias("v")).select("place", "raw_sha256", *fields.columns())
    parsed = parsed.withColumns({"file": F.coalesce("new_file", "old_file"), "license": normalise_license(strip(F.col("license"))), "repositories": repositories(F.col("repos")), "lang": F.lower(strip(F.col("lang"))), "record_id": _record_id(F.col("commit"), F.col("place"))})
    reason, field = _first(
        (F.col("malformed").isNotNull(), "malformed_row", ""), (F.col("file").isNull(), "malformed_row", "new_file|old_file"), (F.size("repositories") == 0, "missing_repository", "repos"),
        (F.col("lang") != language, "not_python", "lang"), (~F.col("license").isin(*licenses), "unsupported_license", "license"),
        (strip(F.col("subject")) == "", "empty_instruction", "subject"), (strip(F.col("new_contents")) == "", "empty_content", "new_contents"),
    )
    told = materialize(parsed.withColumns({"reason": reason, "field": F.coalesce("malformed", field)}), "edits")
    good = told.where("reason is null")
    prompt = F.concat(F.lit("Update "), "file", F.lit(" according to this instruction:\n"), strip(F.col("subject")), F.lit("\n\nCurrent file:\n"), F.coalesce("old_contents", F.lit("")))
    identity = F.concat_ws("\n", "commit", F.array_join("repositories", ","), "file", "raw_sha256")
    accepted = good.select(sample_id(source, identity).alias("id"), "record_id", "license", "repositories", prompt.alias("prompt"), F.col("new_contents").alias("answer"), "raw_sha256")
    return accepted, _rejected(told.where("reason is not null"))


def import_manifest(total: DataFrame, accepted: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """``kind, key, n`` of an import: rows, candidates, accepted, rejected, and counts per reason and per value of ``label``."""
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("key"), "n")
    per = lambda df, kind, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    candidates = accepted.select("record_id").unionAll(rejected.select("record_id"))
    parts = [one(total, "rows"), one(candidates, "candidates"), one(accepted, "accepted"), one(rejected, "rejected"), per(rejected, "reason", "reason"), per(accepted, label, label)]
    return reduce(DataFrame.unionAll, parts)


def registration_audit(rejected: DataFrame, declared: DataFrame) -> DataFrame:
    """Reasons whose rejects don't reproduce the declared counts (``reason, n``): ``reason, declared, found``; none if all do."""
    found = rejected.groupBy("reason").agg(F.count("*").alias("found"))
    both = declared.select("reason", F.col("n").alias("declared")).join(found, "reason", "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("found")))
