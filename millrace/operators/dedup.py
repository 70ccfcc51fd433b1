"""Exact deduplication, group splits, message trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import hash_bucket, split_of
from millrace.operators.graph import connected_components
from millrace.session import discard, materialize


def exact_winners(rows: DataFrame, key: str, order: list[str], carried: list[str] = ()) -> DataFrame:
    """The first row of each key by ``order``, with ``n_copies``.

    A combinable minimum of (order, carried columns): a key that a third of all rows
    share costs no task more than its partial minima, and no row is sorted.
    """
    first = F.min(F.struct(*order, *carried)).alias("__f")
    grouped = rows.groupBy(key).agg(first, F.count("*").alias("n_copies"))
    return grouped.select(key, *[F.col("__f")[c].alias(c) for c in [*order, *carried]], "n_copies")


def exact_rejects(rows: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """Losers of ``exact_winners``, each with the winner's id."""
    winners = exact_winners(rows, key, order, [row_id] if row_id not in order else []).select(F.col(key).alias("__k"), F.col(row_id).alias("duplicate_of"))
    return rows.join(winners, rows[key] == winners["__k"]).where(F.col(row_id) != F.col("duplicate_of")).drop("__k")


def group_components(memberships: DataFrame, row_id: str, key: str) -> DataFrame:
    """``row_id, component`` (its least row id) over rows that share any key.

    Each key's rows hang on its least row, so a key of any size gives one edge a row.
    """
    rows = materialize(memberships.where(F.col(key).isNotNull()).select(F.col(row_id).alias("r"), F.col(key).alias("k")).distinct(), "memberships")
    least = rows.groupBy("k").agg(F.min("r").alias("m"))
    edges = rows.join(least, "k").where("r <> m").select(F.col("r").alias("a"), F.col("m").alias("b"))
    found = connected_components(edges)
    everyone = memberships.select(F.col(row_id).alias("r")).distinct()
    return everyone.join(found, everyone["r"] == found["node"], "left").select(F.col("r").alias(row_id), F.coalesce("component", "r").alias("component"))


def component_digest(components: DataFrame, row_id: str) -> DataFrame:
    """``component, n_members, component_id``: an id that depends on the members alone.

    The members' hashes are summed up, which needs no list of them in one task.
    """
    part = F.conv(F.substring(F.sha2(F.col(row_id).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    grouped = components.groupBy("component").agg(F.count("*").alias("n_members"), F.sum(part).cast("decimal(38,0)").alias("s"))
    return grouped.select("component", "n_members", F.sha2(F.concat_ws(":", F.col("n_members").cast("string"), F.col("s").cast("string")), 256).alias("component_id"))


def safe_split(components: DataFrame, row_id: str, seed: str = "split-v1") -> DataFrame:
    """Rows with their component's id and split: a component is never cut."""
    ids = component_digest(components, row_id)
    split = split_of(hash_bucket(seed, F.col("component_id")))
    return components.join(ids, "component").select(row_id, "component", "n_members", "component_id", split.alias("split"))


def root_paths(nodes: DataFrame, node: str, parent: str, rounds: int = 40, flags: str | None = None) -> DataFrame:
    """``node, root, depth, status`` by pointer doubling: a round doubles the known path.

    ``status`` is ``ok``, ``missing_parent`` (a named parent is no node; its child is the
    root found) or ``cycle`` (root and depth are null). Depth counts edges to the root.
    With ``flags`` (a column of bits) the result has ``flags`` too: the bits that any node
    from this one to its root has.
    """
    bits = F.lit(0).cast("long") if flags is None else F.coalesce(F.col(flags), F.lit(0)).cast("long")
    ids = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"), bits.alias("f"))
    known = ids.select(F.col("n").alias("k")).distinct()
    linked = ids.join(known, ids["p"] == known["k"], "left")
    state = linked.select("n", F.coalesce("k", "n").alias("up"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("d"), (F.col("p").isNotNull() & F.col("k").isNull()).alias("lost"), F.col("k").isNull().alias("done"), "f")
    state = materialize(state, "paths")
    total = state.count()
    for _ in range(rounds):
        above = state.select(F.col("n").alias("un"), F.col("up").alias("uup"), F.col("d").alias("ud"), F.col("lost").alias("ulost"), F.col("done").alias("udone"), F.col("f").alias("uf"))
        step = state.join(above, state["up"] == above["un"])
        own = lambda mine, theirs: F.when(F.col("done"), mine).otherwise(theirs)
        step = step.select(
            "n", own(F.col("up"), F.col("uup")).alias("up"), own(F.col("d"), F.col("d") + F.col("ud")).alias("d"), own(F.col("lost"), F.col("ulost")).alias("lost"),
            (F.col("done") | F.col("udone")).alias("done"), F.col("f").bitwiseOR(F.col("uf")).alias("f"),
        )
        before, state = state, materialize(step, "paths")
        discard(before)
        open_ = state.where("not done").count()
        if not open_ or state.agg(F.max("d")).first()[0] > 2 * total:
            break
    status: Column = F.when(~F.col("done"), "cycle").when(F.col("lost"), "missing_parent").otherwise("ok")
    found = state.select(F.col("n").alias("node"), F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("d")).alias("depth"), status.alias("status"), F.col("f").alias("flags"))
    return found if flags is not None else found.drop("flags")


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, path``: the nodes from one to its root, by doubling; for trees without cycles or missing parents."""
    state = materialize(nodes.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.array(node).alias("path")), "ancestors")
    while state.where("up is not null").limit(1).count():
        above = state.select(F.col("n").alias("un"), F.col("up").alias("uup"), F.col("path").alias("upath"))
        step = state.join(above, state["up"] == above["un"], "left")
        before, state = state, materialize(step.select("n", F.col("uup").alias("up"), F.when(F.col("un").isNull(), F.col("path")).otherwise(F.concat("path", "upath")).alias("path")), "ancestors")
        discard(before)
    return state.select(F.col("n").alias("node"), "path")


def latest_by(rows: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; partitions send on their own firsts only."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
