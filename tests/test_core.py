"""Core operators against brute force and on awkward input."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import parsing, stats
from millrace.functions import records, render
from millrace.functions import text as X
from millrace.operators import dedup, events, retrieval, sampling, selection, similarity
from millrace.sources import files


def test_normalise(spark):
    rows = spark.createDataFrame([(1, "﻿  é\r\nb\r 　"), (2, ""), (3, None), (4, "a\x00b")], "i long, t string")
    got = {r["i"]: r["t"] for r in rows.select("i", X.normalise(F.col("t")).alias("t")).collect()}
    assert got == {1: "é\nb", 2: "", 3: None, 4: "a\x00b"}
    assert [r[0] for r in rows.where(F.col("t").rlike(X.FORBIDDEN)).select("i").orderBy("i").collect()] == [1, 4]


def test_split_bucket_is_the_digest(spark):
    import hashlib

    got = spark.createDataFrame([("k",)], "k string").select(X.hash_bucket("s", F.col("k"))).first()[0]
    assert got == int(hashlib.sha256(b"s\0k").hexdigest()[:16], 16) % 10_000


def test_exact_winners_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", "s2", 1), ("a", "s1", 9), ("a", "s1", 3), (None, "s", 4), ("b", None, 5)], "k string, s string, i long")
    got = {r["k"]: (r["i"], r["n_copies"]) for r in dedup.exact_winners(rows, "k", ["s", "i"]).collect()}
    assert got == {"a": (3, 3), None: (4, 1), "b": (5, 1)}
    assert {(r["i"], r["duplicate_of"]) for r in dedup.exact_rejects(rows, "k", ["s", "i"], "i").collect()} == {(1, 3), (9, 3)}


def test_root_paths(spark):
    nodes = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 5), (7, 8), (8, 7), (9, 8)]
    got = {r["node"]: (r["root"], r["depth"], r["status"]) for r in dedup.root_paths(spark.createDataFrame(nodes, "n long, p long"), "n", "p").collect()}
    assert got[4] == (1, 3, "ok") and got[1] == (1, 0, "ok") and got[6] == (5, 1, "missing_parent")
    assert all(got[i] == (None, None, "cycle") for i in (7, 8, 9))


def test_mulmod_and_signature():
    rng = random.Random(1)
    p = similarity.PRIME
    a = [rng.randrange(p) for _ in range(500)] + [0, 1, p - 1]
    for b in (rng.randrange(p), p - 1, 1, 0):
        assert similarity._mulmod(np.array(a, dtype=np.uint64), b).tolist() == [x * b % p for x in a]
    perms = similarity.permutations(4)
    assert similarity.signature(np.array(a, dtype=np.uint64), perms).tolist() == [min((m * x + c) % p for x in a) for m, c in perms]


@pytest.mark.parametrize("pairwise", [3, 1000])
def test_near_duplicates_large_buckets_lose_no_link(spark, pairwise):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", "one two", "one two", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = (t or "").split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w) or "<empty>"}

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    own = similarity.classes(rows)
    nodes = similarity.distinct_nodes(own)
    graph = {r["node"]: r["component"] for r in dedup.connected_components(similarity.links(nodes, pairwise=pairwise)).collect()}
    got = {r["doc_id"]: graph.get(r["node"], r["node"]) for r in own.select("doc_id", "node").collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    alike = {(r["a"], r["b"]) for r in similarity.similar_pairs(nodes, 0.8, pairwise).collect()}
    node = {r["doc_id"]: r["node"] for r in own.collect()}
    assert alike == {tuple(sorted((node[i], node[j]))) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_running_sums_and_prefix(spark):
    rng = random.Random(7)
    data = [("a" if i % 3 else "b", i, rng.randint(1, 9)) for i in range(300)]
    rows = spark.createDataFrame(data, "k string, i long, v long")
    cum = Counter()
    for r in sampling.running(rows.repartition(6), "k", ["i"], "v").orderBy("i").collect():
        cum[r["k"]] += r["v"]
        assert r["cum"] == cum[r["k"]]
    targets = spark.createDataFrame([("a", 100), ("b", 10_000)], "k string, target long")
    got = sampling.closest_prefix(rows, "k", ["i"], "v", targets).groupBy("k").agg(F.sum("v").alias("s")).collect()
    sums = {r["k"]: r["s"] for r in got}
    prefix, best = 0, None
    for k, _, v in data:
        if k == "a":
            prefix += v
            if best is None or abs(prefix - 100) < abs(best - 100):
                best = prefix
    assert sums["a"] == best and sums["b"] == sum(v for k, _, v in data if k == "b")
    taken = sampling.exact_budget(rows, "k", ["i"], "v", targets).groupBy("k").agg(F.sum("taken").alias("t")).collect()
    assert {r["k"]: r["t"] for r in taken} == {"a": 100, "b": 10_000}


def test_packing(spark):
    sizes = [9, 8, 2, 1, 5, 5, 3, 7, 10, 4]
    rows = spark.createDataFrame([("x", i, s) for i, s in enumerate(sizes)], "k string, i long, s long")
    got = sampling.pack_best_fit(rows, "k", "i", "s", 10).collect()
    load = Counter()
    for r in got:
        load[r["bin"]] += r["s"]
    assert len(got) == 10 and max(load.values()) <= 10 and len(load) == 6
    fit = {r["i"]: r["bin"] for r in sampling.next_fit(rows, "k", ["i"], "s", 10).collect()}
    assert [fit[i] for i in range(10)] == [0, 1, 1, 2, 2, 3, 3, 4, 5, 6]


def best_fit(sizes, capacity):
    rooms, out = [], {}
    for i, s in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= s]
        if fits:
            b = min(fits)[1]
            rooms[b] -= s
        else:
            b = len(rooms)
            rooms.append(capacity - s)
        out[i] = b
    return out


def test_best_fit_by_counts_is_best_fit_one_by_one(spark):
    rng = random.Random(3)
    for n, capacity, top in ((0, 5, 5), (1, 5, 5), (300, 10, 10), (300, 64, 20), (300, 64, 64), (400, 1000, 400)):
        sizes = [rng.randint(1, top) for _ in range(n)]
        wanted, got, place = best_fit(sizes, capacity), {}, 0
        stretches = sampling.best_fit_stretches(list(Counter(sizes).items()), capacity)
        for place, (i, s) in enumerate(sorted(enumerate(sizes), key=lambda x: (-x[1], x[0]))):
            size, start, each, first = max((x for x in stretches if x[1] <= place), key=lambda x: x[1])
            assert size == s
            got[i] = first + (place - start) // each
        assert got == wanted and len(stretches) <= 4 * len(set(sizes)) + 1
    sizes = [rng.randint(0, 60) for _ in range(200)] + [70, 71]
    rows = spark.createDataFrame([(["x", None][i % 7 == 0], i, s, 1) for i, s in enumerate(sizes)], "k string, i long, s long, n int").repartition(5)
    found = {r["i"]: (r["bin"], r["reason"]) for r in sampling.pack_best_fit(rows, "k", "i", "s", 64).collect()}
    assert len(found) == len(sizes)
    for part in (0, 1):
        own = [(i, s) for i, s in enumerate(sizes) if (i % 7 == 0) == part and 0 < s <= 64]
        bins = best_fit([s for _, s in own], 64)
        assert {i: found[i] for i, _ in own} == {i: (bins[j], None) for j, (i, _) in enumerate(own)}
    assert {found[i][1] for i, s in enumerate(sizes) if s > 64} == {"sequence_too_long"} and {found[i][1] for i, s in enumerate(sizes) if s == 0} == {"no_tokens"}


def test_strip_is_linear_in_inner_blanks(spark):
    """A megabyte of blanks inside a text, and one of blanks at its end."""
    import time

    rows = spark.createDataFrame([("a" + " " * (1 << 20) + "b",), (" \u3000" + "c" + "\t" * (1 << 20),)], "t string")
    rows.select(F.length(X.strip(F.col("t")))).collect()
    began = time.perf_counter()
    assert [r[0] for r in rows.select(F.length(X.strip(F.col("t")))).collect()] == [(1 << 20) + 2, 1]
    assert time.perf_counter() - began < 5


def test_previous_and_folded_pass_ranges(spark):
    rng = random.Random(5)
    data = [(["a", "b", None][i % 3], i, rng.randint(1, 9)) for i in rng.sample(range(1000), 300)]
    rows = spark.createDataFrame(data, "k string, i long, v long").repartition(4)
    got = {r["i"]: r["p"] for r in sampling.previous(rows, "k", "i", "p").collect()}
    for k in ("a", "b", None):
        own = sorted(i for x, i, _ in data if x == k)
        assert [got[i] for i in own] == [None, *own[:-1]]
    bins = {r["i"]: r["bin"] for r in sampling.next_fit(rows, "k", ["i"], "v", 20).collect()}
    for k in ("a", "b", None):
        b, used = 0, 0
        for i, v in sorted((i, v) for x, i, v in data if x == k):
            b, used = (b + 1, v) if used and used + v > 20 else (b, used + v)
            assert bins[i] == b


def test_percentiles(spark):
    for n in (1, 2, 3, 7, 20, 21, 100):
        data = sorted(random.Random(n).choices(range(50), k=n))
        rows = spark.createDataFrame([(0, v) for v in data], "k int, v int")
        picks = {"b": stats.percentile_floor(0.95), "c": stats.percentile_nearest(0.95), "d": stats.percentile_clamped(0.975), "e": stats.percentile_even(0.975)}
        got = stats.by_index(rows, ["k"], "v", picks).first()
        import math

        assert got["b"] == data[int((n - 1) * 0.95)] and got["c"] == data[math.ceil(n * 0.95) - 1]
        assert got["d"] == data[max(1, min(n, int(0.975 * n + 0.999999999999))) - 1] and got["e"] == data[round((n - 1) * 0.975)]


def test_parsers():
    assert parsing.bracket_calls("[f(a=1, b='x, y'), g h(c=[1, {'k': (2)}]), e()]")[0] == {"name": "f", "arguments": {"a": 1, "b": "x, y"}}
    for bad in ("", "[]", "f()", "[f(a)]", "[f(a=1, a=2)]", "[f(a=x())]", "[f(a=1]", "[f(),]"):
        with pytest.raises(ValueError):
            parsing.bracket_calls(bad)
    cases = {
        '{"a": 1}': ("none", 1), "7": ("wrap_single_key", 7), '"a": 1': ("brace_member_fragment", 1), '{"a": 1': ("close_object", 1), "```JSON\n{\"a\": 1}\n```": ("unwrap_json_fence", 1),
        '{b: "x, a: 2", a: 1}': ("quote_bare_keys", 1), '["a"] => [1]': ("arrow_single_key", [1]), "one": ("wrap_bareword_single_key", "one"),
        '{"in": {"a": 1, "c": 2}}': ("promote_required_keys", 1), '{"in": {"a": 1}': ("close_object_promote_required_keys", 1),
    }
    for text, (action, leaf) in cases.items():
        value, got = parsing.repaired(text, ("a",))
        assert got == action and json.loads(value)["a"] == leaf
    assert json.loads(parsing.repaired('{b: "x, a: 2", a: 1}', ("a",))[0])["b"] == "x, a: 2"  # leaves stay as they are
    assert json.loads(parsing.repaired('{"in": {"a": 1, "c": 2}}', ("a",))[0]) == {"a": 1, "in": {"c": 2}}
    first = {"wrap_single_key", "brace_member_fragment", "close_object", "none"}
    for text, (action, _) in cases.items():
        assert parsing.repaired(text, ("a",), 0) == (text, "none")
        assert parsing.repaired(text, ("a",), 1)[1] == (action if action in first else "none")
        assert parsing.repaired(text, ("a",), 2)[1] == ("none" if action == "close_object_promote_required_keys" else action)
    for text in ("no {json", "null", '{"x,}": 1,}', "[1, 2", "", '{"in": {"b": 1}}'):
        assert parsing.repaired(text, ("a", "b")) == (text, "none")
    shape = parsing.json_shape({"a": [1, 2.5, True, None], "b": "x", "c": [], "d": [{}, {}]})
    assert shape["properties"]["a"]["items"] == {"anyOf": [{"type": t} for t in ("integer", "number", "boolean", "null")]} and shape["properties"]["c"] == {"type": "array"} and shape["required"] == list("abcd")


def test_think_block(spark):
    cases = {"x": "missing_think_block", "<think>a</think><think>b</think> c": "multiple_think_blocks", "y <think>a</think> b": "nested_think_tag", "</think><think>": "nested_think_tag", "<think> </think> b": "empty_reasoning", "<think>a</think> <|im_end|>": "empty_final_answer", " <think>a\n</think>\n b <|im_end|>": None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", F.inline(F.array(parsing.think_block(F.col("raw")))))
    got = {r["raw"]: r for r in rows.collect()}
    assert {k: r["reason"] for k, r in got.items()} == cases
    last = got[list(cases)[-1]]
    assert (last["reasoning"], last["answer"]) == ("a", "b")


def test_chunks_cover_lines(spark):
    for n in (0, 1, 39, 40, 41, 75, 76, 110, 111):
        text = "\n".join(f"l{i}" for i in range(n))
        got = retrieval.chunks(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t").orderBy("start_line").collect()
        want, start = [], 0
        while start < n:
            end = min(n, start + 40)
            want.append((start + 1, end))
            if end == n:
                break
            start = end - 5
        assert [(r["start_line"], r["end_line"]) for r in got] == want


def test_rate_limit_and_runs(spark):
    rows = spark.sql("select 1 k, id i, timestamp_seconds(id * 20) ts, if(id < 4, 'x', 'y') e from range(10)")
    got = [r["allowed"] for r in events.rate_limit(rows, "k", "ts", "i", 2, 60).orderBy("i").collect()]
    assert got == [True, True, False, True, True, False, True, True, False, True]
    runs = events.runs_of_equal(rows, "k", ["ts", "i"], "e").orderBy("first").collect()
    assert [(r["e"], r["first"], r["last"], r["n"]) for r in runs] == [("x", 0, 3, 4), ("y", 4, 9, 6)]
    assert events.runs_of_equal(rows.limit(0), "k", ["ts", "i"], "e").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"i": 1}\n\n{"i": "x"\n{"i": 2}\n')
    good, bad = files.read_jsonl_lenient(spark, str(tmp_path / "in"), "i long")
    assert sorted(r["i"] for r in good.collect()) == [1, 2] and bad.count() == 1
    rows = spark.createDataFrame([(1, "train", None), (2, "test", "x")], "i long, split string, t string")
    path = str(tmp_path / "set")
    assert files.register(rows, path) == files.register(rows.orderBy("t"), path)
    with pytest.raises(files.SourceError):
        files.register(rows.limit(1), path)
    assert files.open_registered(spark, path).count() == 2
    files.write_jsonl(rows, str(tmp_path / "out"), order=["i"])
    back = files.read_jsonl(spark, str(tmp_path / "out"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    expected = files.artifact_digests(spark, str(tmp_path / "in")).unionByName(spark.createDataFrame([("gone", 1, "x")], "name string, size long, sha256 string"))
    assert [r["reason"] for r in files.verify_artifacts(spark, str(tmp_path / "in"), expected).collect()] == ["missing"]
    with pytest.raises(files.SourceError):
        files.require_unique(spark.createDataFrame([(1,), (1,)], "i long"), "i")


def test_bootstrap(spark):
    rows = spark.createDataFrame([("a", 3, 10), ("b", -1, 5), ("c", 2, 8)], "c string, d long, n long")
    first = stats.cluster_bootstrap(rows, "d", "n", "c", seed=1, replicates=500).first()
    assert first == stats.cluster_bootstrap(rows.repartition(3), "d", "n", "c", seed=1, replicates=500).first()
    assert first["lower_bp"] <= first["point_bp"] == round(4 * 10_000 / 23) <= first["upper_bp"]


def test_first_distinct_is_taking_turns(spark):
    rng = random.Random(12)
    data = [(t, i, rng.choice("abcdefghij")) for t in range(14) for i in range(rng.randint(1, 5))] + [(20, 0, None)]
    taken, want = set(), {}
    for t in range(14):
        for _, i, h in sorted(x for x in data if x[0] == t):
            if h not in taken:
                taken.add(h)
                want[t] = (i, h)
                break
    got = {r["t"]: (r["i"], r["h"]) for r in selection.first_distinct(spark.createDataFrame(data, "t long, i long, h string"), "t", "i", "h").collect()}
    assert got == want


def test_frames_and_hidden_text():
    whole = "<think>a\n\nb</think> c\n\nd e"
    for cut in range(1, len(whole)):
        got = list(selection.frames([whole[:cut], whole[cut:]]))
        assert [f for f, _ in got] == ["<think>a", "b</think> c", "d e"] and "".join(v for _, v in got) == "cd e"
    assert list(selection.frames([])) == []


def test_label_mask_and_render(spark):
    rows = spark.createDataFrame([([("user", "hi", ""), ("assistant", "é!", "\nwhy\n")],)], "m array<struct<role: string, content: string, reasoning: string>>")
    for mode, body in (("plain", "é!"), ("no_thinking", "é!"), ("thinking", "<think>\nwhy\n</think>\n\né!")):
        r = rows.select(render.render(F.col("m"), mode).alias("r")).first()["r"]
        a, b = r["spans"][0]
        assert r["text"][a:b] == body + render.END and len(r["spans"]) == 1
    tokens = spark.createDataFrame([([(1, 0, 2), (2, 2, 4), (3, 3, 6)], [(2, 5)])], "t array<struct<id: int, start: int, end: int>>, s array<struct<start: int, end: int>>")
    assert tokens.select(render.label_mask(F.col("t"), F.col("s"))).first()[0] == [-100, 2, None]


def test_canonical_conversation():
    row = lambda *m, tools=("f x",): json.dumps({"tools": [{"name": t} for t in tools], "messages": [{"from": a, "value": b} for a, b in m]})
    value, reason = records.canonical_conversation(row(("user", " q "), ("assistant", "[f x(a=1)]"), ("tool", "r"), ("assistant", "done")), 7)
    assert reason is None and json.loads(value)["messages"][1]["tool_calls"] == [{"arguments": {"a": 1}, "id": "call_7_1_0", "name": "f_x"}]
    for text, want in ((None, "invalid_row_shape"), ("{}", "invalid_row_shape"), (row(("user", "q"), tools=("a b", "a_b")), "invalid_tool_schema"), (row(("user", "q"), ("assistant", "[g()]")), "malformed_tool_call"), (row(("user", "q"), ("tool", "r")), "unpaired_tool_result"), (row(("assistant", "q")), "invalid_role_path")):
        assert records.canonical_conversation(text, 0) == (None, want)
    assert records.call_from_json('{"name": "f", "arguments": {}}', frozenset("f")) and not records.call_from_json('{"name": "g", "arguments": {}}', frozenset("f"))


def test_trajectories_and_scores(spark):
    """Stages in order, names in order within a stage, exact and subset arguments, statuses."""
    from millrace.functions import calls

    call = "struct<name: string, args: map<string, string>, mode: string, band: int, status: string>"
    e = lambda name, band=None, mode="exact", **args: (name, args, mode, band, "ok")
    a = lambda name, status="ok", **args: (name, args, None, None, status)
    cases = [
        ([e("f", x="1")], [a("f", x="1")], True, True), ([e("f", x="1")], [a("f", x="2")], True, False), ([e("f", x="1")], [], False, False), ([], [], True, True),
        ([e("f", mode="subset", x="1")], [a("f", x="1", y="2")], True, True), ([e("f", x="1")], [a("f", x="1", y="2")], True, False), ([e("f", mode="subset", x="1")], [a("f")], True, False),
        ([e("f"), e("g")], [a("g"), a("f")], False, False), ([e("f", 1), e("g", 1)], [a("g"), a("f")], True, True), ([e("f", 1), e("g", 2)], [a("g"), a("f")], False, False),
        ([e("f", 1, x="1"), e("f", 1, x="2")], [a("f", x="2"), a("f", x="1")], True, False), ([e("f")], [a("f", "failed")], True, False), ([e("f")], [a("f", "not_executed")], True, True),
    ]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y, _, _) in enumerate(cases)], f"i int, e array<{call}>, a array<{call}>")
    got = rows.select("i", calls.names_match(F.col("e"), F.col("a")), calls.calls_match(F.col("e"), F.col("a"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[2:] for c in cases]


def test_tagged_calls():
    names = {"look up": "look_up"}
    assert records.tagged("a <tool_call>{'name': 'look up', 'arguments': {'x': 1}}</tool_call> b", names) == ("a  b", [{"name": "look_up", "arguments": {"x": 1}}])
    assert records.tag_call('\\n{"arguments": {"name": "look up", "y": 2}}\\n', names) == {"name": "look_up", "arguments": {"y": 2}}
    for bad in ("<tool_call>", "<tool_call>{}</tool_call>", '<tool_call>{"name": "x", "arguments": {}}</tool_call>', "</tool_call><tool_call>", "<tool_call>f()</tool_call>"):
        with pytest.raises(ValueError):
            records.tagged(bad, names)

    def row(*turns, tools=("f x",), **more):
        listed = json.dumps([{"type": "function", "function": {"name": t}} for t in tools])
        return json.dumps({"id": "1", "category": "", "subcategory": "", "task": "", "tools": listed, "conversations": [{"from": a, "value": b} for a, b in turns]} | more)

    head, call = [("system", "s"), ("human", "h")], '<tool_call>{"name": "f x", "arguments": {}}</tool_call>'
    value, reason = records.tag_conversation(row(*head, ("gpt", call), ("tool", " <tool_response> r </tool_response>")), 4)
    assert reason is None and json.loads(value)["messages"][2:] == [{"role": "assistant", "content": None, "tool_calls": [{"id": "call_4_2_0", "name": "f_x", "arguments": {}}]}, {"role": "tool", "content": "r", "tool_call_ids": ["call_4_2_0"]}]
    for text, want in ((row(*head, more=1), "invalid_row_shape"), (None, "invalid_row_shape"), (row(*head), "invalid_role_path"), (row(*head, ("gpt", call), tools=()), "invalid_tool_schema"), (row(*head, ("gpt", call), tools=("a b", "a_b")), "invalid_tool_schema"), (row(*head, ("gpt", "<tool_call>")), "malformed_tool_call"), (row(*head, ("gpt", "x"), ("tool", "r")), "unpaired_tool_result")):
        assert records.tag_conversation(text, 0) == (None, want)
    assert records.tag_profile(row(*head, ("gpt", call + "<tool_call>x</tool_call>"))) == ("malformed_tool_call", "system>human>gpt", 1, 1, 1)


def test_sources_pinned_files_evidence_and_logs(spark, tmp_path):
    import hashlib

    (tmp_path / "origin").mkdir()
    data = b"pinned"
    (tmp_path / "origin" / "a.bin").write_bytes(data)
    pin = ("a.bin", len(data), hashlib.sha256(data).hexdigest())
    origin, cache = str(tmp_path / "origin" / "a.bin"), str(tmp_path / "cache")
    with pytest.raises(files.SourceError):
        files.acquire(spark, origin, cache, *pin, offline=True)
    with pytest.raises(files.SourceError):
        files.acquire(spark, origin, cache, "a.bin", len(data), "0" * 64)
    place = files.acquire(spark, origin, cache, *pin)
    assert files.acquire(spark, "/nowhere", cache, *pin, offline=True) == place
    for i, (run, status) in enumerate([("r1", "pass"), ("r2", "fail"), ("r3", "pass")]):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "summary.json").write_text(json.dumps({"run_id": run, "status": status, "world": i % 2}, indent=1))
        (tmp_path / "runs" / run / "run.json").write_text(json.dumps({"run_id": run}))
    schema = "run_id string, status string, world int"
    with pytest.raises(files.SourceError):
        files.read_evidence(spark, str(tmp_path / "runs"), schema, ["world"])
    (tmp_path / "runs" / "r3" / "summary.json").write_text(json.dumps({"run_id": "r3", "status": "pass", "world": 5}))
    assert sorted(r["run_id"] for r in files.read_evidence(spark, str(tmp_path / "runs"), schema, ["world"]).collect()) == ["r1", "r3"]
    assert files.run_manifests(spark, str(tmp_path / "runs"), "run_id string").count() == 3
    (tmp_path / "array.json").write_text(json.dumps([{"i": 1}, {"i": 2}]))
    assert files.read_json_array(spark, str(tmp_path / "array.json"), "i int").count() == 2
    assert files.tree_digest(spark, str(tmp_path / "origin")) == files.tree_digest(spark, str(tmp_path / "origin"))


def test_redaction_and_changed_paths():
    assert records.redacted({"a": [{"API-key": 1, "b": {"mySecret": {"c": 2}}}], "tokens": 3, "d": 4}) == {"a": [{"API-key": "[REDACTED]", "b": {"mySecret": "[REDACTED]"}}], "tokens": "[REDACTED]", "d": 4}
    assert records.changed_paths({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"x": 1, "y": 3, "z": 0}, "b": {}}) == ["a.y", "a.z", "b"]
    assert records.changed_paths(1, 2) == ["<root>"] and records.changed_paths({}, {}) == []


def test_importers_check_types_as_written(spark):
    from millrace.operators import importing

    good = {"message_tree_id": "t", "message_id": "m", "parent_id": None, "text": " hi", "role": "prompter", "lang": "EN", "review_result": True, "deleted": False, "tree_state": "ready_for_export"}
    rows = [good, good | {"message_id": "n", "parent_id": "m", "role": "assistant"}, good | {"message_id": 5}, good | {"message_id": "o", "deleted": 0}, good | {"message_id": "p", "parent_id": " "}, {k: v for k, v in good.items() if k != "lang"}, [1], good | {"message_id": "q", "text": 1.5}]
    lines = [json.dumps(r) for r in rows] + ["no json", None]
    accepted, rejected = importing.import_tree(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "place long, line string"))
    only = accepted.collect()
    assert len(only) == 1 and [tuple(m) for m in only[0]["messages"]] == [("user", " hi"), ("assistant", " hi")] and only[0]["group_id"] == "t" and len(only[0]["raw_sha256s"]) == 2
    assert sorted((r["record_id"], r["reason"], r["field"]) for r in rejected.collect()) == sorted([
        ("row-00000002", "malformed_row", "message_id"), ("o", "malformed_row", "deleted"), ("p", "malformed_row", "parent_id"), ("m", "malformed_row", "lang"), ("row-00000006", "malformed_row", "message_tree_id"),
        ("q", "malformed_row", "text"), ("row-00000008", "malformed_row", "message_tree_id"), ("row-00000009", "malformed_row", "message_tree_id"),
    ])
    none, nothing = importing.import_code_edits(spark.createDataFrame([], "place long, line string"))
    assert none.count() == nothing.count() == 0


def test_tokenize_refuses_a_crossing_token(spark):
    from millrace.operators import tokens

    rows = spark.createDataFrame([(1, "ab cd", [(0, 2)]), (2, None, [])], "i int, t string, s array<struct<start: int, end: int>>")
    got = {r["i"]: r for r in tokens.tokenize(rows, "t", "s", tokens.words, 5).collect()}
    assert got[1]["labels"] == [2, -100] and got[2]["reason"] == "no_supervised_tokens"
    crossing = spark.createDataFrame([(1, "ab cd", [(1, 3)])], rows.schema)
    with pytest.raises(Exception, match="crosses"):
        tokens.tokenize(crossing, "t", "s", tokens.words, 5).collect()
    with pytest.raises(ValueError):
        sampling.exact_budget(rows.selectExpr("i", "1 n"), "i", ["n"], "n", rows.selectExpr("i", "7 target"), cap=3)


@pytest.mark.parametrize("most_known", [0, 1 << 20])
def test_shared_passages_equal_brute_force(spark, most_known):
    from millrace.operators import passages

    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(12)]
    docs = [" ".join(rng.choice(words) for _ in range(20)) + " " + rng.choice(items)[: rng.randint(0, 200)].upper() + "! " + rng.choice(items) for _ in range(40)] + ["", None]
    wanted = {(i, d): n for i, a in enumerate(items) for d, b in enumerate(docs) if (n := len(set(passages.grams(a, 5)) & set(passages.grams(b, 5))))}
    a = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {(r["item_id"], r["doc_id"]): r["n_shared"] for r in passages.shared_passages(b, a, "doc_id", "item_id", n=5, most_known=most_known).collect()}
    assert got == wanted and len(wanted) > 20
    assert passages.shared_passages(b, a.limit(0), "doc_id", "item_id").count() == passages.shared_passages(b.limit(0), a, "doc_id", "item_id").count() == 0


def test_published_versions(spark, tmp_path):
    root, rows = str(tmp_path / "table"), spark.createDataFrame([(1, "a"), (2, "b")], "i long, t string")
    with pytest.raises(files.SourceError):
        files.current(spark, root)
    one = files.publish(rows, root)
    with pytest.raises(files.SourceError):
        files.rollback(spark, root)
    two = files.publish(rows.limit(1), root)
    assert one != two and files.current(spark, root).count() == 1
    assert files.rollback(spark, root) == one and files.current(spark, root).count() == 2
    assert files.publish(rows.orderBy("t"), root) == one and files.pointers(spark, root) == [one, two, one, one]
    with pytest.raises(files.SourceError):
        files.point(spark, root, "none")
