"""Operators in Spark against brute force, and on awkward tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from millrace.llm import bpe, common, fingerprint, language_id, mixing, quality, secret_scan, simhash, toxicity, url_filter, warc
from millrace.operators.graph import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("size", T.LongType())])
LONG = "word and more words. " * 20_000


def rows():
    base = "one two three four five six seven eight nine ten. " * 8
    texts = [None, "", " \n\t", "short text", base, base, base + "x", LONG, "12 34", 'token = "0123456789abcdefabcd99"', "tie tie tie"]
    out = [(i if i != 3 else None, t, "en" if i % 3 else None, ["a", "b", None][i % 3], len(t or ""), "fp", 7) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_every_operator_takes_awkward_and_empty_tables(docs, nothing, spark):
    n = len(rows())
    model = language_id.learn(docs)
    net = toxicity.train(["bad bad words", "good words"], [1, 0])
    for f in (
        mixing.mix, secret_scan.find, secret_scan.redact, bpe.tokenize, simhash.near_duplicates, quality.judge, fingerprint.fingerprints,
        lambda d: language_id.identify(d, model), lambda d: toxicity.score(d, net),
    ):
        assert f(docs).count() == n
        assert f(nothing).count() == 0
    assert language_id.learn(nothing)["names"] == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels).scores(["a"])[0] < 0.5


def test_pipeline_stages_keep_columns(docs, nothing, spark):
    for table in (docs, nothing):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.schema.names == DOCS.names
            now = spark.createDataFrame(now.collect(), DOCS)
        assert corpus_pipeline.tokens(spark, now, "").count() == now.count()


CLASHING = ["y", "k", "i", "t", "h", "n", "__n", "__id", "__s", "__p", "__k", "part", "copies", "rows", "take", "nth", "least_id", "text_hash", "keep", "__q_kept", "edge", "seen", "labelled", "own_id"]


def test_columns_of_any_name_do_no_harm(spark):
    """Every operator and stage on a table whose other columns have the names that operators use inside."""
    plain = spark.createDataFrame([(i, f"text number {i % 7} " * 30 + ("zug" if i % 5 == 0 else "bob"), "en", "ab"[i % 2]) for i in range(30)], "doc_id long, text string, lang string, source string")
    more = plain.select("*", *[F.lit(7 + n).alias(c) for n, c in enumerate(CLASHING)]).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 7, 8) for i in range(30)], "doc_id long, toxic int, k int, i int")
    rows = lambda df: sorted(map(str, df.collect()))
    model, net = language_id.learn(more), toxicity.learn(more, labels)
    assert np.array_equal(model["xf"], language_id.learn(plain)["xf"])
    assert np.array_equal(net.w["chars"], toxicity.learn(plain, labels.select("doc_id", "toxic")).w["chars"])
    for f in (mixing.mix, simhash.near_duplicates, fingerprint.fingerprints, secret_scan.find, bpe.tokenize, lambda d: language_id.identify(d, model), lambda d: toxicity.score(d, net)):
        assert rows(f(more)) == rows(f(plain))
    pages = [("page_id", F.col("doc_id")), ("url", F.concat(F.lit("http://a.net/"), F.col("doc_id").cast("string"))), ("html", F.col("text"))]
    few, many = (d.select(*[c.alias(n) for n, c in pages], *[c for c in CLASHING if c in d.columns]) for d in (plain, more))
    for f in (url_filter.judge, warc.plan):
        assert rows(f(many)) == rows(f(few))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, "")
        assert got.columns == more.columns and rows(got.select(*plain.columns)) == rows(stage(spark, plain, ""))
        assert got.select(*CLASHING).distinct().count() <= 1 and got.where("y <> 7 or __n <> 13").count() == 0


def test_sample_keeps_rare_values_where_ids_repeat(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("aa").alias("lang"), F.lit("aaaa").alias("text"))
    rows = rows.unionAll(spark.range(2, 201).select("id", F.lit("zz"), F.concat(F.lit("z"), F.col("id").cast("string"))))
    got = Counter(r["k"] for r in common.bounded(rows, "lang", "doc_id", 250, 1000).collect())
    assert got == {"aa": 1, "zz": 199}
    assert Counter(r["k"] for r in common.bounded(rows, "lang", "doc_id", 250, 40).collect()) == {"aa": 1, "zz": 20}
    with pytest.raises(ValueError):
        common.bounded(rows, "doc_id", "doc_id", 250, 40)


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "ids" in out.columns


def test_quality_stage_removes_lines_and_documents(spark):
    good = " ".join(f"Sentence{i} has words, and number{i} goes on." for i in range(20))
    bad = " ".join(f"### $$$ *** &&& %%% ||| <<< {i}" for i in range(40))
    table = spark.createDataFrame([(1, good, "en", "a", 0, "", 0), (2, good + "\n" + "Home | News | Shop | About | Help | More", "en", "a", 0, "", 0), (3, "\n".join([bad, good]), "en", "a", 0, "", 0)], DOCS)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, table, "").collect()}
    assert kept == {1: good, 2: good}


def test_mix_hits_targets_and_repeats(spark):
    rng = random.Random(1)
    sizes = {"a": 900, "b": 300, "c": 100, "d": 50, None: 40}
    data = [(i, " ".join(["w"] * rng.randint(0, 60)), None, s, 0, "", 0) for i, s in enumerate(k for k, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(data, DOCS)
    got = mixing.mix(table.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(2)).collect()))
    words, total = Counter(), 0
    for _, text, _, source, *_ in data:
        words[source] += len(text.split())
    total = sum(words.values())
    weights, left, targets = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), 1.5 * total, {}
    while True:
        open_ = [s for s in weights if s not in targets]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * words[s]]
        if not above:
            break
        for s in above:
            targets[s] = 2.0 * words[s]
            left -= targets[s]
    targets |= share
    taken = Counter()
    for r in got:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * total and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 61
    out = mixing.emit(table, mixing.mix(table))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_emit_shares_copies_of_repeated_rows(spark):
    table = spark.createDataFrame([(1, "a b c", None, "s", 0, "", 0)] * 7 + [(2, "x y", None, "s", 0, "", 0)] * 3, DOCS)
    mixed = mixing.mix(table)
    assert mixing.emit(table, mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(40)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("distance,blocks", [(1, 4), (2, 5), (3, 6), (4, 9)])
@pytest.mark.parametrize("pairwise", [1, 16, 1 << 40])
def test_links_equal_brute_force(spark, pairwise, distance, blocks):
    rng = random.Random(9)
    values = []
    for _ in range(8):
        centre = rng.getrandbits(64)
        values += [centre]
        for _ in range(20):
            x = rng.choice(values[-12:])
            for b in rng.sample(range(64), rng.randint(1, distance + 1)):
                x ^= 1 << b
            values.append(x)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash.links(table, distance, blocks, pairwise)
    got = {r["node"]: r["component"] for r in connected_components(found).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_simhash_query_equals_brute_force(spark):
    """The whole operator on whole texts: fingerprints by the definition, components by all pairs; string ids."""
    import xxhash

    rng, words = random.Random(2), [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [None, "", " \n", "One two", "one TWO", *[" ".join(base[: rng.randint(390, 400)]) for _ in range(20)], *[" ".join(rng.choice(words) for _ in range(9)) for _ in range(20)]]

    def fingerprint_of(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps, ids = [fingerprint_of(t) for t in texts], [f"d{i:03}" for i in range(len(texts))]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert got == {ids[i]: (f"{fps[i]:016x}", ids[find(i)]) for i in range(len(texts))}


def test_keep_one_keeps_smallest_and_idless(docs):
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert kept.count(4) == 1 and 5 not in kept and kept.count(None) == 1 and kept.count(0) == 1


@pytest.mark.parametrize("partitions", [1, 6, 40])
def test_fingerprint_order_and_wrap(spark, partitions):
    data = [(i * 7 % 50, f"text number {i} " * (i % 5)) for i in range(50)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(data, "doc_id long, text string"), partitions=partitions).collect()}
    order = sorted(data)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(a)
        assert got[i]["fingerprint"] == fingerprint.written(fingerprint._Document(0, a).least).hex()
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_fingerprint_splits_an_id_that_many_rows_share(spark):
    """Rows of one id stand in order of their texts' hashes; equal rows, null ids and string ids take part."""
    data = [("a", f"one {i % 30} of the texts of this id") for i in range(90)] + [(None, "same text, no id")] * 40 + [("b", None)]
    table = spark.createDataFrame(data, "doc_id string, text string").repartition(4)
    got = fingerprint.fingerprints(table, partitions=8).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in data)
    hashed = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).collect()
    order = [r["text"] for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or "", r["h"]))]
    edits = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert Counter(r["edited_sha256"] for r in got) == Counter(hashlib.sha256(e.encode()).hexdigest() for e in edits)


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://A.example.COM/de/1", "http://a.example.com/en/1", "https://example.net/en/x", "https://example.net", "http://badexample.com/de/", "http://x.org/fr/?q", "http://net/x", "ftp://h.example.com/de"]
    urls += [f"http://s.example.com/{'de' if i % 2 else 'en'}/{i}.html" for i in range(60)]
    table = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(table).collect()}
    assert [got[i]["rule"] for i in range(11)] == [None, None, None, "example.com/de/", None, "example.net/en/", None, None, "org/fr/", "net/", None]
    assert got[3]["host"] == "a.example.com" and got[0]["host"] == got[2]["path"] == ""
    assert all(got[11 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(60))
    of = lambda odd: {got[11 + i]["template"] for i in range(60) if i % 2 == odd}
    assert len(of(0)) == len(of(1)) == 1 and not of(0) & of(1)  # ids are one wildcard; the two branches differ in purity
    assert url_filter.judge(table.limit(0)).count() == 0


def test_url_branches_without_evidence_stay_apart_and_allowed(spark):
    """However many blocked siblings a branch has; blocked ones that are shown to be alike are one wildcard."""
    for n in (0, 3, 40):
        urls = [f"http://s.example.com/de/{a}/deep/er/than/four/{b}/x{k}" for k in range(n) for a in ("p", "q", "r") for b in ("one", "two")]
        urls += [f"http://s.example.com/en/{a}/deep/er/than/four/one/{k}" for k in range(5) for a in ("p", "q")]
        got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
        assert {r["verdict"] for r in got if r["rule"] is None} == {"allow"} and all(r["purity"] == 0.5 for r in got if r["rule"] is None)
        assert all(("<*block>" in r["template"]) == (n == 40) for r in got if r["rule"])


def test_url_tree_learns_deep_branches(spark):
    """Branches that differ below the fourth level are told apart; a branch blocks by its labels alone."""
    rules = (("block", "h", "/a/b/c/d/e/bad"), ("allow", "h", "/a/b/c/d/e/good"))
    urls = [f"http://h/a/b/c/d/e/{w}{k}/{k}" for k in range(60) for w in ("bad", "good")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, rules=rules, learn_from=F.col("page_id") % 10 > 1).collect()
    assert all(r["by_tree"] == "allow" for r in got if r["by_rule"] == "allow")
    many = [f"http://h/a/b/c/d/e/{w}/{x}/{k}" for k in range(30) for w in ("bad", "good") for x in ("u", "v")]
    pages = spark.createDataFrame(list(enumerate(many)), "page_id long, url string")
    got = url_filter.judge(pages, rules=rules, learn_from=F.col("page_id") % 5 > 0).collect()
    assert all(r["by_tree"] == r["by_rule"] for r in got)


def test_url_held_out_agreement(spark):
    """Ruled urls whose labels the tree doesn't see: it blocks no allowed one, and finds most that the rules block."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = url_filter.judge(pages, learn_from=F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 != 0)
    held = got.where(F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0).where("rule is not null")
    n = {(r["by_rule"], r["by_tree"]): r["count"] for r in held.groupBy("by_rule", "by_tree").count().collect()}
    assert n.get(("allow", "block"), 0) == 0


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    data = [("1", "http://a", big), ("2", "http://b\r\n", big), ("3", None, None), ("4", "u", "é" * 400), ("5 >é%", "v", "é" * 400), ("6", "w", "y" * (17 << 20)), (None, "n", "null id"), ("7", "z", "z" * 2000), (None, "z", "z" * 2000)]
    table = spark.createDataFrame(data, "page_id string, url string, html string")
    for n, size in enumerate((1, 3000, 1 << 25)):
        path = str(tmp_path / f"warc{n}")
        warc.write(warc.plan(table), path, file_bytes=size)
        rows = warc.read(spark, path, payloads=True).collect()
        got = {r["page_id"]: r for r in rows if r["url"] != "n"}
        assert len(rows) == 9 and "gap" not in {r["kind"] for r in rows}
        assert got["1"]["kind"] == "revisit" and got["1"]["refers_to"] == "2" and got["2"]["refers_to"] is None
        assert got["4"]["kind"] == got["5 >é%"]["kind"] == "response" and got[None]["refers_to"] == "7"
        assert size > 1 or len({r["archive"] for r in rows}) == 9
        for i, _, html in data:
            html = (html or "").encode()
            if i is not None:
                assert got[i]["payload_digest"] == hashlib.sha1(html).hexdigest() and got[i]["payload_bytes"] == len(html)
                assert got[i]["kind"] == "revisit" or got[i]["payload"] == html
    empty = str(tmp_path / "none")
    warc.write(warc.plan(table.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs)
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() / found.count() > 0.97
