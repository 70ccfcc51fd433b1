"""The pipeline's near-duplicate stage against brute force."""

import random

import pytest

import corpus_pipeline
from millrace.llm import near, simhash

SCHEMA = "doc_id long, text string"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(texts):
    parent, sets = list(range(len(texts))), [shingles(t) for t in texts]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def groups():
    rng = random.Random(6)
    words, texts = [f"w{i}" for i in range(400)], []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(150)]
        for n in range(45):
            t = list(base)
            for _ in range(n % 7):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t[rng.randrange(12) :]))
    return [*texts, "", None, "one two", "one  TWO", "one three", " \n"]


def test_stage_joins_texts_similar_by_four_fifths_that_simhash_misses(spark):
    texts = groups()
    expected = sorted(set(brute(texts)))
    table = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()) == expected
    assert simhash.keep_one(table).count() > len(expected)


@pytest.mark.parametrize("pairwise", [1, 8, 1 << 40])
def test_large_buckets_lose_no_pair(spark, pairwise):
    texts = groups()
    table = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in near.keep_one(table, pairwise=pairwise).collect()) == sorted(set(brute(texts)))


def test_a_pair_at_exactly_four_fifths_links(spark):
    a, b = [f"a{i}" for i in range(13)], [f"a{i}" for i in range(12)] + ["b"]
    assert len(shingles(" ".join(a)) & shingles(" ".join(b))) == 8 and len(shingles(" ".join(a)) | shingles(" ".join(b))) == 10
    table = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "other words that are like none of those")], SCHEMA)
    assert sorted(r["doc_id"] for r in near.keep_one(table).collect()) == [1, 3]


def test_stage_tells_rows_of_one_id_apart_and_groups_idless_rows(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    rows = [(1, x), (1, y), (1, y), (2, y + " end"), (None, z), (None, z), (None, z + " end"), (None, x)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert sorted(kept, key=str) == [(1, "x"), (1, "y"), (None, "z")]
