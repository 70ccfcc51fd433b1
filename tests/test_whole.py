"""Queries that take whole tables and whole texts."""

from millrace.plans import registry
from millrace.plans.tables import table


def test_call_match_takes_every_order(spark):
    sf = "/root/testdata/sf0.01"
    orders = table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    assert orders > 3000 and registry.QUERIES["q_call_match"](spark, sf).count() == orders


def test_no_word_is_cut(spark):
    sf = "/root/testdata/sf0.01"
    words = {r["doc_id"]: len(r["text"].split()) for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: len(r["labels"]) for r in registry.QUERIES["q_trim_supervision"](spark, sf).collect()}
    assert labels == words and max(words.values()) > 60
    padded = registry.QUERIES["q_pad_mask"](spark, sf).collect()
    assert {r["doc_id"] for r in padded if r["reason"]} == {d for d, n in words.items() if not 2 <= n <= 2048}
    assert all(len(r["input_ids"]) == 2048 and sum(r["attention_mask"]) == words[r["doc_id"]] for r in padded if not r["reason"])
    blocks = registry.QUERIES["q_replace_block"](spark, sf).collect()
    assert sum("<>" in r["tokens"] for r in blocks) == 415


def test_message_texts_are_whole(spark, tmp_path):
    start = "the same forty characters start both of these messages, which then "
    rows = [(1, 1, "user", start + "differ"), (1, 2, "user", start + "part"), (2, 2, "user", start + "go on")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len({r["trace"] for r in run("q_candidate_selection")}) == 2
    assert start + "go on" in "".join(r["frame"] for r in run("q_frames") if r["conv_id"] == 2)
    assert any(start + "differ" in str(r["value"]) for r in run("q_call_parse"))
