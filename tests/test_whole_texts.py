"""Queries that join texts take all of them."""

from millrace.plans import registry


def test_history_has_whole_turns(spark, tmp_path):
    long = "a question of far more than twenty characters, " * 9
    turns = [(1, k, "user" if k % 2 else "assistant", f"{k} {long}") for k in range(8)]
    turns += [(2, 0, "user", long), (2, 1, "assistant", None), (2, 2, "user", " \u3000\n"), (3, 0, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["history"] for r in registry.QUERIES["history_last6"](spark, str(tmp_path)).collect()}
    assert got == {1: "\n".join(f"{role}: {text}" for _, _, role, text in turns[2:8]), 2: f"user: {long}", 3: ""}


def test_answers_have_whole_documents(spark, tmp_path):
    docs = [(k, f"alpha beta {'gamma ' * (4 - k)}" + "and much more text that nothing may cut " * 5) for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (got,) = registry.QUERIES["assembled_answers"](spark, str(tmp_path)).collect()
    text = "根据当前知识资料：" + "；".join(text for _, text in docs[:3])
    assert got.asDict() == {"item_id": 7, "answer": text, "deltas": len(range(0, len(text), 32))}
