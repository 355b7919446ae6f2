"""Joins of rows that multiply on the way never send a side through the driver, however small its files are."""

from treegauge.llm import common as C
from treegauge.llm import minhash_tensor as M
from treegauge.llm import spelling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_signatures_are_shuffled(spark):
    sig = C.materialize(M.signatures(spark.createDataFrame([(i, f"a b c {i}") for i in range(9)], "doc_id long, text string"), 2, 4, 1, 7).withColumnRenamed("doc_id", "node"))
    keyed = plan(M.shared_keys(sig))
    assert "SortMergeJoin" in keyed and "Broadcast" not in keyed
    pairs = C.materialize(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"))
    texts = C.materialize(spark.createDataFrame([(i, f"a b c {i}") for i in range(9)], "doc_id long, text string"))
    assert "Broadcast" not in plan(M.verify(pairs, texts, 2, 80))


def test_keys_of_words_are_shuffled(spark):
    words = C.materialize(spark.createDataFrame([("hello", 9), ("hallo", 3), ("hullo", 2)], "word string, n long"))
    formed = plan(spelling.forms(words))
    assert "SortMergeJoin" in formed and "Broadcast" not in formed
    rooted = plan(spelling.rooted(spelling.forms(words)))
    assert "SortMergeJoin" in rooted and "Broadcast" not in rooted
