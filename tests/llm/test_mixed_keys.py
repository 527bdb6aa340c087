"""The mix of tables with null and repeated ids."""

from collections import Counter

from trovespark.llm import mixing


def test_rows_that_share_an_id_are_mixed_each_by_itself(spark):
    rows = [(None if i % 2 else 7, " ".join([f"w{i}"] * (i + 1)), "ab"[i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r["text"] for r in mixing.mixed(docs).collect())
    keyed = mixing.mix_documents(docs, more=("text",)).collect()
    assert got == Counter({r["text"]: n for r in keyed if (n := int(r["taken"] / r["size"] + 0.5))})
