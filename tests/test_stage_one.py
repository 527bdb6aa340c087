"""Terms and letters counted in Arrow batches; keywords looked up among the terms asked for only."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovespark.functions import text as T
from trovespark.operators import search
from trovespark.plans import compose

ODD = [None, "", " ", "aB", "fooBarBaz_qux.Quux/9A", "Größe ÉTÉ été", "ΟΔΟΣ aΣ", "İstanbul Kx K", "a1B2 ABc", "日本語 テスト", "x" * 100 + " yy" * 5000, "٣٤ ½ ²x 7", "𝒜𝒷 𐐀𐐨 \x00a"]


@pytest.fixture(params=[1 << 22, 5])
def sliced(monkeypatch, request):
    monkeypatch.setattr(T, "TEXT_SLICE", request.param)


def test_terms_and_letters_are_those_of_the_sql(sliced):
    texts = pa.array(ODD)
    cut = [[] for _ in ODD]
    for at, some in zip((0, *[s.offset for s in T._slices(texts)][1:]), T._slices(texts)):
        rows, terms = T._cut(some)
        for r, t in zip(rows.tolist(), terms.to_pylist()):
            cut[at + r].append(t)
    con = duckdb.connect()
    con.register("odd", pa.table({"i": range(len(ODD)), "t": ODD}))
    sql = r"select list_filter(string_split_regex(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) from odd order by i"
    assert cut == [r[0] or [] for r in con.execute(sql).fetchall()]
    letters = ", ".join(f"length(lower(t)) - length(replace(lower(t), '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")
    assert T._letters.func(texts).to_pylist() == [list(map(lambda x: x and float(x), r[0])) for r in con.execute(f"select [{letters}] from odd order by i").fetchall()]


def test_postings_count_terms_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc int, text string")
    cut = {r["doc"]: r["terms"] or [] for r in docs.select("doc", T.code_terms(F.col("text")).alias("terms")).collect()}
    want = {(i, t): (n, len(terms)) for i, terms in cut.items() for t, n in Counter(terms).items()}
    assert {(r["doc"], r["term"]): (r["tf"], r["dl"]) for r in search.postings(docs, "doc").collect()} == want and len(want) > 15


def test_terms_not_asked_for_are_not_shuffled(spark, tmp_path):
    spark.range(1000).select(F.concat(F.lit("t"), "id").alias("term")).write.parquet(f"{tmp_path}/index")
    spark.createDataFrame([("t1",), ("t2",), ("zz",)], "term string").write.parquet(f"{tmp_path}/asked")
    found = compose.present(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/index"))
    assert sorted(r["term"] for r in found.collect()) == ["t1", "t2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
