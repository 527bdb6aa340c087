"""What grows no faster than its input: symbol look-up, the concurrency walk, overlaps of citations."""

import random

from pyspark.sql import functions as F

from trovespark.evaluation import metrics
from trovespark.operators import graph, search
from trovespark.sources import scratch


def test_a_symbol_is_settled_without_a_window(spark):
    rows = [("n1", "a.B", "x/a.B"), ("n2", "c.B", "x/c.B"), ("n3", "c.B.M", None), ("n4", None, "x/q.Z"), ("n5", "a.B", "x/other")]
    nodes = spark.createDataFrame(rows, "id string, qualified_name string, canonical_id string")
    names = spark.createDataFrame([("x/a.B",), ("c.B",), ("k.c.B",), ("B",), ("x/q.Z",), ("no.no",), (None,), ("B",)], "name string")
    found = search.find_symbol(names, nodes)
    want = {("x/a.B", 0, "n1"), ("c.B", 1, "n2"), ("k.c.B", 2, "n2"), ("B", 1, "n1"), ("B", 1, "n2"), ("B", 1, "n5"), ("x/q.Z", 0, "n4")}
    assert sorted((r["asked"], r["priority"], r["id"]) for r in found.collect()) == sorted(want)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_last_hop_is_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "kept", lambda df, name: written.append(name) or scratch.kept(df, name))
    rng = random.Random(3)
    edges = [(rng.choice("abcdefgh"), rng.choice("abcdefgh"), rng.choice(["spawns", "sends_to", "calls"])) for _ in range(14)]
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    got = {(r["seed"], r["node"]): (r["direction"], r["distance"]) for r in graph.concurrency(spark.createDataFrame([("s", "a"), ("t", "b")], "seed string, node string"), df).collect()}
    want = {}
    for seed, start in (("s", "a"), ("t", "b")):
        met = {}
        for way, (i, j) in (("affects", (0, 1)), ("affected_by", (1, 0))):
            seen, front = {start: 0}, {start}
            for hop in (1, 2, 3):
                front = {e[j] for e in edges if e[2] != "calls" and e[i] in front} - set(seen)
                seen |= {n: hop for n in front}
            for n, d in seen.items():
                met.setdefault(n, {})[way] = d
        want |= {(seed, n): ("both" if len(m) == 2 else next(iter(m)), min(m.values())) for n, m in met.items() if n != start}
    assert got == want and len(want) > 4 and "hop2" in written and "hop3" not in written


def test_only_files_that_both_cite_are_looked_up(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(metrics.intervals, "met", lambda x, y, *how, real=metrics.intervals.met: looked.append(x.count()) or real(x, y, *how))
    side = lambda rows: spark.createDataFrame(rows, "scenario string, file string, start_line int, end_line int")
    e = [("p", f"e{i}.go", 1, 5) for i in range(50)] + [("p", "f.go", 1, 5), ("p", "f.go", 9, 9), ("p", "same.go", 3, 4), ("p", "back.go", 5, 4), ("p", None, 1, 2)]
    a = [("p", f"a{i}.go", 1, 5) for i in range(50)] + [("p", "f.go", 4, 8), ("p", "same.go", 3, 4), ("p", "same.go", 3, 4), ("p", "back.go", 5, 4), ("p", None, 1, 2)]
    r = metrics.retrieval_quality(side(e), side(a)).first()
    assert (r["n_expected"], r["n_actual"], r["hits"], r["recall"]) == (55, 54, 2, 2 / 55)
    assert sum(looked) <= 5
    assert metrics.retrieval_quality(side(e), side(a), strict=True).first()["hits"] == 2
