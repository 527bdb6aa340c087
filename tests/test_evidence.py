"""Change evidence by symbol and by intent, and the best anchor of all."""

import json

import pytest
from pyspark.sql import functions as F

from trovespark.operators import audit, graph, sanitize, search
from trovespark.sources import documents, readers


def test_change_evidence_ranks_hunks_for_an_intent(spark):
    hunks = spark.createDataFrame([("h1", "a", 1, "a.go", 3, 9, "slashing of the validator"), ("h2", "b", 2, "b.go", 1, 2, "gas limit of a block"), ("h3", "c", 3, "c.go", 5, 6, "readme words")], "hunk string, symbol string, number long, file string, start_line int, end_line int, patch string")
    prs = spark.createDataFrame([("a", 7, "2026-01-01"), ("a", 8, "2026-02-01"), ("z", 9, "2026-01-01")], "symbol string, number long, merged_at string")
    asked = spark.createDataFrame([("a",)], "symbol string")
    intents = spark.createDataFrame([("q", "validator slashing bug")], "query_id string, text string")
    got = search.change_evidence(hunks, prs, asked, intents).collect()
    assert [(r["symbol"], r["number"]) for r in sorted(got, key=lambda r: r["rank"]) if r["way"] == "symbol"] == [("a", 8), ("a", 7)]
    assert [(r["asked"], r["number"], r["file"], r["start_line"], r["end_line"], r["patch"]) for r in got if r["way"] == "intent"] == [("q", 1, "a.go", 3, 9, "slashing of the validator")]


def test_best_anchor_is_of_all_anchors(spark):
    texts = spark.createDataFrame([(1, "e", "the quick brown fox"), (2, "f", "what this was"), (3, "e", "lazy dogs and dogs"), (4, "g", None)], "id long, entry string, text string")
    anchors = spark.createDataFrame([(1, "e", "this was the what"), (90, "e", "brown fox, the"), (91, "f", "brown fox, quick"), (150, "e", "dogs")], "anchor long, entry string, text string")
    stop = ("the", "this", "was", "what", "and")
    assert sorted(map(tuple, search.best_anchors(texts, anchors, ["id"], stop).collect())) == [(1, 91, 3), (3, 150, 1)]
    assert sorted(map(tuple, search.best_anchors(texts, anchors, ["id"], stop, ["entry"]).collect())) == [(1, 90, 2), (3, 150, 1)]


def rule_file(*rules, version=1):
    return json.dumps({"version": version, "rules": list(rules)})


def test_rule_files_are_checked():
    good = {"id": "A", "pattern": "a+", "action": "drop", "severity": "high"}
    rules = documents.rules(rule_file(good, {"id": "B", "pattern": "b", "action": "fail_closed", "severity": "low"}))
    assert sanitize.lookup(rules, "A") == ("A", "a+", "drop") and sanitize.lookup(rules, "Z") is None and [r[0] for r in sanitize.fail_closed(rules)] == ["B"]
    for bad in (rule_file(good, good), rule_file(), rule_file(good, version=2), rule_file(good | {"pattern": "("}), rule_file(good | {"action": "hide"}), rule_file(good | {"severity": "odd"}), rule_file(good | {"id": " "})):
        with pytest.raises(ValueError):
            documents.rules(bad)
    assert len(sanitize.fail_closed(sanitize.POLICY)) == 1


def test_glossary_and_project_files(spark):
    text = json.dumps({"entries": [{"canonical": "x", "aliases": ["gas", "gas", " "], "code_keywords": ["GasLimit"]}, {"canonical": "y", "aliases": ["a"]}]})
    assert documents.glossary(text) == [(["gas"], ["GasLimit"])]
    entries = {"b.yaml": json.dumps({"id": "E2", "title": "two", "anchors": [{"file": "f.go", "symbol": "S", "line": 3}]}), "a.yaml": json.dumps({"id": "E1", "title": "one"})}
    project, subsystems, found = documents.project(spark, json.dumps({"id": "p", "name": "P"}), json.dumps([{"id": "s", "name": "S"}]), entries)
    assert project.first()["id"] == "p" and subsystems.count() == 1
    assert [(r["file_name"], r["id"]) for r in found.collect()] == [("a.yaml", "E1"), ("b.yaml", "E2")]
    with pytest.raises(ValueError, match="E1"):
        documents.project(spark, "{}", "[]", entries | {"c.yaml": json.dumps({"id": "E1"})})
    scenes = documents.scenarios(spark, {"s.json": json.dumps({"name": "n", "prompt": "p", "runs": 2}), "notes.txt": "x"})
    assert [(r["name"], r["runs"]) for r in scenes.collect()] == [("n", 2)]


def test_marking_needs_all_keys(spark):
    df = spark.createDataFrame([("status: draft\nreviewer: x",)], "t string")
    with pytest.raises(Exception, match="last_verified_at"):
        df.select(documents.marked_verified(F.col("t"), "2026-01-01", "r")).collect()


def test_events_stay_logged_if_the_audit_fails(spark, tmp_path):
    events = spark.sql("select timestamp'2026-01-01 00:00:10' as ts, if(id = 0, 'debug', 'info') as level, 'done' as event, 't' || id as trace_id, 'r' as run_id, false as dry_run, map('a','b') as fields from range(5)")
    (tmp_path / "file").write_text("not a folder")
    assert readers.record_events(events, str(tmp_path / "log"), str(tmp_path / "file" / "audit")) != ""
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert readers.record_events(events, str(tmp_path / "log2"), str(tmp_path / "audit")) == "" and audit.read_log(spark, str(tmp_path / "audit")).count() == 4


def test_flows_by_one_way_only(spark):
    steps = spark.createDataFrame([("f", "a", "S", ["i"]), ("f", "b", "T", []), ("g", "c", "U", [])], "flow string, step string, symbol string, invariants array<string>")
    assert {r["step"] for r in graph.flows_by(steps, entry_point="S").collect()} == {r["step"] for r in graph.flows_by(steps, invariant="i").collect()} == {"a", "b"}
    assert graph.flows_by(steps, flow="g").count() == 1
    with pytest.raises(ValueError):
        graph.flows_by(steps, flow="g", invariant="i")


def test_no_k_means_ten(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc long, vec array<float>")
    q = v.where("doc = 3").withColumnRenamed("doc", "query_id")
    assert search.knn(q, v, k=0).count() == 10


def test_knn_of_odd_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, []), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 2.0])], "doc long, vec array<float>")
    got = search.knn(v.withColumnRenamed("doc", "query_id"), v, k=2).collect()
    best = {r["query_id"]: (r["doc"], round(r["score"], 6)) for r in got if r["rank"] == 1}
    assert best == {0: (0, 1.0), 1: (0, 0.0), 2: (0, 0.0), 3: (0, 0.0), 4: (4, 1.0), 5: (5, 1.0)}
