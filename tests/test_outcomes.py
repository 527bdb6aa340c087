"""What becomes of every prompt: outcomes, traces, stage events; and evaluation runs over the whole pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from trovespark.evaluation import runner
from trovespark.functions import text as T
from trovespark.plans import compose
from trovespark.sources import readers

CORPUS = [
    ("d1", "a/engine.go", 1, 9, "c", "EngineFinalize", "function", "func EngineFinalize rewards validators at the end of a block"),
    ("d2", "a/secret.go", 1, 3, "c", "SecretHolder", "function", "the key is -----BEGIN RSA PRIVATE KEY----- zebra zebra"),
    ("d3", "b/gas.go", 5, 8, "c", "GasLimit", "function", "gas limit of a block header and its parent"),
]
PROMPTS = [("p1", "how does EngineFinalize pay validators"), ("p2", ""), ("p3", None), ("p4", "zebra zebra SecretHolder"), ("p5", "GasLimit of a header")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(CORPUS, "doc string, file string, start_line int, end_line int, commit_hash string, symbol string, chunk_kind string, text string")
    return rows.withColumn("vec", T.letter_counts(F.col("text"))).cache()


@pytest.fixture(scope="module")
def done(spark, corpus):
    events = compose.StageEvents()
    prompts = spark.createDataFrame(PROMPTS, "prompt_id string, text string")
    refuse = [("zebra", "zebra", "fail_closed")]
    out = compose.compose(prompts, corpus, glossary=[(["validators"], ["rewards"])], rules=refuse, settings=compose.Settings(recall=1, citations=1, knowledge=1), embed=T.letter_counts, events=events)
    return out, events


def test_every_prompt_has_an_outcome(done):
    got = {r["prompt_id"]: (r["status"], r["rule"]) for r in done[0].outcomes.collect()}
    assert got == {"p1": ("ok", None), "p2": ("empty_prompt", None), "p3": ("empty_prompt", None), "p4": ("fail_closed", "zebra"), "p5": ("ok", None)}
    assert {r["prompt_id"] for r in done[0].packs.collect()} == {"p1", "p5"}


def test_traces_tell_how_seeds_were_found(done):
    rows = {r["prompt_id"]: r for r in done[0].traces.collect()}
    assert set(rows) == {"p1", "p4", "p5"}
    t = rows["p1"]
    assert (t["producer"], t["vocab_expanded"], t["vocab_keywords"], t["graph_calls"]) == ("composer", True, ["rewards"], 0)
    kinds = [(s["n"], s["kind"], s["decision"]) for s in t["steps"]]
    assert kinds[-1] == (t["rounds"] + 1, "keyword", "expand") and kinds[t["rounds"] - 1][1:] == ("recall", "accept") and len(kinds) == t["rounds"] + 1
    assert [s["keywords"] for s in t["steps"][: t["rounds"] - 1]] == [[]] * (t["rounds"] - 1)
    accepted = t["steps"][t["rounds"] - 1]
    assert accepted["query"].startswith(PROMPTS[0][1] + " rewards") and accepted["keywords"] and accepted["hits"] and 0 < accepted["confidence"] <= 1
    assert t["final_seeds"] == ["a/engine.go:1-9"] == t["steps"][-1]["hits"] and t["failed_keywords"] == [] and t["vector_calls"] == t["rounds"]


def test_stage_events_count_the_stages(spark, done, tmp_path):
    out, events = done
    path = str(tmp_path / "log")
    readers.append_events(events.rows(spark, "run-1"), path)
    got = {r["event"]: json.loads(r["fields"]) for r in spark.read.json(path).select("event", F.to_json("fields").alias("fields")).collect()}
    assert list(events.seen) == ["composer.intent_classified", "composer.stage1_extracted", "composer.stage2_searched", "composer.stage3_expanded", "composer.stage4_allocated", "composer.stage5_sanitized", "composer.compose_complete"] and set(got) == set(events.seen)
    count = lambda event, what="rows": int(got[f"composer.{event}"][what])
    assert count("intent_classified") == count("intent_classified", "unknown") == out.intents.count() == 3
    assert count("stage1_extracted") == out.extraction.keywords.count() and count("stage2_searched") == out.seeds.count() and count("stage3_expanded") == out.neighbours.count()
    assert count("stage4_allocated") == out.selected.count() and count("stage4_allocated", "used_tokens") == out.selected.agg(F.sum("tokens")).first()[0]
    assert count("stage5_sanitized", "aborted") == 1 == count("stage5_sanitized", "redactions") and count("compose_complete") == out.packs.count() == 2


# --- evaluation runs -------------------------------------------------------------------------------

SCENARIO = "name string, prompt string, match_mode string, runs int, expected_citations array<struct<file:string,start_line:int,end_line:int>>"


def test_scenarios_over_the_pipeline(spark, corpus):
    scenarios = spark.createDataFrame([("pays", PROMPTS[0][1], "overlap", 3, [("a/engine.go", 4, 5)]), ("gas", PROMPTS[4][1], "strict", 1, [("b/gas.go", 5, 7)]), ("blank", "", "overlap", 2, [("x", 1, 1)]), ("key", "zebra zebra SecretHolder", "overlap", 1, [])], SCENARIO)
    tool = compose.composing_tool(corpus, rules=[("zebra", "zebra", "fail_closed")], settings=compose.Settings(recall=1, citations=1, knowledge=1), embed=T.letter_counts)
    got = {r["name"]: r for r in runner.run_scenarios(scenarios, tool).collect()}
    assert (got["pays"]["runs"], got["pays"]["failed"], got["pays"]["recall"], got["pays"]["precision"], got["pays"]["citation_count"], got["pays"]["body_count"]) == (3, 0, 1.0, 1.0, 1, 1)
    assert (got["gas"]["recall"], got["gas"]["f1"]) == (0.0, 0.0) and got["gas"]["token_utilization"] > 0
    assert (got["blank"]["failed"], got["blank"]["error"], got["blank"]["recall"]) == (2, "run 1: empty_prompt; run 2: empty_prompt", None)
    assert got["key"]["error"] == "run 1: fail_closed: rule=zebra"


def test_payloads_of_all_kinds(spark):
    pack = json.dumps({"citations": [{"file": "f", "start_line": 1, "end_line": 2}], "bodies": [{}, {}], "metadata": {"utilization_ratio": 0.5}, "sanitize_report": [1]})
    answers = {1: (pack, None, None, 10), 2: (None, pack, None, 30), 3: (None, "", None, 1), 4: (None, "not json", None, 1), 5: ("[1]", None, None, 1), 6: (None, None, "timeout", 1), 7: (pack, "ignored", None, 20)}
    scenarios = spark.createDataFrame([("s", "p", "overlap", 8, [("f", 2, 9)]), ("t", "p", None, None, None)], SCENARIO)

    def tool(runs):
        rows = spark.createDataFrame([(f"s#{k}", *v) for k, v in answers.items()], "run_id string, structured string, text string, error string, latency_ms long")
        return runs.join(rows, "run_id").drop("prompt")

    got = {r["name"]: r for r in runner.run_scenarios(scenarios, tool).collect()}
    s = got["s"]
    assert s["error"] == "run 3: decode: empty tool result; run 4: decode text pack; run 5: decode structured pack; run 6: timeout; run 8: no result"
    assert (s["failed"], s["precision"], s["recall"], s["token_utilization"], s["body_count"], s["redaction_count"], s["latency_p50"], s["latency_max"]) == (5, 1.0, 1.0, 0.5, 2, 1, 20, 30)
    assert (got["t"]["runs"], got["t"]["error"]) == (1, "run 1: no result")
