"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from trovespark.functions import text as T
from trovespark.operators import audit, budget, graph, inventory, pack, ranking, sanitize
from trovespark.plans import compose
from trovespark.sources import readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,tokens", [("", 0), ("abc", 0), ("abcd", 1), ("abcdefgh", 2), ("한국어 코드", 1), ("hello world!", 3)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, T.token_estimate(F.col("t")), t=text) == tokens


@pytest.mark.parametrize("path,test", [("a/b_test.go", True), ("a/b.go", False), ("x/testdata/y.go", True), ("a/b.spec.ts", True), ("contest/a.go", False), ("a/Token.t.sol", True), ("tests/a.go", True)])
def test_test_paths(spark, path, test):
    assert one(spark, T.is_test_path(F.col("p")), p=path) is test


def test_line_slice_is_clamped(spark):
    text = "a\nb\nc"
    assert [one(spark, T.line_slice(F.col("t"), F.lit(a), F.lit(b)), t=text) for a, b in ((1, 2), (2, 9), (4, 5), (3, 2), (0, 1))] == ["a\nb", "b\nc", "", "", ""]


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_compound_order(spark):
    words = F.array(F.lit("chain"), F.lit("Config"), F.lit("load"))
    assert one(spark, T.compounds(words)) == ["ChainConfig", "chainConfig", "ChainConfigLoad", "chainConfigLoad", "ConfigLoad", "configLoad"]


def test_fusion_scores_and_ties(spark):
    lists = spark.createDataFrame([("p", "a.go", 1, "bm25", 1.0, 1), ("p", "a.go", 1, "symbol", 1.5, 1), ("p", "b.go", 30, "bm25", 1.0, 2), ("p", "b.go", 1, "bm25", 1.0, 2)], "prompt string, file string, start_line int, list_kind string, weight double, rank int")
    fused = ranking.top_k(ranking.reciprocal_rank_fusion(lists, ["prompt"], ["file", "start_line"]), ["prompt"], ranking.citation_order(), 30)
    rows = fused.orderBy("rank").collect()
    assert [(r["file"], r["start_line"]) for r in rows] == [("a.go", 1), ("b.go", 1), ("b.go", 30)]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1.5 / 61)


def test_tests_are_demoted(spark):
    df = spark.createDataFrame([("handler_test.go", 1.0), ("handler.go", 1.0)], "file string, score double")
    assert {r["file"]: r["score"] for r in ranking.demote_tests(df).collect()} == {"handler_test.go": 0.25, "handler.go": 1.0}


def row(score, text, kind="function", seed=True, commit="c"):
    return {"score": score, "text": text, "chunk_kind": kind, "is_seed": seed, "commit_hash": commit}


def test_budget_skips_what_does_not_fit():
    got = budget.choose([row(10, "x" * 1_000_000), row(1, "y" * 40)], budget.Budget(tokens=100, knowledge_reserve=0))
    assert [r["tokens"] for r in got] == [10]
    assert budget.Budget(tokens=1000, overhead=0.2).usable == 800


def test_budget_reserves():
    rows = [row(50 - i, "abcd" * 4) for i in range(20)] + [row(1, "abcd", "invariant"), row(1, "abcd", seed=False)]
    got = budget.choose(rows, budget.Budget())
    assert sum(r["chunk_kind"] == "function" and r["is_seed"] for r in got) == 8
    assert any(r["chunk_kind"] == "invariant" for r in got) and any(not r["is_seed"] for r in got)


def test_budget_cuts_long_bodies_to_their_head():
    got = budget.choose([row(1, "\n".join(["word" * 20] * 500))], budget.Budget(tokens=400, knowledge_reserve=0))
    assert got[0]["degraded"] and got[0]["text"].endswith(budget.SNIPPET_MARK)


def test_sanitizer_actions(spark):
    df = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY-----"), (2, "key sk-" + "a" * 24), (3, "mail me@example.com twice me@example.com"), (4, "clean")], "id int, text string")
    got = {r["id"]: r for r in sanitize.sanitize(df).collect()}
    assert got[1]["aborted"] and got[2]["text"] == "" and got[2]["redactions"][0]["rule"] == "secret-key"
    assert got[3]["text"] == "mail *** twice ***" and got[3]["redactions"][0]["excerpt"] == "email: 2 matches"
    assert got[4]["text"] == "clean" and got[4]["redactions"] == []


def test_reach_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "d", "spawns")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("s", "a")], "seed string, node string")
    got = {r["node"]: r["distance"] for r in graph.reach(seeds, graph.arrows(edges, "forward"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    both = {r["node"]: r["direction"] for r in graph.concurrency(seeds, edges.withColumn("type", F.lit("spawns")), 3).collect()}
    assert both["b"] == "both" and both["d"] == "affects"


def test_audit_chain_finds_the_break(spark):
    log = audit.chained(spark.createDataFrame([("t", i, f"e{i}") for i in range(6)], "chain string, seq long, body string"), "chain", "seq", "body")
    assert audit.chain_breaks(log, "chain", "seq", "body").first()["first_break"] is None
    bad = log.withColumn("body", F.when(F.col("seq") == 3, F.lit("x")).otherwise(F.col("body")))
    assert audit.chain_breaks(bad, "chain", "seq", "body").first()["first_break"] == 3


def test_edge_admission_caps_new_targets(spark):
    edges = spark.createDataFrame([("p", i, "a", f"t{i}", "calls", 1) for i in range(30)] + [("p", 99, "z", "a", "calls", 1)], "prompt_id string, pos int, source string, target string, relation string, distance int")
    got = pack.admitted_edges(edges, spark.createDataFrame([("p", "a")], "prompt_id string, key string")).collect()
    assert sorted(r["pos"] for r in got) == list(range(16))


def test_glossary_expansion(spark):
    df = spark.createDataFrame([("p", "How is the 쿼럼 checked? QUORUM")], "prompt_id string, text string")
    got = inventory.expand(df, [(["쿼럼", "quorum"], ["Quorum", "calcQuorum"]), (["none"], ["X"])]).first()
    assert got["keywords"] == ["Quorum", "calcQuorum"] and got["expanded"].endswith(" Quorum calcQuorum")


def test_flow_notes(spark):
    note = "---\nflow_id: F1\n---\n### STEP F1.1\n- symbol: vm.Call\n- calls: F1.2, F1.3\n- invariants: INV-1\n- when empty -> skip\n### STEP F1.2\n- symbol: vm.Run\n"
    got = readers.flow_notes(spark.createDataFrame([("a.md", note)], "path string, text string")).orderBy("pos").collect()
    assert [(r["flow"], r["step"], r["symbol"], r["calls"]) for r in got] == [("F1", "F1.1", "vm.Call", ["F1.2", "F1.3"]), ("F1", "F1.2", "vm.Run", [])]
    assert got[0]["branches"][0]["then"] == "skip"


def test_publish_and_promote(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    label = readers.publish(spark.range(3), root, "abcdef0123", "0123456789")
    with pytest.raises(ValueError, match="rows"):
        readers.promote(spark, root, label, {"rows": False})
    readers.promote(spark, root, label, {"rows": True})
    assert label == "abcdef01-01234567" and readers.current(spark, root).count() == 3


def test_event_stream_counts(spark, tmp_path):
    from trovespark.streaming.events import event_stream, windowed_counts

    events = spark.sql("select timestamp'2026-01-01 00:00:10' as ts, 'info' as level, 'done' as event, 't' || id as trace_id, 'r' as run_id, false as dry_run, map('a','b') as fields from range(5)")
    readers.append_events(events, str(tmp_path / "log"))
    q = windowed_counts(event_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").first()["n"] == 5


def test_compose_is_whole_and_stamped(spark):
    corpus = spark.createDataFrame([(str(i), f"a/f{i}.go", 1, 3, "c", f"Sym{i}", "function", f"func Sym{i} handles gas limit\nbody {i}\nend", [float(i), 1.0]) for i in range(20)], "doc string, file string, start_line int, end_line int, commit_hash string, symbol string, chunk_kind string, text string, vec array<float>")
    prompts = spark.createDataFrame([("p", "Where is Sym3 gas limit handled")], "prompt_id string, text string")
    anchors = spark.createDataFrame([("bug_fix", "a", [1.0, 0.0]), ("docs_update", "b", [0.0, 1.0])], "intent string, anchor string, vec array<float>")
    nodes, edges = corpus.select(F.col("doc").alias("id")), spark.createDataFrame([("3", "19", "calls"), ("19", "18", "calls")], "src string, dst string, type string")
    embed = lambda text: F.array(F.char_length(text).cast("float"), F.lit(1.0).cast("float"))
    whole = compose.compose(prompts, corpus.withColumn("vec", embed(F.col("text"))), anchors, nodes, edges, [(["gas"], ["Sym4"])], embed=embed, settings=compose.Settings(recall=3, bm25=3))
    got = whole.packs
    r = got.first()
    assert r["intent"] == "bug_fix" and whole.intents.first()["intent"] == "bug_fix"
    assert {x["round"] for x in whole.extraction.rounds.collect()} == {1, 2}
    assert {x["target"] for x in whole.neighbours.collect()} >= {"19"} and len(r["edges"]) > 0
    assert "a/f3.go:1-3" in r["citations"] and len(r["integrity_hash"]) == 64
    assert pack.verified(got, ["intent", "query", "citations", "bodies", "edges", "used_tokens"]).first()["status"] == "ok"


def test_knn_in_blocks_is_knn(spark, monkeypatch):
    from trovespark.operators import search

    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "doc long, vec array<float>")
    q = v.where("doc < 20").withColumnRenamed("doc", "query_id")
    whole = sorted(map(tuple, search.knn(q, v, k=3).collect()))
    monkeypatch.setattr(search, "MOST_QUERIES", 6)
    assert sorted(map(tuple, search.knn(q, v, k=3).collect())) == whole


def test_pack_markdown_leaves_out_empty_sections(spark):
    from trovespark.operators.render import REDACTED, pack_markdown

    packs = spark.createDataFrame([("p", "why", "", 5, 10), ("q", "how", "bug_fix", 0, 10)], "prompt_id string, query string, intent string, used_tokens int, budget_tokens int")
    cited = spark.createDataFrame([("p", 2, "a.py", 1, 1, ""), ("p", 1, "b", 3, 4, "c0")], "prompt_id string, pos int, file string, start_line int, end_line int, commit_hash string")
    bodies = spark.createDataFrame([("p", "a.py", 1, 1, "x = 1")] * 2, "prompt_id string, file string, start_line int, end_line int, text string")
    edges = spark.createDataFrame([], "prompt_id string, source string, relation string, target string")
    got = dict(map(tuple, pack_markdown(packs, cited, bodies, edges).collect()))
    assert got["p"] == f"# Task\n\nwhy\n\n# Relevant code\n\n## b:3-4@c0\n\n{REDACTED}\n\n## a.py:1\n\n```python\nx = 1\n```\n\n# Pack metadata\n\n- Tokens used/budget: 5/10\n"
    assert got["q"] == "# Task\n\nhow\n\n**Detected intent**: bug_fix\n\n# Pack metadata\n\n- Tokens used/budget: 0/10\n"


def test_cited_bodies_stay_inside_their_root(spark):
    from trovespark.sources.readers import cited_bodies

    files = spark.createDataFrame([("a/b.go", "1\n2\n3")], "path string, text string")
    c = spark.createDataFrame([("a/b.go", 2, 9), ("a/../a/b.go", 1, 1), ("gone", 1, 1), ("a/b.go", 4, 5)], "file string, start_line int, end_line int")
    assert sorted(r["text"] for r in cited_bodies(c, files).collect()) == ["", "", "", "2\n3"]


def test_candidates_of_a_prompt_without_hits_are_its_own_words(spark):
    from trovespark.plans.compose import augmented, candidates

    p = spark.createDataFrame([("p", "fix the parser"), ("q", "¿")], "prompt_id string, text string")
    hits = spark.createDataFrame([("q", 1, "", "x/load_test.go"), ("q", 2, "Sym", "y")], "prompt_id string, rank int, symbol string, file string")
    words = candidates(p, hits)
    assert [r["keyword"] for r in words.where("prompt_id = 'p'").sort("pos").collect()] == ["FixParser", "fixParser", "fix", "parser"]
    assert [r["keyword"] for r in words.where("prompt_id = 'q'").sort("pos").collect()] == ["load", "Sym"]
    assert {r["augmented"] for r in augmented(p, words).collect()} == {"fix the parser FixParser fixParser fix", "¿ load Sym"}


def test_expansion_by_intent_is_expansion_of_each(spark):
    import random

    rng = random.Random(2)
    kinds = ["calls", "invokes", "implements", "extends", "imports", "references", "defines", "spawns"]
    edges = spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{rng.randrange(44)}", rng.choice(kinds)) for _ in range(160)], "src string, dst string, type string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(40)], "id string")
    intents = list(T.INTENT_SHAPE)
    seeds = spark.createDataFrame([(f"p{i}", intents[i], f"n{rng.randrange(40)}", rng.random()) for i in range(len(intents)) for _ in range(4)], "prompt_id string, intent string, node string, score double").distinct()
    order = ["prompt_id", "source", "target", "relation", "distance", "score", "seeds", "rank"]
    got = sorted(map(str, compose.expand_by_intent(seeds, nodes, edges).select(order).collect()))
    want = []
    for i, name in enumerate(intents):
        _, relations, hops = T.INTENT_SHAPE[name]
        want += compose.expand(seeds.where(F.col("prompt_id") == f"p{i}").drop("intent"), nodes, edges, list(relations), hops=hops).select(order).collect()
    assert got == sorted(map(str, want)) and len(got) > 20


def test_budget_streams_what_choose_takes(spark):
    import random

    rng = random.Random(3)
    rows = [(f"p{i % 3}", f"f{i}", 1, 2, rng.choice(["", "c"]), rng.choice(["doc", "invariant", "function"]), rng.random() < 0.6, float(rng.randrange(9)), "\n".join("x" * rng.randrange(1, 900) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "prompt_id string, file string, start_line int, end_line int, commit_hash string, chunk_kind string, is_seed boolean, score double, text string")
    small = budget.Budget(tokens=1500)
    got = {(r["prompt_id"], r["pos"], r["file"], r["text"], r["tokens"], r["degraded"]) for r in budget.allocate(df.drop("text"), df.select("file", "start_line", "end_line", "text"), small).collect()}
    want = set()
    for p in ("p0", "p1", "p2"):
        mine = sorted((r.asDict() for r in df.collect() if r["prompt_id"] == p), key=lambda r: (-r["score"], r["file"]))
        want |= {(p, r["pos"], r["file"], r["text"], r["tokens"], r["degraded"]) for r in budget.choose(mine, small)}
    assert got == want
