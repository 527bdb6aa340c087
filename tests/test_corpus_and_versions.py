"""The flow corpus from notes; gates and promotion of versions."""

import json

import pytest
from trovespark.operators import inventory
from trovespark.sources import commits, flow_corpus, versions

NOTE = '''---
flow: ep-send # the name
entry_point: rpc.Send
summary: "sends it"
links: [spine-block, ep-other]
called_by: —
---
# Send

### STEP S-1 check
- symbol: `Pool.Add` # here
- at: `core/pool.go:236`
- kind: guard # comment
- calls: [S-2, ep-other, helper]
- reads: state
- branches:
  - when: "no funds" → then: "reject" at: `core/pool.go:240`
  - when: otherwise
- invariant: [INV-GAS-1, other]
- prose: text # stays

### STEP S-2
- at: core/other.go
- calls: []
'''
RULES = '''### INV-GAS-1 — gas is paid
- statement: it is
- enforced_at:
  - `core/a.go:12` `ep-send:S-1` `ep-send:S-2`
  - plain words
- check: look

### INV-SIG-2 — signed
- assumes: keys
'''


@pytest.fixture(scope="module")
def records(spark):
    files = spark.createDataFrame([("a/b/send.md", NOTE), ("unnamed.md", "no front matter\n### STEP X\n- symbol: f\n")], "path string, text string")
    return flow_corpus.corpus(files, spark.createDataFrame([("invariants.md", RULES)], "path string, text string"))


def test_flows_and_steps(records):
    flows = {r["id"]: r.asDict() for r in records["flow"].collect()}
    assert flows["ep-send"] == {"id": "ep-send", "entry_point": "rpc.Send", "trigger": None, "summary": "sends it", "root_symbol": None, "links": ["spine-block", "ep-other"], "called_by": []}
    assert set(flows) == {"ep-send", "unnamed"}
    steps = {r["id"]: r for r in records["step"].collect()}
    s = steps["S-1"]
    assert (s["symbol"], s["file"], s["line"], s["kind"], s["calls"], s["reads"], s["writes"], s["invariants"], s["prose"]) == ("Pool.Add", "core/pool.go", 236, "guard", ["S-2", "ep-other", "helper"], "state", None, ["INV-GAS-1"], "text # stays")
    assert [tuple(b) for b in s["branches"]] == [("no funds", "reject", "core/pool.go:240"), ("otherwise", None, None)]
    assert (steps["S-2"]["file"], steps["S-2"]["line"], steps["S-2"]["calls"], steps["S-2"]["branches"]) == ("core/other.go", None, [], [])
    assert [tuple(r) for r in flow_corpus.missing_symbols(records["step"]).collect()] == [("ep-send", "S-2")]


def test_invariants_and_edges(records):
    rules = {r["id"]: r for r in records["invariant"].collect()}
    assert [tuple(e) for e in rules["INV-GAS-1"]["enforced_at"]] == [("ep-send", "S-1", "core/a.go:12"), ("ep-send", "S-2", "core/a.go:12")]
    assert (rules["INV-GAS-1"]["title"], rules["INV-GAS-1"]["check"], rules["INV-SIG-2"]["domain"], rules["INV-SIG-2"]["assumes"], rules["INV-SIG-2"]["enforced_at"]) == ("gas is paid", "look", "SIG", "keys", [])
    assert sorted(map(tuple, records["edge"].collect())) == [("calls", "ep-send:S-1", "ep-send:S-2"), ("calls_flow", "ep-send:S-1", "ep-other"), ("calls_flow", "ep-send:S-1", "helper"), ("enforces", "INV-GAS-1", "ep-send:S-1"), ("enforces", "INV-GAS-1", "ep-send:S-2")]


def test_tagged_lines_and_files(spark, records, tmp_path):
    flow_corpus.write_corpus(records, str(tmp_path / "out"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((x["type"] for x in lines)) == ["edge"] * 5 + ["flow"] * 2 + ["invariant"] * 2 + ["step"] * 3
    assert all(next(iter(x)) == "type" for x in lines) and {"writes"} <= set(next(x for x in lines if x["type"] == "step"))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "x.md").write_text(NOTE)
    (tmp_path / "notes" / "x.txt").write_text("no")
    assert flow_corpus.flows(flow_corpus.notes(spark, str(tmp_path / "notes"))).select("id").collect()[0][0] == "ep-send"


# --- versions --------------------------------------------------------------------------------------


def version(spark, nodes=(("a", "x/a", "f.go"), ("b", "x/b", "g.go")), edges=(("a", "b"),), chunks=("x/a", "x/b", None), graph=("c", "1.19", "d"), vector=("c", "d", 3), sources=("f.go", "g.go")):
    return {
        "nodes": spark.createDataFrame(list(nodes), "id string, canonical_id string, file_path string"),
        "edges": spark.createDataFrame(list(edges), "src string, dst string"),
        "chunks": spark.createDataFrame([(c,) for c in chunks], "canonical_id string"),
        "graph": spark.createDataFrame([graph], "src_commit string, schema_version string, graph_digest string"),
        "vector": spark.createDataFrame([vector], "src_commit string, graph_digest string, chunk_count long"),
        "sources": spark.createDataFrame([(s,) for s in sources], "path string"),
    }


def failed(spark, **what):
    live = what.pop("live", True)
    return [r["check"] for r in versions.gate(**version(spark, **what), live=live).orderBy("place").collect() if not r["ok"]]


@pytest.mark.parametrize(
    "what,check",
    [
        ({}, []),
        ({"edges": [("a", "zz")]}, ["valid"]),
        ({"nodes": [("a", "x/a", "f.go"), ("a", "x/b", "g.go"), ("b", "x/b", "g.go")]}, ["valid"]),
        ({"graph": ("c2", "1.19", "d")}, ["aligned"]),
        ({"graph": ("c", "1.18", "d")}, ["aligned"]),
        ({"graph": ("c", "odd", "d")}, ["aligned"]),
        ({"graph": ("", "2.0", ""), "vector": ("c", "d", None)}, []),
        ({"vector": ("c", "d", 4)}, ["counts"]),
        ({"chunks": ("x/a", "no", None)}, ["bridge"]),
        ({"chunks": ("x/a", "no", None), "live": False}, []),
        ({"sources": ("f.go", "h.go")}, ["audit"]),
    ],
)
def test_each_check_fails_by_itself(spark, what, check):
    assert failed(spark, **what) == check


def test_promotion(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    for label in ("v1", "v2"):
        spark.createDataFrame([(label,)], "x string").write.parquet(f"{root}/version={label}/t")
    with pytest.raises(ValueError):
        versions.read(spark, root, "t")
    good, warned, bad = (versions.gate(**version(spark, **w)) for w in ({}, {"sources": ("f.go",)}, {"chunks": ()}))
    assert versions.promote(spark, root, "v1", good) == []
    with pytest.raises(versions.GateFailed, match="counts"):
        versions.promote(spark, root, "v2", bad)
    assert versions.current(spark, root) == "v1" and versions.read(spark, root, "t").first()[0] == "v1"
    opened = versions.read(spark, root, "t")
    assert versions.promote(spark, root, "v2", warned) == ["audit: 1 files gone, 0 not indexed"]
    assert opened.first()[0] == "v1" and versions.read(spark, root, "t").first()[0] == "v2"  # a reader keeps the version it opened
    monkeypatch.setattr(versions, "commits", lambda *_: [{"version": "v1"}])  # a writer that read before the last promotion
    with pytest.raises(commits.Conflict):
        versions.promote(spark, root, "v1", good)
    monkeypatch.undo()
    versions.promote(spark, root, "v1", good)
    assert versions.current(spark, root) == "v1"


def test_export_writes_a_file_an_entry(spark, tmp_path):
    kind = "id string, title string, summary string, status string, related array<string>, pitfalls array<string>"
    entries = spark.createDataFrame([("A1", "One", "first", "verified", [], ["mind\nthis"]), ("A2", "Two", "second", "draft", [], []), ("A3", "Three", "third", "needs_verification", ["A1"], [])], kind)
    docs = spark.createDataFrame([("x/spec.md", "a\nb")], "path string, text string")
    for some in (entries, entries.where("id <> 'A3'")):  # what the first left is swept
        inventory.export(some, str(tmp_path / "out"), docs)
    files = sorted(tmp_path.glob("out/*/*/part-*"))
    assert [f.parent.name for f in files] == ["path=spec.md", "id=A1"] and files[0].read_text() == "a\nb\n" and files[1].read_text().startswith("# One\n\nfirst")


def test_scope_is_of_whole_segments(spark):
    files = spark.createDataFrame([("a/x.go",), ("ab/y.go",), ("a/b/z.go",), ("a/x.go",), ("c",)], "path string")
    got = lambda *how: sorted(r[0] for r in inventory.in_scope(files, *how).collect())
    assert got() == ["a/b/z.go", "a/x.go", "ab/y.go", "c"] and got(("a", "c")) == ["a/b/z.go", "a/x.go", "c"] and got(("a/",), ("a/b",)) == ["a/x.go"]
