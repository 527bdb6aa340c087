"""Queries of what stands between batches: indexes brought up to date, logs that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovespark.evaluation import runner
from trovespark.functions import text as T
from trovespark.operators import audit, graph, intervals, inventory, search, vector_index, vocabulary
from trovespark.plans.catalogue import _BM25, composition, query, rounded
from trovespark.sources import flow_corpus, index, versions
from trovespark.sources.scratch import new_folder
from trovespark.sources.tables import table, view


def refreshed_index(spark: SparkSession, sf: str) -> index.Index:
    """An index of an older corpus, in which documents lack, differ or are no more, brought up to now; half of its buckets are compacted."""
    now = view(spark, sf, "corpus").select("doc", "text")
    number = F.col("doc").cast("long")
    before = now.where(number % 7 != 0).withColumn("text", F.when(number % 5 == 0, F.concat_ws(" ", "text", F.lit("stale words"))).otherwise(F.col("text")))
    before = before.unionByName(now.where(number % 11 == 0).withColumn("doc", F.concat(F.lit("old"), "doc")))
    path = new_folder(spark, "index")
    index.build(before, path, buckets=16)
    index.refresh(now, path)
    return index.compact(spark, path, range(0, 16, 2))


@query(
    "s23_incremental_index",
    f"with {_BM25} select term, count(*) as documents, cast(sum(tf) as bigint) as occurrences, cast(sum(dl) as bigint) as lengths from pt join dl using (doc) group by term",
    ("corpus", "prompts"),
)
def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    return refreshed_index(spark, sf).postings().groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"), F.sum("dl").alias("lengths"))


@query(
    "s23_r1_standing_search",
    f"""with {_BM25}, mm as (select query_id, min(score) as lo, max(score) as hi from tk group by query_id)
    select query_id, doc, rank, round(case when hi > lo then (score - lo) / (hi - lo) else 1 end, 6) as score from tk join mm using (query_id)""",
    ("corpus", "prompts"),
)
def standing_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search that reads the buckets of the prompts' terms of an index it didn't build."""
    found = search.search_index(view(spark, sf, "prompts"), refreshed_index(spark, sf))
    return rounded(found.select("query_id", "doc", F.col("rank").cast("long").alias("rank"), "score"), "score")


@query(
    "x14_s16_o2_appended_audit",
    """recursive with o as (select *, row_number() over (partition by trace_id order by seq) as n from audit),
    c as (select trace_id, n, sha256(repeat('0', 64) || '|' || body) as hash from o where n = 1 union all select o.trace_id, o.n, sha256(c.hash || '|' || o.body) from c join o on o.trace_id = c.trace_id and o.n = c.n + 1)
    select trace_id as chain, max(n) as records, cast(null as bigint) as first_break, max_by(hash, n) as last_hash from c group by trace_id""",
    ("audit",),
)
def appended_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches, of which the second is given twice, and their chains verified as one."""
    rows, path = view(spark, sf, "audit"), new_folder(spark, "audit")
    bounds = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    third = ((bounds["b"] or 0) - (bounds["a"] or 0)) // 3 + 1
    for i in (0, 1, 1, 2):
        some = rows.where(F.floor((F.col("seq") - (bounds["a"] or 0)) / third) == i)
        audit.append(some, path, "trace_id", [F.col("seq")], F.col("body"), f"part-{i}")
    return audit.chain_breaks(audit.read_log(spark, path), "chain", "seq", "body")


_CALLS = """with s as (select 'f' || cast(o_custkey % 50 as varchar) as flow, row_number() over (partition by o_custkey % 50 order by o_orderkey) as r, count(*) over (partition by o_custkey % 50) as n from orders),
    e as (select distinct flow, r as a, b from (select flow, r, n, 2 * r as b from s union all select flow, r, n, 2 * r + 1 from s union all select flow, r, n, r + 3 from s where r % 5 = 0
        union all select flow, r, n, r // 2 from s where r % 13 = 0 union all select flow, r, n, r - 7 from s where r % 17 = 0) x where b between 1 and n and b <> r)"""


def flow_calls(spark: SparkSession, sf: str) -> DataFrame:
    """(flow, step, calls) of flows that branch, meet again and run in cycles."""
    w = Window.partitionBy("flow")
    s = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("flow"), "o_orderkey").withColumns({"r": F.row_number().over(w.orderBy("o_orderkey")), "n": F.count("*").over(w)})
    r = F.col("r")
    calls = F.array(2 * r, 2 * r + 1, F.when(r % 5 == 0, r + 3), F.when(r % 13 == 0, F.floor(r / 2).cast("int")), F.when(r % 17 == 0, r - 7))
    kept_calls = F.filter(calls, lambda b: b.isNotNull() & (b >= 1) & (b <= F.col("n")) & (b != r))
    return s.select("flow", r.cast("long").alias("step"), F.array_distinct(kept_calls).cast("array<bigint>").alias("calls"))


@query(
    "g9_call_order",
    f"""{_CALLS.replace("with ", "with recursive ", 1)}, p as (select flow, a, b from e union select p.flow, p.a, e.b from p join e on e.flow = p.flow and e.a = p.b),
    c as (select s.flow, s.r as step, coalesce(max(x.b), s.r) as cycle from s left join (select p.flow, p.a, p.b from p join p q on q.flow = p.flow and q.a = p.b and q.b = p.a) x on x.flow = s.flow and x.a = s.r group by s.flow, s.r),
    d as (select distinct e.flow, x.cycle as a, y.cycle as b from e join c x on x.flow = e.flow and x.step = e.a join c y on y.flow = e.flow and y.step = e.b where x.cycle <> y.cycle),
    l as (select distinct flow, cycle as node, 0 as layer from c union select l.flow, d.b, l.layer + 1 from l join d on d.flow = l.flow and d.a = l.node),
    m as (select flow, node, max(layer) as layer from l group by flow, node)
    select c.flow, c.step, cast(m.layer as int) as layer, c.cycle from c join m on m.flow = c.flow and m.node = c.cycle""",
)
def call_order_(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_order(flow_calls(spark, sf))


@query(
    "g1_j10_callers_through_interfaces",
    """with m as (select s.seed, n.id, regexp_extract(n.qualified_name, '^(.*)\\.[^.]*$', 1) as owner, regexp_extract(n.qualified_name, '([^.]*)$', 1) as method from seeds s join nodes n on n.id = s.node),
    f as (select distinct m.seed, i.id as node from m join nodes t on t.qualified_name = m.owner join edges e on e.src = t.id and e.type = 'implements' join nodes x on x.id = e.dst join nodes i on i.qualified_name = x.qualified_name || '.' || m.method),
    s as (select seed, node from seeds union select seed, node from f),
    c as (select distinct s.seed, e.dst as source, e.src as target from s join edges e on e.dst = s.node and e.type in ('calls', 'invokes') where e.src in (select id from nodes) and e.dst in (select id from nodes)),
    r as (select *, row_number() over (partition by seed order by source, target) as r from c)
    select seed, source, target, 'called_by' as relation, 1 as distance from r where r <= 50""".replace("\\\\", "\\"),
    ("seeds", "nodes", "edges"),
)
def callers_through_interfaces(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(view(spark, sf, "seeds"), view(spark, sf, "edges"), view(spark, sf, "nodes"), ["called_by"], interfaces=True)


@query("r4_inverted_file_search")
def inverted_file_search(spark: SparkSession, sf: str) -> DataFrame:
    """r4_x2_knn's queries in an inverted file; tests measure its recall and the share of vectors scored."""
    e = table(spark, sf, "embeddings")
    ix = vector_index.temporary(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = vector_index.search(ix, asked)
    return rounded(found.select("query_id", "doc", F.col("rank").cast("long").alias("rank"), "score"), "score")


@query(
    "j11_x10_large_glossary",
    """with g as (select doc_id as entry, lower(substr(text, 11, 14)) as a, lower(substr(text, 41, 9)) as b, 'group' || cast(doc_id % 50 as varchar) as k, 'doc' || cast(doc_id as varchar) as l from documents where doc_id % 2 = 0),
    m as (select conv_id, turn, d.text as body, entry, k, l from conversations d join g on (trim(a) <> '' and contains(lower(d.text), a)) or (trim(b) <> '' and contains(lower(d.text), b))),
    w as (select conv_id, turn, kw, min(place) as place from (select conv_id, turn, k as kw, entry * 2 as place from m union all select conv_id, turn, l, entry * 2 + 1 from m) group by all)
    select conv_id, turn, coalesce(string_agg(kw, ' ' order by place), '') as kw from conversations left join w using (conv_id, turn) group by conv_id, turn""",
)
def large_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """A glossary that grows with the documents, from stretches of their texts, over all turns of all conversations."""
    d = table(spark, sf, "documents").where("doc_id % 2 = 0")
    entries = d.select(F.col("doc_id").alias("entry"), F.array(F.substring("text", 11, 14), F.substring("text", 41, 9)).alias("aliases"), F.array(F.concat(F.lit("group"), F.col("doc_id") % 50), F.concat(F.lit("doc"), "doc_id")).alias("keywords"))
    out = vocabulary.expand_all(table(spark, sf, "conversations"), entries)
    return out.select("conv_id", "turn", F.array_join("keywords", " ").alias("kw"))


@query(
    "j3_j4_overlapping_ranges",
    """with a as (select distinct o_custkey % 7 as f, o_orderkey % 20000 as s, o_orderkey % 20000 + case when o_orderkey % 50 = 0 then 5000 else o_orderkey % 40 end as e from orders),
    b as (select distinct c_custkey % 7 as f, c_custkey * 11 % 20000 as s, c_custkey * 11 % 20000 + c_custkey % 60 as e from customer)
    select a.f, a.s, a.e, cast(count(*) as bigint) as met, cast(min(b.s) as bigint) as least, cast(max(b.e) as bigint) as most from a join b on a.f = b.f and a.s <= b.e and b.s <= a.e group by all""",
)
def overlapping_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of a few crowded files, some of them wide."""
    s = F.col("o_orderkey") % 20000
    a = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("f"), s.alias("s"), (s + F.when(F.col("o_orderkey") % 50 == 0, 5000).otherwise(F.col("o_orderkey") % 40)).alias("e")).distinct()
    t = F.col("c_custkey") * 11 % 20000
    b = table(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("f"), t.alias("bs"), (t + F.col("c_custkey") % 60).alias("be")).distinct()
    return intervals.overlapping(a, b, ["f"], ("s", "e"), ("bs", "be")).groupBy("f", "s", "e").agg(F.count("*").alias("met"), F.min("bs").alias("least"), F.max("be").alias("most"))


def flow_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Notes of flows, a step for each order, and of invariants, one for each customer, as Markdown."""
    n = F.col("o_custkey") % 50
    step = F.concat(
        F.lit("### STEP s-"), "o_orderkey", F.lit("\n- symbol: `Sym"), F.col("o_orderkey") % 700, F.lit("` # order\n- at: `src/f"), F.col("o_orderkey") % 40, F.lit(".go:"), F.col("o_orderkey") % 900 + 1,
        F.lit("`\n- calls: [s-"), F.col("o_orderkey") + 1, F.lit(", ep-"), n, F.lit("]\n- branches:\n  - when: \"late\" → then: \"retry\" at: `src/g.go:"), F.col("o_orderkey") % 90, F.lit("`\n- invariant: "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("[INV-KEY-"), F.col("o_custkey"), F.lit("]"))).otherwise(F.lit("—")), F.lit("\n"),
    )
    orders = table(spark, sf, "orders").select(n.alias("n"), "o_orderkey", step.alias("step"))
    text = F.concat(F.lit("---\nflow: ep-"), "n", F.lit("\ncalled_by: [ep-"), (F.col("n") + 1) % 50, F.lit("]\n---\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "step"))), lambda x: x["step"]), ""))
    notes = orders.groupBy("n").agg(text.alias("text")).select(F.format_string("flows/%d.md", "n").alias("path"), "text")
    rules = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("### INV-KEY-"), "c_custkey", F.lit(" — key of "), "c_name", F.lit("\n- statement: holds\n- enforced_at:\n  - `src/k.go:1` `ep-"), F.col("c_custkey") % 50, F.lit(":s-"), "c_custkey", F.lit("`\n")).alias("text"))
    return notes, rules


@query(
    "s15_flow_corpus",
    """with s as (select 'ep-' || (o_custkey % 50) as flow, 's-' || o_orderkey as id, 'Sym' || (o_orderkey % 700) as symbol, 'src/f' || (o_orderkey % 40) || '.go' as file, o_orderkey % 900 + 1 as line, o_orderkey % 90 as g,
        case when o_orderkey % 3 = 0 then 'INV-KEY-' || o_custkey else '' end as inv, 's-' || (o_orderkey + 1) as next from orders)
    select 'step' as kind, flow as a, id as b, symbol || '@' || file || ':' || line || ' late>retry@src/g.go:' || g || ' ' || inv as c from s
    union all select 'edge', 'calls', flow || ':' || id, flow || ':' || next from s union all select 'edge', 'calls_flow', flow || ':' || id, flow from s
    union all select distinct 'edge', 'called_by', 'ep-' || (o_custkey % 50), 'ep-' || ((o_custkey % 50 + 1) % 50) from orders
    union all select 'edge', 'enforces', 'INV-KEY-' || c_custkey, 'ep-' || (c_custkey % 50) || ':s-' || c_custkey from customer
    union all select 'invariant', 'INV-KEY-' || c_custkey, 'KEY', 'key of ' || c_name from customer""",
)
def flow_corpus_(spark: SparkSession, sf: str) -> DataFrame:
    """Notes written from tables, and what is read from them again."""
    records = flow_corpus.corpus(*flow_files(spark, sf))
    branch = F.transform("branches", lambda b: F.concat(b["when"], F.lit(">"), b["then"], F.lit("@"), b["at"]))
    told = F.concat("symbol", F.lit("@"), "file", F.lit(":"), "line", F.lit(" "), F.array_join(branch, "|"), F.lit(" "), F.array_join("invariants", "|"))
    out = records["step"].select(F.lit("step").alias("kind"), F.col("flow").alias("a"), F.col("id").alias("b"), told.alias("c"))
    out = out.unionByName(records["edge"].select(F.lit("edge").alias("kind"), F.col("rel").alias("a"), F.col("from").alias("b"), F.col("to").alias("c")))
    return out.unionByName(records["invariant"].select(F.lit("invariant").alias("kind"), F.col("id").alias("a"), F.col("domain").alias("b"), F.col("title").alias("c")))


@query(
    "s24_gate",
    """with c as (select 'example.com/Brand#' || (length(text) % 25) || '/pkg' || (length(text) % 50) || '.Sym' || (length(text) % 37) as canonical_id from corpus),
    l as (select count(*) as n from (select src as id from edges union all select dst from edges) x where id not in (select id from nodes)), t as (select count(*) as n from (select id from nodes group by id having count(*) > 1) x),
    n as (select count(*) as n, sum(case when canonical_id in (select canonical_id from nodes) then 1 else 0 end) as known from c), p as (select count(distinct file_path) as n from nodes), q as (select count(distinct file_path) as n from nodes where start_line < 500)
    select 1 as place, 'valid' as check, l.n = 0 and t.n = 0 as ok, false as soft, t.n || ' repeated nodes, ' || l.n || ' loose ends' as detail from l, t
    union all select 2, 'aligned', false, false, 'digest mismatch' union all select 3, 'counts', n > 0, false, n || ' chunks' from n
    union all select 4, 'bridge', known >= 0.9 * n, false, cast(known as bigint) || ' of ' || n from n union all select 5, 'audit', p.n = q.n, true, (p.n - q.n) || ' files gone, 0 not indexed' from p, q""",
    ("corpus", "nodes", "edges"),
)
def gate_(spark: SparkSession, sf: str) -> DataFrame:
    nodes, n = view(spark, sf, "nodes"), F.length("text")
    chunks = view(spark, sf, "corpus").select(F.concat(F.lit("example.com/Brand#"), n % 25, F.lit("/pkg"), n % 50, F.lit(".Sym"), n % 37).alias("canonical_id"))
    one = lambda digest: spark.createDataFrame([("c0ffee", "1.19", digest)], "src_commit string, schema_version string, graph_digest string")
    return versions.gate(nodes, view(spark, sf, "edges"), chunks, one("d1"), one("d2"), nodes.where("start_line < 500").select(F.col("file_path").alias("path")))


_SCENARIO = "'s' || cast(c_custkey as varchar)"


@query(
    "p13_scenario_runs",
    f"""with s as (select c_custkey as k, {_SCENARIO} as name, 1 + c_custkey % 3 as runs, c_custkey % 4 = 0 as strict from customer), j as (select unnest(range(0, 3)) as j),
    r as (select s.*, run, (k + run) % 7 as fate, k * run % 100 as ms from (select *, unnest(range(1, runs + 1)) as run from s) s),
    a as (select distinct name, run, strict, 'f' || ((k + run * j) % 5) as f, k * j % 40 + 1 as x, k * j % 40 + 1 + j * 3 as y from r, j where fate > 1),
    e as (select distinct name, run, strict, 'f' || ((k + j) % 5) as f, k * j % 40 + 1 + k % 2 as x, k * j % 40 + 5 as y from r, j where fate > 1 and j < 2),
    m as (select a.name, a.run, a.f, a.x, a.y, e.x as ex, e.y as ey from a join e on a.name = e.name and a.run = e.run and a.f = e.f and case when a.strict then a.x = e.x and a.y = e.y else a.x <= e.y and e.x <= a.y end),
    p as (select r.name, r.run, ms, na, ne, coalesce(ha, 0) / na as precision, coalesce(he, 0) / ne as recall from r
        join (select name, run, count(*) as na from a group by all) using (name, run) join (select name, run, count(*) as ne from e group by all) using (name, run)
        left join (select name, run, count(distinct (f, x, y)) as ha, count(distinct (f, ex, ey)) as he from m group by all) using (name, run)),
    g as (select name, median(precision) as precision, median(recall) as recall, median(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end) as f1,
        quantile_disc(ms, 0.5) as latency_p50, max(ms) as latency_max, 3 as citation_count from p group by name),
    b as (select name, count(*) as failed, string_agg('run ' || run || case when fate = 0 then ': timeout' else ': decode text pack' end, '; ' order by run) as error from r where fate < 2 group by name)
    select s.name, s.runs, coalesce(b.failed, 0) as failed, coalesce(b.error, '') as error, round(g.precision, 6) as precision, round(g.recall, 6) as recall, round(g.f1, 6) as f1, g.latency_p50, g.latency_max, cast(g.citation_count as bigint) as citation_count
    from s left join g using (name) left join b using (name)""",
)
def scenario_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A scenario for each customer, put one to three times to a tool that answers in structure, as text, wrongly or not at all."""
    k = F.col("c_custkey")
    hit = lambda f, x, y: F.struct(F.concat(F.lit("f"), f).alias("file"), x.cast("int").alias("start_line"), y.cast("int").alias("end_line"))
    expected = F.array(*[hit((k + j) % 5, k * j % 40 + 1 + k % 2, k * j % 40 + 5) for j in (0, 1)])
    scenarios = table(spark, sf, "customer").select(F.concat(F.lit("s"), k).alias("name"), k.cast("string").alias("prompt"), F.when(k % 4 == 0, "strict").otherwise("overlap").alias("match_mode"), (1 + k % 3).cast("int").alias("runs"), expected.alias("expected_citations"))

    def tool(runs: DataFrame) -> DataFrame:
        n, run = F.col("prompt").cast("long"), F.substring_index("run_id", "#", -1).cast("long")
        pack = F.to_json(F.struct(F.array(*[hit((n + run * j) % 5, n * j % 40 + 1, n * j % 40 + 1 + j * 3) for j in (0, 1, 2)]).alias("citations")))
        fate = (n + run) % 7
        return runs.select("run_id", F.when(fate > 2, pack).alias("structured"), F.when(fate == 1, "not json").when(fate == 2, pack).alias("text"), F.when(fate == 0, "timeout").alias("error"), (n * run % 100).alias("latency_ms"))

    out = runner.run_scenarios(scenarios, tool)
    return rounded(out.select("name", "runs", "failed", "error", "precision", "recall", "f1", "latency_p50", "latency_max", "citation_count"), "precision", "recall", "f1")


@query("p4_p5_outcomes_and_traces")
def outcomes_and_traces(spark: SparkSession, sf: str) -> DataFrame:
    done = composition(spark, sf)
    traced = done.traces.select("prompt_id", "rounds", "vocab_expanded", F.size("steps").alias("n_steps"), F.size("final_seeds").alias("n_seeds"), F.size("failed_keywords").alias("n_failed"))
    return done.outcomes.join(traced, "prompt_id", "left")


@query(
    "f4_validity",
    """select l_orderkey, l_linenumber, l_suppkey > 3 and l_quantity > 5 and l_linenumber > 1 as hit, l_suppkey > 3 and l_quantity > 5 and l_partkey % 7 > 0 and l_partkey % 3 <> 1 and l_linenumber > 1 as neighbour,
    l_partkey % 3 <> 1 as intent, l_partkey % 7 > 0 and l_partkey % 5 > 0 and l_suppkey > 3 as trace from lineitem""",
)
def validity(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    file = F.when(s > 3, F.lit("a.go")).otherwise("")
    start = (F.col("l_quantity") - 5).cast("int")
    cite = lambda path: F.struct(path.alias("file"), start.alias("start_line"), (start + 2).alias("end_line"))
    relation = F.when(k % 3 == 0, "calls").when(k % 3 == 2, "tested_by").otherwise("knows")
    intent = F.when(k % 3 == 0, "bug_fix").when(k % 3 == 2, "").otherwise("guess")
    kinds = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(F.lit("recall"), F.lit("other"))).otherwise(F.array(F.lit("recall"), F.lit("keyword")))
    return l.select(
        "l_orderkey", "l_linenumber", T.hit_valid(file, start, start + 2, F.col("l_linenumber") - 1).alias("hit"),
        T.neighbour_valid(cite(file), cite(F.when(k % 7 == 0, "").otherwise("b.go")), relation, F.col("l_linenumber") - 1).alias("neighbour"), T.intent_valid(intent).alias("intent"), T.trace_valid(file, F.lit("composer"), kinds).alias("trace"),
    )


@query(
    "f9_filtered_vectors",
    """with c as (select vec_id as doc, embedding as b, doc_id % 3 <> 0 as pinned, source || '/d' || doc_id || '.go' as file, lang, doc_id % 2 as kind from embeddings join documents on doc_id = vec_id),
    q as (select vec_id as q, embedding as a from embeddings where vec_id % 20 = 0),
    s as (select q, doc, list_inner_product(a::double[], b::double[]) / (sqrt(list_inner_product(a::double[], a::double[])) * sqrt(list_inner_product(b::double[], b::double[]))) as score from q, c
        where pinned and lang = 'en' and kind = 1 and regexp_matches(file, '^[^/]*/d[^/]*[.]go$')),
    r as (select *, row_number() over (partition by q order by round(score, 9) desc, doc) as rank from s) select q as query_id, doc, rank, round(score, 6) as score from r where rank <= 10""",
)
def filtered_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 3 != 0, "c0ffee").otherwise("").alias("commit_hash"), F.concat("source", F.lit("/d"), "doc_id", F.lit(".go")).alias("file"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 1, "Function").otherwise("type").alias("symbol_kind"))
    chunks = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")).join(d, "doc")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = search.filtered_knn(asked, chunks, "en", "*/d*.go", "c0ffee", ("function",))
    return rounded(found.select("query_id", "doc", F.col("rank").cast("long").alias("rank"), "score"), "score")


@query(
    "s26_files_in_scope",
    "select distinct file_path as path from nodes where (file_path like 'src/pkg1/%' or file_path like 'src/pkg2/%' or file_path like 'src/pkg30/%') and file_path not like 'src/pkg2/%' and file_path <> 'src/pkg1/f7.go'",
    ("nodes",),
)
def files_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "nodes").select(F.col("file_path").alias("path"))
    return inventory.in_scope(files, ("src/pkg1", "src/pkg2/", "src/pkg30"), ("src/pkg2", "src/pkg1/f7.go"))
