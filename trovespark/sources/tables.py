"""The local tables in the shapes the operators take, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EDGE_TYPES = ("calls", "invokes", "implements", "extends", "imports", "references", "defines", "spawns", "sends_to", "recvs_from", "acquires_lock", "accessed_under_lock", "publishes", "contains")
_TYPE_OF = " ".join(f"when {i} then '{t}'" for i, t in enumerate(EDGE_TYPES))

VIEWS = {
    "nodes": """select 'n' || cast(p_partkey as string) as id,
        case p_partkey % 5 when 0 then 'function' when 1 then 'method' when 2 then 'type' when 3 then 'interface' else 'const' end as type,
        'Sym' || cast(p_partkey % 37 as string) as name,
        'pkg' || cast(p_size as string) || '.Sym' || cast(p_partkey % 37 as string) || case when p_partkey % 5 = 1 then '.M' || cast(p_partkey % 7 as string) else '' end as qualified_name,
        'example.com/' || p_brand || '/pkg' || cast(p_size as string) || '.Sym' || cast(p_partkey % 37 as string) as canonical_id,
        'src/pkg' || cast(p_size as string) || '/f' || cast(p_partkey % 40 as string) || case when p_partkey % 9 = 0 then '_test.go' else '.go' end as file_path,
        cast(1 + (p_partkey % 100) * 10 as int) as start_line, cast(6 + (p_partkey % 100) * 10 + p_partkey % 20 as int) as end_line, 'go' as language
        from {part}""",
    "edges": f"""select src, dst, type, cast(count(*) as int) as count from (
        select 'n' || cast(l_partkey as string) as src, 'n' || cast(l_partkey + l_suppkey * 13 + l_linenumber as string) as dst,
        case (l_orderkey + l_linenumber) % {len(EDGE_TYPES)} {_TYPE_OF} end as type from {{lineitem}}) x group by src, dst, type""",
    "seeds": "select 's' || cast(s_suppkey as string) as seed, 'n' || cast(s_suppkey * 7 as string) as node from {supplier}",
    "corpus": """select cast(doc_id as string) as doc, source || '/d' || cast(doc_id as string) || case when doc_id % 9 = 0 then '_test.go' else '.go' end as file,
        1 as start_line, cast(length(text) - length(replace(text, chr(10), '')) + 1 as int) as end_line, case when doc_id % 3 = 0 then '' else 'c0ffee' end as commit_hash,
        'Sym' || cast(doc_id % 700 as string) as symbol, case doc_id % 5 when 0 then 'function' when 1 then 'method' when 2 then 'invariant' when 3 then 'convention' else 'doc' end as chunk_kind,
        lang as language, text from {documents}""",
    "doc_edges": f"""select cast(doc_id as string) as src, cast(doc_id * 13 % 991 as string) as dst, case doc_id % {len(EDGE_TYPES)} {_TYPE_OF} end as type from {{documents}}
        union all select cast(doc_id as string), cast(doc_id * 7 % 199 as string), case doc_id % 3 when 0 then 'calls' when 1 then 'references' else 'implements' end from {{documents}}""",
    "prompts": "select cast(item_id as string) as query_id, text from {benchmark}",
    "citations": """select cast(l_orderkey as string) as scenario, 'src/f' || cast(l_suppkey as string) || '.go' as file, cast(l_quantity as int) as start_line,
        cast(l_quantity as int) + l_linenumber * 3 as end_line, l_returnflag as flag, l_partkey from {lineitem}""",
    "runs": """select cast(user_id as string) as scenario, event_id as run, case event_type when 'error' then '' else event_type end as intent, value / 500 as precision,
        (value % 100) / 100 as recall, (value % 10) / 10 as f1, cast(floor(value * 10) as bigint) as latency_ms, cast(event_id % 17 as int) as citation_count,
        case when event_id % 23 = 0 then 'timeout' else '' end as error from {events}""",
    "steps": """select flow, step, calls from (select 'f' || cast(o_custkey % 50 as string) as flow, 't' || cast(o_orderkey as string) as step,
        o_orderkey, 't' || cast(o_orderkey * 2 + 1 as string) as a, 't' || cast(o_orderkey * 2 + 2 as string) as b from {orders}) x""",
    "entries": """select case when c_custkey % 97 = 0 then 'bad id' else 'A' || cast(c_custkey as string) || '.core' end as id, 'nation' || cast(c_nationkey + case when c_custkey % 50 = 0 then 100 else 0 end as string) as subsystem,
        'B' || cast(c_custkey % 8 + 1 as string) as knowledge_type, case when c_custkey % 31 = 0 then '' else c_name end as title, c_name || ' in ' || c_mktsegment as summary,
        case c_mktsegment when 'BUILDING' then 'verified' when 'AUTOMOBILE' then 'needs_verification' when 'MACHINERY' then 'draft' when 'HOUSEHOLD' then 'deprecated' else 'unknown' end as status,
        case c_custkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'urgent' end as priority, case when c_custkey % 3 = 0 then '2026-01-05' else 'soon' end as last_verified_at,
        'A' || cast(c_custkey + 1 as string) || '.core' as other, 'src/pkg' || cast(c_custkey % 60 as string) || '/f' || cast(c_custkey % 40 as string) || '.go' as file,
        case when c_custkey % 5 = 0 then 'pkg' || cast(c_custkey % 60 as string) || '.' else '' end || 'Sym' || cast(c_custkey % 40 as string) as symbol,
        cast(1 + (c_custkey % 100) * 10 + c_custkey % 19 as int) as line, 'keep ' || lower(c_mktsegment) as pitfall, c_mktsegment, c_custkey from {customer}""",
    "subsystems": "select 'nation' || cast(n_nationkey as string) as id, n_name as name from {nation}",
    "audit": "select cast(user_id as string) as trace_id, event_id as seq, event_type || ':' || cast(cast(floor(value * 100) as bigint) as string) as body from {events}",
    "answers": """select case l_linenumber % 4 when 0 then 'alpha' when 1 then 'beta' when 2 then 'gamma' else 'delta' end as mode, l_returnflag as difficulty, l_linestatus as domain,
        cast(case when l_quantity > 25 then 1 else 0 end as int) as located, cast(case when l_discount > 0.04 then 1 else 0 end as int) as correct, cast(l_linenumber % 3 as bigint) as fabricated,
        l_discount as recall, l_tax as precision, cast(l_quantity as bigint) as rel_total, cast(floor(l_quantity / 2) as bigint) as rel_hit, cast(l_suppkey + 1 as bigint) as dir_total,
        cast(floor(l_suppkey / 3) as bigint) as dir_hit, l_partkey as context_tokens from {lineitem}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the tables it names are opened."""
    sql = VIEWS[name]
    if name == "steps":
        sql = sql.replace("calls from", "array(a, b) as calls from", 1)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def view_sql(name: str) -> str:
    """The same view for DuckDB, whose tables go by their names."""
    sql = VIEWS[name]
    if name == "steps":
        sql = sql.replace("calls from", "[a, b] as calls from", 1)
    return sql.format(**{t: t for t in TABLES})
