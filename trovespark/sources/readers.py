"""Readers and writers: index tables, manifests, flow notes, scenarios, event logs, versioned datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovespark.functions.text import alignment_errors, line_slice
from trovespark.operators.audit import append

LEVELS = ("debug", "info", "warn", "error")

NODE = "id string, type string, name string, qualified_name string, canonical_id string, file_path string, start_line int, end_line int, language string"
EDGE = "src string, dst string, type string, count int"
CHUNK = "chunk_id string, file string, start_line int, end_line int, commit_hash string, language string, symbol string, symbol_kind string, chunk_kind string, canonical_id string, text string, vec array<float>"
MANIFEST = "schema_version string, version string, build_timestamp string, src_root string, src_commit string, graph_digest string"
ENTRY = (
    "id string, subsystem string, knowledge_type string, title string, summary string, status string, priority string, last_verified_at string, related array<string>, pitfalls array<string>, "
    "aliases_local array<string>, aliases_en array<string>, keywords array<string>, anchors array<struct<file:string,symbol:string,line:int,kind:string>>"
)
SCENARIO = "name string, prompt string, intent string, match_mode string, runs int, expected_citations array<struct<file:string,start_line:int,end_line:int,commit_hash:string>>"
EVENT = "ts timestamp, level string, event string, trace_id string, run_id string, dry_run boolean, fields map<string,string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's one row; an error if it isn't there."""
    df = spark.read.schema(MANIFEST).json(f"{path}/manifest.json")
    if df.count() != 1:
        raise ValueError(f"{path} has no manifest")
    return df


def graph_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and manifest of a graph snapshot."""
    pinned = manifest(spark, path)
    return spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.schema(EDGE).parquet(f"{path}/edges"), pinned


def vector_index(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """Chunks whose vectors have the embedder's dimensions; reading any other fails."""
    if not path:
        raise ValueError("a vector index needs a path")
    chunks = spark.read.schema(CHUNK).parquet(path)
    return chunks.withColumn("vec", F.when(F.size("vec") == dimensions, F.col("vec")).otherwise(F.raise_error(F.format_string("vector of %d dimensions", F.size("vec"))).cast("array<float>")))


def source_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path, text, n_lines) of all files under the roots; of a path in several roots the first root's."""
    parts = [spark.read.option("recursiveFileLookup", "true").text(r, wholetext=True).select(F.lit(i).alias("root"), F.expr(f"replace(substring_index(_metadata.file_path, '{r.rstrip('/')}/', -1), '%20', ' ')").alias("path"), F.col("value").alias("text")) for i, r in enumerate(roots)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy("path").agg(F.min("root").alias("root"))
    return out.join(best, ["path", "root"]).withColumn("n_lines", F.size(F.split("text", "\n")))


def yaml_entries(spark: SparkSession, texts: dict[str, str], schema: str = ENTRY) -> DataFrame:
    """Entries from YAML or JSON documents by file name, in order of their names. JSON needs nothing; YAML needs PyYAML."""
    rows = []
    for name in sorted(texts):
        try:
            rows.append(json.loads(texts[name]))
        except ValueError:
            import yaml

            rows.append(yaml.safe_load(texts[name]))
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def flow_notes(files: DataFrame) -> DataFrame:
    """Steps of flows from Markdown notes (path, text): a front matter with flow_id, then blocks '### STEP id' with '- key: value' lines.

    (flow, pos, step, symbol, calls array, invariants array, branches array of when/then)."""
    flow = F.regexp_extract("text", r"(?m)^flow_id:\s*(\S+)", 1)
    cut = F.split("text", r"(?m)^### STEP ")
    blocks = F.slice(cut, 2, F.size(cut))
    steps = files.select(flow.alias("flow"), F.posexplode(blocks).alias("pos", "block"))
    value = lambda key: F.trim(F.regexp_extract("block", rf"(?m)^- {key}:(.*)$", 1))
    many = lambda key: F.filter(F.split(value(key), r"\s*,\s*"), lambda x: x != "")
    branch = F.regexp_extract_all("block", F.lit(r"(?m)^- when (.*?) -> (.*)$"), F.lit(0))
    return steps.select(
        "flow",
        "pos",
        F.trim(F.regexp_extract("block", r"^([^\n]*)", 1)).alias("step"),
        value("symbol").alias("symbol"),
        many("calls").alias("calls"),
        many("invariants").alias("invariants"),
        F.transform(branch, lambda b: F.struct(F.regexp_extract(b, r"^- when (.*?) -> ", 1).alias("when"), F.regexp_extract(b, r" -> (.*)$", 1).alias("then"))).alias("branches"),
    )


def tagged_records(spark: SparkSession, path: str, schema: str) -> dict[str, DataFrame]:
    """A JSON-lines corpus split on its type field."""
    rows = spark.read.schema(f"type string, {schema}").json(path)
    return {t: rows.where(F.col("type") == t).drop("type") for t in ("flow", "step", "invariant", "edge")}


def append_events(events: DataFrame, path: str) -> None:
    """Log lines as JSON; an event without a name is refused."""
    if not events.where(F.coalesce(F.col("event"), F.lit("")) == "").isEmpty():
        raise ValueError("an event needs a name")
    events.write.mode("append").json(path)


def record_events(events: DataFrame, log: str, audit: str, chain: str = "trace_id", least: str = "info") -> str:
    """Events of level least or more to the event log, then to the audit log (audit.read_log), whose chains go on from batch to batch; the event log stays written if the audit fails, and what failed is returned (blank: nothing)."""
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower("level"))
    rows = events.where(level >= LEVELS.index(least) + 1)
    append_events(rows, log)
    try:
        append(rows, audit, chain, [F.col("ts"), F.col("event"), F.to_json("fields")], F.to_json(F.struct("ts", "event", "fields")))
    except Exception as e:  # noqa: BLE001  whatever the audit's store raises
        return str(e).split("\n")[0] or type(e).__name__
    return ""


def report(df: DataFrame, most: int = 10_000) -> str:
    """A bounded report as indented JSON and a line end; more rows than most are an error."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([json.loads(r) for r in rows], indent=2) + "\n"


def publish(df: DataFrame, root: str, commit: str, digest: str) -> str:
    """Writes a version and returns its label; promote() makes it current."""
    label = f"{commit[:8]}-{digest[:8]}"
    df.write.mode("overwrite").parquet(f"{root}/version={label}")
    return label


def promote(spark: SparkSession, root: str, label: str, checks: dict[str, bool]) -> None:
    """Points current at a version if every check holds. Labels are appended, each in a file that appears whole, so readers see the one before or this one."""
    failed = sorted(k for k, ok in checks.items() if not ok)
    if failed:
        raise ValueError(f"not promoted: {', '.join(failed)}")
    spark.createDataFrame([(label,)], "version string").withColumn("at", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").json(f"{root}/current")


def current(spark: SparkSession, root: str) -> DataFrame:
    last = spark.read.schema("version string, at long").json(f"{root}/current").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{root}/version={last['version']}")


def changed_files(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified between two tables of (path, hash)."""
    both = indexed.select("path", F.col("hash").alias("was")).join(now.select("path", F.col("hash").alias("is")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def aligned(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """One row (ok, errors): whether two snapshots' manifests belong together."""
    g, v = graph.select(*[F.col(c).alias(f"g_{c}") for c in ("src_commit", "schema_version", "graph_digest")]), vector.select(*[F.col(c).alias(f"v_{c}") for c in ("src_commit", "graph_digest")])
    errors = alignment_errors(*[F.col(c) for c in ("g_src_commit", "v_src_commit", "g_schema_version", "g_graph_digest", "v_graph_digest")])
    return g.join(F.broadcast(v), how="inner").select((F.size(errors) == 0).alias("ok"), errors.alias("errors"))  # one row each


def cited_bodies(citations: DataFrame, files: DataFrame) -> DataFrame:
    """citations with the lines they cite as text, from files (path, text); empty if the file is missing or the path leaves its root."""
    inside = ~F.concat(F.lit("/"), F.col("file"), F.lit("/")).contains("/../")
    joined = citations.join(files.select(F.col("path").alias("file"), F.col("text").alias("_all")), "file", "left")
    text = F.when(inside & F.col("_all").isNotNull(), line_slice(F.col("_all"), F.col("start_line"), F.col("end_line"))).otherwise(F.lit(""))
    return joined.withColumn("text", text).drop("_all")
