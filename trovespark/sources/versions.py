"""Versions of a dataset: a gate of checks over what was written, and promotion by a commit that one writer wins.

Readers follow the last commit, which names a whole version; versions stay, so an older one can be promoted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovespark.functions.text import alignment_errors
from trovespark.sources.commits import commit, commits

#: Share of hits whose canonical name the graph knows.
LEAST_BRIDGE = 0.9


class GateFailed(ValueError):
    """A check of the gate failed."""


def gate(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, graph: DataFrame, vector: DataFrame, sources: DataFrame | None = None, live: bool = True) -> DataFrame:
    """(place, check, ok, soft, detail): the five checks of a version as rows.

    valid: node ids are unique and edges end at nodes. aligned: the manifests (one row each) are of one
    commit and digest, the schema is new enough. counts: there are chunks, as many as the vector manifest's chunk_count says, if it has one.
    bridge: of chunks that name a canonical id, LEAST_BRIDGE or more are nodes' (left out unless live). audit: the graph's
    files and those of sources (path) are the same; soft, as it only warns.
    """
    ids = nodes.select("id")
    twice = ids.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids.distinct(), "id", "left_anti").agg(F.count("*").alias("n"))

    def check(df: DataFrame, place: int, name: str, ok: Column, detail: Column, soft: bool = False) -> DataFrame:
        return df.select(F.lit(place).alias("place"), F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(soft).alias("soft"), detail.alias("detail"))

    both = twice.withColumnRenamed("n", "twice").join(ends.withColumnRenamed("n", "loose"))
    valid = check(both, 1, "valid", (F.col("twice") == 0) & (F.col("loose") == 0), F.format_string("%d repeated nodes, %d loose ends", "twice", "loose"))
    g = graph.select(*[F.col(c).alias(f"g_{c}") for c in ("src_commit", "schema_version", "graph_digest")])
    counted = F.col("chunk_count").cast("long") if "chunk_count" in vector.columns else F.lit(None).cast("long")
    v = vector.select(*[F.col(c).alias(f"v_{c}") for c in ("src_commit", "graph_digest")], counted.alias("told"))
    given = lambda c: F.nullif(F.col(c), F.lit(""))  # noqa: E731  what a manifest leaves out isn't compared
    errors = alignment_errors(given("g_src_commit"), given("v_src_commit"), F.coalesce("g_schema_version", F.lit("")), given("g_graph_digest"), given("v_graph_digest"))
    aligned = check(g.join(v), 2, "aligned", F.size(errors) == 0, F.array_join(errors, "; "))
    n = chunks.agg(F.count("*").alias("n"), F.count_if(F.coalesce("canonical_id", F.lit("")) != "").alias("named"))
    counts = check(n.join(v), 3, "counts", (F.col("n") > 0) & (F.coalesce("told", "n") == F.col("n")), F.format_string("%d chunks", "n"))
    known = chunks.join(nodes.select("canonical_id").where("canonical_id <> ''").distinct(), "canonical_id", "left_semi").agg(F.count("*").alias("known"))
    bridge = check(n.join(known), 4, "bridge", F.col("known") >= LEAST_BRIDGE * F.col("named"), F.format_string("%d of %d", "known", "named"))
    out = valid.unionByName(aligned).unionByName(counts)
    out = out.unionByName(bridge) if live else out
    if sources is not None:
        have, are = nodes.select(F.col("file_path").alias("path")).distinct(), sources.select("path").distinct()
        odd = have.join(are, "path", "left_anti").agg(F.count("*").alias("gone")).join(are.join(have, "path", "left_anti").agg(F.count("*").alias("new")))
        out = out.unionByName(check(odd, 5, "audit", (F.col("gone") == 0) & (F.col("new") == 0), F.format_string("%d files gone, %d not indexed", "gone", "new"), True))
    return out


def promote(spark: SparkSession, root: str, label: str, checked: DataFrame) -> list[str]:
    """Makes a version current if no hard check of gate() failed, and returns what the soft ones warn of. Another writer's promotion meanwhile raises Conflict."""
    number = len(commits(spark, root)) + 1
    rows = sorted(checked.where("not ok").collect(), key=lambda r: r["place"])  # five at most
    if hard := [f"{r['check']} ({r['detail']})" for r in rows if not r["soft"]]:
        raise GateFailed(f"{label}: {'; '.join(hard)}")
    commit(spark, root, number, {"version": label})
    return [f"{r['check']}: {r['detail']}" for r in rows]


def current(spark: SparkSession, root: str) -> str | None:
    """The label of the version that readers open."""
    log = commits(spark, root)
    return log[-1]["version"] if log else None


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version."""
    label = current(spark, root)
    if label is None:
        raise ValueError(f"{root} has no current version")
    return spark.read.parquet(f"{root}/version={label}/{table}")
