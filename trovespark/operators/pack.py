"""Evidence packs: assembly, validity, integrity hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.functions.text import citation_key
from trovespark.operators.ordered import columns, folded

EDGE_ONLY = 16


EDGES = columns(prompt_id="string", pos="long", source="string", target="string", relation="string", distance="integer")


class Admission:
    """The keys known to one prompt; call it with its cited keys, then with its edges in order."""

    def __init__(self, most: int = EDGE_ONLY) -> None:
        self.seen, self.left = set(), most

    def __call__(self, r: dict) -> dict | None:
        """An edge whose source is known; the first targets that aren't become known, and so may be later edges' sources."""
        if r["key"] is not None:
            self.seen.add(r["key"])
            return None
        if r["source"] not in self.seen:
            return None
        if r["target"] not in self.seen:
            if not self.left:
                return None
            self.seen.add(r["target"])
            self.left -= 1
        return r


def admit(rows: list[dict], known: set[str], most: int = EDGE_ONLY) -> list[dict]:
    """Edges, in order, that an Admission lets pass."""
    step = Admission(most)
    for k in known:
        step({"key": k})
    return [r for r in rows if step(r | {"key": None})]


def admitted_edges(edges: DataFrame, cited: DataFrame, most: int = EDGE_ONLY) -> DataFrame:
    """admit() for each prompt: edges (prompt_id, pos, source, target, relation, distance), cited (prompt_id, key); a prompt's keys are streamed before its edges."""
    names = EDGES.fieldNames()
    left = edges.select(F.col("prompt_id").cast("string").alias("prompt_id"), F.col("pos").cast("long").alias("pos"), *names[2:]).withColumn("key", F.lit(None).cast("string"))
    right = cited.select(F.col("prompt_id").cast("string").alias("prompt_id"), "key").distinct()
    both = left.unionByName(right, allowMissingColumns=True)
    return folded(both, "prompt_id", [F.asc_nulls_last("key"), F.asc("pos"), F.asc("source"), F.asc("target"), F.asc("relation")], lambda: Admission(most), EDGES)


def assemble(prompts: DataFrame, bodies: DataFrame, edges: DataFrame, usable: int) -> DataFrame:
    """One row for each prompt (prompt_id, intent, query): citations, bodies, edges, metadata and their hash. A prompt with an aborted body gives no pack."""
    refused = bodies.where("aborted").select("prompt_id").distinct()
    kept = bodies.join(refused, "prompt_id", "left_anti").where("text <> ''").withColumn("tokens", F.floor(F.char_length("text") / 4).cast("int"))
    keyed = kept.withColumn("key", citation_key(F.col("file"), F.col("start_line"), F.col("end_line")))
    body = F.struct("pos", "key", "text", "tokens", "degraded")
    packed = keyed.groupBy("prompt_id").agg(F.array_sort(F.collect_list(body)).alias("bodies"), F.sum("tokens").alias("used_tokens"))
    linked = admitted_edges(edges, keyed.select("prompt_id", "key")).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target", "relation", "distance"))).alias("edges"))
    out = prompts.join(refused, "prompt_id", "left_anti").join(packed, "prompt_id", "left").join(linked, "prompt_id", "left")
    out = out.withColumn("citations", F.transform("bodies", lambda b: b["key"])).withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    out = out.withColumn("utilization", F.col("used_tokens") / F.lit(float(usable)))
    return stamped(out, ["intent", "query", "citations", "bodies", "edges", "used_tokens"])


def canonical(columns: list[str]):  # noqa: ANN201
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def stamped(packs: DataFrame, columns: list[str]) -> DataFrame:
    """With the SHA-256 of the columns as JSON, fields in the order given."""
    return packs.withColumn("integrity_hash", F.sha2(canonical(columns), 256)).withColumn("hash_algorithm", F.lit("sha256"))


def verified(packs: DataFrame, columns: list[str]) -> DataFrame:
    """With a status: ok, mismatch, missing hash or unknown algorithm (none means SHA-256)."""
    same = F.sha2(canonical(columns), 256) == F.col("integrity_hash")
    algo = F.coalesce(F.col("hash_algorithm"), F.lit(""))
    status = F.when(F.coalesce(F.col("integrity_hash"), F.lit("")) == "", "missing").when(~algo.isin("", "sha256"), "unknown_algorithm").when(same, "ok").otherwise("mismatch")
    return packs.withColumn("status", status)
