"""Evaluation runs: each scenario is put to a tool several times, every run is a row, whatever it ends in.

A tool takes runs (run_id, prompt) and gives a row for each: what it returned as a structured payload
or as text, an error, and how long it took. A run that fails, or whose payload can't be read, is a row with
an error and counts in no metric.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.evaluation.metrics import folded_runs, retrieval_quality
from trovespark.sources.scratch import kept

#: (run_id, prompt) to (run_id, structured string, text string, error string, latency_ms long); payloads are JSON.
Tool = Callable[[DataFrame], DataFrame]
CITATIONS = "array<struct<file:string,start_line:int,end_line:int>>"


def runs_of(scenarios: DataFrame) -> DataFrame:
    """(run_id, name, run, prompt, match_mode): each scenario's runs, 1 at least."""
    runs = F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("runs", F.lit(1)), F.lit(1)))).alias("run")
    return scenarios.select("name", "prompt", F.coalesce("match_mode", F.lit("overlap")).alias("match_mode"), runs).withColumn("run_id", F.concat_ws("#", "name", "run"))


def decoded(answers: DataFrame) -> DataFrame:
    """answers with pack (a variant: the structured payload, else the text as JSON) and error (the tool's, or why there is no pack)."""
    structured, text = F.col("structured"), F.coalesce("text", F.lit(""))
    given = F.coalesce(structured, text)
    pack = F.try_parse_json(F.when(given != "", given))
    told = F.coalesce("error", F.lit(""))
    wrong = F.when(told != "", told).when(given == "", "decode: empty tool result").when(pack.isNull() | (F.schema_of_variant(pack).substr(1, 6) != "OBJECT"), F.when(structured.isNotNull(), "decode structured pack").otherwise("decode text pack"))
    return answers.withColumns({"pack": F.when(wrong.isNull(), pack), "error": F.coalesce(wrong, F.lit(""))})


def run_scenarios(scenarios: DataFrame, tool: Tool) -> DataFrame:
    """One row for each of scenarios (name, prompt, match_mode, runs, expected_citations): runs, failed, error (each failed run's, in order), and the medians and percentiles of those that didn't fail, null if all did.

    A scenario's mode is overlap or strict. A tool that leaves a run out has failed it.
    """
    runs = kept(runs_of(scenarios), "runs")
    answers = runs.select("run_id", "name", "run", "match_mode").join(tool(runs.select("run_id", "prompt")), "run_id", "left")
    answers = answers.withColumn("error", F.when(F.col("structured").isNull() & F.col("text").isNull() & F.col("error").isNull(), "no result").otherwise(F.col("error")))
    got = kept(decoded(answers), "answers")
    good = got.where("error = ''")
    cited = F.variant_get("pack", "$.citations", CITATIONS)
    size = lambda path: F.coalesce(F.size(F.variant_get("pack", path, "array<variant>")), F.lit(0))
    told = good.select("run_id", "name", "match_mode", cited.alias("citations"), F.coalesce(F.variant_get("pack", "$.metadata.utilization_ratio", "double"), F.lit(0.0)).alias("token_utilization"), size("$.bodies").alias("body_count"), size("$.sanitize_report").alias("redaction_count"), F.col("latency_ms"))
    told = kept(told, "told")
    wanted = good.select("run_id", "name", "match_mode").join(scenarios.select("name", F.explode("expected_citations").alias("c")), "name").select("run_id", "match_mode", "c.*")
    found = told.select("run_id", "match_mode", F.explode("citations").alias("c")).select("run_id", "match_mode", "c.*")
    scored = None
    for strict in (False, True):
        of = lambda df, s=strict: df.where((F.col("match_mode") == "strict") == s)
        one = retrieval_quality(of(wanted), of(found), "run_id", strict)
        scored = one if scored is None else scored.unionByName(one)
    rows = told.join(scored.select("run_id", "precision", "recall", "f1"), "run_id", "left")
    rows = rows.fillna(1.0, ["precision", "recall", "f1"])  # nothing expected and nothing found
    rows = rows.withColumns({"citation_count": F.coalesce(F.size("citations"), F.lit(0)), "error": F.lit("")})
    folded = folded_runs(rows, "name", ("precision", "recall", "f1", "token_utilization")).withColumnRenamed("runs", "survived")
    counts = rows.groupBy("name").agg(*[F.floor(F.median(c)).cast("long").alias(c) for c in ("body_count", "redaction_count")])
    bad = got.where("error <> ''").groupBy("name").agg(F.count("*").alias("failed"), F.array_sort(F.collect_list(F.struct("run", F.format_string("run %d: %s", "run", "error").alias("e")))).alias("e"))  # of one scenario
    all_ = scenarios.select("name", F.greatest(F.coalesce("runs", F.lit(1)), F.lit(1)).alias("runs"))
    out = all_.join(folded, "name", "left").join(counts, "name", "left").join(bad, "name", "left")
    return out.withColumns({"failed": F.coalesce("failed", F.lit(0)), "error": F.coalesce(F.array_join(F.transform("e", lambda x: x["e"]), "; "), F.lit(""))}).drop("e", "survived")
