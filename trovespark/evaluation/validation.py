"""Rules that scenarios and intent anchors must keep: one pass, a row for each broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.functions.text import INTENTS, citation_valid

MATCH_MODES = ("overlap", "strict")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _broken(df: DataFrame, key: list[str], rules: list[tuple[Column, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(message)) for broken, message in rules]))
    return df.select(*key, F.explode(found).alias("message"))


def scenario_issues(scenarios: DataFrame) -> DataFrame:
    """(name, message) of scenarios (name, prompt, intent, match_mode, runs, expected_citations); an empty intent stands for none."""
    cited = F.forall("expected_citations", lambda c: citation_valid(c["file"], c["start_line"], c["end_line"]))
    rules = [
        (_blank("name"), "name is missing"),
        (_blank("prompt"), "prompt is missing"),
        (~F.col("match_mode").isin(*MATCH_MODES), "match mode unknown"),
        (~F.col("intent").isin(*INTENTS), "intent unknown"),
        (F.col("runs") < 1, "no runs"),
        (~cited, "citation invalid"),
    ]
    return _broken(scenarios, ["name"], rules)


def anchor_issues(anchors: DataFrame) -> DataFrame:
    """(intent, message) of an anchor map (intent, texts)."""
    rules = [
        (~F.col("intent").isin(*INTENTS), "intent unknown"),
        (F.size("texts") < 1, "no anchors"),
        (F.exists("texts", lambda t: F.trim(t) == ""), "anchor is blank"),
    ]
    return _broken(anchors, ["intent"], rules)


def counts_by_severity(issues: DataFrame) -> DataFrame:
    """(severity, n) of issues."""
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def has_errors(issues: DataFrame) -> bool:
    return not issues.where("severity = 'error'").isEmpty()
