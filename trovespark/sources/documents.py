"""Hand-written documents: YAML or JSON files of rules, glossaries, projects and scenarios, and the documents rewritten from tables.

Their number is bounded by what people write, so the parsing is the driver's; what they describe
becomes DataFrames. JSON needs nothing; YAML needs PyYAML.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovespark.operators.sanitize import Rule, checked_rules
from trovespark.sources.readers import ENTRY, SCENARIO

SUBSYSTEM = "id string, name string"
PROJECT = "id string, name string, code_root string"


def parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def table_of(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    lines = spark.createDataFrame([(json.dumps(r, default=str),) for r in records], "value string")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def rules(text: str) -> list[Rule]:
    """A rule file: version 1, and rules of id, pattern, action and severity. What doesn't hold is an error."""
    found = parsed(text)
    if not isinstance(found, dict) or set(found) - {"version", "rules"}:
        raise ValueError("a rule file has a version and rules")
    if found.get("version") != 1:
        raise ValueError(f"rule file of version {found.get('version')}, not 1")
    return checked_rules(found.get("rules") or [])


def glossary(text: str) -> list[tuple[list[str], list[str]]]:
    """Aliases and code keywords of each glossary entry, for expand(); entries without either are left out."""
    found = parsed(text) or {}
    entries = found.get("entries", []) if isinstance(found, dict) else found
    tidy = lambda e, k: [x for x in dict.fromkeys(e.get(k) or []) if x.strip()]
    return [(a, k) for e in entries if (a := tidy(e, "aliases")) and (k := tidy(e, "code_keywords"))]


def project(spark: SparkSession, project_text: str, subsystems_text: str, entry_texts: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """project, subsystems and entries (with their file), entries in order of file names; an id that two files claim is an error."""
    named = [parsed(entry_texts[f]) | {"file_name": f} for f in sorted(entry_texts)]
    twice = sorted(i for i, n in Counter(e.get("id") for e in named).items() if n > 1)
    if twice:
        raise ValueError(f"entries that share an id: {', '.join(map(str, twice))}")
    subsystems = parsed(subsystems_text)
    subsystems = subsystems.get("subsystems", []) if isinstance(subsystems, dict) else subsystems
    return table_of(spark, [parsed(project_text)], PROJECT), table_of(spark, subsystems, SUBSYSTEM), table_of(spark, named, f"file_name string, {ENTRY}")


def scenarios(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Scenarios of .yaml, .yml and .json files, in order of their names."""
    return table_of(spark, [parsed(texts[f]) for f in sorted(texts) if f.endswith((".yaml", ".yml", ".json"))], SCENARIO)


def as_yaml(lists: dict[str, str | Column]) -> Column:
    """A YAML mapping from keys to arrays of strings, in the order given; strings are quoted as JSON, which YAML reads."""
    item = lambda x: F.concat(F.lit('- "'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"\n'))
    values = {k: F.col(v) if isinstance(v, str) else v for k, v in lists.items()}
    return F.concat(*[F.concat(F.lit(f"{k}:"), F.when(F.size(v) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(v, item), ""))).otherwise(F.lit(" []\n"))) for k, v in values.items()])


def marked_verified(text: Column, date: str, reviewer: str) -> Column:
    """An entry's YAML text verified at date by reviewer: the values of three top-level keys are replaced, all else stays byte for byte. A missing key is an error."""
    out = text
    for key, value in (("status", "verified"), ("last_verified_at", f'"{date}"'), ("reviewer", reviewer)):
        line = rf"(?m)^{key}:.*$"
        missing = F.raise_error(F.lit(f"no key {key}")).cast("string")
        out = F.when(out.rlike(line), F.regexp_replace(out, line, f"{key}: {value}".replace("$", r"\$"))).otherwise(missing)
    return out


def with_sections(text: Column, sections: dict[str, Column]) -> Column:
    """Markdown text whose sections of these ## titles have new bodies; what stands before, between and behind them stays as it is, and titles it lacks are not added."""
    out = text
    for title, body in sections.items():
        before = F.regexp_extract(out, rf"(?s)^(.*?(?:^|\n)## {title}\n)", 1)
        behind = F.substring(out, F.char_length(before) + 1, F.lit(1 << 30))
        rest = F.regexp_extract(behind, r"(?s)((?:^|\n)## .*)$", 1)
        out = F.when(before == "", out).otherwise(F.concat(before, F.lit("\n"), body, F.lit("\n"), rest))
    return out


def version_label(path: Column) -> Column:
    """The version in a path's @<version> segment; empty if it has none."""
    return F.regexp_extract(path, "(?:^|/)@([^/]+)", 1)


def cited_nodes(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """nodes with the citation they project to, at the commit of their snapshot's one-row manifest."""
    at = manifest.select(F.col("src_commit").alias("commit_hash")).limit(1)
    return nodes.join(F.broadcast(at), how="left").withColumn("citation", F.struct(F.col("file_path").alias("file"), "start_line", "end_line", "commit_hash")).drop("commit_hash")
