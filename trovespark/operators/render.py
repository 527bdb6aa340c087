"""Evidence packs as Markdown, one text for each row, and worksheets of entries that wait for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.functions.text import citation_string

#: Code fences by file extension.
FENCES = {
    "go": "go",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "sol": "solidity",
    "rs": "rust",
    "java": "java",
    "kt": "kotlin",
    "rb": "ruby",
    "sh": "bash",
    "yaml": "yaml",
    "yml": "yaml",
    "json": "json",
    "sql": "sql",
}
REDACTED = "_body redacted by sanitize policy_"


def fence(file: Column) -> Column:
    extension = F.lower(F.regexp_extract(file, r"\.([^./]*)$", 1))
    names = F.create_map(*[F.lit(x) for pair in FENCES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, extension), F.lit(""))


def section(title: str, items: Column, between: str) -> Column:
    """A heading and its items; nothing if there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"# {title}\n\n"), F.array_join(items, between), F.lit("\n\n"))).otherwise(F.lit(""))


def pack_markdown(packs: DataFrame, citations: DataFrame, bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """(prompt_id, markdown) of packs (prompt_id, query, intent, used_tokens, budget_tokens).

    citations (prompt_id, pos, file, start_line, end_line, commit_hash) come in order of pos, each with
    its body (prompt_id, file, start_line, end_line, text; one for each key) or a note that it was redacted; then edges
    (prompt_id, source, relation, target). Caps of the stages before bound what a prompt has of each.
    """
    key = ["prompt_id", "file", "start_line", "end_line"]
    cited = citations.join(bodies.groupBy(*key).agg(F.max("text").alias("text")), key, "left")
    shown = citation_string(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("commit_hash"))
    code = F.concat(F.lit("```"), fence(F.col("file")), F.lit("\n"), F.col("text"), F.lit("\n```"))
    block = F.concat(F.lit("## "), shown, F.lit("\n\n"), F.when(F.coalesce("text", F.lit("")) == "", F.lit(REDACTED)).otherwise(code))
    blocks = cited.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    line = F.format_string("- `%s` —%s→ `%s`", F.col("source"), F.col("relation"), F.col("target"))
    lines = edges.groupBy("prompt_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    whole = packs.join(blocks, "prompt_id", "left").join(lines, "prompt_id", "left")
    task = F.concat(F.lit("# Task\n\n"), F.col("query"), F.lit("\n\n"), F.when(F.col("intent") != "", F.concat(F.lit("**Detected intent**: "), F.col("intent"), F.lit("\n\n"))).otherwise(F.lit("")))
    share = F.format_string("# Pack metadata\n\n- Tokens used/budget: %d/%d", F.col("used_tokens"), F.col("budget_tokens"))
    return whole.select("prompt_id", F.concat(task, section("Relevant code", F.col("blocks"), "\n\n"), section("Call graph", F.col("lines"), "\n"), share, F.lit("\n")).alias("markdown"))


def worksheet(entries: DataFrame, status: str = "needs_verification") -> DataFrame:
    """(subsystem, n, worksheet): the entries of a status with their anchor and what to check, by id, file and line, for each subsystem."""
    anchor = F.format_string("%s:%d (%s)", F.col("file"), F.col("line"), F.col("symbol"))
    item = F.concat(F.lit("- [ ] "), F.col("id"), F.lit(": "), F.when(F.trim("title") == "", F.lit("—")).otherwise(F.col("title")), F.lit("; "), anchor)
    waiting = entries.where(F.col("status") == status).groupBy("subsystem").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "file", "line", item.alias("item")))).alias("items"))
    return waiting.select("subsystem", "n", F.concat(F.lit("## "), F.col("subsystem"), F.lit("\n"), F.array_join(F.transform("items", lambda x: x["item"]), "\n")).alias("worksheet"))
