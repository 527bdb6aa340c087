"""The flow corpus from Markdown: notes of flows and their steps, invariants and where they are enforced, and the edges that follow from both.

Notes are rows (path, text); every record is cut out of its note by column expressions, so notes of any
number are read where they lie. Records leave as JSON lines, each tagged with its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a front matter ends, what begins a step or an invariant, and how they name things.
HEADER = r"(?s)\A---\n(.*?)\n---\n"
STEP, INVARIANT = r"(?m)^###\s+STEP\s+(?=[A-Za-z0-9\-])", r"(?m)^###\s+(?=INV-[A-Z]+-\d+\s*—)"
#: Names that are flows though they hold a dash.
FLOW_PREFIXES = ("ep-", "spine-")
TYPES = ("flow", "step", "invariant", "edge")


def notes(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """(path, text) of the Markdown files of a folder that Spark can read."""
    return spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def bare(value: Column) -> Column:
    """Without a comment (a blank and # begin one) and outer blanks."""
    return F.trim(F.regexp_replace(value, r" #.*$", ""))


def none_if_blank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def listed(value: Column) -> Column:
    """[a, b] as an array, anything else as one item; nothing, null, a dash and [] as none."""
    v = bare(value)
    inner = F.filter(F.transform(F.split(F.regexp_extract(v, r"^\[(.*)\]$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(v.isNull() | v.isin("", "—", "[]"), F.array().cast("array<string>")).when(v.rlike(r"^\[.*\]$"), inner).otherwise(F.array(v))


def ticked(value: Column) -> Column:
    """What stands between the first two backticks, else the bare value."""
    return F.coalesce(none_if_blank(F.trim(F.regexp_extract(value, r"`([^`]+)`", 1))), bare(value))


def field(block: Column, key: str) -> Column:
    """The rest of the line '- key:' (null: none); of several the last."""
    found = F.regexp_extract_all(block, F.lit(rf"(?m)^- {key}:[ \t]*([^\n]*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def nested(block: Column, key: str) -> Column:
    """The lines under '- key:' up to the next field or heading."""
    return F.split(F.regexp_extract(block, rf"(?ms)^- {key}:[^\n]*\n(.*?)(?=^- \w+:|^###|\z)", 1), "\n")


def blocks(body: Column, heading: str) -> Column:
    parts = F.split(body, heading)
    return F.slice(parts, 2, F.size(parts))


def flows(files: DataFrame) -> DataFrame:
    """(id, entry_point, trigger, summary, root_symbol, links, called_by, body) of each note; without a name of its own a flow has its file's."""
    head = F.regexp_extract("text", HEADER, 1)
    raw = lambda key: F.when(head.rlike(rf"(?m)^\s*{key}\s*:"), F.regexp_extract(head, rf"(?m)^\s*{key}\s*:[ \t]*([^\n]*)$", 1))
    value = lambda key: F.regexp_replace(bare(raw(key)), r'^"+|"+$', "")
    name = F.coalesce(none_if_blank(value("flow")), F.regexp_replace("path", r"^.*/|\.md$", ""))
    return files.select(name.alias("id"), *[value(k).alias(k) for k in ("entry_point", "trigger", "summary", "root_symbol")], *[listed(raw(k)).alias(k) for k in ("links", "called_by")], F.regexp_replace("text", HEADER, "").alias("body"))


def steps(found: DataFrame) -> DataFrame:
    """(flow, pos, id, symbol, file, line, kind, calls, reads, writes, emits, branches, invariants, prose) of flows()."""
    b = F.col("block")
    rows = found.select(F.col("id").alias("flow"), F.posexplode(blocks(F.col("body"), STEP)).alias("pos", "block"))
    at = ticked(field(b, "at"))
    located = at.rlike(r"^.*?:\d+\s*$")
    quoted = lambda x: F.trim(F.regexp_replace(F.trim(x), r'^"+|"+$', ""))
    arrow = r"^(.*?)\s*→\s*then:\s*(.*?)\s*at:\s*(.*)$"

    def branch(line: Column) -> Column:
        seg = F.regexp_extract(line, r"^\s*-\s*when:\s*(.*)$", 1)
        whole = seg.rlike(arrow)
        part = lambda i: F.regexp_extract(seg, arrow, i)
        return F.struct(quoted(F.when(whole, part(1)).otherwise(seg)).alias("when"), F.when(whole, quoted(part(2))).alias("then"), F.when(whole, ticked(part(3))).alias("at"))

    lines = F.filter(nested(b, "branches"), lambda x: x.rlike(r"^\s*-\s*when:"))
    return rows.select(
        "flow", "pos", F.regexp_extract(b, r"^([A-Za-z0-9\-]+)", 1).alias("id"), none_if_blank(ticked(field(b, "symbol"))).alias("symbol"),
        F.when(located, F.regexp_extract(at, r"^(.*?):(\d+)\s*$", 1)).otherwise(at).alias("file"), F.when(located, F.regexp_extract(at, r"^(.*?):(\d+)\s*$", 2).cast("int")).alias("line"),
        bare(field(b, "kind")).alias("kind"), listed(field(b, "calls")).alias("calls"), *[bare(field(b, k)).alias(k) for k in ("reads", "writes", "emits")],
        F.transform(lines, branch).alias("branches"), F.filter(listed(field(b, "invariant")), lambda x: x.startswith("INV-")).alias("invariants"), F.trim(field(b, "prose")).alias("prose"),
    )


def invariants(files: DataFrame) -> DataFrame:
    """(id, domain, title, statement, assumes, check, enforced_at array<struct<flow, step, loc>>) of notes of invariants."""
    b = F.col("block")
    rows = files.select(F.explode(blocks(F.col("text"), INVARIANT)).alias("block"))

    def sites(line: Column) -> Column:
        ticks = F.transform(F.regexp_extract_all(line, F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.trim(x))
        ref = r"^[A-Za-z0-9\-]+:[A-Za-z0-9\-]+$"
        loc = F.get(F.filter(ticks, lambda x: ~x.rlike(ref)), F.lit(0))
        return F.transform(F.filter(ticks, lambda x: x.rlike(ref)), lambda x: F.struct(F.substring_index(x, ":", 1).alias("flow"), F.substring_index(x, ":", -1).alias("step"), loc.alias("loc")))

    lines = F.filter(nested(b, "enforced_at"), lambda x: x.rlike(r"^\s*-\s*`"))
    name = F.regexp_extract(b, r"^(INV-[A-Z]+-\d+)", 1)
    return rows.select(name.alias("id"), F.split(name, "-")[1].alias("domain"), F.trim(F.regexp_extract(b, r"^INV-[A-Z]+-\d+\s*—\s*([^\n]*)", 1)).alias("title"), *[F.trim(field(b, k)).alias(k) for k in ("statement", "assumes", "check")], F.flatten(F.transform(lines, sites)).alias("enforced_at"))


def edges(found: DataFrame, of_flows: DataFrame, rules: DataFrame) -> DataFrame:
    """(rel, from, to): flows called by others, calls of steps to steps of their flow or to flows, and invariants' places."""
    called = found.select(F.lit("called_by").alias("rel"), F.col("id").alias("from"), F.explode("called_by").alias("to"))
    each = of_flows.select("flow", F.concat_ws(":", "flow", "id").alias("from"), F.explode("calls").alias("c"))
    c = F.col("c")
    to_step = c.contains("-") & ~(c.startswith(FLOW_PREFIXES[0]) | c.startswith(FLOW_PREFIXES[1]))
    calls = each.select(F.when(to_step, "calls").otherwise("calls_flow").alias("rel"), "from", F.when(to_step, F.concat_ws(":", "flow", "c")).otherwise(c).alias("to"))
    held = rules.select("id", F.explode("enforced_at").alias("e")).where("e.flow <> ''")
    return called.unionByName(calls).unionByName(held.select(F.lit("enforces").alias("rel"), F.col("id").alias("from"), F.concat_ws(":", "e.flow", "e.step").alias("to")))


def corpus(files: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """The records of flow notes and invariant notes, both (path, text), by type."""
    found, known = flows(files), invariants(rules)
    of_flows = steps(found)
    return {"flow": found.drop("body"), "step": of_flows, "invariant": known, "edge": edges(found, of_flows, known)}


def write_corpus(records: dict[str, DataFrame], path: str) -> None:
    """JSON lines with their type first, nulls kept."""
    line = lambda kind, df: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns), {"ignoreNullFields": "false"}).alias("value"))
    out = None
    for kind in TYPES:
        one = line(kind, records[kind])
        out = one if out is None else out.unionByName(one)
    out.write.text(path)


def missing_symbols(of_flows: DataFrame) -> DataFrame:
    """(flow, id) of steps without a symbol, which the build warns of."""
    return of_flows.where("symbol is null").select("flow", "id")
