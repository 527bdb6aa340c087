"""Domain inventory: validation, counts, policy views, glossary and worksheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.functions.text import directory_glob, qualified

STATUSES = ("draft", "needs_verification", "verified", "deprecated")
TYPES = tuple(f"B{i}" for i in range(1, 8))
PRIORITIES = ("high", "medium", "low")
EMBEDDABLE = ("verified", "needs_verification")


def issues(entries: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(id, severity, message) of every broken rule: one pass over the entries, then anti-joins for what they refer to."""

    def rule(broken: Column, severity: str, message: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    rules = F.array(
        rule(~F.col("id").rlike(r"^[A-Z][0-9]+(\.[a-z0-9_]+)*$"), "error", "id malformed"),
        rule(F.trim("title") == "", "error", "title missing"),
        rule(F.char_length("title") > 120, "warning", "title too long"),
        rule(F.trim("summary") == "", "error", "summary missing"),
        rule(~F.col("status").isin(*STATUSES), "error", "status unknown"),
        rule(~F.col("knowledge_type").isin(*TYPES), "error", "knowledge type unknown"),
        rule(~F.col("priority").isin(*PRIORITIES), "warning", "priority unknown"),
        rule((F.col("status") == "verified") & ~F.coalesce(F.col("last_verified_at"), F.lit("")).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "error", "verified without a date"),
    )
    local = entries.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("i")).select("id", "i.severity", "i.message")
    issue = lambda df, message: df.select("id", F.lit("error").alias("severity"), F.lit(message).alias("message"))
    homeless = issue(entries.join(subsystems.select(F.col("id").alias("subsystem")), "subsystem", "left_anti"), "subsystem unknown")
    related = entries.select("id", F.explode("related").alias("other"))
    lost = issue(related.join(entries.select(F.col("id").alias("other")), "other", "left_anti"), "related entry unknown")
    selfish = issue(related.where("other = id"), "related to itself")
    twice = issue(entries.groupBy("id").count().where("count > 1"), "id repeated")
    return local.unionByName(homeless).unionByName(lost).unionByName(selfish).unionByName(twice)


def counts_with_zeros(entries: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) of the fixed values, zeros kept, others left out."""
    all_ = entries.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return all_.join(entries.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def verified_by_subsystem(entries: DataFrame, subsystems: DataFrame) -> DataFrame:
    counted = entries.groupBy(F.col("subsystem").alias("sid")).agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count("*").alias("total"))
    return subsystems.join(counted, F.col("id") == F.col("sid"), "left").select(F.col("id").alias("subsystem"), F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("total", F.lit(0)).alias("total"))


def policy_views(entries: DataFrame) -> DataFrame:
    """(subsystem, paths, watch_out, governs): sorted distinct sets of each subsystem's entries; anchors is array<struct<file, symbol>>."""
    anchored = entries.select("subsystem", F.explode_outer("anchors").alias("a"), "pitfalls")
    per = anchored.groupBy("subsystem").agg(
        F.array_sort(F.collect_set(directory_glob(F.col("a.file")))).alias("paths"),
        F.array_sort(F.collect_set(qualified(F.col("a.symbol"), F.col("a.file")))).alias("governs"),
    )
    warned = entries.select("subsystem", F.explode("pitfalls").alias("p")).groupBy("subsystem").agg(F.array_sort(F.collect_set("p")).alias("watch_out"))
    return per.join(warned, "subsystem", "left").withColumn("watch_out", F.coalesce("watch_out", F.array().cast("array<string>")))


def glossary(entries: DataFrame, gate: str = "verified") -> DataFrame:
    """(canonical, aliases, code_keywords) of entries that pass the gate and have both."""
    tidy = lambda *cols: F.array_distinct(F.filter(F.concat(*cols), lambda x: F.trim(x) != ""))
    out = entries.where(F.col("status") == gate).select(F.col("id").alias("canonical"), tidy("aliases_local", "aliases_en").alias("aliases"), tidy("keywords").alias("code_keywords"))
    return out.where((F.size("aliases") > 0) & (F.size("code_keywords") > 0))


def expand(prompts: DataFrame, entries: list[tuple[list[str], list[str]]]) -> DataFrame:
    """prompts (prompt_id, text) with the keywords of every glossary entry (aliases, keywords) whose alias the prompt contains, in glossary order.

    The glossary is a bounded list; it becomes one expression, so no prompt is joined with every alias.
    """
    low = F.lower("text")
    hit = F.lit(False)
    added = []
    for aliases, keywords in entries:
        hit = F.exists(F.array(*[F.lit(a.lower()) for a in aliases]), lambda a: F.contains(low, a))
        added.append(F.when(hit, F.array(*[F.lit(k) for k in keywords])).otherwise(F.array().cast("array<string>")))
    keywords = F.array_distinct(F.concat(*added)) if added else F.array().cast("array<string>")
    return prompts.withColumn("keywords", keywords).withColumn("expanded", F.concat_ws(" ", F.col("text"), F.array_join("keywords", " ")))


def best_catalogue(texts: DataFrame, catalogue: list[tuple[str, list[str]]], text: str = "text") -> DataFrame:
    """texts with the catalogue class of which the text contains most keywords, the first of equals, or 'no match'."""
    low, best, most = F.lower(text), F.lit("no match"), F.lit(0)
    scored = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(-i).alias("place"), F.size(F.filter(F.array(*[F.lit(k) for k in words]), lambda k: F.contains(low, k))).alias("n")) for i, (name, words) in enumerate(catalogue)])
    top = F.array_max(F.transform(scored, lambda s: F.struct(s["n"].alias("n"), s["place"].alias("place"), s["name"].alias("name"))))
    return texts.withColumn("_top", top).withColumn("matched", F.when(F.col("_top.n") > most, F.col("_top.name")).otherwise(best)).withColumn("matched_keywords", F.col("_top.n")).drop("_top")


def anchor_drift(anchors: DataFrame, definitions: DataFrame, most: int = 15) -> DataFrame:
    """Anchors (file, symbol, line) with the nearest definition's line and what became of them: clean, drift, review (too far) or unresolved."""
    near = anchors.join(definitions.select("file", "symbol", "start_line"), ["file", "symbol"], "left")
    found = near.groupBy("file", "symbol", "line").agg(F.min(F.when(F.col("start_line").isNotNull(), F.struct(F.abs(F.col("start_line") - F.col("line")).alias("shift"), F.col("start_line")))).alias("n"))
    bucket = F.when(F.col("n").isNull(), "unresolved").when(F.col("n.shift") == 0, "clean").when(F.col("n.shift") <= most, "drift").otherwise("review")
    return found.select("file", "symbol", "line", F.col("n.start_line").alias("new_line"), bucket.alias("bucket"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """(bucket, n) of anchor_drift's rows."""
    return drift.groupBy("bucket").agg(F.count("*").alias("n"))


def refreshed_anchors(entries: DataFrame, drift: DataFrame) -> DataFrame:
    """entries (id, file, symbol, line, ...) with the new line where drift, from anchor_drift, says that an anchor moved a little."""
    moved = drift.where("bucket = 'drift'").select("file", "symbol", "line", "new_line")
    joined = entries.join(moved, ["file", "symbol", "line"], "left")
    return joined.withColumns({"refreshed": F.col("new_line").isNotNull(), "line": F.coalesce("new_line", "line")}).drop("new_line").select(*entries.columns, "refreshed")


def promoted(entries: DataFrame, subsystems: DataFrame, chosen: DataFrame, date: str) -> DataFrame:
    """entries with the chosen ones (id) verified at date, but those whose changed row would break a rule stay as they are; with promoted and the number of errors."""
    wanted = entries.join(chosen.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    changed = wanted.where("_chosen").withColumns({"status": F.lit("verified"), "last_verified_at": F.lit(date)})
    rest = wanted.where("_chosen is null")
    errors = issues(changed.unionByName(rest), subsystems).where("severity = 'error'").groupBy("id").agg(F.count("*").alias("errors"))
    out = wanted.join(errors, "id", "left").withColumn("errors", F.when(F.col("_chosen"), F.coalesce("errors", F.lit(0))).otherwise(F.lit(0)))
    ok = F.coalesce(F.col("_chosen"), F.lit(False)) & (F.col("errors") == 0)
    out = out.withColumn("promoted", ok).withColumns({"status": F.when(F.col("promoted"), "verified").otherwise(F.col("status")), "last_verified_at": F.when(F.col("promoted"), date).otherwise(F.col("last_verified_at"))})
    return out.select(*entries.columns, "promoted", "errors")


def markdown(entries: DataFrame) -> DataFrame:
    """(id, text): one Markdown page for each embeddable entry; empty sections are left out."""
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {title}\n\n- "), F.array_join(items, "\n- "))).otherwise(F.lit(""))
    page = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("summary"), section("Related", F.array_sort("related")), section("Pitfalls", F.col("pitfalls")))
    return entries.where(F.col("status").isin(*EMBEDDABLE)).select("id", page.alias("text"))


def export(entries: DataFrame, folder: str, documents: DataFrame | None = None) -> None:
    """markdown()'s pages, each a file of its own at entries/id=<id>, and documents (path, text) at docs/path=<base name>. What the folder held goes first."""
    for rows, key, name in ((markdown(entries), "id", "entries"), (documents.select(F.regexp_extract("path", "[^/]*$", 0).alias("path"), "text") if documents is not None else None, "path", "docs")):
        if rows is not None:
            rows.dropDuplicates([key]).repartition(key).write.mode("overwrite").partitionBy(key).text(f"{folder}/{name}")


def in_scope(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Distinct files (path) under any included folder (none named: all) and under no excluded one; a prefix is whole path segments."""
    under = lambda folders: reduce(lambda p, q: p | q, [F.col("path").startswith(f.rstrip("/") + "/") | (F.col("path") == f.rstrip("/")) for f in folders], F.lit(False))
    chosen = files.where(under(include)) if include else files
    return chosen.where(~under(exclude)).select("path").distinct()
