"""Precision, recall and F1 of citations, latencies, and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.functions.text import basename, last_component, normal_path
from trovespark.operators import intervals
from trovespark.sources.scratch import kept

KEY = ["file", "start_line", "end_line"]


def retrieval_quality(expected: DataFrame, actual: DataFrame, case: str = "scenario", strict: bool = False) -> DataFrame:
    """(case, n_expected, n_actual, hits, precision, recall, f1): citations match if they overlap on a file by a line, or, strictly, if they are the same.

    Duplicates count once. Nothing expected and nothing found is perfect; only one of them empty gives 0.
    """
    sided = lambda df, e: df.select(case, *KEY, F.lit(e).alias("_e"), F.lit(not e).alias("_a"))
    cited = sided(expected, True).unionByName(sided(actual, False)).groupBy(case, *KEY).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    whole = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (case, *KEY)])
    if strict:
        cited = cited.withColumn("_same", F.col("_e") & F.col("_a") & whole)
    else:
        cited = kept(cited.withColumn("_same", F.col("_e") & F.col("_a") & whole & F.coalesce(F.col("start_line") <= F.col("end_line"), F.lit(False))), "cited")
    counts = ["n_expected", "n_actual", "recalled", "hits"]
    marked = lambda df, *marks: df.select(case, *[m.cast("long").alias(c) for c, m in zip(counts, marks)])
    parts = [marked(cited, F.col("_e"), F.col("_a"), F.col("_same"), F.col("_same"))]
    if not strict:  # what both have matches itself; the rest is looked up, in files that both cite
        files = cited.groupBy(case, "file").agg(F.max("_e").alias("e"), F.max("_a").alias("a"), F.min("_same").alias("s")).where(F.col("e") & F.col("a") & ~F.col("s"))
        cited = kept(cited.join(kept(files.select(case, "file"), "shared-files"), [case, "file"], "left_semi"), "shared")
        lines, none = ("start_line", "end_line"), F.lit(0)
        for mine, other, marks in (("_e", "_a", (none, none, F.lit(1), none)), ("_a", "_e", (none, none, none, F.lit(1)))):
            alone = cited.where(F.col(mine) & ~F.col("_same")).select(case, *KEY)
            parts.append(marked(intervals.met(alone, cited.where(other).select(case, *KEY), [case, "file"], lines, lines), *marks))
    counted = reduce(DataFrame.unionByName, parts).groupBy(case).agg(*[F.sum(c).alias(c) for c in counts])
    ratio = lambda hit, n, other: F.when(F.col(n) > 0, F.col(hit) / F.col(n)).when(F.col(other) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    counted = counted.withColumn("precision", ratio("hits", "n_actual", "n_expected")).withColumn("recall", ratio("recalled", "n_expected", "n_actual"))
    both = F.col("precision") + F.col("recall")
    return counted.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def folded_runs(runs: DataFrame, case: str = "scenario", metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Medians of a case's runs without an error, nearest-rank latency percentiles; citation counts cut to integers."""
    good = runs.where(F.coalesce(F.col("error"), F.lit("")) == "")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency_ms)").cast("long")
    return good.groupBy(case).agg(
        F.count("*").alias("runs"),
        *[F.median(m).alias(m) for m in metrics],
        F.floor(F.median("citation_count")).cast("long").alias("citation_count"),
        p(0.5).alias("latency_p50"),
        p(0.95).alias("latency_p95"),
        F.max("latency_ms").alias("latency_max"),
    )


def intent_rollup(cases: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Means by intent over cases without an error; no intent is (unspecified)."""
    good = cases.where(F.coalesce(F.col("error"), F.lit("")) == "")
    intent = F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("(unspecified)")).alias("intent")
    return good.groupBy(intent).agg(F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in metrics], F.floor(F.avg("latency_ms")).cast("long").alias("latency_ms"))


def accuracy_by_mode(answers: DataFrame) -> DataFrame:
    """Rates of located and correct answers and sums of fabricated citations by mode, by mode and difficulty, by mode and domain."""
    sets = answers.groupingSets([["mode"], ["mode", "difficulty"], ["mode", "domain"]], "mode", "difficulty", "domain")
    return sets.agg(F.count("*").alias("answers"), F.avg(F.col("located").cast("double")).alias("located"), F.avg(F.col("correct").cast("double")).alias("correct"), F.sum("fabricated").alias("fabricated"))


def scored_answers(answers: DataFrame, citations: DataFrame, truth: DataFrame, files: DataFrame, scaffolding: str = "bundles/") -> DataFrame:
    """answers (id, mode, correctness, ...) with located, n_citations, fabricated and self_cited.

    citations (id, mode, file, start_line, end_line) locate the answer if one overlaps a line of truth
    (id, file, start_line, end_line) in the same file. One that cites the scaffolding counts as such;
    others are made up if no file (path, n_lines) of that path, or if there is none of that base name,
    has the lines.
    """
    key = ["id", "mode"]
    c = citations.select(*key, "file", "start_line", "end_line", F.monotonically_increasing_id().alias("c"), basename(normal_path(F.col("file"))).alias("base"))
    t = truth.select("id", basename(normal_path(F.col("file"))).alias("base"), F.col("start_line").alias("ts"), F.col("end_line").alias("te"))
    located = intervals.met(c, t, ["id", "base"], ("start_line", "end_line"), ("ts", "te")).select(*key).distinct().withColumn("located", F.lit(1))
    longest = files.groupBy(basename(F.col("path")).alias("base")).agg(F.max("n_lines").alias("base_lines"))
    exact = files.groupBy(F.col("path").alias("whole")).agg(F.max("n_lines").alias("path_lines"))
    known = c.join(longest, "base", "left").join(exact, normal_path(F.col("file")) == F.col("whole"), "left")
    lines = F.coalesce("path_lines", "base_lines", F.lit(0))
    own = F.contains(F.col("file"), F.lit(scaffolding))
    bad = ~own & ~((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("start_line") <= lines))
    counted = known.groupBy(*key).agg(F.count("*").alias("n_citations"), F.count_if(bad).alias("fabricated"), F.count_if(own).alias("self_cited"))
    return answers.join(located, key, "left").join(counted, key, "left").fillna(0, ["located", "n_citations", "fabricated", "self_cited"])


def accuracy(scored: DataFrame) -> DataFrame:
    """By mode: rates of located, correct and passed answers and sums of citations, made-up and self-citing ones."""
    rate = lambda c: F.avg(c.cast("double"))
    return scored.groupBy("mode").agg(
        F.count("*").alias("n"),
        rate(F.col("located")).alias("location_acc"),
        rate((F.col("correctness") == "correct").cast("int")).alias("correct_rate"),
        rate(F.col("correctness").isin("correct", "partial").cast("int")).alias("pass_rate"),
        *[F.sum(c).alias(c) for c in ("n_citations", "fabricated", "self_cited")],
    )


#: How a member of the truth is reached that only relations lead to.
RELATIONAL = ("transitive", "interface-impl", "semantic")


def scored_impacts(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, mode, n_gt, n_ans, recall, precision, rel_total, rel_hit, dir_total, dir_hit) of answers (id, mode, file, symbol, start_line, end_line) against truth (id, file, symbol, reach, start_line, end_line).

    A member of either side matches one of the other in a file of the same base name, if one's last
    symbol part holds the other's, else if both have lines and they overlap, else if the truth has no symbol.
    """
    last = lambda c: F.lower(last_component(F.col(c)))
    t = truth.select("id", F.monotonically_increasing_id().alias("t"), basename(F.trim("file")).alias("base"), F.coalesce("symbol", F.lit("")).alias("ts"), F.col("reach").isin(*RELATIONAL).alias("rel"), F.col("start_line").alias("ta"), F.col("end_line").alias("tz"))
    a = answers.select("id", "mode", F.monotonically_increasing_id().alias("a"), basename(F.trim("file")).alias("base"), F.coalesce("symbol", F.lit("")).alias("as_"), F.col("start_line").alias("aa"), F.col("end_line").alias("az"))
    named = (F.col("ts") != "") & (F.col("as_") != "") & (F.contains(last("ts"), last("as_")) | F.contains(last("as_"), last("ts")))
    lined = F.col("ta").isNotNull() & F.col("tz").isNotNull() & F.col("aa").isNotNull() & F.col("az").isNotNull()
    met = t.join(a, ["id", "base"]).where(named | F.when(lined, (F.col("aa") <= F.col("tz")) & (F.col("ta") <= F.col("az"))).otherwise(F.col("ts") == ""))
    asked = a.groupBy("id", "mode").agg(F.count("*").alias("n_ans"))
    sizes = t.groupBy("id").agg(F.count("*").alias("n_gt"), F.count_if("rel").alias("rel_total"), F.count_if(~F.col("rel")).alias("dir_total"))
    hit = lambda c: F.count_distinct(F.when(c, F.col("t")))
    got = met.groupBy("id", "mode").agg(F.count_distinct("t").alias("hit"), hit(F.col("rel")).alias("rel_hit"), hit(~F.col("rel")).alias("dir_hit"), F.count_distinct("a").alias("good"))
    both = asked.join(sizes, "id", "left").join(got, ["id", "mode"], "left").fillna(0, ["n_gt", "rel_total", "dir_total", "hit", "rel_hit", "dir_hit", "good"])
    return both.select("id", "mode", "n_gt", "n_ans", F.when(F.col("n_gt") > 0, F.col("hit") / F.col("n_gt")).alias("recall"), (F.col("good") / F.col("n_ans")).alias("precision"), "rel_total", "rel_hit", "dir_total", "dir_hit")


def impact_scores(rows: DataFrame) -> DataFrame:
    """By mode: macro means of recall and precision, and relational and direct recall as ratios of sums."""
    return rows.groupBy("mode").agg(
        F.count("*").alias("n"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        (F.sum("rel_hit") / F.sum("rel_total")).alias("relational_recall"),
        (F.sum("dir_hit") / F.sum("dir_total")).alias("direct_recall"),
        F.avg("context_tokens").alias("context_tokens"),
    )


def impact_members(truth: DataFrame, answers: DataFrame, case: str = "case") -> DataFrame:
    """Members of the truth that an answer names: the same base name of file, and the same symbol part or overlapping lines; (case, n_gt, n_ans, found, precise)."""
    t = truth.select(case, F.monotonically_increasing_id().alias("t"), basename(F.col("file")).alias("base"), F.col("symbol").alias("ts"), F.col("start_line").alias("ta"), F.col("end_line").alias("tz"))
    a = answers.select(case, F.monotonically_increasing_id().alias("a"), basename(F.col("file")).alias("base"), F.col("symbol").alias("as_"), F.col("start_line").alias("aa"), F.col("end_line").alias("az"))
    last = lambda c: F.element_at(F.split(c, r"\."), -1).alias("last")
    named = t.withColumn("last", last("ts")).join(a.withColumn("last", last("as_")), [case, "base", "last"]).select(case, "t", "a")
    met = named.unionByName(intervals.overlapping(t, a, [case, "base"], ("ta", "tz"), ("aa", "az")).select(case, "t", "a"))
    sizes = t.groupBy(case).agg(F.count("*").alias("n_gt")).join(a.groupBy(case).agg(F.count("*").alias("n_ans")), case, "full_outer").fillna(0)
    got = met.groupBy(case).agg(F.count_distinct("t").alias("found"), F.count_distinct("a").alias("precise"))
    return sizes.join(got, case, "left").fillna(0, ["found", "precise"])


def unresolved_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations that name no file, by path or base name, with at least so many lines: they were made up."""
    known = files.groupBy(basename(F.col("path")).alias("known")).agg(F.max("n_lines").alias("n_lines"))  # a row for each name, however many files share it
    return citations.join(known, (basename(F.col("file")) == F.col("known")) & (F.col("start_line") <= F.col("n_lines")), "left_anti")
