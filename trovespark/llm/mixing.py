"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is cut into blocks of equal word counts. Blocks go to sources by the highest quotients
weight / (2k + 1), never beyond a source's limit; the quotients are counted above a searched
threshold, so millions of blocks cost no more than few. Sainte-Laguë is house monotone: the quotas of
a shard are the quotas of all blocks up to its end less those up to its start. Within a source,
documents stand in a seeded order; the mix takes whole passes over that order and the first blocks of
one more pass, so every document is taken whole, some times, but for one per source that is cut.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovespark.llm.common import hashed_to, unused, written

REPEATS = 3
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of the total by weight; none above repeats times its size, the excess shared again by weight."""
    total, fixed, free = sum(sizes), {}, {i for i, n in enumerate(sizes) if n}
    out = [Fraction(0)] * len(sizes)
    while free:
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = {i for i in free if Fraction(left * weights[i], weight) > repeats * sizes[i]}
        if not over:
            for i in free:
                out[i] = Fraction(left * weights[i], weight)
            break
        fixed |= {i: repeats * sizes[i] for i in over}
        free -= over
    for i, n in fixed.items():
        out[i] = Fraction(n)
    return out


def sainte_lague(weights: list[Fraction], blocks: int, limits: list[int] | None = None) -> list[int]:
    """Integer quotas that sum to blocks (or to all limits, if lower), by the highest quotients; ties go to the first."""
    w = [float(x) for x in weights]
    limits = limits or [blocks] * len(w)
    blocks = min(blocks, sum(m for m, x in zip(limits, w, strict=True) if x > 0))
    if not blocks:
        return [0] * len(w)
    above = lambda t: [min(m, int((x / t + 1) // 2)) if x > 0 else 0 for x, m in zip(w, limits, strict=True)]  # noqa: E731  quotients of t or more
    lo, hi = 0.0, max(w) * 2  # at lo enough, at hi none
    lo = min(x for x in w if x > 0) / (4.0 * blocks + 4)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(above(mid)) >= blocks:
            lo = mid
        else:
            hi = mid
    out = above(hi)
    order = sorted((i for i in range(len(w)) if w[i] > 0), key=lambda i: (-w[i] / (2 * out[i] + 1), i))
    while (short := blocks - sum(out)) > 0:
        for i in order:
            if short and out[i] < limits[i]:
                out[i] += 1
                short -= 1
    return out


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, shards: int = 16, seed: int = 3, most_blocks: int = 1 << 20, rows_each: int = 4000, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, quota, first_shard, last_shard, more) of every row.

    size counts runs of other characters than ASCII white space (null: 0). Sources in code point order,
    null last, weigh weights in turn. taken is a document's words in the mix, repeats counted; the mix
    writes its blocks to shards in order, first_shard and last_shard bound the document's last pass
    (null: not in it). Documents without words take no part (taken 0). Repeated rows are mixed each by
    itself; an empty table gives no rows; other columns are ignored. The driver holds a row for each
    source, no more.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *more)  # rows that tie are copies
    rows = written(rows, "mix-rows")
    named = sorted(((r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in named]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(named))], repeats)
    block = max(1, sum(sizes) // most_blocks)
    total = round(sum(wanted, Fraction(0)) / block)
    limits = [-(-repeats * n // block) for n in sizes]
    quotas = [sainte_lague(wanted, total * k // shards, limits) for k in range(shards + 1)] if named else []
    ends = [[quotas[k][i] for k in range(1, shards + 1)] for i in range(len(named))]
    plan = rows.sparkSession.createDataFrame(
        [(s, n, float(t), e[-1] * block, [x * block for x in e]) for (s, n), t, e in zip(named, wanted, ends, strict=True)],
        "source string, source_size long, target double, quota long, ends array<long>",
    )
    buckets = hashed_to(rows, rows_each, least=64)
    placed = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("size").over(order))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.select("doc_id", "source", "size", *more, (F.col("before") + F.col("upto") - F.col("size")).alias("start"))
    plan = plan.withColumnRenamed("source", "s")
    placed = placed.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))  # a row for each source, which the driver has just held
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least("size", F.col("quota") - passes * F.col("source_size") - F.col("start")))
    placed = placed.withColumn("whole", F.least(passes, F.lit(repeats))).withColumn("part", F.when(passes >= repeats, F.lit(0)).otherwise(part))
    shard = lambda at: F.size(F.filter("ends", lambda e: e <= at)).cast("int")
    last_pass = F.col("whole") * F.col("source_size") + F.col("start")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        "quota",
        F.when(F.col("part") > 0, shard(last_pass)).alias("first_shard"),
        F.when(F.col("part") > 0, shard(last_pass + F.col("part") - 1)).alias("last_shard"),
        *more,
    )


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself: rows of docs, all columns, as often as the mix takes them, to the nearest whole number.

    Every row counts by itself, whatever its doc_id, so rows are numbered in a written table first. Rows
    without words, null texts among them, are never taken; an empty table gives no rows.
    """
    row, same, times, nth = unused(docs, "row", "same", "times", "nth")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-numbered", "zstd")
    taken = F.round(F.col("taken") / F.col("size")).cast("int")
    plan = mix_documents(numbered.select("doc_id", "source", "text", F.col(row).alias("mix_row")), more=("mix_row",), **how).where("size > 0")
    plan = plan.select(F.col("mix_row").alias(same), taken.alias(times)).where(F.col(times) > 0)
    kept = numbered.join(plan, F.col(row) == F.col(same)).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    return kept.drop(row, same, times, nth)
