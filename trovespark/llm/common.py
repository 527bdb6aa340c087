"""What the operators share: scratch tables, ordered buckets, label samples, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trovespark.sources.scratch import shared_folder

BATCH_BYTES = 32 << 20
#: Bits of the filter that goes before a large side is shuffled: so many for each key, in words of 64, at most FILTER_WORDS.
FILTER_BITS, FILTER_HASHES, FILTER_WORDS = 12, 4, 1 << 23


def new_scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/trovespark/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, batches: Callable, schema: str | StructType, rows_each: int = 1000) -> DataFrame:
    """df.mapInArrow with batches of rows_each rows and BATCH_BYTES at most, as texts may be long: it bounds what a Python worker holds at a time.

    Spark reads both bounds when the plan runs, so they stay lowered in the session.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows_each), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(conf.get(name)).removesuffix("b")) <= most:
            conf.set(name, str(most))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(it)
        pa.default_memory_pool().release_unused()  # the worker lives on, and other tasks need the memory

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for df to have no such column."""
    have = {c.lower() for c in df.columns}
    return [next(n for k in range(1, len(have) + 2) if (n := "_" * k + name) not in have) for name in names]


def with_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the further columns named; other columns, whatever their names, are left behind."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def hashed_to(df: DataFrame, rows_each: int, least: int = 64) -> int:
    """How many hash buckets give about rows_each rows in each; grows with the table."""
    return max(least, -(-df.count() // rows_each))


def cut_points(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut the long column key into parts of about equal row counts (a mergeable sketch; no sort)."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("p")).first()["p"]
    return sorted(set(got or []))


def part_of(key: str, cuts: list[int]) -> Column:
    """The number of cut points at or below key, as a balanced tree of comparisons; null keys come first."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def range_parts(ids: DataFrame, key: str, rows_each: int, coarse_ranges: int = 128) -> Callable[[DataFrame], DataFrame]:
    """A function that adds coarse and part to a table with the long column key: parts follow its order and hold about rows_each rows.

    Quantiles of key give at most coarse_ranges coarse ranges, equal widths the parts of each, so the
    number of parts grows with the table; the ranges themselves are the only thing broadcast.
    """
    n = ids.count()
    cuts = cut_points(ids, key, min(coarse_ranges, -(-n // rows_each)))
    inner = max(1, -(-n // (rows_each * (len(cuts) + 1))))
    spans = ids.withColumn("coarse", part_of(key, cuts)).groupBy("coarse").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    low, high = F.col("lo").cast("double"), F.col("hi").cast("double")  # of longs, whose difference may not be one
    spans = F.broadcast(written(spans.select("coarse", low.alias("lo"), ((high - low + 1) / inner).alias("width")), "spans"))

    def placed(df: DataFrame) -> DataFrame:
        fine = F.least(F.floor((F.col(key).cast("double") - F.col("lo")) / F.col("width")), F.lit(inner - 1))
        return df.withColumn("coarse", part_of(key, cuts)).join(spans, "coarse", "left").withColumn("part", F.col("coarse").cast("long") * inner + F.coalesce(fine, F.lit(0))).drop("lo", "width")

    return placed


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def hash_share(*columns: str) -> Column:
    """A number from 0 to 1 by a hash of columns, for samples that reruns repeat."""
    return F.xxhash64(F.lit(20_011), *columns).bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(0x80000000))


def label_shares(labelled: DataFrame, label: str, per_label: int, most_rows: int) -> tuple[Column, int]:
    """The share of each label's values of u that makes about per_label of them, less if labels are many, and a bound of the whole sample."""
    counts = {r[label]: max(1, r["n"]) for r in labelled.groupBy(label).agg(F.approx_count_distinct("u").alias("n")).collect()}
    if not counts:
        return F.lit(0.0), 1
    each = max(1, min(per_label, most_rows // len(counts)))
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    return F.element_at(shares, F.col(label)), 2 * each * len(counts)


def worth_joining(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """rows without most of those whose columns on aren't in the written table keys, so that they needn't be shuffled to a join with it.

    A Bloom filter of FILTER_WORDS words at most; where there are too many keys for it, more rows than need be go on to the join, which alone decides.
    """
    words = min(FILTER_WORDS, 1 + keys.count() * FILTER_BITS // 64)
    spots = [F.pmod(F.xxhash64(F.lit(i), *on), F.lit(words * 64)) for i in range(FILTER_HASHES)]
    spot = keys.select(F.explode(F.array(*spots)).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    set_ = spot.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # words at most
    bits = np.zeros(words, np.int64)
    bits[set_["w"].to_numpy()] = set_["b"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def perhaps(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for places in it:
            yield pd.Series(np.logical_and.reduce([sent.value[p.to_numpy() >> 6] >> (p.to_numpy() & 63) & 1 == 1 for p in places]))

    return rows.where(perhaps(*spots))


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b longs): (node, root), root the smallest node reachable.

    Alternating large and small stars until nothing changes; every round is a table in the shared
    folder, so the plan doesn't grow, and goes once the next is written. No node's neighbours are
    gathered: only their minimum is, by a map-side combined aggregation, and it is joined back, which
    adaptive execution may split.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-links")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large, f"{name}-large")
        if state(large) == now and large.select("u").distinct().count() == now[0]:  # every node has one neighbour, and that is no one's but a root
            break
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small, f"{name}-small")
        discard(spark, edges, large)
        edges, before, now = small, now, state(small)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def shared_cells(cells: DataFrame, name: str, maybe: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Of cells (cell long, node long, and root long if some are known): the pairs (a, b) that share a cell with no third, and (node, met), a row for each node that shares cells with more: met are these cells with their members, no more of them than cells of the node.

    Most meetings are of two by chance; they come out of the aggregation, without a join. maybe is a
    condition on a and b that turns them down there. Cells whose nodes are all of one root are left out. As few cells
    are crowded, a filter of them goes over all rows before the rest is shuffled to a join.
    """
    apart = "low < high" if "root" in cells.columns else "a < b"
    roots = [F.min("root").alias("low"), F.max("root").alias("high")] if "root" in cells.columns else []
    counts = cells.groupBy("cell").agg(F.count("*").alias("members"), F.min("node").alias("a"), F.max("node").alias("b"), *roots).where("members > 1").where(apart)
    counts = counts if maybe is None else counts.where((F.col("members") > 2) | maybe)
    counts = written(counts, f"{name}-cells")
    crowded = written(counts.where("members > 2").select("cell", "members"), f"{name}-crowded")
    shared = worth_joining(cells.select("cell", "node"), crowded, "cell").join(crowded, "cell").groupBy("node").agg(F.collect_list(F.struct("cell", "members")).alias("met"))
    return counts.where("members = 2").select("a", "b").distinct(), written(shared, f"{name}-shared")


def stars_of(pairs: DataFrame, shared: DataFrame, nodes: DataFrame, near: Callable[[str, str], Column], checked: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of nodes (node long, n long, whatever near reads) that share cells: of pairs, and of all nodes of a cell with its head, the one that shares cells with most others; and (node, x, met), the rows of nodes that share cells, with degree in x first.

    pairs and shared come of shared_cells. near(x, y) is a condition on two structs of a row of nodes, checked(pairs)
    the links among distinct pairs (a, b). A group of near copies gives a star round the text they were made from. With rest_of
    these are enough to give the components of all links between nodes that share a cell. What is known of a node is joined to its one
    row and dealt to its cells afterwards.
    """
    what = [c for c in nodes.columns if c not in ("node", "n")]
    degree = F.aggregate("met", F.lit(0).cast("long"), lambda n, c: n + c["members"])
    held = written(nodes.join(shared, "node").select("node", F.struct(degree.alias("degree"), "n", "node", *what).alias("x"), F.col("met.cell").alias("met")), f"{name}-held")
    members = held.select(F.explode("met").alias("cell"), "x")
    heads = members.groupBy("cell").agg(F.max("x").alias("y"))
    stars = members.join(heads, "cell").where(F.col("x.node") != F.col("y.node")).where(near("x", "y"))
    side = lambda end, as_: nodes.select(F.col("node").alias(end), F.struct("node", *what).alias(as_))
    twos = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(near("x", "y")).select("a", "b")
    stars = stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).union(twos).distinct()
    return written(checked(stars), f"{name}-stars"), held


def merged_roots(rooted: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """rooted (node, root, of all nodes) after links (a, b) have joined their ends' components. Only links between different roots are followed."""
    of = lambda end: rooted.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    over = components(between, name).select(F.col("node").alias("root"), F.col("root").alias("over"))
    return written(rooted.select("node", "root").join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")), f"{name}-merged")


def rest_of(held: DataFrame, roots: DataFrame, near: Callable[[str, str], Column], checked: Callable[[DataFrame], DataFrame], name: str, lists: DataFrame | None = None) -> DataFrame:
    """The links, beyond stars_of's, in cells whose nodes are of several roots (node, root): nodes outside the head's component are held against the rest, as pairs that have met already can't join anything.

    With lists (node, cells), of each node's cells in one order, a pair comes out of the first cell it shares only. What remains
    quadratic is the number of tries of near in a cell of many nodes of which few are linked to any other.
    """
    members = held.join(roots, "node", "left").select(F.explode("met").alias("cell"), F.col("x").withField("root", F.coalesce("root", "node")).alias("x"))
    apart = members.groupBy("cell").agg(F.max("x").alias("h"), F.min("x.root").alias("low"), F.max("x.root").alias("high")).where("low <> high")
    members = members.join(apart.select("cell", F.col("h.root").alias("main")), "cell")
    first = F.lit(True)
    if lists is not None:
        members = members.join(lists.select(F.col("node").alias("of"), F.col("cells").alias("listed")), F.col("x.node") == F.col("of")).withColumn("x", F.col("x").withField("cells", F.col("listed"))).drop("of", "listed")
        same = F.zip_with("x.cells", "y.cells", lambda p, q: F.when(p == q, p))
        first = F.get(F.filter(same, lambda c: c.isNotNull()), F.lit(0)) == F.col("cell")
    members = written(members, f"{name}-apart")
    met = F.col("y.root") == F.col("x.root")
    once = (F.col("y.root") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    rest = members.where("x.root <> main").join(members.select("cell", F.col("x").alias("y")), "cell").where(~met & once & near("x", "y") & first)
    return checked(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
