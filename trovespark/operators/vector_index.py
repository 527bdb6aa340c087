"""Approximate vector search in an inverted file: vectors in the cells of their nearest centroids, of which a query asks a few.

The centroids are fitted on a bounded sample, the SAMPLE vectors of least hashes (those of all vectors, if fewer);
every vector is indexed. Large cells are split into parts by a hash, so that copies of one vector make
many parts. What a query finds in the cells it asks is scored exactly, as knn does. How many cells a
query must ask for a wanted recall is measured on the sample when the index is built: among all vectors neighbours are nearer, and
lie in nearer cells, than among the sample's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trovespark.operators.ranking import top_k
from trovespark.operators.search import matrix
from trovespark.sources.scratch import new_folder

#: Vectors that the centroids are fitted on, most centroids, vectors of a part, queries that meet a part at a time.
SAMPLE, MOST_CELLS, PART, ASKED = 20_000, 4096, 4096, 1024
#: Vectors of the sample whose neighbours are looked up to measure recall.
MEASURED = 500


def fitted(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd's rounds from vectors drawn by distance; fewer if the sample has fewer distinct vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    cells = min(cells, len(distinct))
    chosen, far = [int(rng.integers(len(distinct)))], None
    while len(chosen) < cells:
        d = np.maximum(1 - distinct @ distinct[chosen[-1]], 0)
        far = d if far is None else np.minimum(far, d)
        chosen.append(int(rng.choice(len(distinct), p=far / far.sum())) if far.sum() > 0 else len(chosen))
    centroids = distinct[chosen]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10) -> int:
    """The least number of nearest cells that hold so large a share of the k nearest neighbours, in the sample, of MEASURED of its vectors."""
    asked = sample[:MEASURED]
    k = min(k, len(sample))
    near = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
    cell = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each cell among those nearest to each
    ranks = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """vectors (cell, part, doc, vec) at path; sizes (cell, n, parts), MOST_CELLS rows at most; probes: cells that a query asks."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")


def celled(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """df (..., vec) with cell: one row for each of the probes nearest centroids; vectors of other dimensions, empty ones and those of length 0 have none."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS at most

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in it:
            m = matrix(b.column("vec"), c.shape[1])
            rows = np.flatnonzero(m.any(axis=1))
            k = min(probes, len(c))
            near = np.argpartition(-(m[rows] @ c.T), k - 1, axis=1)[:, :k] if len(rows) else np.empty((0, k), np.int64)
            out = b.take(pa.array(np.repeat(rows, k)))
            yield pa.record_batch([*out.columns, pa.array(near.ravel().astype(np.int32))], [*out.schema.names, "cell"])

    return df.mapInArrow(batches, StructType([*df.schema.fields, StructField("cell", StructType.fromDDL("c int")["c"].dataType)]))


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95) -> VectorIndex:
    """An index of vectors (doc, vec) at path; cells default to about the square root of their number, at most a thirtieth of the sample. The commonest dimension of the sample is the index's."""
    spark = vectors.sparkSession
    vectors = vectors.select("doc", "vec")
    sample = vectors.where("size(vec) > 0").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    n = vectors.count()
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.array([1])
    m = matrix(sample, int(np.bincount(sizes).argmax())) if len(sample) else np.ones((1, 1))
    m = m[m.any(axis=1)] if m.any() else np.ones((1, m.shape[1]))
    centroids = fitted(m, min(MOST_CELLS, cells or max(1, min(round(n**0.5), len(m) // 30))))
    probes = probes_for(m, centroids, recall)
    placed = f"{path}/placed"
    celled(vectors, centroids, 1).write.parquet(placed)
    rows = spark.read.parquet(placed)
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    counts.write.parquet(f"{path}/sizes")
    parts = rows.join(F.broadcast(spark.read.parquet(f"{path}/sizes")), "cell")  # MOST_CELLS rows at most
    parts = parts.select("cell", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc", "vec")
    parts.repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/vectors")
    spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centroids)], "cell int, vec array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
    return VectorIndex(spark, path, centroids, probes)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
    return VectorIndex(spark, path, np.array([r["vec"] for r in rows]), rows[0]["probes"])


def asked_cells(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """queries (query, vec) with each cell they ask, its n and parts."""
    return celled(queries, index.centroids, probes).join(F.broadcast(index.sizes()), "cell")


def search(index: VectorIndex, queries: DataFrame, query: str = "query_id", k: int = 10, probes: int | None = None) -> DataFrame:
    """(query, doc, score, rank): the k nearest by cosine among the cells of the probes (the index's own, if not given) centroids nearest to each query (query, vec).

    Vectors that have no cell (see celled) aren't found, and such queries find nothing.
    """
    vectors = index.vectors()
    asked = asked_cells(index, queries.select(query, "vec"), probes or index.probes)
    crowd = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
    grouped = asked.join(crowd, "cell").withColumn("grp", F.pmod(F.xxhash64(query), F.col("groups")).cast("int"))
    left = grouped.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "grp", query, F.col("vec").alias("asked"))
    right = vectors.join(crowd, "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "doc", "vec")
    schema = StructType([StructField(query, queries.schema[query].dataType), StructField("doc", vectors.schema["doc"].dataType), StructField("score", DoubleType())])
    names, dimensions = [f.name for f in schema], index.centroids.shape[1]

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return pa.table([q[query].slice(0, 0), v["doc"].slice(0, 0), pa.array([], pa.float64())], names)
        scores = np.round(matrix(q["asked"].combine_chunks(), dimensions) @ matrix(v["vec"].combine_chunks(), dimensions).T, 12)
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
        a, b = np.nonzero(np.round(scores, 9) >= np.round(least, 9)[:, None])
        return pa.table([q[query].take(pa.array(a)), v["doc"].take(pa.array(b)), pa.array(scores[a, b])], names)

    key = ["cell", "part", "grp"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema)
    return top_k(found, [query], [F.desc(F.round("score", 9)), F.asc("doc")], k)


def temporary(vectors: DataFrame, cells: int | None = None) -> VectorIndex:
    """An index in a folder of its own among the scratch tables."""
    return build(vectors, new_folder(vectors.sparkSession, "vectors"), cells)
