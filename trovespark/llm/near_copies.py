"""Near copies by the Jaccard similarity of word shingles.

Candidates are texts whose fingerprints the segment-popcount grid links. Two texts of similarity 0.8
differ in about ten of 64 bits, though, which is more than any grid can look for, so those that share
a MinHash cell are candidates too: the minima of six hashes, one cell for each of 40 bands. A pair of
similarity s shares none with probability (1 - s^6)^40, which is 5 in 10^6 at 0.8. A sketch, four bits
of each minimum, turns most chance meetings down: what it estimates from lies 4.5 standard deviations
below what near texts have. Every pair left is checked on its whole shingle sets, so cells and
sketches decide what is compared, never what is near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.llm.common import in_arrow, merged_roots, rest_of, shared_cells, stars_of, unused, with_text, written
from trovespark.llm.near_dedup import fingerprint, fingerprint_links, shingle_hashes

BANDS, ROWS = 40, 6
MINIMA = 480  # of a text: the first BANDS * ROWS make its cells, all of them its sketch
SKETCH_BITS = 4  # of each minimum; a row's sketch is so many longs
SKETCH = MINIMA * SKETCH_BITS // 64
SURE = 4.5
BLOCK = 1 << 8
HEAD_PAIRS = 200
_FACTORS = np.random.default_rng(11).integers(1, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(blocks: list[np.ndarray]) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; a text without words has one of its own."""
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(1, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set of shingles."""
    least = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    mixed = (found ^ found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(mixed), BLOCK):
        h = mixed[None, at : at + BLOCK] * _FACTORS[:, None]
        h ^= h >> np.uint32(15)
        np.minimum(least, h.min(axis=1), out=least)
    return least


def cells_of(least: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketch_of(least: np.ndarray) -> np.ndarray:
    """Bits of all minima, as longs."""
    bits = (least[:, None] >> np.arange(SKETCH_BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(bool).ravel(), bitorder="little").view("<i8")


def most_different(least: float) -> int:
    """The bits in which sketches of texts of that similarity differ, SURE standard deviations above the mean: of unequal minima every other bit."""
    n = MINIMA
    spread = sqrt((least * (1 - least) / 4 + (1 - least) / (4 * SKETCH_BITS)) / n)
    return floor(n * SKETCH_BITS * ((1 - least) / 2 + SURE * spread))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, fp, size, sketch, cells) of every row: th a hash of the text, fp its fingerprint, size its distinct shingles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps, sizes, bits, cells = [], [], [], []
            for t in b.column(1).cast(pa.binary()):
                blocks = list(shingle_hashes(t.as_py(), words))
                found = shingles(blocks)
                least = minima(found)
                fps.append(fingerprint(blocks))
                sizes.append(len(found))
                bits.append(sketch_of(least))
                cells.append(cells_of(least))
            many = pa.list_(pa.int64())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, many), pa.array(cells, many)], ["doc_id", "th", "fp", "size", "sketch", "cells"])

    rows = with_text(docs).withColumn("th", F.xxhash64("text"))
    return in_arrow(rows, batches, "doc_id long, th long, fp long, size long, sketch array<long>, cells array<long>")


def near_pairs(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The distinct pairs (a, b) whose texts (th, text) have a Jaccard similarity of least or more. A text that many pairs have as b is dealt out to several tasks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for b in it:
            near = []
            for k, s, t in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary()), strict=True):
                if k != last:
                    last, y = k, shingles(list(shingle_hashes(t.as_py(), words)))
                x = shingles(list(shingle_hashes(s.as_py(), words)))
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= least * (len(x) + len(y) - common))
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    deals = pairs.groupBy("b").agg(F.ceil(F.count("*") / HEAD_PAIRS).cast("int").alias("deals"))
    dealt = deals.join(texts, deals.b == texts.th).select("b", F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    asked = pairs.join(deals, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int").alias("deal"))
    both = asked.join(texts.select(F.col("th").alias("a"), F.col("text").alias("ta")), "a").join(dealt, ["b", "deal"])
    return in_arrow(both.select("a", "b", "ta", "tb"), batches, "a long, b long", 250)


def fingerprint_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b) pairs of texts: of equal fingerprints each with the one that most documents have, and those of linked fingerprints."""
    fps = classes.groupBy("fp").agg(F.sum("n").alias("n"), F.max_by("th", F.struct("n", "th")).alias("head"))
    same = classes.join(fps.select("fp", "head"), "fp").where("th <> head").select(F.col("th").alias("a"), F.col("head").alias("b"))
    links, head = fingerprint_links(fps.select("fp", "n"), radius), fps.select("fp", "head")
    a, b = head.select(F.col("fp").alias("a"), F.col("head").alias("ha")), head.select(F.col("fp").alias("b"), F.col("head").alias("hb"))
    return same.union(links.join(a, "a").join(b, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")))


def copy_roots(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, least: float, radius: int) -> DataFrame:
    """(node, root) of all distinct texts (th, n documents, fp, size, sketch, cells): root is the smallest of those near it, over any number of steps. texts_of gives (th, text) for a table of th."""
    differ = most_different(least)

    def near(x: str, y: str) -> Column:
        of = lambda c: (F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))
        bits = sum((F.bit_count(p.bitwiseXOR(q)) for p, q in (of(f"s{i}") for i in range(SKETCH))), F.lit(0))
        return (F.least(*of("size")) >= least * F.greatest(*of("size"))) & (bits <= differ)  # sets of other sizes can't be near

    alike = written(fingerprint_pairs(classes, radius), "copy-alike")
    twos, shared = shared_cells(classes.select(F.explode("cells").alias("cell"), F.col("th").alias("node")), "copies")
    pairs = alike.union(twos)
    asked = shared.select(F.col("node").alias("th")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = written(texts_of(asked), "copy-texts")
    checked = lambda pairs: near_pairs(written(pairs, "copy-pairs"), texts, words, least)
    nodes = classes.select(F.col("th").alias("node"), "n", "size", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    lists = classes.select(F.col("th").alias("node"), "cells")
    stars, held = stars_of(twos, shared, nodes, near, checked, "copies")
    rooted = merged_roots(nodes.select("node", F.col("node").alias("root")), stars.unionByName(checked(alike)), "copies")
    return merged_roots(rooted, rest_of(held, rooted, near, checked, "copies", lists), "copies-rest")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of docs, all columns, of which each component of near copies keeps one, that of the smallest doc_id.

    Texts are near if their sets of shingles of so many words have a Jaccard similarity of least or
    more. Null texts count as empty; texts without words are near each other; of rows that repeat
    doc_id and text one stays. Rows are named by doc_id and a hash of their text, so a null or repeated
    doc_id costs no other text its row. An empty table gives no rows.
    """
    found = written(sketches(docs, words), "copy-sketches", "zstd")
    alike = [F.first(c).alias(c) for c in ("fp", "size", "sketch", "cells")]
    classes = written(found.groupBy("th").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), *alike), "copy-classes", "zstd")
    own, th, first_id = unused(docs, "own", "th", "first_id")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))

    def rows_of(some: DataFrame) -> DataFrame:
        """One row of docs for each (th, first_id)."""
        key = some.select(F.col("th").alias(th), F.col("first_id").alias(first_id))
        return keyed.join(key, (F.col(own) == F.col(th)) & F.col("doc_id").eqNullSafe(F.col(first_id)), "left_semi").dropDuplicates([own])

    def texts_of(asked: DataFrame) -> DataFrame:
        named = rows_of(classes.join(asked, "th", "left_semi"))
        return named.select(F.col(own).alias("th"), F.coalesce("text", F.lit("")).alias("text"))

    roots = copy_roots(classes, texts_of, words, least, radius)
    named = classes.join(roots, classes.th == roots.node).select("th", "first_id", "root")
    first = F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "th")).alias("first")
    return rows_of(named.groupBy("root").agg(first).select("first.th", "first.first_id")).drop(own)
