"""SimHash near-duplicates by segment popcounts.

Each fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints, so it is a safe filter. The
embedding space is cut into eight groups of four segments; if the distance is at most r < 8, at least
8 - r groups agree exactly, so every link shares a unit cell in one of the C(8, r) projections on
8 - r groups. That is the grid: one row for each fingerprint and projection, an equi-join on cells,
then the Manhattan distance over all segments, then the exact Hamming distance.

Copies cost nothing: the join runs on distinct fingerprints. A large group of near copies gives a
star, not all pairs, and no link that joins two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.llm.common import in_arrow, merged_roots, rest_of, shared_cells, stars_of, with_text, written

ODD_BITS = 0x5555555555555555
GROUPS = 8


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of a UTF-8 text's shingles, repeats included, in blocks; fewer words are one shingle, no words none."""
    tokens = text.lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    n, digest = max(1, len(tokens) - words + 1) if tokens else 0, xxhash.xxh64_intdigest
    for at in range(0, n, block):
        yield np.fromiter((digest(b" ".join(tokens[i : i + words]), seed) for i in range(at, min(n, at + block))), "<u8")


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(blocks: Iterable[np.ndarray]) -> int:
    """The signed 64-bit fingerprint of shingle hashes: a bit is 1 if over half of them set it."""
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        counts += votes(h)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty, whose fingerprint is 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in texts), np.int64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return in_arrow(with_text(docs), batches, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, two bits each."""
    low, high = fp.bitwiseAND(F.lit(ODD_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def projections(radius: int) -> list[int]:
    """Masks that keep GROUPS - radius of the eight groups."""
    masks = [sum(0xFF << 8 * g for g in keep) for keep in combinations(range(GROUPS), GROUPS - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def manhattan(x: Column, y: Column) -> Column:
    """Manhattan distance of two packed popcount vectors. The segments hold 0 to 2: equal segments give
    xor 0, neighbours 1 or 3, opposite ones 2, so the distance is the count of non-zero segments plus
    that of segments that are 2."""
    d = x.bitwiseXOR(y)
    low, high = d.bitwiseAND(F.lit(ODD_BITS)), F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(ODD_BITS))
    return F.bit_count(low.bitwiseOR(high)) + F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def grid_links(classes: DataFrame, radius: int, ahead: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of distinct fingerprints fp with their document counts n: links (a, b), the roots (node, root) of all after these, and further links; all together give all components.

    Near copies share most of their cells. So, unless ahead is 0, each ahead-th projection goes ahead, and links them as
    stars; then all projections look only at cells in which nodes of different components meet. From step to step only links between different roots are followed.
    """
    if not 1 <= radius < GROUPS:
        raise ValueError(f"radius must lie in 1..{GROUPS - 1}")
    v, masks = popcounts(F.col("fp")), projections(radius)
    nodes = classes.select(F.col("fp").alias("node"), "n", v.alias("v"))

    def linked(x: Column, y: Column, vx: Column, vy: Column) -> Column:
        return (manhattan(vx, vy) <= radius) & (F.bit_count(x.bitwiseXOR(y)) <= radius)

    def near(x: str, y: str) -> Column:
        return linked(*(F.col(f"{s}.{c}") for c in ("node", "v") for s in (x, y)))

    def cells(rows: DataFrame, some: list[int], *more: str) -> DataFrame:
        grids = rows.select("node", "v", *more, F.explode(F.array(*[F.lit(m) for m in some])).alias("grid"))
        return grids.select(F.xxhash64("grid", F.col("v").bitwiseAND(F.col("grid"))).alias("cell"), "node", *more)  # a chance meeting of two cells costs a comparison

    a, b = F.col("a"), F.col("b")
    maybe = linked(a, b, popcounts(a), popcounts(b))
    exact = lambda pairs: pairs
    rooted = nodes.select("node", F.col("node").alias("root"))
    if ahead:
        stars, _ = stars_of(*shared_cells(cells(nodes, masks[::ahead]), "ahead", maybe), nodes, near, exact, "ahead")
        rooted = merged_roots(rooted, stars, "ahead")
    pairs, shared = shared_cells(cells(rooted.withColumn("v", popcounts(F.col("node"))), masks, "root"), "grid", maybe)
    stars, held = stars_of(pairs, shared, nodes, near, exact, "grid")
    rooted = merged_roots(rooted, stars, "grid")
    return stars, rooted, rest_of(held, rooted, near, exact, "grid")


def fingerprint_roots(classes: DataFrame, radius: int = 4, ahead: int = 5) -> DataFrame:
    """(node, root) of all distinct fingerprints fp with their document counts n: root is the smallest of those it is linked with, over any number of links."""
    _, rooted, rest = grid_links(classes, radius, ahead)
    return merged_roots(rooted, rest, "near")


def fingerprint_links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links among distinct fingerprints fp with their document counts n, each within the radius, enough to give all components."""
    stars, _, rest = grid_links(classes, radius)
    return stars.unionByName(rest)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id long, text string).

    Null and empty texts have fingerprint 0 and link like any other; texts of fewer words than a
    shingle count as one shingle; repeated rows come back as often as they stand; an empty table gives
    no rows; further columns are ignored. A null doc_id is never a component's name unless alone.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "classes")
    roots = fingerprint_roots(classes, radius)
    named = written(classes.join(roots, classes.fp == roots.node).select("fp", "first_id", "root"), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
