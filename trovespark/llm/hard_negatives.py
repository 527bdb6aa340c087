"""Hard negatives by a two-dimensional block matrix multiply.

The score matrix of anchors and rows is cut into tiles (panel of anchors x block of rows), a task each, and stays where it is
made: the panel's rows and the block's are sent along the rows and columns of that grid, as strips cut into chunks of dimensions.
A task holds its panel and one strip, adds the products of their chunks up to a piece of its tile, and keeps of it
what beats the best so far; no score is written. A first pass finds the best positives of each anchor,
among rows of its label only, a second multiplies again and finds the best negatives of each window of
an anchor and a positive. What leaves a tile is bounded by the best k of each window, whatever the labels' sizes.

Rows are dealt to panels and blocks by a hash of their row number, so no label and no vec_id makes a
larger tile than another. All pairs of anchors and rows are scored, so work grows with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovespark.llm.common import BATCH_BYTES, in_arrow, new_scratch, written

#: Anchors and rows of a tile at most, less where vectors are long, and rows of one where there are fewer tiles than cores; dimensions of a chunk.
PANEL, BLOCK, LEAST_BLOCK, CHUNK = 1 << 14, 1 << 18, 1 << 14, 256
PANEL_CELLS, BLOCK_CELLS = 1 << 22, 1 << 26
#: Rows of a strip, and of a block's first; anchors of a piece of a tile: a piece is 2 MB of floats.
STRIP, FIRST_STRIP, SIDE = 2048, 64, 256
#: 100 times a score must be a long.
MOST_SCORE = 1 << 56
NO_SCORE = -(1 << 60)
META = ("ids", "known", "labels", "rows", "scores")
FOUND = "anchor_row long, anchor_id long, place int, id long, row long, score long"


def as_integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: label and vector given, every component finite; q is floor(scale * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return vectors.where(F.col("label").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def padded(lists: pa.Array, fill: int, width: int | None = None) -> np.ndarray:
    """Lists of longs as rows of a matrix of that width, or the longest one's; after shorter ones fill goes on."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    m = np.full((len(lists), width), fill, np.int64)
    m[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return m


def strips(rows: DataFrame, order: list[Column], dims: int) -> DataFrame:
    """Matrices (g, part, chunk, n, width, m) of the rows (g, vec_id, label, row, q, scores) of each g, in the order given; chunk 0 brings their names, labels and scores.

    The first strips of a group are small and double, so that most rows meet marks that are high already.
    """
    most, chunk, first = max(1, min(STRIP, BATCH_BYTES // 32 // dims)), CHUNK, FIRST_STRIP
    ints = ("g", "part", "chunk", "n", "width")

    def matrix(g: int, part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        m, scores = padded(t["q"].combine_chunks(), 0, dims), padded(t["scores"].combine_chunks(), NO_SCORE)
        low, high = int(m.min()), int(m.max())
        m = m.astype(next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))
        meta = (t["vec_id"].fill_null(0).to_numpy(), t["vec_id"].is_valid().to_numpy().astype(np.uint8), t["label"].to_numpy(), t["row"].to_numpy(), scores)
        for c in range(-(-dims // chunk)):
            some = m[:, c * chunk : (c + 1) * chunk]
            values = [*(pa.array([x], pa.int32()) for x in (g, part, c, len(t), some.shape[1])), *(pa.array([x], pa.binary()) for x in (some.tobytes(), *(x.tobytes() if c == 0 else None for x in meta)))]
            yield pa.RecordBatch.from_arrays(values, [*ints, "m", *META])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, held, n = None, 0, [], 0
        for batch in it:
            g, i = batch.column("g").to_numpy(), 0
            while i < len(g):
                if g[i] != at:
                    if n:
                        yield from matrix(at, part, held)
                    at, part, held, n = int(g[i]), 0, [], 0
                size = min(most, first << min(part, 20))
                end = min(int(np.searchsorted(g, at, "right")), i + size - n)
                held.append(batch.slice(i, end - i))
                n, i = n + end - i, end
                if n == size:
                    yield from matrix(at, part, held)
                    part, held, n = part + 1, [], 0
        if n:
            yield from matrix(at, part, held)

    dealt = rows.select("g", "vec_id", "label", "row", "q", "scores").repartition("g").sortWithinPartitions("g", *order)
    made = in_arrow(dealt, packed, f"{', '.join(f'{c} int' for c in ints)}, m binary, {', '.join(f'{c} binary' for c in META)}", STRIP)
    path = new_scratch(rows.sparkSession, "strips")
    made.write.option("parquet.page.size.row.check.min", "1").option("parquet.block.size.row.check.min", "1").option("parquet.block.size", str(16 << 20)).parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def extent(m: np.ndarray) -> tuple[int, float, int]:
    """The greatest component of a matrix, the greatest norm of its rows, and their length."""
    f = m.astype(np.float64)
    return max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))), float(np.sqrt(np.einsum("ij,ij->i", f, f).max(initial=0))), m.shape[1]


def exact_in(a: list[tuple[int, float, int]], b: list[tuple[int, float, int]]) -> type:
    """A type that holds all sums of products of rows with chunks of such extents; an error where a score could leave MOST_SCORE."""
    if sum(x[0] * y[0] * x[2] for x, y in zip(a, b, strict=True)) >= MOST_SCORE:
        raise OverflowError("components too large: a score times 100 may not be a 64-bit integer")
    most = 1.001 * sum(x[1] * y[1] for x, y in zip(a, b, strict=True))  # no partial sum, in whatever order, is above the product of the norms
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def product(a: np.ndarray, b: np.ndarray, chunks: int) -> np.ndarray:
    """a times b transposed, exact; ends with an error where a score of so many chunks could leave MOST_SCORE."""
    kind = exact_in([extent(a)] * chunks, [extent(b)] * chunks)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Matrix:
    """The rows of some strips: their chunks, in the type that a product needs, and their names."""

    def __init__(self, parts: list[list[dict]]) -> None:
        read = lambda p: np.frombuffer(p["m"], {2: np.int16, 4: np.int32, 8: np.int64}[len(p["m"]) // (p["n"] * p["width"])]).reshape(p["n"], -1)
        self.chunks = [np.concatenate([read(p) for p in chunk]) for chunk in zip(*parts, strict=True)]
        self.extents = [extent(m) for m in self.chunks]
        heads = [p[0] for p in parts]
        self.ids, self.labels, self.rows = (np.concatenate([np.frombuffer(p[k], np.int64) for p in heads]) for k in ("ids", "labels", "rows"))
        self.known = np.concatenate([np.frombuffer(p["known"], np.uint8) for p in heads])
        scores = [np.frombuffer(p["scores"], np.int64).reshape(p["n"], -1) for p in heads]
        width = max(s.shape[1] for s in scores)
        self.scores = np.concatenate([np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=NO_SCORE) for s in scores])
        self.typed: dict[type, list[np.ndarray]] = {}

    def of(self, kind: type) -> list[np.ndarray]:
        if kind not in self.typed:
            self.typed = {kind: [m.astype(kind) for m in self.chunks]}
        return self.typed[kind]

    def runs(self) -> list[tuple[int, int, int]]:
        """(label, first, end) of the rows, which must be in order of label."""
        ends = np.append(np.flatnonzero(np.diff(self.labels)) + 1, len(self.labels)).tolist()
        return [(int(self.labels[first]), first, end) for first, end in zip([0, *ends[:-1]], ends, strict=True)]

    def by_label(self) -> dict[int, np.ndarray]:
        order = np.argsort(self.labels, kind="stable")
        cuts = np.flatnonzero(np.diff(self.labels[order])) + 1
        return {int(self.labels[some[0]]): some for some in np.split(order, cuts)}


class Best:
    """Of each of many groups the k best scores above its floor, and whose they are; of equal ones the first given stand first."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.score = floor, np.repeat(floor[:, None], k, 1)
        self.of = {c: np.zeros(self.score.shape, np.int64) for c in ("ids", "known", "rows")}

    def least(self) -> np.ndarray:
        """What a score must be above."""
        return self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, whose: np.ndarray, b: Matrix) -> None:
        u, k = np.unique(group), self.score.shape[1]
        g, s = np.concatenate([np.repeat(u, k), group]), np.concatenate([self.score[u].ravel(), score])
        order = np.lexsort((-s, g))
        best = order[np.searchsorted(g[order], u)[:, None] + np.arange(k)]
        self.score[u] = s[best]
        for c, old in self.of.items():
            old[u] = np.concatenate([old[u].ravel(), getattr(b, c)[whose]])[best]


def tile(a: list[np.ndarray], b: list[np.ndarray], room: dict) -> np.ndarray:
    """The sum of the chunks' products, in memory that the next one takes again."""
    kind, shape = a[0].dtype, (len(a[0]), len(b[0]))
    if kind not in room:
        room[kind] = np.empty(SIDE * STRIP, kind)
    out = room[kind][: shape[0] * shape[1]].reshape(shape)
    np.matmul(a[0], b[0].T, out=out)
    for x, y in zip(a[1:], b[1:], strict=True):
        out += x @ y.T
    return out


def mark(x: np.ndarray, kind: type) -> np.ndarray:
    """x as a column that scores of that type compare with as with integers."""
    most = {np.float32: 1 << 24, np.float64: 1 << 53}.get(kind, 1 << 62)
    return np.clip(x, -most, most).astype(kind)[:, None]


class Positives:
    """The k best other rows of its label of each anchor of a panel; a label's anchors are multiplied with its rows only."""

    def __init__(self, a: Matrix, k: int) -> None:
        self.a, self.each, self.best = a, 1, Best(np.full(len(a.rows), NO_SCORE), k)
        self.units = [(label, i, min(i + SIDE, end)) for label, first, end in a.runs() for i in range(first, end, SIDE)]

    def meet(self, b: Matrix, room: dict) -> None:
        kind, columns = exact_in(self.a.extents, b.extents), b.by_label()
        for label, i, end in self.units:
            if label in columns:
                own = columns[label]
                s = tile([m[i:end] for m in self.a.of(kind)], [m[own] for m in b.of(kind)], room)
                x, y = np.nonzero(s > mark(self.best.least()[i:end], kind))
                other = self.a.rows[i + x] != b.rows[own[y]]
                x, y = x[other], y[other]
                self.best.add(i + x, s[x, y].astype(np.int64), own[y], b)


class Negatives:
    """The k best rows of another label in the window of each anchor and positive: low*p <= 100*n <= high*p."""

    def __init__(self, a: Matrix, k: int, low: int, high: int) -> None:
        given, p = a.scores != NO_SCORE, np.where(a.scores == NO_SCORE, 0, a.scores)
        self.a, self.each, self.high = a, p.shape[1], np.where(given, high * p // 100, NO_SCORE)
        self.best = Best(np.where(given, -(low * -p // 100) - 1, MOST_SCORE).ravel(), k)  # -floor(-x) is ceil(x)
        self.units = [(i, [(label, max(first - i, 0), end - i) for label, first, end in a.runs() if first < i + SIDE and end > i]) for i in range(0, len(a.rows), SIDE)]

    def meet(self, b: Matrix, room: dict) -> None:
        kind, columns = exact_in(self.a.extents, b.extents), b.by_label()
        least = self.best.least().reshape(-1, self.each)
        for i, runs in self.units:
            part = slice(i, i + SIDE)
            s = tile([m[part] for m in self.a.of(kind)], b.of(kind), room)
            hit = s > mark(least[part].min(1), kind)
            hit &= s <= mark(self.high[part].max(1), kind)
            for label, first, end in runs:
                if label in columns:
                    hit[first:end, columns[label]] = False
            at = np.flatnonzero(hit)
            x, y, v = i + at // s.shape[1], at % s.shape[1], s.ravel()[at].astype(np.int64)
            c, w = np.nonzero((v[:, None] > least[x]) & (v[:, None] <= self.high[x]))
            self.best.add(x[c] * self.each + w, v[c], y[c], b)


def met(a: DataFrame, b: DataFrame, panels: int, blocks: int, dims: int, keeper: Callable[[Matrix], Positives | Negatives]) -> DataFrame:
    """FOUND: what the keeper of each panel of strips a found in each block of strips b, of group place of each anchor. A task holds a panel, one strip and the best so far."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    what = ["part", "chunk", "n", "width", "m", *META]
    a = a.select(F.col("g").alias("panel"), every(blocks).alias("block"), F.lit(0).alias("side"), *what)
    b = b.select(every(panels).alias("panel"), F.col("g").alias("block"), F.lit(1).alias("side"), *what)

    def found(keeps: Positives | Negatives) -> Iterator[pa.RecordBatch]:
        best = keeps.best
        group, place = np.nonzero(best.score > best.floor[:, None])
        for i in range(0, len(group), 1 << 16):
            g, p = group[i : i + (1 << 16)], place[i : i + (1 << 16)]
            anchor, of = g // keeps.each, {c: x[g, p] for c, x in best.of.items()}
            columns = [pa.array(keeps.a.rows[anchor]), pa.array(keeps.a.ids[anchor], mask=keeps.a.known[anchor] == 0), pa.array((g % keeps.each).astype(np.int32)), pa.array(of["ids"], mask=of["known"] == 0), pa.array(of["rows"]), pa.array(best.score[g, p])]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_row", "anchor_id", "place", "id", "row", "score"])

    def multiplied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, panel, keeps, strip, room = None, [], None, [], {}
        for batch in it:
            for r in batch.to_pylist():
                if (r["panel"], r["block"]) != at:
                    if keeps:
                        yield from found(keeps)
                    at, panel, keeps = (r["panel"], r["block"]), [], None
                strip = strip + [r] if r["chunk"] else [r]
                if sum(p["width"] for p in strip) < dims:
                    continue
                if r["side"] == 0:
                    panel.append(strip)
                elif panel:
                    keeps = keeps or keeper(Matrix(panel))
                    keeps.meet(Matrix([strip]), room)
        if keeps:
            yield from found(keeps)

    tasks = a.unionByName(b).repartitionById(panels * blocks, F.col("panel") * blocks + F.col("block"))
    return in_arrow(tasks.sortWithinPartitions("panel", "block", "side", "part", "chunk"), multiplied, FOUND, 64)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) for vectors (vec_id long, label long, q array<long>).

    anchor is a condition on vec_id; its rows are the anchors. Higher scores come first, ties by smaller
    vec_id, null ones last; a row is never its own positive, but a repeated row is. Shorter vectors
    count as if zeros followed; an empty vector scores 0. An anchor whose label no other row has gives
    no rows, and so does a positive whose window is empty (any with a negative score). An empty table
    gives no rows. Components so large that 100 times a score might not be a 64-bit integer end the
    query with an OverflowError.
    """
    rows = written(vectors.select("vec_id", "label", "q", F.monotonically_increasing_id().alias("row")), "vectors")
    of_anchors = rows.where(anchor)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("a"), F.max(F.size("q")).alias("d")).first()
    dims = max(1, size["d"] or 0)
    groups = lambda n, most: max(1, -(-n // max(1, most)))
    panels, blocks = groups(size["a"], min(PANEL, PANEL_CELLS // dims)), groups(size["n"], min(BLOCK, BLOCK_CELLS // dims))
    blocks = max(blocks, min(groups(size["n"], LEAST_BLOCK), 2 * rows.sparkSession.sparkContext.defaultParallelism // panels))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("g")
    no_scores, id_order = F.array().cast("array<long>").alias("scores"), [F.col("vec_id").asc_nulls_last(), F.col("row")]
    b = strips(rows.select("*", dealt(blocks), no_scores), id_order, dims)
    a = strips(of_anchors.select("*", dealt(panels), no_scores), [F.col("label"), *id_order], dims)
    first = lambda key: F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")).alias("r")
    found = met(a, b, panels, blocks, dims, lambda panel: Positives(panel, positives))
    found = found.select("*", first(["anchor_row"])).where(F.col("r") <= positives)
    found = written(found.select("anchor_row", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("r").alias("positive_rank")), "positives")
    scores = found.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score")))["positive_score"].alias("scores"))
    a = strips(of_anchors.select("*", dealt(panels)).join(scores, "row"), [F.col("label"), *id_order], dims)
    best = met(a, b, panels, blocks, dims, lambda panel: Negatives(panel, negatives, low, high))
    best = best.select("*", first(["anchor_row", "place"])).where(F.col("r") <= negatives)
    best = best.select("anchor_row", (F.col("place") + 1).alias("positive_rank"), F.col("r").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_row", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def mined_from_embeddings(vectors: DataFrame, anchor_every: int = 100, noise_every: int = 7, labels: int = 10) -> DataFrame:
    """hard_negatives of embeddings (vec_id, embedding, label): where noise_every divides vec_id the label is one higher, modulo labels; anchors are the ids that anchor_every divides."""
    rows = as_integers(vectors)
    shifted = F.when(F.col("vec_id") % noise_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % anchor_every == 0)


#: The same rows by all pairs of anchors and rows.
SQL = """with r as (
    select row_number() over () as i, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as q
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.i as a_i, a.vec_id as anchor_id, a.label = b.label as same, b.i as b_i, b.vec_id as b_id,
        cast(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) as bigint) as score
    from r a, r b where a.vec_id % 100 = 0 and a.i <> b.i),
p as (select *, row_number() over (partition by a_i order by score desc, b_id nulls last, b_i) as positive_rank from s where same qualify positive_rank <= 5)
select p.anchor_id, p.b_id as positive_id, cast(row_number() over (partition by p.a_i, p.positive_rank order by n.score desc, n.b_id nulls last, n.b_i) as int) as rank,
    n.b_id as negative_id, p.score as positive_score, n.score as negative_score, cast(p.positive_rank as int) as positive_rank
from p join s n on p.a_i = n.a_i and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10"""
