"""Sharding by a minimax contiguous partition.

Rows with equal texts are one atomic group; groups are ordered by a 64-bit hash of the text, after those that
alone fill a shard's fair share. The smallest feasible shard capacity is binary-searched: a capacity is feasible if the greedy cut (fill a
shard until the next group doesn't fit) needs no more shards than asked for; with that capacity as a bound, shards are cut at their fair shares. The groups never meet in
one place: the driver holds sums of cells of the hash space, at most CELLS of them and SPLIT for each
cell it refines. A cell of several groups is counted once as if it could be cut anywhere (a lower
bound of the capacity) and once as if it couldn't be cut (an upper bound); only cells in which a cut
can lie are split further, by the next bits of the hash, until both bounds meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovespark.llm.common import hashed_to, written

CELL_BITS, SPLIT_BITS = 13, 8

Cell = tuple[int, int, int, bool]  # first hash (unsigned), bits fixed, bytes, one group only


def unsigned(h: str) -> Column:
    """The hash with its sign bit flipped, so that signed order is the unsigned order used here."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def cuts_for(cells: list[Cell], before: list[int], shards: int, capacity: int, divisible: bool) -> list[tuple[int, int]] | None:
    """The greedy cuts for a capacity as (cell, position in bytes), or None if shards don't suffice."""
    at, out = 0, []
    for _ in range(shards):
        to = at + capacity
        i = bisect_right(before, to) - 1  # the cell that holds position to
        if i >= len(cells):
            return out
        if not divisible or cells[i][3]:
            to = before[i]
        if to <= at:
            return None
        out.append((i, to))
        at = to
    return out if at >= before[-1] else None


def even_cuts(before: list[int], shards: int, capacity: int) -> list[int]:
    """The cells at which shards 1, 2, ... begin, for a capacity that suffices; before holds the bytes before each cell, and all.

    Each shard is cut at the boundary nearest to its fair share of what is left, as far as it keeps the capacity and what
    remains still fits in the remaining shards.
    """
    needed = [len(before) - 1]  # what k shards can hold begins at needed[k] or later
    for _ in range(shards - 1):
        needed.append(bisect_left(before, before[needed[-1]] - capacity))
    at, out = 0, []
    for left in range(shards - 1, 0, -1):
        fair = before[at] + (before[-1] - before[at]) / (left + 1)
        last = bisect_right(before, before[at] + capacity) - 1
        near = bisect_left(before, fair)
        near -= near > at + 1 and fair - before[near - 1] <= before[min(near, len(before) - 1)] - fair
        at = min(max(near, at + 1, needed[left]), last)
        out.append(at)
    return out


def smallest(lo: int, hi: int, ok: Callable[[int], bool]) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the hashes (sign flipped) at which shards 1, 2, ... begin; groups has h long and size long.

    Several rows may share an h; together they are one group.
    """

    def cells_of(rows: DataFrame, bits: int) -> list[Cell]:
        first = F.col("u").bitwiseAND(F.lit(-(1 << (64 - bits))))
        got = rows.groupBy(first.alias("c")).agg(F.sum("size").alias("s"), (F.min("u") == F.max("u")).alias("one"), F.min("u").alias("lo")).collect()
        return [((r["lo"] if r["one"] else r["c"]), bits, r["s"], r["one"]) for r in got]

    rows = groups.select(unsigned("h").alias("u"), "size")
    cells = sorted(cells_of(rows, CELL_BITS))
    while cells:
        before = [0, *accumulate(c[2] for c in cells)]
        total = before[-1]
        floor = max(-(-total // shards), max(c[2] for c in cells if c[3]) if any(c[3] for c in cells) else 0)
        upper = smallest(floor, total, lambda c: cuts_for(cells, before, shards, c, False) is not None)
        lower = smallest(floor, upper, lambda c: cuts_for(cells, before, shards, c, True) is not None)
        early, late = cuts_for(cells, before, shards, lower, False), cuts_for(cells, before, shards, upper, True)
        if lower == upper:
            return upper, [cells[i][0] for i in even_cuts(before, shards, upper) if i < len(cells)]
        early = early or []
        open_ = set()
        at = 0
        for k in range(shards):  # a cut lies between the pessimistic and the optimistic one
            if k < len(early):
                at = early[k][0]
            else:  # the pessimistic walk got stuck: go on from where it stands
                at = max(0, bisect_right(before, before[at] + lower) - 1) if at < len(cells) else at
            until = late[k][0] if k < len(late) else len(cells) - 1
            open_ |= {i for i in range(min(at, until), min(until, len(cells) - 1) + 1) if not cells[i][3]}
        if not open_:
            raise AssertionError("bounds differ though no cell is open")
        finer: list[Cell] = []
        for bits in {cells[i][1] for i in open_}:
            starts = [cells[i][0] for i in open_ if cells[i][1] == bits]
            wanted = rows.where(F.col("u").bitwiseAND(F.lit(-(1 << (64 - bits)))).isin(starts))
            finer += cells_of(wanted, min(64, bits + SPLIT_BITS))
        cells = sorted([c for i, c in enumerate(cells) if i not in open_] + finer)
    return 0, []


def shard_of(u: str, cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (F.col(u) >= F.lit(c)).cast("int")
    return out


def heavy_first(rows: DataFrame, shards: int) -> DataFrame:
    """rows (h, size, ...) in whose order the groups of a shard's fair share or more, shards at most, come before the rest, so that the rest may be cut evenly."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = rows.groupBy("h").agg(F.sum("size").alias("s")).where(F.col("s") >= -(-total // shards)).orderBy("h").collect()
    place = F.col("h")
    for i, r in enumerate(heavy):
        place = F.when(F.col("h") == r["h"], F.lit(i)).otherwise(place)  # no other group is likely to have so low a hash; one that has joins it
    return rows.withColumn("h", place.cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, rows_each: int = 4000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is bytes.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 that of its bytes (null: of none).
    Equal texts, and null ones among themselves, share a shard. Slots are numbered by hash buckets of
    doc_id, so no task gets a whole shard. Repeated rows come back as often as they stand and fill
    slots of their own; an empty table gives no rows; other columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.lit(11), F.col("text").isNull(), "text").alias("h"),
    )
    rows = heavy_first(written(rows, "shard-rows"), shards)
    _, cuts = minimax_cuts(rows, shards)
    buckets = hashed_to(rows, rows_each * shards, least=32)
    placed = rows.withColumn("u", unsigned("h")).withColumn("shard", shard_of("u", cuts)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(13), "doc_id", "h"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").count()
    before = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")))
    out = numbered.join(before, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
