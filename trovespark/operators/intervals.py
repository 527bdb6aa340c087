"""Joins of line ranges on bins: an equi-join in which a crowded file is many keys, whatever the ranges' lengths.

A range is of the level at which it covers two bins at most (bins of level m are 8**m lines). It
stands in its bins of its own level and of the other side's coarser levels, so two ranges
can meet at the coarser of their levels only, where one is at home; the first bin that they have in common
reports them. So wide ranges aren't cut into many bins, and no pair comes twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin grow by this factor from level to level.
GROWTH = 8


def _level(lo: Column, hi: Column) -> Column:
    return F.ceil(F.log(float(GROWTH), F.greatest(hi - lo + 1, F.lit(1)).cast("double"))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur; 22 at most, as ranges of longs have no more."""
    return [r["m"] for r in df.select(F.col("_level").alias("m")).distinct().collect() if r["m"] is not None]


def _ranged(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    lo, hi = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns({f"_lo{side}": lo, "_level": _level(lo, hi), f"_hi{side}": hi})


def _binned(df: DataFrame, levels: list[int], side: str, home: bool | None = None) -> DataFrame:
    """df in the bins of its own level (home), or of the coarser ones among levels; or, with _home to tell them, both."""
    own, coarser = F.array(F.col("_level")), F.filter(F.array(*[F.lit(m) for m in levels]).cast("array<int>"), lambda m: m > F.col("_level"))
    at = {True: own, False: coarser, None: F.concat(own, coarser)}[home]
    width = F.pow(F.lit(float(GROWTH)), F.col("_m")).cast("long")
    first, last = F.floor(F.col(f"_lo{side}") / width), F.floor(F.col(f"_hi{side}") / width)
    binned = df.withColumn("_m", F.explode(at)).withColumn("_bin", F.explode(F.sequence(first, last))).withColumn(f"_first{side}", first)
    return (binned if home is not None else binned.withColumn("_home", F.col("_m") == F.col("_level"))).drop("_level")


def overlapping(x: DataFrame, y: DataFrame, on: list[str], xs: tuple[str, str], ys: tuple[str, str]) -> DataFrame:
    """x and y joined where the keys on are equal and the ranges xs = (start, end) of x and ys of y overlap by a line: start <= the other's end, both ways.

    The other columns of x and y must differ in name. Ranges with a null end overlap nothing; one whose end is before its
    start overlaps what the condition says.
    """
    x, y = _ranged(x, *xs, "x"), _ranged(y, *ys, "y")
    mx, my = _levels(x), _levels(y)
    same = (F.col("_bin") == F.greatest("_firstx", "_firsty")) & (F.col(xs[0]) <= F.col(ys[1])) & (F.col(ys[0]) <= F.col(xs[1]))
    key = [*on, "_m", "_bin"]
    at_home = _binned(x, my, "x", True).join(_binned(y, mx, "y", True), key)
    coarser_y = _binned(x, my, "x", False).join(_binned(y, mx, "y", True), key)
    coarser_x = _binned(x, my, "x", True).join(_binned(y, mx, "y", False), key)
    return reduce(DataFrame.unionByName, (at_home, coarser_y, coarser_x)).where(same).drop("_m", "_bin", "_firstx", "_firsty", "_lox", "_hix", "_loy", "_hiy")


def met(x: DataFrame, y: DataFrame, on: list[str], xs: tuple[str, str], ys: tuple[str, str]) -> DataFrame:
    """The distinct rows of x that overlap any of y, as overlapping() has it, found by one semi join: however many of y they overlap, they come once."""
    columns = x.columns
    x, y = _ranged(x, *xs, "x"), _ranged(y.select(*on, *[F.col(c).alias(f"_y{i}") for i, c in enumerate(ys)]).distinct(), "_y0", "_y1", "y")
    mx, my = _levels(x), _levels(y)
    a, b = _binned(x, my, "x").alias("a"), _binned(y, mx, "y").alias("b")
    equal = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*on, "_m", "_bin"]])
    same = (F.col("a._home") | F.col("b._home")) & (F.col(f"a.{xs[0]}") <= F.col("b._y1")) & (F.col("b._y0") <= F.col(f"a.{xs[1]}"))
    return a.join(b, equal & same, "left_semi").select(*columns).distinct()
