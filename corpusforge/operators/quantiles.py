"""Exact order statistics of groups of any size, without sorting a group in one task.

The range of a group that holds the wanted rank is cut into `BINS` bins, whose counts are combined map-side; the bin that
holds the rank becomes the range, by the least and greatest value really in it. This goes on until a range holds one value, or so
few rows that they are sorted as they are. Every pass is a shuffle of counts; no pass brings a group's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BINS, FEW = 1024, 4096


def order_statistics(rows: DataFrame, value: str, by: tuple[str, ...], ranks: Column, few: int = FEW, bins: int = BINS) -> DataFrame:
    """by, n, rank, value: of each group the values at `ranks`, an array of places from 0 in ascending order, made from n (the group's size).

    Nulls don't count; NaN is refused by being left out. A group without a value has no row; ranks outside of 0 to n - 1 neither. by may be empty.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    slim = rows.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], v.alias("_v"))
    whole = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = whole.withColumn("rank", F.explode(F.array_distinct(ranks))).where((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
    # _left: the rank among the rows of the range; _rows: how many these are.
    open_ = written(wanted.select(*keys, "n", F.col("rank").cast("long").alias("rank"), "_low", "_high", F.col("rank").cast("long").alias("_left"), F.col("n").alias("_rows")), "ranks")
    done = []
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    while True:
        done.append(open_.where("_low = _high").select(*keys, "n", "rank", F.col("_low").alias("_v")))
        rest = open_.where("_low < _high")
        met = rest.where(F.col("_rows") <= few)
        sorted_ = _inside(slim, met, same).groupBy(*[met[k] for k in keys], "n", "rank", "_left").agg(F.sort_array(F.collect_list("_v")).alias("a"))
        done.append(sorted_.select(*keys, "n", "rank", F.get("a", F.col("_left").cast("int")).alias("_v")))
        rest = rest.where(F.col("_rows") > few)
        if rest.isEmpty():
            break
        width = F.col("_high") - F.col("_low")  # over 0, as doubles underflow by degrees
        halves = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)  # where the width overflows
        share = F.when(width < float("inf"), (F.col("_v") - F.col("_low")) / width).otherwise(halves)
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        counted = _inside(slim, rest, same).groupBy(*[rest[k] for k in keys], "n", "rank", "_left", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        over = Window.partitionBy(*keys, "rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
        placed = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(over), F.lit(0)))
        hit = placed.where((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_rows")))
        open_ = written(hit.select(*keys, "n", "rank", "_low", "_high", (F.col("_left") - F.col("_before")).alias("_left"), "_rows"), "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "rank", F.col("_v").alias(value))


def _inside(slim: DataFrame, ranges: DataFrame, same) -> DataFrame:
    """The values of slim in each range of their group. Ranges are a few a group."""
    conditions = [*same(slim, ranges), slim["_v"].between(ranges["_low"], ranges["_high"])]
    met = conditions[0]
    for c in conditions[1:]:
        met = met & c
    return ranges.join(slim, met).select(*[ranges[c] for c in ranges.columns], slim["_v"])


def interpolated(rows: DataFrame, value: str, by: tuple[str, ...], share: float) -> DataFrame:
    """by, value: the share-quantile of each group, linear between the two values beside its place."""
    place = share * (F.col("n") - 1)
    found = order_statistics(rows, value, by, F.array(F.floor(place), F.ceil(place)))
    keys = list(by)
    return found.groupBy(*keys, "n").agg(F.min(F.struct("rank", value)).alias("a"), F.max(F.struct("rank", value)).alias("b")).select(*keys, (F.col(f"a.{value}") + (F.col(f"b.{value}") - F.col(f"a.{value}")) * (place - F.floor(place))).alias(value))
