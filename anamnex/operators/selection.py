"""Exact percentiles of groups of any size, by selection.

A mergeable quantile sketch of each large group brackets the wanted ranks; a second pass counts what lies below, at and
inside each bracket, and keeps only the values inside. While these are still too many, they are sketched in turn. What is
left, at most `most` values for a rank, is ranked exactly. Each pass leaves about a hundredth of a group, so that the
number of passes is the logarithm of its size, and no task holds more than a sketch or `most` values of one group.

Groups of at most `most` values are ranked in one aggregate, as nothing in it can grow beyond that.

Odd rows. Nulls don't count; a group of nulls alone has no row. NaN is larger than all numbers, and equal to itself. Of
equal values any number may stand at a bracket's ends: they are counted and not kept. The rank of a share is
ceil(share * n), at least 1, in double precision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Values of one group that a task may hold.
MOST_HELD = 100_000
#: Steps of a sketch's grid; its ranks are off by at most a tenth of a step.
GRID = 200
#: Groups of more rows than both of these are joined by broadcast; there are fewer than BROADCAST_GROUPS of them.
HOT_ROWS, BROADCAST_GROUPS = 1_000_000, 1000


def with_group(rows: DataFrame, groups: DataFrame, by: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (by, n, ...); large groups go by a broadcast of fewer than BROADCAST_GROUPS rows, so that no task gets all rows of one."""
    bound = max(HOT_ROWS, total // BROADCAST_GROUPS)
    cold = rows.join(groups.where(F.col("n") <= bound), by)
    if groups.where(F.col("n") > bound).isEmpty():
        return cold
    return cold.unionByName(rows.join(F.broadcast(groups.where(F.col("n") > bound)), by))


def rank(share: float, n: Column) -> Column:
    return F.greatest(F.ceil(F.lit(share) * n), F.lit(1)).cast("bigint")


def direct(rows: DataFrame, value: str, shares: dict[str, float], by: str) -> DataFrame:
    return rows.groupBy(by).agg(*(F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, p in shares.items()))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: str, most: int = MOST_HELD) -> DataFrame:
    """Columns by and one for each share, named as in shares: the value at its rank among the group's values in ascending order."""
    return _percentiles(rows.select(F.col(by).alias("g__"), F.col(value).alias("v")).where(F.col("v").isNotNull()), shares, "g__", most).withColumnRenamed("g__", by)


def _percentiles(rows: DataFrame, shares: dict[str, float], by: str, most: int) -> DataFrame:
    groups = rows.groupBy(by).agg(F.count("*").alias("n"))
    large = groups.where(F.col("n") > most)
    sizes = large.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if not sizes["k"]:
        return direct(rows, "v", shares, by)
    groups = written(groups)
    total = groups.agg(F.sum("n")).first()[0]
    small = direct(with_group(rows, groups.where(F.col("n") <= most), by, total).drop("n"), "v", shares, by)
    return small.unionByName(selected(rows, groups.where(F.col("n") > most), total, shares, by, most))


def selected(rows: DataFrame, groups: DataFrame, total: int, shares: dict[str, float], by: str, most: int) -> DataFrame:
    """percentiles() of the given groups (by, n)."""
    asked = groups.select(by, "n", F.explode(F.array(*(F.struct(F.lit(name).alias("share"), rank(p, F.col("n")).alias("r")) for name, p in shares.items()))).alias("a")).select(by, "n", "a.*")
    own = rows.select(by, F.lit(None).cast("string").alias("of"), "v")
    found: list[DataFrame] = []
    while True:
        # 1. brackets: of the wanted ranks, in the grid of what is still possible
        grid = own.groupBy(by, "of").agg(F.percentile_approx("v", [k / GRID for k in range(GRID + 1)], 10 * GRID).alias("grid"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        at = F.floor(F.col("r") / F.col("n") * GRID).cast("int")
        low = F.when(at < 2, F.col("least")).otherwise(F.get("grid", at - 2))
        high = F.when(at > GRID - 3, F.col("greatest")).otherwise(F.get("grid", at + 3))
        joined = asked.alias("a").join(grid.alias("g"), (F.col(f"a.{by}") == F.col(f"g.{by}")) & (F.col("g.of").isNull() | (F.col("g.of") == F.col("a.share"))))
        brackets = written(joined.select(F.col(f"a.{by}").alias(by), "share", "n", "r", low.alias("low"), high.alias("high")))
        # 2. how many lie below, at the ends and inside
        packed = brackets.groupBy(by).agg(F.max("n").alias("n"), F.collect_list(F.struct("share", "low", "high")).alias("asked"))
        met = with_group(own, packed, by, total).select(by, "v", F.explode(F.filter("asked", lambda a: F.col("of").isNull() | (F.col("of") == a["share"]))).alias("a"))
        side = F.when(F.col("v") < F.col("a.low"), 0).when(F.col("v") == F.col("a.low"), 1).when(F.col("v") < F.col("a.high"), 2).when(F.col("v") == F.col("a.high"), 3).otherwise(4)
        met = met.select(by, "v", "a.share", side.alias("side"))
        counts = met.groupBy(by, "share").agg(*(F.count_if(F.col("side") == k).alias(f"c{k}") for k in range(4)))
        ruled = written(brackets.join(counts, [by, "share"]))
        below, inside = F.col("c0") + F.col("c1"), F.col("c2")
        if ruled.where((F.col("r") <= F.col("c0")) | (F.col("r") > below + inside + F.col("c3"))).count():
            raise AssertionError("a sketch missed a rank")  # against its guarantee
        found.append(ruled.where(F.col("r") <= below).select(by, "share", F.col("low").alias("v")))
        found.append(ruled.where(F.col("r") > below + inside).select(by, "share", F.col("high").alias("v")))
        # 3. what lies inside, for the ranks that do
        asked = written(ruled.where((F.col("r") > below) & (F.col("r") <= below + inside)).select(by, inside.alias("n"), "share", (F.col("r") - below).alias("r")))
        largest = asked.agg(F.max("n")).first()[0]
        if largest is None:
            break
        kept = met.where("side = 2").join(asked.select(by, "share"), [by, "share"], "left_semi").select(by, F.col("share").alias("of"), "v")
        own = written(kept)
        if largest <= most:
            order = Window.partitionBy(by, "of").orderBy("v")
            ranked = own.withColumn("k", F.row_number().over(order)).join(asked.select(by, F.col("share").alias("of"), "r"), [by, "of"]).where("k = r")
            found.append(ranked.select(by, F.col("of").alias("share"), "v"))
            break
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(by).agg(*(F.max(F.when(F.col("share") == name, F.col("v"))).alias(name) for name in shares))
