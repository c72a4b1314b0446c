"""Exact quantiles of groups of any size: histograms narrow the range of each rank until few rows are left to order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import drop_stored, small_enough, stored

BINS = 256
FEW = 10_000  #: rows of a rank's range that one task orders
BROADCAST_RANKS = 300_000


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, one column for each share): the value at each share of 0 to 1, linearly interpolated between neighbours; nulls and NaN are left out.

    A group's ranks start with its least and greatest value as range. While a range holds more than ``FEW`` rows it is cut
    into ``BINS`` bins of equal width, whose counts (one partial aggregate) tell the bin that holds the rank; its own least and greatest
    value are the next range. The keys and values are written once; up to ``BROADCAST_RANKS`` ranks go to them, so no group is shuffled whole (more ranks meet
    their groups by a join that Spark splits where it is skewed). No task ever orders more than ``FEW`` rows of a rank.
    """
    if not shares or not all(0 <= p <= 1 for p in shares.values()):
        raise ValueError("shares must lie between 0 and 1")
    keys = [f"__g{i}" for i in range(len(by))] or ["__g0"]
    base = df.select(*([F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("__g0")]), F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    base = stored(base, "values")
    each = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.floor(p * (F.col("n") - 1)) + (0 if side == 0 else F.when(F.floor(p * (F.col("n") - 1)) < p * (F.col("n") - 1), 1).otherwise(0))).cast("long").alias("k"),
                     (F.lit(float(p)) * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))).alias("part")) for name, p in shares.items() for side in (0, 1)]
    spans = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    open_ = stored(spans.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(F.array(*each)).alias("x")).select(*keys, "n", "lo", "hi", "below", "x.*"), "ranks")
    own = [*keys, "name", "side", "k", "part"]

    def inside(ranks: DataFrame) -> DataFrame:
        r = ranks.select(*[F.col(k).alias(f"{k}r") for k in keys], "name", "side", "k", "part", "lo", "hi", "below")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys])
        return base.join(F.broadcast(r) if small_enough(ranks, BROADCAST_RANKS) else r, same & F.col("__v").between(F.col("lo"), F.col("hi"))).drop(*[f"{k}r" for k in keys])

    while not open_.where(f"n > {FEW} and lo < hi").isEmpty():
        wide = inside(open_.where(f"n > {FEW} and lo < hi")).withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)))
        counts = wide.groupBy(*own, "below", "bin").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*own).orderBy("bin"))
        found = counts.withColumn("upto", F.col("below") + upto).where("upto > k and upto - n <= k").select(*keys, "n", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"), "name", "side", "k", "part")
        after = stored(found.unionByName(open_.where(f"n <= {FEW} or lo = hi")), "ranks")
        drop_stored(open_)
        open_ = after
    order = F.row_number().over(Window.partitionBy(*own).orderBy("__v"))
    few = inside(open_.where("lo < hi")).withColumn("i", order).where("i = k - below + 1").select(*own, "__v")
    ends = few.unionByName(open_.where("lo = hi").select(*own, F.col("lo").alias("__v")))
    line = F.max(F.when(F.col("side") == 0, F.col("__v"))) * (1 - F.max("part")) + F.max(F.when(F.col("side") == 1, F.col("__v"))) * F.max("part")
    out = ends.groupBy(*keys, "name").agg(line.alias("v")).groupBy(*keys).pivot("name", list(shares)).agg(F.first("v"))
    made = stored(out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *shares), "quantiles")
    drop_stored(base)
    drop_stored(open_)
    return made
