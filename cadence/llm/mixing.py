"""Mixing sources to target weights by hash-threshold histograms.

A source's target is met by whole copies of all its rows and by one further copy of the
rows whose hash lies at or below a threshold. The threshold is found without sorting:
sizes are summed by source and hash bucket, the bucket in which the budget ends is the
only one refined, digit by digit of the hash, until it holds one hash value. Larger
budgets give larger thresholds, so the mixes of growing budgets are nested.

Defined results: a null text has size 0 and is taken 0 times its size; a null source is
a source of its own and comes last; rows that repeat an id share its hash and are taken
together; sources of size 0 have target 0; very long texts are counted whole and taken whole; an empty table gives an empty table; other columns pass
through ``mixed_documents`` whatever their names and are not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, drop_stored, free_name, hash60, n_words, small_enough, stored

DIGIT = 12  #: bits of the hash that a level of the histogram resolves
LEVELS = 5  #: 60 bits
SEED = "mix:"
BROADCAST_SOURCES = 20_000


def source_totals(sized: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """(source, source_size, weight): sources in code point order, null last, weights repeating.

    Ranks are range-partitioned counts plus offsets, so sources may be many.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = F.col("source").isNull().cast("int")
    ranged = stored(totals.repartitionByRange(last, F.col("source")).withColumn("pid", F.spark_partition_id()), "sources")
    each = {r.pid: r.n for r in ranged.groupBy("pid").agg(F.count("*").alias("n")).collect()}
    start, at = {}, 0
    for pid in sorted(each):
        start[pid], at = at, at + each[pid]
    offset = F.lit(0)
    for pid, n in start.items():
        offset = F.when(F.col("pid") == pid, n).otherwise(offset)
    place = F.row_number().over(Window.partitionBy("pid").orderBy(last, "source")) - 1 + offset
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return ranged.select("source", "source_size", F.element_at(weights, (place % len(cycle) + 1).cast("int")).alias("weight"))


def with_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by weight, none above ``cap`` times its source, the excess reshared."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    while True:  # the level rises until the set of capped sources stands still
        free = F.col("weight") * F.lit(level) < limit
        used, weight = sources.agg(F.sum(F.when(~free, limit)), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            break
        now = (share * total - (used or 0.0)) / weight
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the hash up to which rows of the source come nearest to its ``extra`` budget.

    ``sized(source, size, h)``; ``budgets(source, extra)``. Rows of one hash stay together;
    the last hash is taken if that comes nearer to the budget than leaving it.
    """
    open_ = budgets.where("extra > 0").withColumn("base", F.lit(0.0)).withColumn("prefix", F.lit(0).cast("long"))
    rows = sized.where("size > 0")
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        digit = F.shiftright("h", shift)
        hist = (rows.withColumn("bucket", digit).groupBy("source", "bucket")
                .agg(F.sum("size").alias("mass"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        near = F.broadcast(open_) if level == 0 and small_enough(open_, BROADCAST_SOURCES) else open_
        joined = hist.join(near.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        if level:
            joined = joined.where(F.shiftright("bucket", DIGIT) == F.col("prefix"))
        run = F.col("base") + F.sum("mass").over(Window.partitionBy("source").orderBy("bucket"))
        # The first bucket whose running sum passes the budget; where none does, all rows fit.
        ends = joined.withColumn("run", run).where("run > extra")
        pick = F.min(F.struct("bucket", "run", "mass", "lo", "hi")).alias("b")
        found = stored(ends.groupBy("source", "extra").agg(pick).select("source", "extra", "b.*"), "boundary")
        if level == LEVELS - 1 or found.where("lo < hi").isEmpty():
            break
        open_ = found.select("source", "extra", (F.col("run") - F.col("mass")).alias("base"), F.col("bucket").alias("prefix"))
        edge = F.broadcast(open_.select(F.col("source").alias("s"), "prefix")) if small_enough(open_, BROADCAST_SOURCES) else open_.select(F.col("source").alias("s"), "prefix")
        last, rows = rows, stored(rows.withColumn("bucket", digit).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("prefix")))
                                  .select("source", "size", "h"), "boundary-rows")
        if level:
            drop_stored(last)
    take = F.col("run") + F.col("run") - F.col("mass") < 2 * F.col("extra")
    done = found.select(F.col("source").alias("s"), F.when(take, F.col("hi")).otherwise(F.col("lo") - 1).alias("found"))
    none = F.when(F.col("extra") > 0, F.lit((1 << 60) - 1)).otherwise(F.lit(-1))
    return budgets.join(done, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("found", none).alias("threshold"))


def mix_sizes(rows: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``rows(source, size, h, ...)`` with source_size, target and copies (how often the mix takes the row)."""
    sources = with_targets(source_totals(rows, cycle), share, cap)
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    sources = stored(sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
                     .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    limits = thresholds(rows.select("source", "size", "h"), sources.select("source", "extra"))
    plan = stored(sources.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "extra", "weight"), "plan")
    plan = plan.withColumnRenamed("source", "__plan_source")
    near = F.broadcast(plan) if small_enough(plan, BROADCAST_SOURCES) else plan
    copies = F.col("whole") + (F.col("h") <= F.col("threshold")).cast("long")
    return (rows.join(near, F.col("source").eqNullSafe(F.col("__plan_source")))
            .withColumn("copies", copies).drop("__plan_source", "whole", "threshold"))


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col), SEED).alias("h"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows = stored(sized_rows(docs, id_col, text_col, source_col), "sizes")
    return mix_sizes(rows, share, cap, cycle).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with ``copies``, how often each is taken; rows taken 0 times are left out.

    The plan of a source is joined to the whole rows by broadcast, so texts are not shuffled.
    """
    rows = stored(sized_rows(docs, id_col, text_col, source_col), "sizes")
    planned = mix_sizes(rows, share, cap, cycle)
    # copies is least below the threshold's end and most up to it; both follow from the source's row.
    limit = planned.where("copies > 0").groupBy("source", "copies").agg(F.max("h").alias("to"))
    s, h, c, to, lo = free_name(docs, "__s", "__h", "__c", "__to", "__lo")
    all_ = planned.groupBy("source").agg(F.min("copies").alias(lo), F.max("copies").alias("hi"))
    steps = all_.alias("a").join(limit.alias("l"), F.col("a.source").eqNullSafe(F.col("l.source")) & (F.col("a.hi") == F.col("l.copies")), "left").select(
        F.col("a.source").alias(s), F.col(f"a.{lo}"), F.col("a.hi").alias(c), F.col("l.to").alias(to))
    steps = stored(steps, "steps")
    near = F.broadcast(steps) if small_enough(steps, BROADCAST_SOURCES) else steps
    out, = free_name(docs, "copies")
    hashed = docs.withColumn(h, hash60(F.col(id_col), SEED))
    return (hashed.join(near, F.col(source_col).cast("string").eqNullSafe(F.col(s)))
            .withColumn(out, F.when(F.col(h) <= F.col(to), F.col(c)).otherwise(F.col(lo)))
            .where(F.col(out) > 0).select(*docs.columns, out))
