"""Shared helpers of the training-data operators.

Words, ASCII lower-casing, shared-folder tables and connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import drop_stored, shared_dir, small_enough, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java regex of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), GAP), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def hash60(c: Column, seed: str) -> Column:
    """A 60-bit hash that SQL engines share: the first 15 hex digits of an MD5."""
    text = F.concat(F.lit(seed), F.coalesce(c.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (node, component), component = least node.

    Alternates two steps on the edge table until nothing changes: every node's
    larger neighbours are hung on its least neighbour, then every node's smaller ones
    are. The least neighbour comes from a partial aggregate, so a hot node costs one
    value for each task; the join on it is an equi-join that AQE splits.
    Edges with a null end are ignored.
    """
    spark = edges.sparkSession

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(least(both), "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        mid = stored(large, "large")
        small = mid.join(least(mid), "u")
        after = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        sign = tuple(after.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        drop_stored(mid)
        drop_stored(now)
        now = after
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    pairs = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return pairs.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def slices(batches: Iterable, rows: int = 500) -> Iterator:
    """Record batches in parts of at most ``rows`` rows, so that few texts are Python objects at a time.

    Arrow's own pool keeps what it once had; the system's gives it back, which many workers on one machine need.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
