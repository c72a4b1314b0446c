"""Prefix trie of conversations by a Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted as sequences of turns (two 64-bit hashes a turn) by range partitions, the blocks; L[i] is the number of turns that
conversation i shares with the one before it, L[0] = L[N] = -1.

1. All nearest smaller values: a block finds for each place the nearest places to its left and right with a smaller L, by a stack. What stays open
   at a block's edge is asked once for each distinct value: block minima, one number a block, name the nearest block with a smaller L, and
   that block's staircase (its running minima) the place.
2. Places with the same (left end, L) are one branching node, whose members are the conversations from its left end to its right end. A conversation
   with more turns than it shares with either neighbour ends a chain of its own.
3. A node stands for all depths down from its parent's, which is the larger L at its two ends; they are expanded to rows.
4. Members, leaves and saved words of an interval are differences of prefix sums over the sorted conversations: member j > first saves the words
   it shares with its predecessor. The smallest member is a range minimum, within a block by doubling, between blocks by block minima.

The driver and the broadcasts see some numbers a block, nothing that is a conversation. A block's work is bounded by its rows; equal conversations are cut
between blocks by their ids, so a hot conversation or first turn fills no block.

Defined results: rows without a conv_id are no conversation; null roles and texts are empty ones; turns go by ``turn``, null first, equal ones by role and
text, and repeated rows are repeated turns; very long texts are hashed whole; a conversation is one row of 24 bytes a turn;
members without turns end at the root; an empty table has no nodes, not even a root; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, n_words, stored

NEAREST = "block long, at long, v int, n int, l long, r long, lo long, left_stair boolean, left_lo long, right_stair boolean, right_lo long"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text): every turn with its place from 1."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("depth"), "role", "text")


def hashed(ordered: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, words) of ``ordered(conv_id, depth, role, text)``: two hashes stand for a turn."""
    return ordered.select("conv_id", "depth", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), n_words(F.col("text")).alias("words"))


def with_shared_heads(rows: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows in which every conversation c takes its first h turns from conversation c - c % ``group``, h = crc32(c) % ``heads``; and the stored table of all conversation ids.

    A first conversation that is absent gives no turns, one with fewer turns gives all; c's own turns after its first h follow.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    members = stored(rows.groupBy("conv_id").agg(F.count("*").cast("int").alias("n")), "members")
    asked = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("h"))
    known = asked.join(members.select(F.col("conv_id").alias("base"), F.col("n").alias("has")), "base", "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0))))
    first = rows.where(F.col("depth") < heads).withColumnRenamed("conv_id", "base")
    taken = known.where("given > 0").join(first, "base").where("depth <= given").select("conv_id", "depth", "a", "b", "words")
    own = rows.join(known.select("conv_id", "h", "given"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("given")).alias("depth"), "a", "b", "words")
    return taken.unionAll(own), members


def common(x: Column, y: Column) -> Column:
    """How many first elements two arrays share; -1 where there is no other array."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    return F.when(x.isNull() | y.isNull(), F.lit(-1)).otherwise(F.when(differs > 0, differs - 1).otherwise(F.size(x)))


def sorted_sequences(rows: DataFrame, members: DataFrame, blocks: int | None) -> DataFrame:
    """(pos, conv_id, key, totals) in blocks; pos has the block above 33 bits and the place in it below; totals[k] are the words of the first k turns."""
    order = Window.partitionBy("conv_id").orderBy("depth")
    summed = rows.select("conv_id", "depth", "a", "b", F.sum("words").over(order).alias("total"))
    gathered = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "total"))).alias("s"))
    known = members.select("conv_id").distinct().join(gathered, "conv_id", "left")
    key = F.coalesce(F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    totals = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(F.transform("s", lambda x: x["total"]), F.array().cast("array<bigint>")))
    seqs = known.select("conv_id", key.alias("key"), totals.alias("totals"))
    dealt = seqs.repartitionByRange(blocks, "key", "conv_id") if blocks else seqs.repartitionByRange("key", "conv_id")
    return dealt.sortWithinPartitions("key", "conv_id").withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", 33))


def places(seqs: DataFrame) -> DataFrame:
    """(block, at, conv_id, n, lcp, nxt, totals, leafs, shared): every conversation's place, L before and after it, and sums within the block before it."""
    edges = seqs.groupBy("block").agg(F.count("*").alias("rows"), F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
    along = Window.partitionBy(F.lit(0)).orderBy("block")  # a row for each block
    known = edges.select("block", (F.sum("rows").over(along) - F.col("rows")).alias("start"), common(F.lag("last").over(along), F.col("first")).alias("in"), common(F.col("last"), F.lead("first").over(along)).alias("out"))
    w = Window.partitionBy("block").orderBy("pos")
    rows = seqs.join(F.broadcast(known), "block")
    met = rows.select("*", F.size("key").alias("n"), F.lag("key").over(w).alias("before"))
    met = met.select("block", "pos", "conv_id", "n", "totals", "out", (F.col("start") + F.row_number().over(w) - 1).alias("at"), F.when(F.col("before").isNull(), F.col("in")).otherwise(common(F.col("before"), F.col("key"))).alias("lcp"))
    met = met.withColumn("nxt", F.coalesce(F.lead("lcp").over(w), F.col("out")))
    met = met.withColumns({"leaf": (F.col("nxt") < F.col("n")).cast("long"), "saved": F.get("totals", F.greatest("lcp", F.lit(0)))})
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    return met.select("block", "at", "conv_id", "n", "lcp", "nxt", "totals", "leaf", "saved", F.coalesce(F.sum("leaf").over(so_far), none).alias("leafs"), F.coalesce(F.sum("saved").over(so_far), none).alias("shared"))


def least_between(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Minima of x[a:z], none of them empty, by doubling."""
    tables, width = [x], 1
    while 2 * width <= len(x):
        tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
        width *= 2
    level = np.frexp((z - a).astype(float))[1] - 1
    out = np.empty(len(a), x.dtype)
    for k in np.unique(level):
        of = level == k
        out[of] = np.minimum(tables[k][a[of]], tables[k][z[of] - (1 << k)])
    return out


def nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """Nearest smaller values of one block; null where they lie outside. ``lo``: the least conversation from there to there, within the block."""
    rows = rows.sort_values("at", ignore_index=True)
    v, conv, size = rows["lcp"].to_numpy(), rows["conv_id"].to_numpy(), len(rows)
    values, left, right, stack = v.tolist(), [-1] * size, [size] * size, []
    for i, x in enumerate(values):
        while stack and values[stack[-1]] > x:
            right[stack.pop()] = i
        if stack:
            left[i] = left[stack[-1]] if values[stack[-1]] == x else stack[-1]
        stack.append(i)
    left, right = np.array(left), np.array(right)
    lo = least_between(conv, np.maximum(left, 0), right)
    start = int(rows["at"].iloc[0])
    later = np.append(np.minimum.accumulate(v[::-1])[::-1][1:], np.iinfo(np.int32).max)
    earlier = np.append(np.iinfo(np.int32).max, np.minimum.accumulate(v)[:-1])
    before = pd.Series(np.append(0, np.minimum.accumulate(conv)[:-1]), dtype="Int64").mask(np.arange(size) == 0)
    whole = lambda x, open_: pd.Series(x + start, dtype="Int64").mask(open_)
    return pd.DataFrame({"block": rows["block"], "at": rows["at"], "v": v, "n": rows["n"], "l": whole(left, left < 0), "r": whole(right, right == size), "lo": lo,
                         "left_stair": v < later, "left_lo": np.minimum.accumulate(conv[::-1])[::-1], "right_stair": v < earlier, "right_lo": before})


def beyond(near: DataFrame, blocks: pd.DataFrame, left: bool) -> DataFrame:
    """(block, v, end, far): where the intervals of value v that leave a block end, and their least conversation outside it.

    ``blocks(block, least, lo)`` are the block minima, sorted.
    """
    ids, least, lows = (blocks[c].to_numpy() for c in ("block", "least", "lo"))
    most = np.iinfo(np.int64).max

    def crossed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, v in zip(np.searchsorted(ids, b["block"].to_numpy()).tolist(), b["v"].tolist()):
                smaller = np.flatnonzero((least[:k] if left else least[k + 1:]) < v)
                hit = None if not len(smaller) else int(smaller[-1]) if left else k + 1 + int(smaller[0])
                between = lows[(-1 if hit is None else hit) + 1:k] if left else lows[k + 1:len(ids) if hit is None else hit]
                out.append((None if hit is None else int(ids[hit]), int(between.min()) if len(between) else most))
            yield pd.DataFrame({"block": b["block"], "v": b["v"], "target": pd.Series([o[0] for o in out], dtype="Int64"), "mid": [o[1] for o in out]})

    side, stair, lo = ("l", "left_stair", "left_lo") if left else ("r", "right_stair", "right_lo")
    asked = near.where(F.col(side).isNull() & (F.col("v") >= 0)).select("block", "v").distinct().mapInPandas(crossed, "block long, v int, target long, mid long")
    stairs = near.where(stair).select(F.col("block").alias("target"), F.col("v").alias("step"), "at", F.coalesce(lo, F.lit(most)).alias("lo"))
    met = asked.join(stairs, "target").where("step < v").groupBy("block", "v").agg(*((F.max("at").alias("end"), F.max_by("lo", "at").alias("lo")) if left else (F.min("at").alias("end"), F.min_by("lo", "at").alias("lo"))))
    return asked.join(met, ["block", "v"], "left").select("block", "v", "end", F.least("mid", F.coalesce("lo", F.lit(most))).alias("far"))


def streamed_digests(batches: Iterable) -> Iterator:
    """SHA-256 of the comma-joined pieces of each l, of rows (l, piece) that come in order."""
    now, digest = None, None
    for b in batches:
        done = []
        for at, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if at != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = at, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["l", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["l", "ends"])


def ends_of(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """(l, ends): digests of the ids of equal conversations, of which the first stands at l. A block's ids go as one piece."""
    equal = entries.where("v = n").select("l", "block", "at")
    pieces = (equal.join(placed.select("at", "conv_id"), "at").groupBy("l", "block")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece")))
    first = equal.select("l").distinct().join(placed.select(F.col("at").alias("l"), F.col("conv_id").cast("string").alias("piece")), "l")
    both = pieces.unionAll(first.select("l", F.lit(-1).cast("long").alias("block"), "piece"))
    return both.repartition("l").sortWithinPartitions("l", "block").select("l", "piece").mapInArrow(streamed_digests, "l long, ends string")


def prefix_trie(rows: DataFrame, members: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): every node of the trie of ``rows(conv_id, depth, a, b, words)``.

    ``members(conv_id)`` may name conversations without turns; ``blocks``: range partitions, else as many as Spark chooses. conv_id and depth
    name a node: the smallest member, whose turn at that depth is the node's (``last_turns`` gives it). saved_tokens: words that a cache of
    prefixes saves below and at the node. ends_sha256: the digest of the ids of members that end there, ascending, comma-joined.
    """
    members = rows.select("conv_id") if members is None else members
    seqs = stored(sorted_sequences(rows, members, blocks), "sequences")
    placed = stored(places(seqs), "places")
    sums = placed.groupBy("block").agg(F.min("lcp").alias("least"), F.min("conv_id").alias("lo"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.count("*").alias("rows")).orderBy("block").toPandas()  # some numbers a block
    near = stored(placed.select("block", "at", "conv_id", "n", "lcp").groupBy("block").applyInPandas(nearest, NEAREST), "nearest")
    n_all = int(sums["rows"].sum())
    west, east = beyond(near, sums, True), beyond(near, sums, False)
    open_ = (near.where("v >= 0").join(west.select("block", "v", F.col("end").alias("wl"), F.col("far").alias("wlo")), ["block", "v"], "left")
             .join(east.select("block", "v", F.coalesce("end", F.lit(n_all)).alias("er"), F.col("far").alias("elo")), ["block", "v"], "left"))
    entries = stored(open_.select("block", "at", "v", "n", F.coalesce("l", "wl").alias("l"), F.coalesce("r", "er").alias("r"),
                                  F.least("lo", F.when(F.col("l").isNull(), F.col("wlo")), F.when(F.col("r").isNull(), F.col("elo"))).alias("lo")), "entries")
    offsets = placed.sparkSession.createDataFrame(
        [(int(b), int(x), int(y)) for b, x, y in zip(sums["block"], sums["leaf"].cumsum() - sums["leaf"], sums["saved"].cumsum() - sums["saved"])], "block long, leafs0 long, shared0 long")
    spots = placed.join(F.broadcast(offsets), "block").select("at", "conv_id", "n", "lcp", "nxt", "totals", "saved", (F.col("leafs") + F.col("leafs0")).alias("leafs"), (F.col("shared") + F.col("shared0")).alias("shared"))

    merged = entries.groupBy("l", "v").agg(F.max("r").alias("r"), F.min("lo").alias("conv_id"), F.sum((F.col("n") > F.col("v")).cast("long")).alias("kids"))
    here = spots.select(F.col("at").alias("l"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("alone"), F.col("n").alias("n_l"), F.col("lcp").alias("lcp_l"), "totals", F.col("leafs").alias("leafs_l"), (F.col("shared") + F.col("saved")).alias("shared_l"))
    there = spots.select(F.col("at").alias("r"), F.col("lcp").alias("lcp_r"), F.col("leafs").alias("leafs_r"), F.col("shared").alias("shared_r"))
    many = merged.join(here, "l").join(there, "r", "left").select(
        "l", "alone", "r", "v", "conv_id", "totals", "lcp_l", F.coalesce("lcp_r", F.lit(-1)).alias("lcp_r"), (F.col("kids") + (F.col("n_l") > F.col("v")).cast("long")).alias("kids"),
        (F.coalesce("leafs_r", F.lit(int(sums["leaf"].sum()))) - F.col("leafs_l")).alias("n_leaves"), (F.coalesce("shared_r", F.lit(int(sums["saved"].sum()))) - F.col("shared_l")).alias("shared"), (F.col("n_l") == F.col("v")).alias("ended"))
    digests = ends_of(entries, placed)
    many = many.join(digests, "l", "left").withColumn("ends", F.coalesce("ends", "alone"))
    one = spots.where("n > greatest(lcp, nxt)").select(
        F.col("at").alias("l"), (F.col("at") + 1).alias("r"), F.col("n").alias("v"), "conv_id", "totals", F.col("lcp").alias("lcp_l"), F.col("nxt").alias("lcp_r"), F.lit(0).cast("long").alias("kids"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("shared"), F.lit(True).alias("ended"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends"))
    nodes = many.select(*one.columns).unionAll(one).withColumn("u", F.greatest("lcp_l", "lcp_r"))
    above = entries.select(F.col("at").alias("up"), F.col("lo").alias("parent"))
    nodes = nodes.withColumn("up", F.when(F.col("u") >= 0, F.when(F.col("lcp_l") >= F.col("lcp_r"), F.col("l")).otherwise(F.col("r")))).join(above, "up", "left")
    steps = F.transform(F.sequence(F.col("u") + 1, F.col("v")), lambda d: F.struct(d.alias("depth"), F.get("totals", F.greatest(d - 1, F.lit(0))).alias("t")))
    wide = nodes.select("conv_id", "parent", "u", "v", (F.col("r") - F.col("l")).alias("n_convs"), "kids", "n_leaves", "shared", "ended", "ends", F.explode(steps).alias("s"))
    last = F.col("s.depth") == F.col("v")
    out = stored(wide.select(
        "conv_id", F.col("s.depth").cast("long").alias("depth"), F.when(F.col("s.depth") == F.col("u") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("shared") - (F.col("n_convs") - 1) * F.col("s.t")).alias("saved_tokens"),
        F.when(last & F.col("ended"), F.col("ends")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie")
    for made in (seqs, placed, near, entries):
        drop_stored(made)
    return out


def last_turns(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each node's last turn, from ``ordered(conv_id, depth, role, text)``; the root has none."""
    return nodes.join(ordered.select("conv_id", F.col("depth").cast("long").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
