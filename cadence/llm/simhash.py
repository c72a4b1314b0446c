"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance d <= 2r share a word within r of both, so every
fingerprint emits all its variants within r = radius/2 and equal variants meet. One
shuffled row stands for all the variants that agree in the *prefix* bits: it is keyed by
the prefix with 0..r of its bits flipped and carries the flips still allowed in the
suffix. Each prefix group then expands its suffix variants in blocks and links
those that are equal. Prefix length follows the number of fingerprints, so a group
stays about ``GROUP_VARIANTS`` variants large whatever the input; a group that many
near copies make larger than ``HOT_VARIANTS`` is dealt by ``DEAL_BITS`` more bits, again and again, before any task sees it.

Equal variants within ``r`` prove a distance within 2r, and the distance of every link is
computed again. Exact copies meet before in one fingerprint. Groups emit a spanning
forest rather than pairs; components() joins the forests.

Defined results: null and blank texts have fingerprint zero and are linked like any
other; repeated rows are returned each; a null doc_id takes part but never names
a component unless all ids of the component are null; texts are read whole, however long; a bit set in exactly half of the
hashes is not set; other columns are not read, so names cannot clash; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, free_name, slices, small_enough, stored

GROUP_VARIANTS = 2_000_000
HOT_VARIANTS, DEAL_BITS = 16_000_000, 10
SALTS = 64  #: parts in which rows of one fingerprint are chained
BLOCK = 1 << 22
BROADCAST_IDS = 500_000
FEW_PAIRS = 200_000  #: candidates that are verified at once
SAMPLE = 4000  #: texts that tell which shingles are frequent
PART_ENTRIES = 500_000  #: shingles of prefixes that one group looks through
PROOF_BITS = 20  #: of 64: pairs of similarity 0.8 differ in 9.7 on average, strangers in 32


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 of all word shingles of an ASCII-lower-cased text."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(found[i:i + shingle]), seed) for i in range(n)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the signed 64 bits of every row's fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def flips(bits: int, most: int) -> dict[int, np.ndarray]:
    """XOR masks over ``bits`` low bits, by the number of bits they flip."""
    return {n: np.array([sum(1 << i for i in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)}


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles of an ASCII-lower-cased text, sorted; a shorter text is one shingle, a blank one none."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i:i + shingle]), 42) for i in range(n)), np.uint64, n))


def signature(text: bytes | None, shingle: int, tables: int, width: int) -> np.ndarray:
    """``tables`` independent fingerprints of ``width`` bits: majorities of the bits of mixed hashes of the distinct shingles."""
    return signature_of(shingle_set(text, shingle), tables, width)


def signature_of(h: np.ndarray, tables: int, width: int) -> np.ndarray:
    """``signature`` of a set of shingle hashes."""
    out = np.zeros(tables, np.int64)
    n = len(h)
    if not n:
        return out
    words = -(-tables * width // 64)
    bits = np.zeros(words * 64, np.int64)
    for i in range(0, n, 1 << 13):
        x = h[i:i + (1 << 13)]
        for w in range(words):
            bits[w * 64:w * 64 + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            # A bijection whose output bits are independent of its input's to the eye.
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    major = bits * 2 > n
    for t in range(tables):
        own = np.zeros(64, bool)
        own[:width] = major[t * width:(t + 1) * width]
        out[t] = np.packbits(own, bitorder="little").view(np.int64)[0]
    return out


def prefix_bits(n: int, radius: int, width: int = 64) -> int:
    """Prefix length at which an average group expands to about GROUP_VARIANTS."""
    r = radius // 2
    ball = sum(len(x) for x in flips(width, r).values())
    return int(min(24, max(4, np.ceil(np.log2(max(1, n * ball / GROUP_VARIANTS))))))


def met(fps: np.ndarray, left: np.ndarray, suffix: int, r: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (a, b) of members of one prefix group that are neighbours in a list of equal suffix variants; ``left`` = flips each may still spend."""
    mask = np.uint64((1 << suffix) - 1)
    masks = flips(suffix, r)
    # Blocks of the suffix space bound what is expanded at a time: top bits of a variant, mixed.
    total = sum(int((left >= n).sum()) * len(m) for n, m in masks.items())
    parts = max(1, -(-total // BLOCK))
    for part in range(parts):
        values, owners = [], []
        for n, m in masks.items():
            own = np.flatnonzero(left >= n)
            step = max(1, BLOCK // max(1, len(m)))
            for i in range(0, len(own), step):
                o = own[i:i + step]
                v = ((fps[o] & mask)[:, None] ^ m[None, :]).ravel()
                o = np.repeat(o, len(m))
                if parts > 1:
                    here = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == part
                    v, o = v[here], o[here]
                values.append(v)
                owners.append(o.astype(np.int32))
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[same], o[same + 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        yield a[near], b[near]


def local_forest(fps: np.ndarray, left: np.ndarray, suffix: int, r: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the members of one prefix group, found by equal suffix variants."""
    root = np.arange(len(fps))

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if np.array_equal(up, x):
                return x
            x = root[up]

    for a, b in met(fps, left, suffix, r, radius):
        while len(a):  # hang the larger root on the smaller until all links are inside one tree
            ra, rb = find(a), find(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
    root = find(root)
    hung = np.flatnonzero(root != np.arange(len(fps)))
    return hung, root[hung]


def local_pairs(fps: np.ndarray, left: np.ndarray, suffix: int, r: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of one prefix group that met, of such pairs alone and the closest of them; each is within the radius itself."""
    n = max(1, len(fps))
    found = [np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b)) for a, b in met(fps, left, suffix, r, radius)]
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    a, b = every // n, every % n
    order = np.argsort(np.bitwise_count(fps[a] ^ fps[b]), kind="stable")
    return spanning(a[order], b[order], len(fps))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of ``n`` nodes those that join trees, the earlier before the later: every tree takes its first pair to another, until none is left."""
    root, kept = np.arange(n), [np.zeros(0, np.int64)]
    while True:
        ra, rb = root[a], root[b]
        at = np.flatnonzero(ra != rb)
        if not len(at):
            at = np.unique(np.concatenate(kept))
            return a[at], b[at]
        ends, pair = np.concatenate([ra[at], rb[at]]), np.concatenate([at, at])
        order = np.lexsort((pair, ends))
        first = np.flatnonzero(np.append(True, np.diff(ends[order]) != 0))
        chosen = np.unique(pair[order][first])
        kept.append(chosen)
        while True:  # the least root of each joined tree spreads over it
            ra, rb = root[a[chosen]], root[b[chosen]]
            if np.array_equal(ra, rb):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root[root], root):
                root = root[root]


DEALT = "key long, done int, left byte, node long, fp long"


def near(df: DataFrame) -> DataFrame:
    """Marked for broadcast where it has few rows; else joins shuffle."""
    return F.broadcast(df) if small_enough(df, BROADCAST_IDS) else df


def keyed(nodes: DataFrame, r: int, width: int, bits: int) -> DataFrame:
    """Rows (key, done, left, node, fp) of ``nodes(node, t, fp)``: one for each way to flip up to r of the first ``bits`` bits."""
    by_count = flips(bits, r)
    masks = np.concatenate([m << np.uint64(width - bits) for m in by_count.values()])
    left = np.concatenate([np.full(len(m), r - n, np.int8) for n, m in by_count.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            rep = np.repeat(np.arange(b.num_rows), len(masks))
            fp, t = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            prefix = ((fp[:, None] ^ masks[None, :]) >> np.uint64(width - bits)).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prefix | (t[rep] << 32)), pa.array(np.full(len(rep), bits, np.int32)), pa.array(np.tile(left, len(fp))), b.column(0).take(pa.array(rep)), pa.array(fp.view(np.int64)[rep])],
                                             ["key", "done", "left", "node", "fp"])

    return nodes.select("node", "t", "fp").mapInArrow(run, DEALT)


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """Rows of one hot group each by the next bits, with every flip that they have left; the key is hashed with those bits (links are verified, so a collision costs time only)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            done, left = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            key, fp = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 4))
            for d in np.unique(done):
                bits = int(min(DEAL_BITS, width - d))
                for n in np.unique(left):
                    at = np.flatnonzero((done == d) & (left == n))
                    for flipped, m in flips(bits, int(min(n, bits))).items():
                        i = np.repeat(at, len(m))
                        part = ((fp[i] >> np.uint64(width - d - bits)) & np.uint64((1 << bits) - 1)) ^ np.tile(m, len(at))
                        mixed = ((key[i] ^ (part + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)) ^ (key[i] >> np.uint64(29))
                        yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(np.full(len(i), d + bits, np.int32)), pa.array(np.full(len(i), n - flipped, np.int8)), b.column(3).take(pa.array(i)), pa.array(fp.view(np.int64)[i])],
                                                         ["key", "done", "left", "node", "fp"])

    return rows.mapInArrow(run, DEALT)


def variants_of(width: int, most: int) -> Column:
    """How many suffix variants a row stands for."""
    out = F.lit(0.0)
    for done in range(width + 1):
        for left in range(most + 1):
            out = F.when((F.col("done") == done) & (F.col("left") == left), float(sum(comb(width - done, n) for n in range(left + 1)))).otherwise(out)
    return out


def groups(nodes: DataFrame, radius: int, width: int, hot_variants: int | None = None) -> DataFrame:
    """Rows of ``keyed`` in groups (key, done) that no family of near copies makes larger than about ``hot_variants`` variants."""
    if radius < 2 or radius % 2:
        raise ValueError("radius must be even and 2 at least")
    r, limit = radius // 2, HOT_VARIANTS if hot_variants is None else hot_variants
    most = nodes.groupBy("t").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]  # tables have groups of their own
    rows = keyed(nodes, r, width, prefix_bits(most, radius, width))
    while True:
        size = rows.groupBy("key", "done", "left").count().withColumn("v", F.col("count") * variants_of(width, r)).groupBy("key", "done").agg(F.sum("v").alias("v"))
        hot = stored(size.where((F.col("v") > limit) & (F.col("done") < width)).select("key", "done"), "hot-groups")
        if hot.isEmpty():
            return rows
        rows = rows.join(near(hot), ["key", "done"], "left_anti").unionByName(dealt(rows.join(near(hot), ["key", "done"], "left_semi").select("key", "done", "left", "node", "fp"), width))


def links(nodes: DataFrame, radius: int = 4, width: int = 64, hot_variants: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose forests connect all of ``nodes(node, t, fp)`` at ``radius`` or less in a table t; fingerprints are distinct in each."""
    r = radius // 2

    def meet(t: pa.Table) -> pa.Table:
        node, suffix = t.column("node").to_numpy(), width - t.column("done")[0].as_py()
        fp, first = np.unique(t.column("fp").to_numpy().view(np.uint64), return_index=True)
        a, b = local_forest(fp, t.column("left").to_numpy()[first], suffix, r, radius)
        return pa.table({"a": node[first[a]], "b": node[first[b]]})

    return groups(nodes, radius, width, hot_variants).groupBy("key", "done").applyInArrow(meet, "a long, b long").distinct()


def candidate_pairs(nodes: DataFrame, radius: int, width: int, hot_variants: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of ``nodes(node, t, fp, proof)`` that meet in a table t and whose proofs are no more than PROOF_BITS apart.

    Nodes of one fingerprint are chained in ``SALTS`` parts and the parts among themselves; the first of them meets the other fingerprints for all.
    Order and part are those of the node in every table, so that a family of near copies gives few different pairs: its members have as neighbours
    the next of those that share the table's fingerprint.
    """
    r = radius // 2
    lead = stored(nodes.groupBy("t", "fp").agg(F.min("node").alias("node"), F.max("node").alias("last")), "first-of-fingerprints")
    # Most fingerprints have one node, which needs no chain.
    mine = nodes.join(near(lead.where("node < last").select("t", "fp")), ["t", "fp"]).withColumns({"order": F.xxhash64("node"), "salt": F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(SALTS))})
    first = mine.groupBy("t", "fp", "salt").agg(F.min(F.struct("order", "node", "proof")).alias("x"), F.count("*").alias("n"))
    before = lambda c, *by: F.lag(c).over(Window.partitionBy(*by).orderBy("order"))
    chained = mine.withColumns({"b": before("node", "t", "fp", "salt"), "q": before("proof", "t", "fp", "salt")}).select(F.col("node").alias("a"), "b", F.col("proof").alias("p"), "q")
    parts = first.select("t", "fp", "x.*")
    chained = chained.unionByName(parts.withColumns({"b": before("node", "t", "fp"), "q": before("proof", "t", "fp")}).select(F.col("node").alias("a"), "b", F.col("proof").alias("p"), "q"))

    def meet(t: pa.Table) -> pa.Table:
        node, suffix = t.column("node").to_numpy(), width - t.column("done")[0].as_py()
        fp, first = np.unique(t.column("fp").to_numpy().view(np.uint64), return_index=True)
        a, b = local_pairs(fp, t.column("left").to_numpy()[first], suffix, r, radius)
        return pa.table({"a": node[first[a]], "b": node[first[b]]})

    met_ = groups(lead, radius, width, hot_variants).groupBy("key", "done").applyInArrow(meet, "a long, b long").distinct()
    proofs = nodes.where("t = 0")
    near_ = (met_.join(proofs.select(F.col("node").alias("a"), F.col("proof").alias("p")), "a").join(proofs.select(F.col("node").alias("b"), F.col("proof").alias("q")), "b").select("a", "b", "p", "q"))
    both = chained.where("b is not null").unionByName(near_).where((F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= PROOF_BITS) & (F.col("a") != F.col("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cluster(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id): least doc_id that each fingerprint of ``fps(doc_id, fp)`` reaches."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.coalesce("least", F.xxhash64("fp"))), "fps")
    found = components(links(nodes.withColumn("t", F.lit(0)), radius))
    named = nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("c"))
    best = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return named.join(best, "c").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    fps = stored(with_fingerprint(docs, shingle, id_col, text_col), "simhash")
    return (fps.join(cluster(fps, radius), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that hold a spanning forest of all ``pairs(a, b)`` whose shingle sets have the Jaccard similarity or more.

    ``texts(doc_id, text)``. Where pairs are many, those that a spanning forest needs come first: one for each
    group, then one for each two groups that are left, then all between groups that are still apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])

    def holds(some: DataFrame) -> DataFrame:
        both = some.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    sets = stored(texts.join(near(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, s array<long>"), "shingle-sets")
    if small_enough(pairs, FEW_PAIRS):
        return holds(pairs)
    good = None
    open_ = pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    for by in (["hi"], ["lo", "hi"], None):
        some = open_.select("a", "b", F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"))
        if by:
            some = some.groupBy(*by).agg(F.min(F.struct("lo", "a", "b")).alias("x")).select("x.a", "x.b")
        tried = stored(some.select("a", "b"), "tried-pairs")
        held = holds(tried)
        good = stored(held if good is None else good.unionByName(held), "verified-pairs")
        if by is None:
            return good
        group = stored(components(good), "verified-groups")
        name = lambda c: near(group.select(F.col("node").alias(c), F.col("component").alias(f"g{c}")))
        left = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").join(tried, ["a", "b"], "left_anti")
        left = left.select("a", "b", F.coalesce("ga", "a").alias("ca"), F.coalesce("gb", "b").alias("cb")).where("ca <> cb")
        open_ = stored(left, "open-pairs")
        if open_.isEmpty():
            return good


def often_met(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about SAMPLE texts hold, sorted, and in how many. They only tell which shingles to look at last; no result depends on them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["s"])

    share = int(np.ceil(SAMPLE / max(SAMPLE, rows.count()) * (1 << 20)))
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share).select("text").mapInArrow(run, "s long")
    found = some.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").toArrow()
    known = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], found.column("n").to_numpy()[order]


def prefix(h: np.ndarray, known: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in one order of all shingles, rare ones first: so many that two sets of the Jaccard ``similarity`` or more have one in common."""
    if not len(h):
        return h
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    n = np.where(known[at] == h, often[at], 0) if len(known) else np.zeros(len(h), np.int64)
    return h[np.lexsort((h, n))[:len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]]


def parity(h: np.ndarray) -> bytes:
    """Of how many hashes of a set fall on each bit, whether it is odd; bits are a power of two, one for each hash at least."""
    bits = max(64, 1 << int(np.ceil(np.log2(max(1, 1.5 * len(h))))))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """How many elements two sets of these parities differ in at least: every bit that differs takes one. The longer is folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def close_enough(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows of ``pairs(a, b, ca, cb)`` but those whose parities in ``sets(doc_id, size, parity)`` rule out the Jaccard ``similarity``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            most = (b.column(4).to_numpy() + b.column(5).to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            apart = np.fromiter(map(least_apart, b.column(6).to_pylist(), b.column(7).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "b", "ca", "cb"]).filter(pa.array(apart <= most))

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("size").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", "na", "nb", "pa", "pb")
    return both.mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def missed_pairs(sets: DataFrame, similarity: float, entries: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of ``sets(node, component, size, prefix)`` in different components that may have the Jaccard ``similarity``: no other pair can.

    Such sets share a shingle of both prefixes, their sizes are alike, and what follows the first shared shingle is long enough for the overlap.
    The prefixes have about ``entries`` shingles; they travel once, packed, to groups that keep the shingles of several components.
    """
    parts = max(1, -(-entries // PART_ENTRIES))
    kinds = {"s": np.int64, "node": np.int64, "component": np.int64, "size": np.int32, "at": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            found = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            own = np.repeat(np.arange(len(n)), n)
            s = np.concatenate([np.zeros(0, np.int64), *found])
            part = (s.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            of, edge = np.unique(part[order], return_index=True)
            cols = [s[order], *(b.column(i).to_numpy()[own][order] for i in range(3)), (np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n))[order]]
            packed = [pa.array([x.astype(k).tobytes() for x in np.split(c, edge[1:])] if len(of) else [], pa.binary()) for c, k in zip(cols, kinds.values())]
            yield pa.RecordBatch.from_arrays([pa.array(of), *packed], ["part", *kinds])

    def several(t: pa.Table) -> pa.Table:
        cols = [np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in kinds.items()]
        order = np.argsort(cols[0], kind="stable")
        s, component = cols[0][order], cols[2][order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        mixed = np.minimum.reduceat(component, first) < np.maximum.reduceat(component, first)
        kept = order[np.repeat(mixed, np.diff(np.append(first, len(s))))]
        return pa.table({c: x[kept] for c, x in zip(kinds, cols)})

    packed = sets.select("node", "component", "size", "prefix").mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in kinds))
    kept = stored(packed.groupBy("part").applyInArrow(several, "s long, node long, component long, size int, at int"), "shared-prefixes")
    side = lambda x: kept.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "size", "at")])
    rest = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    both = side("a").join(side("b"), "s").where(
        (F.col("a_component") != F.col("b_component")) & (F.struct("a_size", "a_node") < F.struct("b_size", "b_node")) & (F.col("a_size") >= F.col("b_size") * similarity - 1e-9)
        & (rest >= (F.col("a_size") + F.col("b_size")) * (similarity / (1 + similarity)) - 1e-6))
    return both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_component").alias("ca"), F.col("b_component").alias("cb")).distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, tables: int = 28, width: int = 32, radius: int = 2, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with an id: groups linked by pairs whose sets of shingles have a Jaccard ``similarity`` or more.

    One 64-bit fingerprint within 4 bits finds only pairs that are almost equal. Pairs that any of several shorter
    fingerprints brings together are candidates: 28 of 32 bits within 2 find, by the binomial law of differing bits, over
    99.9 % of pairs of similarity 0.9, 99.8 % at 0.85 and 97 % at 0.8. Each candidate is then verified by its texts' shingles.
    What fingerprints, chains and forests leave out is found exactly: pairs of different groups that share a shingle of their ``prefix`` are verified, too,
    but those whose ``parity`` tells that they differ in too much.
    """
    words = -(-64 // width)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(often_met(rows, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            made = [signature_of(h, tables + words, width).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()),
                                              pa.array([prefix(h, known, often, similarity).tobytes() for h in sets], pa.binary()), pa.array(map(parity, sets), pa.binary())], ["doc_id", "sign", "digest", "size", "prefix", "parity"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            made = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, tables + words)
            proof = made[:, tables].copy()
            for w in range(1, words):
                proof |= made[:, tables + w] << (w * width)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(made), t, np.int32)), pa.array(made[:, t]), pa.array(proof)], ["node", "t", "fp", "proof"])

    signed = stored(rows.mapInArrow(run, "doc_id long, sign binary, digest binary, size int, prefix binary, parity binary"), "signatures")
    # Rows of one whole signature are one node, named by the least doc_id.
    whole = stored(signed.groupBy("sign").agg(F.min("doc_id").alias("node")), "signature-nodes")
    nodes = stored(whole.select("node", "sign").mapInArrow(unpack, "node long, t int, fp long, proof long"), "signature-words")
    pairs = stored(candidate_pairs(nodes, radius, width), "candidate-pairs")
    drop_stored(nodes)
    found = components(verified(pairs, rows, shingle, similarity))
    named = whole.join(found, "node", "left").select("sign", F.coalesce("component", "node").alias("component"))
    grouped = stored(signed.join(named, "sign").select("doc_id", "component", "digest", "size"), "first-groups")
    # Each set once in each group: equal sets share all links.
    sets = grouped.groupBy("digest", "component").agg(F.min("doc_id").alias("doc_id")).join(signed.select("doc_id", "digest", "size", "prefix"), ["doc_id", "digest"])
    entries = signed.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    missed = stored(close_enough(missed_pairs(sets.withColumnRenamed("doc_id", "node"), similarity, entries), signed, similarity), "missed-pairs")
    if missed.isEmpty():
        return grouped.select("doc_id", F.col("component").alias("component_id"))
    more = verified(missed.select("a", "b"), rows, shingle, similarity)
    joined = components(missed.join(more, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select("node", F.col("component").alias("last"))
    return grouped.join(joined, F.col("component") == F.col("node"), "left").select("doc_id", F.coalesce("last", "component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, tables: int = 28, width: int = 32, radius: int = 2, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, that of the least doc_id, of each group of near-duplicates; all columns stay.

    Only ids travel: the losers are broadcast if few, else anti-joined. Rows with a null
    doc_id cannot be named as members of a group and stay; rows that repeat a doc_id are one document.
    """
    own, = free_name(docs, "__loser")
    found = stored(similar_groups(docs, shingle, tables, width, radius, similarity, id_col, text_col), "groups")
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    near = F.broadcast(losers) if small_enough(losers, BROADCAST_IDS) else losers
    out = docs.join(near, F.col(id_col).cast("long") == F.col(own), "left_anti")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(own))
    if twice.isEmpty():
        return out
    repeated = out.join(twice, F.col(id_col).cast("long") == F.col(own), "left_semi").dropDuplicates([id_col])
    return out.join(twice, F.col(id_col).cast("long") == F.col(own), "left_anti").unionByName(repeated)
