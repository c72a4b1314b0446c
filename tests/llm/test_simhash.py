import numpy as np
import xxhash

from cadence.llm import simhash

from .cases import awkward, none


def brute(fps, ids, radius):
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(fps)):
        known = [ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None]
        out[i] = min(known) if known else None
    return out


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "A b\tc d  e f"
    hashes = [xxhash.xxh64_intdigest(" ".join(w), 42) for w in zip(*[text.lower().split()[i:] for i in range(4)])]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 4) == want
    assert simhash.fingerprint(b"one two", 4) == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(b" \n", 4) == 0


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(40):  # chains, dense balls and strangers
        base = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 12))):
            fps.append(base)
            for _ in range(int(rng.integers(0, 4))):
                base ^= 1 << int(rng.integers(0, 64))
    fps = list(dict.fromkeys(fps))
    rows = [(int(np.uint64(f).view(np.int64)), i + 1) for i, f in enumerate(fps)]
    got = {r.fp: r.component_id for r in simhash.cluster(spark.createDataFrame([(n, f) for f, n in rows], "doc_id long, fp long"), 4).collect()}
    want = brute(fps, [n for _, n in rows], 4)
    assert {f: got[f] for f, _ in rows} == {rows[i][0]: want[i] for i in want}


def test_blocks_do_not_change_the_forest(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 56, 30)]))
    left = np.full(len(fps), 2)
    whole = simhash.local_forest(fps, left, 56, 2, 4)
    monkeypatch.setattr(simhash, "BLOCK", 5000)
    parts = simhash.local_forest(fps, left, 56, 2, 4)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 10
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got[1] == got[2] and got[2][1] == 1
    assert got[3] == got[4] == got[5] == ("0" * 16, 3)
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 6, 7, 8]


def test_several_short_fingerprints_find_edited_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.integers(0, 3000))}"
    docs, parent = [], {}
    for i in range(60):
        base = [word() for _ in range(200)]
        docs.append(" ".join(base))
        if i < 30:  # one word changed: similarity 0.95
            base[int(rng.integers(0, 200))] = "changed"
            parent[len(docs)] = len(docs) - 1
            docs.append(" ".join(base))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert sum(got[i] == p for i, p in parent.items()) >= 28
    assert all(got[i] == i for i in range(len(docs)) if i not in parent)


def test_signature_starts_with_the_fingerprint_bits():
    text = b"a b c d e f g h i"
    assert int(simhash.signature(text, 5, 4, 48)[0]) == simhash.fingerprint(text, 5) & ((1 << 48) - 1)
    assert not simhash.signature(None, 5, 4, 48).any()


def planted(seed, pairs, size, shingles_changed):
    """Texts of ``size`` words and copies with words changed five places or more apart; similarity (n - c) / (n + c) of n shingles, c of them changed."""
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(pairs):
        base = [f"w{int(x)}" for x in rng.integers(0, 100_000, size)]
        other = list(base)
        for at in range(shingles_changed // 5):
            other[4 + at * (size - 8) // (shingles_changed // 5)] = "changed"
        docs += [" ".join(base), " ".join(other)]
    return docs


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def groups_of(spark, docs):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}


def test_links_are_verified_by_shingles(spark):
    docs = planted(6, 200, 204, 35)
    assert all(0.65 < jaccard(docs[i], docs[i + 1]) < 0.75 for i in range(0, len(docs), 2))
    rng = np.random.default_rng(7)  # texts of two shingles have few bits set
    docs += [" ".join(f"w{int(x)}" for x in rng.integers(0, 100_000, 6)) for _ in range(2000)]
    got = groups_of(spark, docs)
    assert all(got[i] == i for i in range(len(docs)))


def test_refuted_links_do_not_cut_groups(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(150):  # near copies of each other at about 0.9, and others too far from them
        own = list(base)
        for at in rng.integers(0, 300, 3):
            own[at] = f"x{int(rng.integers(0, 1000))}"
        docs.append(" ".join(own))
    far = planted(9, 20, 204, 35)
    want = {i: 0 for i in range(150)} | {150 + i: 150 + i for i in range(40)}
    assert groups_of(spark, docs + far) == want
    monkeypatch.setattr(simhash, "FEW_PAIRS", 10)
    assert groups_of(spark, docs + far) == want


def test_recall_at_the_contract_similarity(spark):
    for changed, least, at in ((20, 95, 0.82), (15, 98, 0.86), (10, 99, 0.90)):
        docs = planted(changed, 100, 194, changed)
        similar = [jaccard(docs[i], docs[i + 1]) for i in range(0, len(docs), 2)]
        assert all(at - 0.02 < x < at + 0.015 for x in similar), similar[:3]
        got = groups_of(spark, docs)
        assert sum(got[i + 1] == i for i in range(0, len(docs), 2)) >= least
    docs = planted(30, 300, 230, 25)
    assert all(0.79 < jaccard(docs[i], docs[i + 1]) < 0.81 for i in range(0, len(docs), 2))
    close = [i for i in range(0, len(docs), 2) if jaccard(docs[i], docs[i + 1]) >= 0.8]
    got = groups_of(spark, docs)
    assert len(close) > 200 and sum(got[i + 1] == i for i in close) >= 0.94 * len(close)


def test_hot_groups_are_dealt_until_they_are_small(spark):
    """A family of fingerprints that share their prefix: more bits deal it out, links stay those of brute force."""
    rng = np.random.default_rng(21)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    for _ in range(300):
        f = base
        for b in rng.integers(0, 40, int(rng.integers(1, 9))):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, 0, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "node long, t int, fp long")
    largest = lambda limit: simhash.groups(nodes, 4, 64, limit).withColumn("v", simhash.variants_of(64, 2)).groupBy("key", "done").agg({"v": "sum"}).agg({"sum(v)": "max"}).first()[0]
    assert largest(20_000) < largest(1e12) / 4
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for limit in (1e12, 20_000):
        par[:] = range(len(fps))
        for r in simhash.links(nodes, 4, hot_variants=limit).collect():
            x, y = find(r.a), find(r.b)
            par[max(x, y)] = min(x, y)
        want = brute(fps, list(range(len(fps))), 4)
        assert [find(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))], limit


def test_a_large_family_of_near_copies(spark):
    """Every copy of a family is found, whatever part of it shares a fingerprint in some table."""
    rng = np.random.default_rng(31)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(600):
        own = list(base)
        own[int(rng.integers(0, 400))] = f"x{i}"
        docs.append(" ".join(own))
    assert groups_of(spark, docs) == {i: 0 for i in range(600)}


def test_spanning_forests_join_what_all_pairs_join():
    rng = np.random.default_rng(41)
    for n, m in ((1, 0), (10, 5), (50, 200), (300, 280)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)

        def parts(a, b):
            root = list(range(n))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in zip(a, b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
            return [find(i) for i in range(n)]

        x, y = simhash.spanning(a, b, n)
        assert parts(x, y) == parts(a, b) and len(x) == n - len(set(parts(a, b)))


def test_no_pair_of_the_similarity_is_left_out(spark):
    """At 0.8 fingerprints miss some pairs; so do fewer of them."""
    docs = planted(30, 300, 230, 25)
    got = groups_of(spark, docs)
    assert all((got[i + 1] == i) == (jaccard(docs[i], docs[i + 1]) >= 0.8) for i in range(0, len(docs), 2))
    few = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), tables=1).collect()}
    assert few == got


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(51)
    for n in (1, 4, 5, 9, 10, 200):
        for _ in range(50):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            a, b = pool[:n], np.sort(np.concatenate([pool[n - int(np.floor(n * 8 / 9)):n], pool[n:n + n // 9]]))
            known = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
            often = rng.integers(3, 9, len(known))
            if len(b) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert len(np.intersect1d(simhash.prefix(a, known, often, 0.8), simhash.prefix(b, known, often, 0.8)))


def test_parities_never_rule_out_similar_sets():
    rng = np.random.default_rng(61)
    ruled_out = 0
    for n in (0, 1, 5, 43, 44, 200, 700, 5000):
        for share in (0, 0.5, 0.8, 0.95, 1):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 1).astype(np.uint64))
            a, b = pool[:n], pool[n - int(n * share):2 * n - int(n * share) + int(rng.integers(0, n // 10 + 1))]
            apart = len(np.setxor1d(a, b))
            assert simhash.least_apart(simhash.parity(a), simhash.parity(b)) <= apart
            ruled_out += simhash.least_apart(simhash.parity(a), simhash.parity(b)) > (len(a) + len(b)) / 9 and n >= 43 and share < 0.8
    assert ruled_out == 10


def test_strangers_that_share_a_passage_are_not_verified(spark, monkeypatch):
    """Texts with a passage in common meet in their prefixes; only similar ones have their sets of shingles read."""
    rng = np.random.default_rng(71)
    passage = [f"p{i}" for i in range(40)]
    docs = [" ".join([*passage, *(f"w{int(x)}" for x in rng.integers(0, 100_000, 160))]) for _ in range(200)]
    docs += planted(30, 30, 230, 25)
    seen, verified = [], simhash.verified

    def counted(pairs, *more):
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "verified", counted)
    got = groups_of(spark, docs)
    assert all((got[200 + i + 1] == 200 + i) == (jaccard(docs[200 + i], docs[200 + i + 1]) >= 0.8) for i in range(0, 60, 2))
    assert all(got[i] == i for i in range(200)) and sum(seen) < 60


def test_missed_pairs_equal_brute_force_in_any_number_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(81)
    rows = [(i, i // 2, 10, rng.choice(60, 3, replace=False).astype(np.int64)) for i in range(80)]
    want = {(a, b) for a, ca, _, x in rows for b, cb, _, y in rows if a < b and ca != cb and any(u == v and 10 - max(i, j) >= 20 * 0.8 / 1.8 - 1e-6 for i, u in enumerate(x) for j, v in enumerate(y))}
    sets = spark.createDataFrame([(a, c, n, bytearray(x.tobytes())) for a, c, n, x in rows], "node long, component long, size int, prefix binary")
    for part in (1 << 20, 40):
        monkeypatch.setattr(simhash, "PART_ENTRIES", part)
        assert {(r.a, r.b) for r in simhash.missed_pairs(sets, 0.8, 240).collect()} == want and want
    assert simhash.missed_pairs(sets.where("false"), 0.8, 0).count() == 0


def test_groups_grow_with_their_own_table_only(spark):
    """Fingerprints of many tables are flipped as often as those of one: groups are of one table."""
    rng = np.random.default_rng(91)
    fps = rng.integers(0, 1 << 31, 3000)
    nodes = spark.createDataFrame([(i, t, int(f) ^ t) for t in range(28) for i, f in enumerate(fps)], "node long, t int, fp long")
    one = simhash.groups(nodes.where("t = 0"), 2, 32).count()
    assert one == 5 * 3000 and simhash.prefix_bits(60_606 * 8, 2, 32) > 2
    simhash_limit, simhash.GROUP_VARIANTS = simhash.GROUP_VARIANTS, 3000
    try:
        assert simhash.groups(nodes, 2, 32).count() == 28 * simhash.groups(nodes.where("t = 0"), 2, 32).count()
    finally:
        simhash.GROUP_VARIANTS = simhash_limit
