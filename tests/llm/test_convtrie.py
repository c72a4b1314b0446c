"""The prefix trie against plain loops over prefixes and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from cadence.llm import convtrie, sql
from cadence.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return out


def trie(convs):
    held = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            held[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in held:
        if p:
            kids[p[:-1]].append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(held, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(held[p]) - 1) * (len(p[-1][1].split()) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c in held[p] if len(convs[c]) == len(p)))
        out.append((min(held[p]), len(p), min(held[p[:-1]]) if p else None, len(held[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, blocks, tmp=None):
    ordered = convtrie.hashed(convtrie.turns(spark.createDataFrame(rows, SCHEMA)))
    shared, members = convtrie.with_shared_heads(ordered)
    return sorted(map(tuple, convtrie.prefix_trie(shared, members, blocks).collect()), key=str)


def random_rows(seed, n, variety=2, most=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), " ".join(rng.choices(["a", "b"], k=rng.randrange(1, variety + 1)))) for c in range(n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("blocks", [1, 2, 5, 16])
def test_trie_equals_a_loop(spark, blocks):
    rows = random_rows(1, 260)
    assert found(spark, rows, blocks) == trie(rebuilt(rows))


@pytest.mark.parametrize("seed", range(3))
def test_tries_of_few_conversations(spark, seed):
    rows = random_rows(10 + seed, 1 + 12 * seed, variety=1, most=4)
    assert found(spark, rows, 4) == trie(rebuilt(rows))


def test_hot_first_turn_conversation_and_a_long_one(spark):
    rng = random.Random(4)
    rows = [(c, t, "user", ["hello", "again and again", "bye"][t]) for c in range(0, 400) for t in range(3)]
    rows += [(1000 + c, t, "user", "hello" if not t else rng.choice("xyz")) for c in range(60) for t in range(4)]
    rows += [(5000 + c, t, "user", f"long {t}" if t < 150 or c else "other") for c in range(3) for t in range(200)]
    assert found(spark, rows, 9) == trie(rebuilt(rows))


def test_awkward_rows(spark):
    rows = [(0, 1, "u", "a b"), (0, None, None, "first"), (0, 1, "u", "a b"), (1, 0, "u", None), (None, 0, "u", "nobody"), (2, 0, "", ""), (2, 1, None, None), (3, 0, "u", " \n"), (45, 0, "u", "w " * 20_000), (61, 2, "u", "x"), (61, 2, "b", "x"),
            (21, 0, "u", "gone"), (-5, 0, "u", "a"), (-7, 0, "u", "a")]
    rows = [(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0]
    assert found(spark, rows, 3) == trie(rebuilt(rows))
    assert found(spark, [r for r in rows if r[0] is None], 2) == []
    turnless = [(c, 0, "u", "only") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]  # base 0 is absent, so nothing is left
    assert found(spark, turnless, 3) == trie(rebuilt(turnless)) and len(trie(rebuilt(turnless))) == 1


def test_query_takes_extra_columns_and_equals_its_sql(spark, tmp_path):
    rows = random_rows(8, 90)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", depth string, block int, n int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, op11_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == trie(rebuilt(rows))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.sql(sql.PREFIX_TRIE).fetchall(), key=str)


def test_nodes_give_their_last_turn(spark):
    ordered = convtrie.turns(spark.createDataFrame([(1, 0, "u", "hi"), (1, 1, "b", "yes"), (2, 0, "u", "hi")], SCHEMA))
    nodes = convtrie.last_turns(convtrie.prefix_trie(convtrie.hashed(ordered)), ordered)
    assert {(r["conv_id"], r["depth"], r["role"], r["text"]) for r in nodes.collect()} == {(1, 0, None, None), (1, 1, "u", "hi"), (1, 2, "b", "yes")}
