"""Ranked lexical search against a plain loop and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from cadence.llm import lexical, sql

from .cases import awkward, none

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def ranked(docs, items, k):
    """(item, rank, doc, score) by the definition, a document for each doc_id."""
    held = {}
    for d, text in docs:
        held.setdefault(d, Counter()).update(TERM.findall(low(text)))
    held = {d: c for d, c in held.items() if c}
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held.values())
    df = Counter(t for c in held.values() for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(TERM.findall(low(text)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in held.items():
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(i, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_search_equals_a_loop(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "ÉTÉ", "x1", "42", "über", "the", "of", "日本", "rare"]
    docs = [(i, rng.choice([" ", ", ", "-", "\x00"]).join(rng.choices(words, weights=[1, 2, 3, 1, 1, 2, 2, 1, 30, 20, 1, 0.1], k=rng.randrange(0, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # ties
    items = [(f"i{i}", " ".join(rng.choices(words, k=5))) for i in range(12)] + [("none", "absent"), ("blank", "--"), ("null", None)]
    d, b = tables(spark, docs, items)
    for k in (1, 7, 50):
        assert sorted(map(tuple, lexical.search(d, b, k=k).collect()), key=str) == ranked(docs, items, k)


def test_awkward_tables(spark):
    d = awkward(spark)
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    items = [("a", "the quick fox"), ("a", "maison"), (None, "12345 word nobody"), ("b", ""), ("c", None)]
    b = spark.createDataFrame([(*i, "x", 1.5, 2) for i in items], "item_id string, text string, term string, tf double, doc_id long")
    got = lexical.search(d, b, k=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 3)
    assert lexical.search(none(spark), b).count() == 0 == lexical.search(d, b.limit(0)).count()


def test_postings_are_bucketed_by_term(spark):
    index = lexical.postings(awkward(spark)).collect()
    assert len({(r["term"], r["bucket"]) for r in index}) == len({r["term"] for r in index})
    assert {r["bucket"] for r in index} <= set(range(lexical.BUCKETS))
    assert {r["doc_id"]: r["tf"] for r in index if r["term"] == lexical.LENGTH}[6] == 30_000


@pytest.mark.parametrize("size", [5, 80])
def test_search_equals_its_sql(spark, tmp_path, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(30)] + ["É", "Zeit"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))) if i % 9 else None) for i in range(size)]
    items = [(f"q{i}", " ".join(rng.choices(words, k=6))) for i in range(6)]
    d, b = tables(spark, docs, items)
    db = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        df.write.parquet(f"{tmp_path}/{name}")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(map(tuple, lexical.search(d, b).collect())) == sorted(db.sql(sql.LEXICAL_SEARCH).fetchall())
