import hashlib
import random

import pytest

from cadence.llm import decontam

from .cases import awkward, none


def brute(text, items, window):
    w = decontam.normal_words(None if text is None else text.encode())
    hit, met = set(), set()
    for item, t in items:
        iw = decontam.normal_words(None if t is None else t.encode())
        n = window if len(iw) >= window else len(iw)
        for g in {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == g:
                    hit.update(range(i, i + n))
                    met |= {item}
    return len(w), len(hit), met


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(7)] + ["É", "x-y"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 9])))) for i in range(9)] + [(3, "w1 w2"), (10, None)]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 30, 60]))) for _ in range(12)]
    return docs, items


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_brute_force(seed):
    docs, items = made(seed)
    block = [(str(i), w) for i, t in items if (w := decontam.normal_words((t or "").encode()))]
    sam = decontam.Automaton(block, 4)
    for d in docs:
        words = decontam.normal_words(d.encode())
        spans, met = sam.scan(words)
        n, hit, want = brute(d, items, 4)
        assert (sum(b - a for a, b in spans), met) == (hit, {str(x) for x in want})


@pytest.mark.parametrize("block_words", [100_000, 6])
def test_blocks_give_the_same_rows(spark, block_words):
    docs, items = made(5)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.contamination(d, i, 4, block_words=block_words).collect():
        n, hit, met = brute(docs[r.doc_id], items, 4)
        ids = ",".join(sorted(map(str, met)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(met), hashlib.sha256(ids.encode()).hexdigest(), hit > 0)


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "Quick, BROWN fox jumps over the lazy dog and runs far!"), (None, "déjà vu"), (2, None)], "item_id long, text string")
    rows = decontam.contamination(awkward(spark), items).collect()
    assert len(rows) == 10 and {r.doc_id: (r.n_hit, r.n_items) for r in rows if r.doc_id in (1, 3, 7)} == {1: (11, 1), 3: (0, 0), 7: (2, 0)}
    assert decontam.contamination(none(spark), items).count() == 0
    assert decontam.contamination(awkward(spark), items.where("false")).where("contaminated").count() == 0


def test_decontaminate_cuts_or_drops(spark):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs far")], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(awkward(spark), items).collect()) == [0, 3, 4, 5, 6, 7, 8]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(awkward(spark), items, max_share=1.0).collect()}
    assert cut[1] == "the quick  away from home" and cut[3] is None


@pytest.mark.parametrize("max_share", [0.0, 0.3, 0.4, 0.6, 1.0])
def test_decontaminate_does_not_depend_on_blocks(spark, max_share):
    docs, items = made(11)
    docs = docs + [" ".join(f"u{i}" for i in range(20)) + " " + " ".join(f"v{i}" for i in range(20))]
    items = items + [(20, " ".join(f"u{i}" for i in range(5, 15))), (21, " ".join(f"v{i}" for i in range(5, 15))), (22, " ".join(f"v{i}" for i in range(12, 20)))]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs + docs[:3] + [None])], "doc_id long, text string, __row string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in d.collect():
        w = decontam.normal_words((r.text or "").encode())
        n, hit, _ = brute(r.text, items, 4)
        if hit <= max_share * max(1, n):
            want.append((r.doc_id, r["__row"], n - hit))
    for block_words in (100_000, 40, 12, 5):
        out = decontam.decontaminate(d, i, 4, max_share=max_share, block_words=block_words)
        assert out.columns == d.columns
        got = out.collect()
        assert sorted((r.doc_id, r["__row"], len(decontam.normal_words((r.text or "").encode()))) for r in got) == sorted(want), block_words
    if max_share == 0.4:  # 18 of 40 words are hit, by three items: each alone would be under the share
        assert len(docs) - 1 not in {r.doc_id for r in got}
