"""Learned operators: language ID, quality, URL filter, language model, secrets, quality rules."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import langid, lmscore, puquality, quality_rules, secrets, urlfilter
from cadence.llm.common import components, fold

from .cases import awkward, labels, none


def texts(seed, n):
    rng = random.Random(seed)
    kinds = {"en": ["the", "and", "thing", "ation", "with"], "de": ["und", "der", "schön", "ung", "nicht"], "fr": ["le", "été", "eaux", "que", "ment"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        out.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(5, 40))), lang))
    return out


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (10, 9), (9, 8)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 241)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark):
    rows = texts(1, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 30 and all(got[i].lang_pred == lang for i, _, lang in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r for r in langid.predict(awkward(spark), model).collect()}
    assert {i: odd[i].lang_pred for i in (3, 4, 5, 8)} == dict.fromkeys((3, 4, 5, 8), "und") and odd[3].score == 0
    assert langid.predict(none(spark), model).count() == 0
    empty = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(awkward(spark), empty).collect()} == {"und"}


def test_marks_digits_and_capitals_tell_no_language(spark):
    rng = random.Random(21)
    rows = texts(1, 300)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    junk = lambda t: " ".join(w.upper() + rng.choice(["!!", "***", "%%%", "###", "&&&", "$$$", " 4711"]) for w in t.split())
    odd = [(i, junk(t), lang) for i, t, lang in rows[:120]]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in odd) >= 0.98 * len(odd)
    assert langid.folded("Été! 12 ÜBER-all\n".encode()) == "été  überall\n".encode()


def test_long_texts_count_every_gram(monkeypatch):
    text = bytes(random.Random(0).choice(b"abc d") for _ in range(5000))
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 700)
    assert np.array_equal(whole, langid.gram_counts(text)) and whole.sum() == 2 * len(text) - 3


def test_positive_unlabelled(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "and", "thing", "ation", "with"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["buy", "$$$", "click!!", "###", "WIN"]) for _ in range(40))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 3)], "doc_id long, quality int")
    model = puquality.train(docs, marks.where(fold(F.col("doc_id"), 3) != 1))
    got = {r.doc_id: r.score for r in puquality.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 4 > 0) for i in held]) > 0.97
    odd = puquality.score(awkward(spark), model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    assert puquality.keep_good(awkward(spark), model).columns == awkward(spark).columns
    bare = puquality.train(docs, marks.where("false"))
    assert {round(r.score, 6) for r in puquality.score(awkward(spark), bare).collect()} == {round(bare.prior, 6)}
    assert puquality.score(none(spark), model).count() == 0


def test_risk_never_goes_negative():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(1, 1, (300, 5)), np.concatenate([rng.normal(1, 1, (300, 5)), rng.normal(-2, 1, (300, 5))])
    w, b = puquality.nnpu_fit(pos, unl, 0.5)
    assert ((unl @ w + b > 0) == (np.arange(600) < 300)).mean() > 0.95 and np.isfinite(w).all()


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://a.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
    ("ftp://notexample.org/en/2#x", "notexample.org", "/en/2", "org/", "allow"), ("http://x.com/de/9", "x.com", "/de/9", "com/de/", "block"), ("http://org", "org", "", None, None),
    ("nothing here", "", "", None, None), (None, "", "", None, None), ("a://b.org/x://c.com/de/", "b.org", "/x://c.com/de/", "org/", "allow")])
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string").select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"))
    r = df.withColumn("r", urlfilter.rule_of(F.col("h"), F.col("p"))).first()
    assert (r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) == (host, path, rule, verdict)


def test_markov_probabilities_sum_to_one():
    m = urlfilter.Markov(["abcab", "abd", "é"])
    for context in (b"", b"\x02", b"ab", b"zzz", b"\x02abc"):
        assert math.isclose(sum(math.exp(m.log_p(context, c)) for c in range(257)), 1, rel_tol=1e-9)


def test_url_filter(spark):
    rows = [(i, f"http://good{i}.org/news/{i}") for i in range(60)] + [(100 + i, f"http://bad{i}.com/de/spam{i}") for i in range(60)] + [(300, "http://x.net/news/7"), (301, "http://x.net/de/spam9"), (302, None), (302, None)]
    got = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0].rule == "org/" and got[100].verdict == "block" and got[302].verdict == "allow"
    assert (got[300].verdict, got[301].verdict) == ("allow", "block")
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_model(spark):
    rows = texts(3, 80)
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(i + 1000, t) for i, t, _ in rows], "doc_id long, text string"))
    train = fold(F.col("doc_id"), 5) != 1
    got = lmscore.lm_scores(docs, train).collect()
    all_ = docs.collect()
    assert len(got) == len(all_)
    tokens = lambda t: [*(t or "").lower().encode().split(), None]
    known = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    c = Counter(w for r in all_ if known(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = {(r.doc_id, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r.text)), 6), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text))) for r in all_}
    assert {(r.doc_id, round(r.base_score, 6), r.n_tokens, r.n_known) for r in got} == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) and r.train == known(r.doc_id) for r in got)
    assert lmscore.lm_scores(docs.where("false"), train).count() == 0


def test_classes_need_few_logits():
    share = 1 / np.arange(1, 3001.0)
    share /= share.sum()
    edges = lmscore.class_edges(share)
    cost = lambda e: len(e) - 1 + sum(share[a:b].sum() * (b - a) for a, b in zip(e[:-1], e[1:]) if b - a > 1)
    assert edges[0] == 0 and edges[-1] == 3000 and (np.diff(edges) > 0).all()
    assert cost(edges) < 0.95 * min(cost(np.unique(np.linspace(0, 3000, k + 1).astype(int))) for k in (10, 55, 200))
    assert lmscore.class_edges(np.ones(1)).tolist() == [0, 1]


def brute_force_score(model, ids):
    """Natural log probability of a text, id by id, from the definition: no batches, windows cut by hand, every id's probability computed."""
    w, d, stride = model.w, lmscore.DIM, lmscore.WINDOW - lmscore.CONTEXT
    every = np.append(ids.astype(np.int64), lmscore.END)
    total = 0.0
    for i, own in enumerate(every):
        first = (i // stride) * stride - lmscore.CONTEXT  # where the window of this id starts
        seen = [model.start if j <= 0 else int(model.row[every[j - 1]]) for j in range(first, i + 1)]
        h = w["embed"][seen].astype(float)
        a = np.array([h[-1] @ w["match"].astype(float) @ h[j] + w["distance"][len(seen) - 1 - j] for j in range(len(seen))])
        a = np.exp(a - a.max())
        mix = np.concatenate([(a / a.sum()) @ h, h[-1]])
        zc = w["class"].astype(float) @ mix + w["class_bias"]
        p = np.zeros(len(model.cls))
        log_of = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
        for k in range(model.n_cls):
            lo, hi = model.lo[k], model.lo[k + 1]
            zi = w["inside"][lo:hi].astype(float) @ mix + w["inside_bias"][lo:hi]
            p[lo:hi] = log_of(zc)[k] + log_of(zi)
        every_id = p[model.row] - np.where(model.row == len(p) - 1, model.unseen, 0)
        assert math.isclose(np.exp(every_id).sum(), 1, rel_tol=1e-5)  # over all ids of the vocabulary
        total += every_id[own]
    return total


def small_model(seed=0, kinds=60):
    rng = np.random.default_rng(seed)
    model = lmscore.Attention(np.bincount(rng.integers(0, kinds, 5000) ** 2 // kinds, minlength=lmscore.VOCAB))
    for k in model.w:
        model.w[k] += (rng.standard_normal(model.w[k].shape) * 0.3).astype(np.float32)
    return model, rng


def test_attention_scores_equal_brute_force():
    model, rng = small_model()
    assert model.n_cls > 2 and (np.diff(model.lo) > 1).any()
    for n in (0, 1, 7, 8, 23, 24, 25, 31, 32, 49, 100):
        ids = rng.integers(0, 70, n).astype(np.uint16)  # some are unknown to the model
        assert math.isclose(lmscore.Scorer(model).score([ids])[0], brute_force_score(model, ids), rel_tol=1e-4), n
    many = [rng.integers(0, 70, n).astype(np.uint16) for n in (0, 300, 5, 0, 64)]
    assert np.allclose(lmscore.Scorer(model).score(many), [lmscore.Scorer(model).score([x])[0] for x in many], rtol=1e-5)
    big, _ = small_model(3)
    big.w["class"] *= 200  # far from the range in which single precision needs no care
    big.w["match"] *= 200
    assert math.isclose(lmscore.Scorer(big).score([many[1]])[0], brute_force_score(big, many[1]), rel_tol=1e-2)


def test_gradients_are_those_of_the_loss():
    model, rng = small_model(4, 30)
    x, y, ok = rng.integers(0, model.start + 1, (3, lmscore.WINDOW)), rng.integers(0, model.start, (3, lmscore.WINDOW)), rng.random((3, lmscore.WINDOW)) < 0.8
    for k in model.w:
        model.w[k] = model.w[k].astype(np.float64)
        model.s[k] = np.zeros_like(model.w[k])

    def loss():
        h, _, u = model.attend(x, 0)
        mix = np.concatenate([u, h], -1).reshape(-1, 2 * lmscore.DIM)
        c = model.cls[y.ravel()]
        p = lmscore.own_log_p(mix @ model.w["class"].T + model.w["class_bias"], c)
        for lo, hi, i in model.by_class(c):
            p[i] += lmscore.own_log_p(mix[i] @ model.w["inside"][lo:hi].T + model.w["inside_bias"][lo:hi], y.ravel()[i] - lo)
        return -p[ok.ravel()].sum()

    got = {}
    model._move = lambda name, i, grad, rate: got.setdefault(name, []).append((i, np.array(grad)))
    model.step(x, y, ok, 0.0)
    for name, w in model.w.items():
        full = np.zeros(w.shape)
        for i, g in got[name]:
            full[i] += g
        for at in (np.unravel_index(int(j), w.shape) for j in np.argsort(-np.abs(full).ravel())[:3]):
            kept, e = w[at], 1e-5
            w[at] = kept + e
            up = loss()
            w[at] = kept - e
            down = loss()
            w[at] = kept
            assert math.isclose((up - down) / (2 * e), full[at], rel_tol=1e-3, abs_tol=1e-4), (name, at)


def test_long_passes_take_large_steps(monkeypatch):
    """A pass over many windows takes few steps, a short one small steps; each window is in one."""
    model, rng = small_model(5)
    for windows, most in ((300, 5), (512 * 240, 250)):
        seen = []
        monkeypatch.setattr(model, "step", lambda x, y, ok, rate: seen.append((len(x), int(ok.sum()))))
        model.fit([rng.integers(0, 60, windows * lmscore.WINDOW - 1).astype(np.uint16)], (0.2, 0.1), 1)
        assert sum(n for n, _ in seen) == windows and sum(n for _, n in seen) == windows * lmscore.WINDOW
        assert len(seen) <= most and max(n for n, _ in seen) <= 512


def test_steps_and_scores_do_not_depend_on_memory_used_before():
    def trained(sizes):
        model, rng = small_model(6, 40)
        for n in sizes:
            x, y, ok = rng.integers(0, model.start + 1, (n, lmscore.WINDOW)), rng.integers(0, model.start, (n, lmscore.WINDOW)), rng.random((n, lmscore.WINDOW)) < 0.8
            model.step(x, y, ok, 0.1)
        return model, lmscore.Scorer(model).score([np.arange(k, dtype=np.uint16) % 40 for k in (0, 3, 200)])

    lmscore._rooms.clear()
    model, scores = trained((2, 3, 2))
    trained((9,))
    for had in lmscore._rooms.values():
        had[:] = np.nan
    again, same = trained((2, 3, 2))
    assert all(np.array_equal(model.w[k], again.w[k]) for k in model.w) and np.array_equal(scores, same) and np.isfinite(scores).all()


def test_training_in_parts_beats_unigrams(spark):
    """Averaged tasks and rounds learn an order that frequencies cannot show."""
    rng = np.random.default_rng(1)
    after = rng.permutation(200)
    rows = []
    for i in range(300):
        seq = [int(rng.integers(200))]
        while len(seq) < 150:
            seq.append(int(after[seq[-1]]) if rng.random() < 0.9 else int(rng.integers(200)))
        rows.append((i, bytearray(np.array(seq, np.uint16).tobytes())))
    texts = spark.createDataFrame(rows[:250], "row long, ids binary")
    counts = lmscore.id_counts(texts)
    assert counts.sum() == 250 * 151 and counts[lmscore.END] == 250
    held = [np.frombuffer(bytes(b), np.uint16) for _, b in rows[250:]]
    unigram = sum(np.log((counts[np.append(x, lmscore.END)] + 0.5) / (counts.sum() + 0.5 * lmscore.VOCAB)).sum() for x in held)
    for parts, fan in ((1, 256), (5, 2)):
        lmscore.FAN, old = fan, lmscore.FAN
        try:
            model = lmscore.train_attention(texts, 1.0, 40_000, -(-40_000 // parts), 2)
        finally:
            lmscore.FAN = old
        assert lmscore.Scorer(model).score(held).sum() > 0.6 * unigram
    again = lmscore.train_attention(texts, 1.0, 40_000, 8000, 2)
    assert np.array_equal(lmscore.Scorer(again).score(held), lmscore.Scorer(lmscore.train_attention(texts, 1.0, 40_000, 8000, 2)).score(held))


def test_the_model_learns_from_every_text(spark):
    """More ids than the floor: the embedding of an id that one text has moves, whichever text it is."""
    texts = spark.createDataFrame([(i, bytearray(np.full(50, i, np.uint16).tobytes())) for i in range(400)], "row long, ids binary")
    model = lmscore.train_attention(texts, floor=1000, task_ids=6000)
    moved = (model.w["embed"] != lmscore.Attention(lmscore.id_counts(texts)).w["embed"]).any(1)
    assert all(moved[model.row[i]] for i in range(400))


def test_sample_follows_the_text():
    small, large = (min(n, lmscore.FLOOR + lmscore.SHARE * n) for n in (10**8, 10**10))
    assert large > 30 * small


def test_subword_ids_hold_the_word():
    import base64

    with open(lmscore.TOKENIZER, "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    plain = ["the", "was?!12", "naïve", "日本語", "<|endoftext|>", "\u00a0x", "a\u00a0b"]
    for found in (plain, plain + ["a" * 5000, "x\u00a0", "end"]):
        ids, n = lmscore.subword_ids([w.encode() for w in found], lmscore.TOKENIZER)
        at = np.append(0, np.cumsum(n))
        assert at[-1] == len(ids)
        for k, w in enumerate(found):
            assert b"".join(pieces[i] for i in ids[at[k]:at[k + 1]]) == b" " + w.encode()
    ids, _ = lmscore.subword_ids([w.encode() for w in plain + ["a" * 5000]], lmscore.TOKENIZER)
    words = lmscore.Words([ids.tobytes(), b"", ids[:3].tobytes()], lmscore.encoder(lmscore.TOKENIZER)[1])
    in_third = int(lmscore.encoder(lmscore.TOKENIZER)[1][ids[:3]].sum())
    assert len(words.name) + len(words.long) == len(plain) + 1 + in_third and list(np.unique(words.of)) == [0, 2]


SECRETS = ["hex", "base64", "letters", "long"]


def secret(rng, kind="hex"):
    return {"hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), "base64": lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) + "==",
            "letters": lambda: "".join(rng.choice("QWRTPSDFGHJKLZXCVBNMqwrtpsdfghjklzxcvbnm") for _ in range(32)), "long": lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(700))}[kind]()


def secret_documents():
    """Texts with planted secrets in many forms, ordinary long words and innocent runs: (doc_id, text, path), and the planted secrets."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("inter", "under", "super", "counter", "over", "trans") for b in ("nationalization", "standingness", "conductivity", "productiveness", "simplification", "formationally")]
    forms = ['api_token = "{}"', "password: {}", "API_KEY={}", "export SECRET_KEY='{}'", '"auth_token": "{}",', "bearer={}"]
    paths = ["src/app.py", "notes.txt", "docs/manual.md", "a/b/c.yaml", None]
    around = lambda: " ".join("".join(rng.choice("aeinorstl") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 5)))
    rows, planted = [], {}
    for i in range(240):
        key = secret(rng, SECRETS[i % 4])
        planted[i] = key
        rows.append((i, f"{around()} {rng.choice(words)} {around()}\n" + forms[i % 6].format(key) + f"\n{around()}", rng.choice(paths)))
    for i in range(300):
        rows.append((1000 + i, f"{around()} {rng.choice(words)} {around()} {rng.choice(words)} {around()} {rng.choice(words)} {around()}", rng.choice(paths)))
    return rng, words, rows, planted, around


def test_secrets(spark):
    rng, words, rows, planted, around = secret_documents()
    bare = {2000 + i: secret(rng, SECRETS[i % 4]) for i in range(24)}  # nothing is assigned: a rule on names and quotes finds none of them
    rows += [(i, f"{around()} {k} {around()} {rng.choice(words)} {around()}", "notes.txt") for i, k in bare.items()]
    false = {3000 + i: w for i, w in enumerate(words)}  # what a rule on names and quotes would keep
    rows += [(i, f'{around()} secret = "{w}" {around()}', "docs/manual.md") for i, w in false.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = secrets.scan(docs, path=F.col("path")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, {})[r.candidate] = r.secret
    assert all(k in by[i] for i, k in planted.items())  # no candidate is lost: long, without digits, unquoted
    assert all(not any(c != k and k.startswith(c) for c in by[i]) for i, k in planted.items())  # nor cut short
    assert sum(by[i][k] for i, k in planted.items()) >= 0.95 * len(planted)
    assert sum(by[i][k] for i, k in bare.items()) >= 0.9 * len(bare)
    assert sum(by[i][w] for i, w in false.items()) <= 0.1 * len(false)
    assert sum(v for i, c in by.items() if 1000 <= i < 2000 for v in c.values()) == 0


def test_numbers_and_words_in_running_text_are_no_secrets(spark):
    rng, words, rows, planted, around = secret_documents()
    numbers = {4000 + i: "".join(rng.choices("0123456789", k=16)) for i in range(40)}
    rows += [(i, f"{around()} {n} {around()}", None) for i, n in numbers.items()]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), path=F.col("path"))
    assert got.where("doc_id >= 1000 and secret").count() == 0 and got.where("doc_id >= 4000").count() == 40


def test_secret_candidates_equal_brute_force(spark):
    import re

    rng, words, rows, planted, around = secret_documents()
    texts_ = [t for _, t, _ in rows[:60]] + ["x=" + "a" * 20, "a" * 15, "k: short678 and short678", 'p = "abcdefgh"', "=" * 40, "a" * 16 + "===b", "", None, "A" * 200_000 + " t", "\u0001" + "b" * 16 + "\u0001" + "c" * 17, "é" + "d" * 16 + "é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)] + [(0, texts_[0])], "doc_id long, text string")
    run, want = re.compile(r"[A-Za-z0-9+/_.\-]+"), Counter()
    for i, t in [*enumerate(texts_), (0, texts_[0])]:
        t, place = (t or "").replace("\u0001", " "), 0
        for m in run.finditer(t):
            n = m.end() - m.start()
            if n >= 16 or n >= 8 and re.search(r"[:=][\"'` ]{0,2}$", t[:m.start()]):
                end = m.end() + len(re.match("={0,2}", t[m.end():])[0])
                want[i, place, t[m.start():end], t[max(0, m.start() - 48):m.start()]] += 1
                place += 1
    got = Counter((r.doc_id, r.place, r.candidate, r.before) for r in secrets.candidates(docs).collect())
    assert got == want


def test_secrets_awkward_rows_and_reviewed_findings(spark):
    rng, words, rows, _, _ = secret_documents()
    assert secrets.scan(none(spark)).count() == 0
    real = awkward(spark).withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.lit(f' token = "{secret(rng)}" token = "{secret(rng)}"'))).otherwise(F.col("text")))
    got = secrets.scan(real, path=F.col("source")).collect()  # repeated rows, clashing names, labels of one kind only
    assert [(r.doc_id, r.place) for r in sorted(got, key=lambda r: r.place) if r.doc_id == 2] == [(2, 0), (2, 0), (2, 1), (2, 1)] and all(r.secret for r in got if r.doc_id == 2)
    findings = spark.createDataFrame([(secret(rng), f"see {'live' if i % 2 else 'sample'} ", "", "a.py", float(i % 2)) for i in range(200)], "candidate string, before string, after string, path string, label double")
    docs = spark.createDataFrame([(1, f"see live {secret(rng)}", "a.py"), (2, f"see sample {secret(rng)}", "a.py")], "doc_id long, text string, path string")
    assert {r.doc_id: r.secret for r in secrets.scan(docs, findings, path=F.col("path")).collect()} == {1: True, 2: False}  # the words beside decide
    assert [r.score for r in secrets.scan(docs, findings, path=F.col("path")).orderBy("doc_id").collect()] == [r.score for r in secrets.scan(docs, findings, path=F.col("path")).orderBy("doc_id").collect()]


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 10, 250, 4000) for k in (0, 1, 2, 7, 39) for p in (0.01, 0.05) if k <= n * p]
    for n, k, p in cases:
        want = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-8), (n, k, p, got, want)


def test_repeated_words(spark):
    rng = random.Random(6)
    rows = [" ".join(rng.choice("ab") for _ in range(n)) for n in (5, 6, 7, 12, 30, 60)] + ["x " * 40, "a b c d e f g h i j", "a b c d e x a b c d e"]
    for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", quality_rules.let(F.split(F.trim("t"), " "), lambda w: quality_rules.repeated_words(w)).alias("n")).collect():
        w = r.t.split()
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        want = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        assert r.n == len(want), r


def test_quality_rules(spark):
    got = quality_rules.judge(awkward(spark), labels(spark), stratum=F.col("lang")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[6].n_repeat_words == 30_000 and by[6].base_failed and by[1].kept
    assert quality_rules.judge(none(spark), labels(spark)).count() == 0
    good = [(i, "plain words of a clean text that goes on for a while " + str(i)) for i in range(3000)]
    junk = [(5000 + i, " ".join("junk### " + str(i + j) for j in range(12))) for i in range(50)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, marks).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)


def brute_language(train, query, centroids):
    """Nearest centroid by plain loops over dictionaries of hashed n-grams: (language, cosine)."""
    def grams(t):
        a, out = [c if not 65 <= c <= 90 else c + 32 for c in t.encode()], Counter()
        for i in range(len(a) - 1):
            two = (a[i] * 0x01000193 + a[i + 1] * 0x85EBCA6B) & 0xFFFFFFFF
            out[((two * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1
            if i + 2 < len(a):
                out[(((two * 0xC2B2AE35 + a[i + 2] * 0x27D4EB2F) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        return out

    df = Counter(g for t, _ in train for g in grams(t))
    idf = lambda g: math.log((len(train) + 1) / (df[g] + 1)) + 1e-3

    def vector(t):
        v = {g: math.sqrt(n) * idf(g) for g, n in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    v = vector(query)
    cosines = [(sum(v.get(g, 0.0) * float(c[g]) for g in v), lang) for lang, c in centroids]
    return max(cosines)


def test_language_equals_brute_force(spark):
    rows = [(i, t, lang) for i, t, lang in texts(4, 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    centroids = [(model.langs[k], c) for k, c in zip(model.owner, model.centroids)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[:20]] + [(900, "Ünd MIT der x"), (901, "ab")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        cosine, lang = brute_language([(t, lang) for _, t, lang in rows], r.text, centroids)
        assert math.isclose(got[r.doc_id].score, min(1, max(0, cosine)), abs_tol=2e-4), r
        assert got[r.doc_id].lang_pred == lang or math.isclose(cosine, 0, abs_tol=1e-6)


def test_url_model_equals_brute_force(spark):
    """Witten-Bell mixture from the definition, character by character."""
    rng = random.Random(3)
    urls = ["".join(rng.choice("ab/c.") for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    model = urlfilter.Markov(urls)
    seen = Counter()
    for u in urls:
        raw = "\x02" + u + "\x03"
        for i in range(1, len(raw)):
            for n in range(min(urlfilter.ORDER, i) + 1):
                seen[raw[i - n:i], raw[i]] += 1

    def p(context, c):
        lower = 1 / urlfilter.ALPHABET if context is None else p(context[1:] if context else None, c)
        if context is None:
            return lower
        after = [n for (k, _), n in seen.items() if k == context]
        return (seen[context, c] + len(after) * lower) / (sum(after) + len(after)) if after else lower

    for u in urls[:5] + ["zzz", "abab/"]:
        raw = "\x02" + u + "\x03"
        want = sum(math.log(p(raw[max(0, i - urlfilter.ORDER):i], raw[i])) for i in range(1, len(raw)))
        assert math.isclose(model.score(u), want, rel_tol=1e-9), u


def test_url_filter_long_urls_ties_and_clashing_names(spark):
    rows = [(i, f"http://good{i % 7}.org/news/{i}", "x") for i in range(60)] + [(100 + i, f"http://bad{i % 7}.com/de/spam{i}", "x") for i in range(60)]
    rows += [(300, "http://x.net/" + "news/" * 20_000, "x"), (301, "http://x.net/" + "de/spam" * 20_000, "x"), (302, "http://y.net/q", "x"), (302, "http://y.net/q", "x"), (303, "://", None)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[300].verdict == "allow" and by[301].verdict == "block" and by[303].host == ""
    assert len({(r.verdict, r.margin) for r in got if r.page_id == 302}) == 1  # equal rows are judged alike
    ratio = urlfilter.Ratio(["aa"] * 10, ["bb"] * 10)
    assert ratio._calibrate(np.array([1.0, 1.0, 0.0]), np.array([0.0, 0.0])) == 0.5  # a tie of both kinds at 0 lies under the cutoff


def test_quality_scores_equal_brute_force(spark):
    """Scores from the weights by plain arithmetic; the risk of the fit from its definition."""
    rng = np.random.default_rng(8)
    pos, unl = rng.normal(0.7, 1, (300, 6)), np.concatenate([rng.normal(0.7, 1, (150, 6)), rng.normal(-0.7, 1, (450, 6))])
    w, b = puquality.nnpu_fit(pos, unl, 0.25, epochs=60, decay=0.0)

    def risk(w, b):
        lp = lambda z: np.logaddexp(0, -z).mean()
        zp, zu = pos @ w + b, unl @ w + b
        return 0.25 * lp(zp) + max(0.0, lp(-zu) - 0.25 * lp(-zp))

    at = risk(w, b)
    assert at < risk(np.zeros(6), 0.0) and all(at <= risk(w + d, b) + 0.03 for d in np.concatenate([np.eye(6), -np.eye(6)]) * 0.3)
    rows = [(i, t) for i, t, _ in texts(6, 20)] + [(900, None), (901, ""), (901, ""), (902, "x " * 100_000)]
    model = puquality.Model(np.linspace(-1, 1, puquality.FOLDED + puquality.STATS), -0.3, 0.5)
    got = puquality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = {i: 1 / (1 + math.exp(-(sum(float(a) * float(c) for a, c in zip(puquality.features((t or "").encode()), model.w)) - 0.3))) for i, t in rows}
    assert len(got) == len(rows) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-3) for r in got)


def run_sql(name, tables, tmp_path):
    import duckdb

    from cadence.llm import queries

    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return con, queries.queries()[name], con.execute(queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op4_source_mixing", "op7_benchmark_decontamination", "op8_quality_rules"])
def test_sql_and_operator_agree(spark, tmp_path, name):
    docs = awkward(spark).where("doc_id is not null and doc_id <> 6")  # the SQL takes minutes for a text of 30 000 words
    rng = random.Random(4)
    junk = [(1000 + i, " ".join(rng.choice(["plain", "words", "of", "text", "again", "more"]) + ("#" * (i % 3 > 1) if j % 2 else "") for j in range(30 + i % 7)) + f" {i}", "en", f"s{i % 5}", 1, None, None, None, None) for i in range(1500)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    if name == "op8_quality_rules":
        docs = docs.dropDuplicates(["doc_id"])  # the SQL counts by doc_id, which is unique in the tables
    good = [(1000 + i, 1 if i % 3 < 2 else 0, 0) for i in range(1500)]
    tables = {"documents": docs, "labels": spark.createDataFrame(good, "doc_id long, quality int, toxic int"),
              "benchmark": spark.createDataFrame([(1, "Quick, BROWN fox jumps over the lazy dog and runs far!"), (2, "été déjà vu"), (3, None)], "item_id long, text string")}
    _, query, want = run_sql(name, tables, tmp_path)
    columns = [c[0] for c in want.description]
    near = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = Counter(near(r) for r in query(spark, str(tmp_path)).select(*columns).collect())
    assert got == Counter(near(r) for r in want.fetchall())
    if name == "op8_quality_rules":  # a cutoff was chosen: about a thousand good rows in the stratum
        assert 300 < sum(n for r, n in got.items() if not r[columns.index("kept")] and not r[columns.index("base_failed")])


def test_class_prior_needs_no_negatives():
    rng = np.random.default_rng(9)
    for prior in (0.1, 0.3, 0.7):
        unl = np.where(rng.random(6000) < prior, rng.normal(3, 1, 6000), rng.normal(-3, 1, 6000))
        assert abs(puquality.class_prior(rng.normal(3, 1, 3000), unl) - prior) < 0.05
    assert puquality.class_prior(np.zeros(0), np.ones(3)) == 0.5
