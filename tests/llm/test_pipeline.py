import corpus_pipeline
from cadence.llm import queries

from .cases import awkward, labels


def write(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs far")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.org/x", ""), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "hi there"), (1, None, None, None), (1, 0, "user", "hi there"), (2, 1, "bot", ""), (None, 0, "user", "lost"), (20, 0, "", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    words = [f"w{i}x" for i in range(400)]
    docs = awkward(spark).unionByName(spark.createDataFrame([(50 + i, " ".join(words[(i * 37 + j * (i + 3)) % 400] for j in range(60)), "en", "a", 1, None, None, None, None) for i in range(12)], awkward(spark).schema))
    d = write(spark, tmp_path, docs)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        out.write.parquet(f"{d}/stage-{i}")
        now = spark.read.parquet(f"{d}/stage-{i}")
    assert now.columns == [*docs.columns, "copies"]
    ids = {r.doc_id for r in now.collect()}
    assert not ids & {1, 2} and corpus_pipeline.run(spark, d).count() == now.count()


def test_every_query_runs_on_awkward_tables(spark, tmp_path):
    d = write(spark, tmp_path, awkward(spark))
    rows = {n: q(spark, d).count() for n, q in queries.queries().items()}
    assert {rows[n] for n in rows if n.split("_")[0] in ("op2", "op3", "op4", "op7", "op8", "op9", "op10", "op12")} == {10}
    assert rows["op6_url_filter"] == 2 and rows["op11_prefix_trie"] > 1


def empty_or(spark, tmp_path, documents=True, marks=True, items=True):
    d = write(spark, tmp_path, awkward(spark) if documents else awkward(spark).where("false"))
    if not marks:
        labels(spark).where("false").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    if not items:
        spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_on_empty_tables(spark, tmp_path):
    d = empty_or(spark, tmp_path / "a", documents=False)
    assert corpus_pipeline.run(spark, d).count() == 0
    d = empty_or(spark, tmp_path / "b", marks=False, items=False)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, d).count() == 10  # without labels all stay
    assert corpus_pipeline.benchmark_decontamination(spark, docs, d).count() == 10
    assert corpus_pipeline.run(spark, d).count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Whole run on a table where each stage has its own work: what stays follows from plain comparison of all rows."""
    import random


    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    item = " ".join(word() for _ in range(14))
    good = [" ".join(word() for _ in range(60)) for _ in range(160)]
    junk = ["### $$$ " + " ".join(rng.choice(["%%%", "***", "&&&", word()]) for _ in range(60)) for _ in range(160)]
    copies = []
    for i in range(20):  # one of sixty words changed: similarity 0.84, and no line within two edits
        w = good[i].split()
        w[30] = word()
        copies.append(" ".join(w))
    leaks = [good[100 + i] + " " + item + " " + word() for i in range(10)]
    lines = [good[110 + i] + "\nthis very line is found in many of the documents here" for i in range(20)]
    texts = good[:100] + copies + leaks + lines + junk
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    is_junk = lambda i: i >= len(texts) - len(junk)
    spark.createDataFrame([(i, int(not is_junk(i)), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    made = {name: stage for name, stage in corpus_pipeline.STAGES}
    one = made["quality classifier"](spark, docs, d)
    kept = {r.doc_id for r in one.collect()}
    assert sum(is_junk(i) for i in kept) <= 5 and sum(not is_junk(i) for i in kept) >= 0.95 * (len(texts) - len(junk))
    clean = docs.where(f"doc_id < {len(texts) - len(junk)}")
    two = made["line dedup"](spark, clean, d)
    first = 130
    want = {i: t if i < first or i == first else t.split("\n")[0] for i, t in enumerate(texts[:150])}
    assert {r.doc_id: r.text for r in two.collect()} == want
    three = made["simhash near-dedup"](spark, two, d)
    shingles = {i: {tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in want.items()}
    near = {(i, j) for i in want for j in want if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
    gone = set(want) - {r.doc_id for r in three.collect()}
    assert gone <= {j for _, j in near} and len(gone) >= 0.9 * len({j for _, j in near})
    four = made["benchmark decontamination"](spark, three, d)
    windows = {" ".join(item.split()[k:k + 10]) for k in range(5)}
    assert {r.doc_id for r in four.collect()} == {i for i in set(want) - gone if not any(w in want[i] for w in windows)}
    five = made["mixing sources"](spark, four, d).collect()
    sizes = {r.doc_id: (r.source, len(r.text.split())) for r in four.collect()}
    total = sum(n for _, n in sizes.values())
    taken = sum(r.copies * sizes[r.doc_id][1] for r in five)
    assert all(1 <= r.copies <= 2 for r in five) and abs(taken - 1.5 * total) < 0.1 * total
