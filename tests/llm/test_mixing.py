from cadence.llm import mixing

from .cases import awkward, none


def targets(sizes, share=1.5, cap=2.0, cycle=(5, 2, 1)):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: cycle[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        for s in over or open_:
            out[s] = min(level * w[s], cap * sizes[s])
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_targets_and_takes(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 40), "hot" if i % 3 else f"s{i % 21:02d}" if i % 2 else None) for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 600
    source = {r.doc_id: r.source for r in docs.collect()}
    size, took, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        size[s] = size.get(s, 0) + r["size"]
        took[s] = took.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken % r["size"] == 0 and r.taken <= 2 * r["size"]
    want = targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(took[s] - want[s]) <= 40


def test_budgets_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "a") for i in range(200)], "doc_id long, text string, source string")
    small = {r.doc_id for r in mixing.mix(docs, share=0.3).collect() if r.taken}
    large = {r.doc_id for r in mixing.mix(docs, share=0.7).collect() if r.taken}
    assert small < large and len(small) == 60 and len(large) == 140


def test_awkward_rows(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert mixing.mix(none(spark)).count() == 0
    mixed = mixing.mixed_documents(awkward(spark))
    assert mixed.columns == [*awkward(spark).columns, "copies"]
    per = {(r.doc_id, r["size"]): r.taken for r in rows}
    for r in mixed.collect():
        n = len((r.text or "").split())
        assert r.copies * n == per[r.doc_id, n]
