import random

import pytest
from pyspark.sql import functions as F

from cadence.llm import linededup

from .cases import awkward, none


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        o = rng.random()
        i = rng.randrange(len(s))
        if o < 0.4:
            s[i] = rng.choice("abcé ")
        elif o < 0.7:
            s.insert(i, rng.choice("abcé "))
        elif len(s) > 1:
            s.pop(i)
    return "".join(s)


def test_band_equals_the_full_table(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("ab é") for _ in range(rng.choice([1, 2, 3, 9, 30])))
        b = edited(rng, a, rng.randrange(5))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        for tau in (1, 2, 3):
            if len(a) - len(b) <= tau:
                pairs.append((a, b, tau))
    df = spark.createDataFrame(pairs, "p string, t string, tau int")
    for tau in (1, 2, 3):
        for r in df.where(F.col("tau") == tau).select("p", "t", linededup.banded_distance(F.col("p"), F.col("t"), tau).alias("n")).collect():
            d = distance(r.p, r.t)
            assert r.n == d if d <= tau else r.n > tau, r


def brute_classes(docs, min_chars, per_edit, tau=2):
    """{(doc_id, line_no): (first_doc, first_line, kept)} by comparing all lines."""
    spots = [(d, n, x) for d, t in docs for n, x in enumerate(t.split("\n")) if x.split()]
    par = list(range(len(spots)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, (_, _, a) in enumerate(spots):
        for j in range(i):
            b = spots[j][2]
            short = min(len(a), len(b))
            most = min(tau, short // per_edit) if per_edit else tau
            if a == b or (short >= min_chars and abs(len(a) - len(b)) <= most and distance(a, b) <= most):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return {(d, n): (*spots[find(i)][:2], find(i) == i) for i, (d, n, _) in enumerate(spots)}


def made_lines(seed, lengths, n=240):
    rng = random.Random(seed)
    seeds = ["".join(rng.choice("ab cde") for _ in range(rng.randrange(*lengths))) for _ in range(30)]
    lines = [edited(rng, rng.choice(seeds), rng.randrange(4)) for _ in range(n)]
    return [(i, "\n".join(lines[i * 8:i * 8 + 8])) for i in range(n // 8)]


def classes(spark, docs, **options):
    return {(r.doc_id, r.line_no): (r.first_doc, r.first_line, r.kept) for r in linededup.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}


@pytest.mark.parametrize("lengths, min_chars, per_edit", [((24, 60), 30, 0), ((6, 40), 10, 10), ((9, 14), 9, 0)])
def test_classes_equal_brute_force(spark, lengths, min_chars, per_edit):
    docs = made_lines(4, lengths)
    assert classes(spark, docs, min_chars=min_chars, per_edit=per_edit) == brute_classes(docs, min_chars, per_edit)


@pytest.mark.parametrize("lengths, per_edit", [((24, 60), 0), ((12, 40), 10)])
def test_hot_segments_lose_no_pair(spark, monkeypatch, lengths, per_edit):
    """With every segment hot, all links come from lines without a few of many segments."""
    monkeypatch.setattr(linededup, "HOT_LINES", 1)
    monkeypatch.setattr(linededup, "SAMPLED", 1)
    docs = made_lines(7, lengths)
    assert classes(spark, docs, min_chars=10, per_edit=per_edit) == brute_classes(docs, 10, per_edit)


def test_a_segment_that_all_lines_share(spark, monkeypatch):
    """Lines from one template: the common segments compare nothing, classes stay those of brute force."""
    monkeypatch.setattr(linededup, "HOT_LINES", 64)
    rng = random.Random(9)
    lines = [f"Posted by user {rng.randrange(10**9):09d} on the board of the town" for _ in range(400)]
    docs = [(i, "\n".join(lines[i * 8:i * 8 + 8] + [edited(rng, lines[i * 8], 1)])) for i in range(50)]
    seen = []
    paired = linededup.paired
    monkeypatch.setattr(linededup, "paired", lambda *a: seen.append(paired(*a).distinct().count()) or paired(*a))
    assert classes(spark, docs) == brute_classes(docs, 10, 10)
    assert sum(seen) < 450 * 449 / 2 / 4  # pairs that were compared, of all


def test_equal_hashes_of_different_lines(spark, monkeypatch):
    """Lines whose first hash agrees are told apart by the second."""
    docs = made_lines(8, (6, 40), 120)
    want = brute_classes(docs, 10, 10)
    monkeypatch.setattr(linededup, "line_id", lambda line: F.length(line).cast("long"))
    assert classes(spark, docs) == want


def test_sql_and_operator_agree(spark, tmp_path):
    import duckdb

    from cadence.llm import queries

    # The SQL engine's distance counts bytes, so these lines have one for each character.
    docs = [(i, t.replace("é", "f")) for i, t in made_lines(12, (6, 50))] + [(900, "one line"), (901, None), (902, ""), (903, " \n \none line\nOne line")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op5_line_dedup(spark, str(tmp_path)).select("doc_id", "line_no", "first_doc", "first_line", "kept").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute("SELECT doc_id, line_no, first_doc, first_line, kept FROM (" + queries.oracle_sql()["op5_line_dedup"] + ")").fetchall())


def test_awkward_rows(spark):
    rows = linededup.line_classes(awkward(spark)).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: True, 2: False, 6: True, 7: True, 8: True, None: True}
    assert linededup.line_classes(none(spark)).count() == 0
    kept = linededup.dedup_lines(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert linededup.dedup_lines(none(spark)).count() == 0


def test_lines_go_but_others_stay(spark):
    docs = spark.createDataFrame([(1, "first line of words here\nshared line that all of them have"), (2, "other words in this line\nshared line that all of them havo\n\nlast words of the text")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}[2] == "other words in this line\n\nlast words of the text"


def test_pipeline_takes_short_lines(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([
        (1, "Read more\nanother thing to read about today\nShare this page\nPart 1\nthe line has twenty-nine chars"),
        (2, "Read more\nsome quite other words of this text\nShare that page\nShare thes page\nPart 2\nthe line has twenty-nine char\n\nlast"),
    ], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got[1].split("\n") == docs.where("doc_id = 1").first().text.split("\n")
    # Share that/thes page: two edits and one at 15 characters; Part 1/Part 2 are other lines.
    assert got[2] == "some quite other words of this text\nShare that page\nPart 2\n\nlast"


@pytest.mark.parametrize("few, lengths, per_edit", [(0, (24, 60), 0), (0, (10, 40), 10), (0, (10, 22), 0), (3, (150, 300), 10), (0, (150, 420), 10)])
def test_pieces_that_are_left_out_lose_no_pair(spark, monkeypatch, few, lengths, per_edit):
    """With every segment and every key hot, all links come from patterns of left-out pieces, also of pieces that are cut again."""
    monkeypatch.setattr(linededup, "HOT_LINES", 1)
    monkeypatch.setattr(linededup, "SAMPLED", 1)
    monkeypatch.setattr(linededup, "FEW", few)
    monkeypatch.setattr(linededup, "SHORT", 6)
    docs = made_lines(17, lengths, 160 if lengths[1] < 100 else 96)
    assert classes(spark, docs, min_chars=10, per_edit=per_edit) == brute_classes(docs, 10, per_edit)


@pytest.mark.parametrize("template", ["Lot {0} of the catalogue", "Posted by user {0} in the forum of the town", "On {0} of May the member {1} wrote", "Order {0} of client {1} was sent on day {2} from the store",
                                      "Terms of use number {0}: " + "the reader agrees with all that stands below and above " * 4 + "in the copy {1} of the paper"])
def test_templates_of_lines(spark, monkeypatch, template):
    monkeypatch.setattr(linededup, "HOT_LINES", 32)
    monkeypatch.setattr(linededup, "FEW", 8)
    monkeypatch.setattr(linededup, "PAIRS", 0)
    rng = random.Random(11)
    n = 260 if len(template) < 100 else 80  # the plain comparison takes its time
    lines = [template.format(rng.randrange(3000), rng.randrange(300), rng.randrange(40)) for _ in range(n)]
    lines += [edited(rng, x, 1) for x in rng.sample(lines, 30)]
    docs = [(i, "\n".join(lines[i * 10:i * 10 + 10])) for i in range(len(lines) // 10)]
    assert classes(spark, docs) == brute_classes(docs, 10, 10)


def test_a_large_template_takes_time_in_proportion(spark):
    """20 000 lines that differ in one number: classes of a sample are those of brute force."""
    rng = random.Random(13)
    numbers = rng.sample(range(10**7), 20_000)
    docs = [(i, f"Posted by the user {n:07d} in the general discussion forum of our site today") for i, n in enumerate(numbers)]
    got = classes(spark, docs)
    # All numbers within two edits of one of a sample are in its class.
    near = {}
    for i, n in enumerate(numbers):
        s = f"{n:07d}"
        for a in range(7):
            for b in range(a + 1, 7):
                near.setdefault((a, b, s[:a] + s[a + 1:b] + s[b + 1:]), []).append(i)
    for i in rng.sample(range(20_000), 300):
        s = f"{numbers[i]:07d}"
        mates = {j for a in range(7) for b in range(a + 1, 7) for j in near[a, b, s[:a] + s[a + 1:b] + s[b + 1:]]}
        assert {got[j, 0][0] for j in mates} == {got[i, 0][0]}
