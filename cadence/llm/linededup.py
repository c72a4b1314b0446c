"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within ``tau`` edits of each other, and equal lines, form classes; the first line
of a class in (doc_id, place) order stays and the others go. With ``per_edit`` the shorter line of a pair
has that many characters for each edit at least, so short lines take fewer edits and the shortest only equality.

- Equal lines meet first, by two hashes of 64 bits: lines that share the first but not the second are told apart.
- A line of length l that allows t edits is cut into t+1 segments. Within t edits of a partner at least one
  segment of the shorter line is found unchanged in the longer one, at a place that the
  lengths and the segment's number narrow to a few: the index holds (length, segment
  number, text) and each line probes it with those substrings for every partner length.
- A segment that about ``HOT_LINES`` lines or more share (estimated on every 16th line by hash) compares nothing; the estimate decides only which way finds a pair.
  Lines that hold one are cut into t+``FINER`` segments instead. A partner within t edits differs in one of them, or (t = 2) in two by one edit each; a key is the line without these,
  and the pieces left out are kept beside it. Keys whose lines all agree in one of two segments are dropped, as other keys hold their pairs. A key of ``FEW`` lines or
  fewer gives pairs like any segment, and so do larger ones while all of them make few pairs. The lines of a larger one (a template with a number in it) are not paired: they meet again by their left-out pieces, cut the same way while they are
  longer than ``SHORT``, and at last by all patterns of a piece with as many edits, each a wildcard or a deletion. Lines that share a pattern with k
  wildcards by d and d' deletions are within k+d+d' edits, so the line of fewest deletions stands for its pattern, and a link to it for each other line joins all that are near.
  The number of rows grows with the lines, not with their pairs.
- Candidates are filtered inside the join by counts of letters, which one edit can change
  by two in sum, and then verified by edit distance: a bit-parallel band of
  2*tau+1 rows that moves along the diagonal, so lines of any length need one word of bits.
- Verified links are joined to classes by components().

Defined results: only lines of ``min_chars`` characters or more take part in the edit
join, shorter ones in equality; lines with fewer than ``min_words`` words always stay, blank ones among them;
null texts have no lines and stay null; a null doc_id sorts last; rows equal in doc_id
and text are one document to this operator and keep the same lines, so their copies are
left to document dedup; a text whose lines all go becomes empty, and ``drop_empty``
removes such rows; very long lines and texts are read whole; empty tables give empty tables; other columns are not read and stay.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, components, drop_stored, free_name, small_enough, stored

TAU = 2
MIN_CHARS = 10
MIN_WORDS = 1
PER_EDIT = 10
HOT_LINES = 512
SAMPLED = 16  #: one line in so many is read to find hot segments
FINER = 3  #: segments beyond the number of edits
FEW = 32  #: rows of a key that are paired
CUTS, PAIRS = (128, 512, 2048), 4_000_000  #: larger keys are, too, as long as the squares of all their sizes sum to no more
SHORT = 8
GAP_OR_START = r"^[\x20\x09-\x0D]*"
#: Blanks, digits and the small letters but four rare ones: one edit changes their counts by two in sum at most.
LETTERS = " 0123456789abcdefghilmnoprstuvw"
BROADCAST_IDS = 300_000


def let(value: Column, body) -> Column:
    """``body`` of a value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS in a line, eight to a long, each at most 255 (capping keeps what one edit can change)."""
    packed = []
    for at in range(0, len(LETTERS), 8):
        out = F.lit(0).cast("long")
        for i, c in enumerate(LETTERS[at:at + 8]):
            n = F.least(F.lit(255), F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))))
            out = out.bitwiseOR(F.shiftleft(n.cast("long"), 8 * i))
        packed.append(out.alias(f"c{at // 8}"))
    return F.struct(*packed)


def count_distance(a: Column, b: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        x, y = a[f"c{i // 8}"], b[f"c{i // 8}"]
        out = out + F.abs(F.shiftright(x, 8 * (i % 8)).bitwiseAND(F.lit(255)) - F.shiftright(y, 8 * (i % 8)).bitwiseAND(F.lit(255)))
    return out


def segment_start(length: Column, i: int, parts: int) -> Column:
    """0-based start of segment i of ``parts``; the last segments are the longer ones."""
    base = F.floor(length / parts).cast("int")
    long_from = parts - length % parts
    return base * i + F.greatest(F.lit(0), F.lit(i) - long_from).cast("int")


def allowed(length: Column, tau: int, per_edit: int) -> Column:
    """Edits that a shorter line of this length allows."""
    return F.least(F.lit(tau), F.floor(length / per_edit).cast("int")) if per_edit else F.lit(tau)


def packed(key: Column, probe: bool) -> Column:
    """63 bits of a hash over a bit that tells probes from a line's own segments."""
    return F.shiftleft(key, 1).bitwiseOR(F.lit(int(probe)).cast("long"))


def one_segment(line: Column, size: Column, gap: int, t: int) -> list[Column]:
    """Keys (length, segment number, text) of the substrings that may be segments of a partner ``gap`` shorter with t edits."""
    out = []
    for i in range(t + 1):
        start, end = segment_start(size, i, t + 1), segment_start(size, i + 1, t + 1) if i < t else size
        for shift in range(max(-i, gap - (t - i)), min(i, gap + (t - i)) + 1):
            out.append(packed(F.xxhash64(size, F.lit(i), F.substring(line, start + 1 + shift, end - start)), bool(gap or shift)))
    return out


def ways(t: int) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Every way in which a line of the cut size and one ``gap`` longer differ by t edits: (gap, lo, hi, m), the runs lo..hi of segments left out and by how much the text after each is moved.

    All edits lie in one segment, or (t = 2) one each in two, which are one run where they are neighbours.
    """
    parts = t + FINER
    out = [(gap, [i], [i], [gap]) for gap in range(t + 1) for i in range(parts)]
    if t == 2:
        out += [(gap, [i], [i + 1], [gap]) for gap in range(3) for i in range(parts - 1)]
        out += [(gap, [i, j], [i, j], [m, gap]) for gap in range(3) for m in (-1, 0, 1) if abs(gap - m) <= 1 for i, j in combinations(range(parts), 2) if j > i + 1]
    return out


def ways_column(tau: int) -> Column:
    """The ways of all numbers of edits up to ``tau`` as an array of structs."""
    fields = lambda t, gap, lo, hi, m: f"named_struct('t', {t}, 'gap', {gap}, 'lo', array({', '.join(map(str, lo))}), 'hi', array({', '.join(map(str, hi))}), 'm', array({', '.join(map(str, m))}))"
    return F.expr("array(" + ", ".join(fields(t, *w) for t in range(1, tau + 1) for w in ways(t)) + ")")


def without(text: Column, size: Column, parts: Column | int, x: Column) -> Column:
    """(kept, left, u, v) of a text by a way ``x``: the text without the runs of a cut of ``size`` into ``parts``, the runs, and hashes of the first and of the last segment left out."""
    at = lambda i: F.floor(size / parts).cast("int") * i + F.greatest(F.lit(0), i - (parts - size % parts)).cast("int")
    moved = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(x["m"], k - 1))
    last = F.size(x["lo"])

    def kept(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(at(F.get(x["hi"], k - 1) + 1) + moved(k))
        end = F.when(k == last, F.length(text)).otherwise(at(F.get(x["lo"], k)) + moved(k))
        return F.substring(text, start + 1, end - start)

    def left(i: Column, k: Column) -> Column:
        start = at(i) + moved(k)
        return F.substring(text, start + 1, at(F.get(x["hi"], k) + 1) + F.get(x["m"], k) - start)

    def run(w: Column) -> Column:
        first, final = w[0], F.element_at(w, -1)
        width = lambda i: at(i + 1) - at(i)
        lo, hi = x["lo"][0], F.element_at(x["hi"], -1)
        neighbours = (last == 1) & (lo != hi)
        return F.struct(F.array_join(F.transform(F.sequence(F.lit(0), last), kept), "\n").alias("kept"), w.alias("left"),
                        F.xxhash64(F.when(neighbours, F.substring(first, F.lit(1), width(lo))).otherwise(first)).alias("u"), F.xxhash64(F.when(neighbours, F.right(final, width(hi))).otherwise(final)).alias("v"))

    return let(F.transform(x["lo"], left), run)


def one_piece(rows: DataFrame, tau: int, edits) -> DataFrame:
    """(key, id, own, pieces, u, v, t, short) of rows (g, id, pieces, t) of one piece: for its own size, and for partners shorter by each gap.

    ``edits(size, t)``: what a piece of that size allows. Pieces of up to SHORT characters are not cut.
    """
    text = F.col("pieces")[0]
    n = F.length(text)
    allowed_here = lambda gap: edits(n - gap, F.col("t"))
    cut = F.filter(ways_column(tau), lambda x: (allowed_here(x["gap"]) == x["t"]) & (n - x["gap"] > SHORT))

    def keyed(x: Column) -> Column:
        size = n - x["gap"]
        return let(without(text, size, x["t"] + FINER, x), lambda w: F.struct(
            F.xxhash64("g", size, x["lo"], x["hi"], w["kept"]).alias("key"), ((x["gap"] == 0) & ~F.exists(x["m"], lambda m: m != 0)).alias("own"), w["left"].alias("pieces"), w["u"].alias("u"), w["v"].alias("v"),
            x["t"].alias("t"), (F.ceil(2 * size / (x["t"] + FINER)) <= SHORT).alias("short")))

    here = F.filter(F.array(*[F.lit(g) for g in range(tau + 1)]), lambda g: (n - g <= SHORT) & (allowed_here(g) >= F.greatest(g, F.lit(1))))
    whole = F.transform(here, lambda g: F.struct(F.xxhash64("g", n - g).alias("key"), (g == 0).alias("own"), F.col("pieces").alias("pieces"), F.xxhash64(text).alias("u"), F.xxhash64(text).alias("v"),
                                                 allowed_here(g).alias("t"), F.lit(True).alias("short")))
    return rows.select("id", F.explode(F.concat(F.transform(cut, keyed), whole)).alias("x")).select("x.key", "id", *[f"x.{c}" for c in MET])


MET = ("own", "pieces", "u", "v", "t", "short")


def two_pieces(rows: DataFrame) -> DataFrame:
    """The same of rows of two pieces that may differ by one edit each, the longer of them cut further. Either line may be the shorter in a piece, so every row counts as its own."""
    def halves(text: Column) -> Column:
        n, parts = F.length(text), 1 + FINER

        def made(x: Column) -> Column:
            size = n - x["gap"]
            return let(without(text, size, parts, x), lambda w: F.struct(F.xxhash64(size, x["lo"], w["kept"]).alias("key"), w["left"][0].alias("piece"), (F.ceil(size / parts) <= SHORT).alias("short")))

        long = F.transform(F.filter(ways_column(1), lambda x: n - x["gap"] > SHORT), made)
        whole = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda g: (n - g <= SHORT) & (n >= g)), lambda g: F.struct(
            F.xxhash64(n - g).alias("key"), text.alias("piece"), F.lit(True).alias("short")))
        return F.concat(long, whole)

    both = rows.withColumns({"x": halves(F.col("pieces")[0]), "y": halves(F.col("pieces")[1])}).select("g", "id", "t", "y", F.explode("x").alias("x")).select("g", "id", "t", "x", F.explode("y").alias("y"))
    return both.select(F.xxhash64("g", "x.key", "y.key").alias("key"), "id", F.lit(True).alias("own"), F.array("x.piece", "y.piece").alias("pieces"), F.xxhash64("x.piece").alias("u"), F.xxhash64("y.piece").alias("v"), "t",
                       (F.col("x.short") & F.col("y.short")).alias("short"))


def one_edit(text: Column) -> Column:
    """Patterns (p, k, d) of a text with one edit at most: a line end stands for any character."""
    places = F.slice(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.lit(1), F.length(text))
    at = lambda i, by: F.concat(F.substring(text, F.lit(1), i - 1), F.lit(by), F.substring(text, i + 1, F.length(text)))
    pattern = lambda p, k, d: F.struct(p.alias("p"), F.lit(k).alias("k"), F.lit(d).alias("d"))
    return F.array_distinct(F.concat(F.array(pattern(text, 0, 0)), F.transform(places, lambda i: pattern(at(i, "\n"), 1, 0)), F.transform(places, lambda i: pattern(at(i, ""), 0, 1))))


def two_edits(text: Column) -> Column:
    """Patterns of a text with two edits."""
    n = F.length(text)
    places = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n)
    later = lambda i: F.slice(F.sequence(i + 1, F.greatest(n, i + 1)), F.lit(1), n - i)

    def both(i: Column, j: Column) -> Column:
        def with_(by: str, then: str) -> Column:
            p = F.concat(F.substring(text, F.lit(1), i - 1), F.lit(by), F.substring(text, i + 1, j - i - 1), F.lit(then), F.substring(text, j + 1, n))
            return F.struct(p.alias("p"), F.lit((by + then).count("\n")).alias("k"), F.lit(2 - (by + then).count("\n")).alias("d"))

        return F.array(*[with_(by, then) for by in ("\n", "") for then in ("\n", "")])

    return F.array_distinct(F.flatten(F.flatten(F.transform(places, lambda i: F.transform(later(i), lambda j: both(i, j))))))


def pattern_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join all lines of ``rows(key, id, pieces, t)`` of one key whose left-out pieces are within t edits: a star for each pattern."""
    single = F.when(F.col("t") == 1, one_edit(F.col("pieces")[0])).otherwise(F.concat(one_edit(F.col("pieces")[0]), two_edits(F.col("pieces")[0])))
    one = rows.where(F.size("pieces") == 1).select("key", "id", "t", F.explode(single).alias("x")).select(F.xxhash64("key", "x.p").alias("at"), "id", "t", "x.k", "x.d")
    pair = rows.where(F.size("pieces") == 2).select("key", "id", "t", F.explode(one_edit(F.col("pieces")[0])).alias("x"), F.col("pieces")[1].alias("z"))
    pair = pair.select("key", "id", "t", "x", F.explode(one_edit(F.col("z"))).alias("y"))
    two = pair.select(F.xxhash64("key", "x.p", "y.p").alias("at"), "id", "t", (F.col("x.k") + F.col("y.k")).alias("k"), (F.col("x.d") + F.col("y.d")).alias("d"))
    met = Window.partitionBy("at")
    each = one.unionAll(two).withColumn("lead", F.min(F.struct("d", "id")).over(met))
    return each.where((F.col("lead.id") != F.col("id")) & (F.col("k") + F.col("d") + F.col("lead.d") <= F.col("t"))).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))


def template_links(lines: DataFrame, tau: int, per_edit: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Of ``lines(id, line)`` that share hot segments: stored links (a, b), rows (key, id, probe) of small keys that are to be paired, and the stored tables behind these."""
    rows = lines.select(F.lit(0).cast("long").alias("g"), "id", F.array("line").alias("pieces"), F.lit(tau).alias("t"))
    links, small, made = [], [], []
    edits = lambda size, t: allowed(size, tau, per_edit)
    while not rows.isEmpty():
        keyed = one_piece(rows.where(F.size("pieces") == 1), tau, edits).unionAll(two_pieces(rows.where(F.size("pieces") == 2)))
        groups = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.max("own").alias("owned"), *[f(c).alias(f"{n}_{c}") for c in ("id", "u", "v") for n, f in (("lo", F.min), ("hi", F.max))])
        several = stored(groups.where("owned and lo_id <> hi_id and lo_u <> hi_u and lo_v <> hi_v").select(F.col("key").alias("__key"), F.col("rows").alias("__rows")), "finer-keys")
        most, n, *work = several.agg(F.max("__rows"), F.count("*"), *[F.sum(F.when(F.col("__rows") <= c, F.col("__rows") * F.col("__rows"))) for c in CUTS]).first()
        few = max([FEW, *[c for c, w in zip(CUTS, work) if FEW and (w or 0) <= PAIRS]])
        met = stored(keyed.join(F.broadcast(several) if n <= BROADCAST_IDS else several, F.col("key") == F.col("__key")).withColumn("big", F.col("__rows") > few).drop("__key", "__rows"), "finer-rows")
        drop_stored(several)
        small.append(met.where("not big").select("key", "id", F.when(F.col("own"), F.lit(0)).otherwise(F.lit(1)).alias("probe")))
        made.append(met)
        if (most or 0) <= few:
            break
        links.append(stored(pattern_links(met.where("big and short")), "template-links"))
        rows = met.where("big and not short").select(F.col("key").alias("g"), "id", "pieces", "t").distinct()
        edits = lambda size, t: t
    return links, small, made


def segment_keys(line: Column, n: Column, tau: int, per_edit: int = 0) -> Column:
    """Array of packed keys of a line of ``n`` characters: own ones are the index, probes are for partners no longer than the line."""
    out = []
    for gap in range(tau + 1):
        size = (n - gap).cast("int")
        keys = F.array().cast("array<bigint>")
        for t in range(max(1, gap), tau + 1):
            keys = F.when(allowed(size, tau, per_edit) == t, F.array(*one_segment(line, size, gap, t))).otherwise(keys)
        out.append(keys)
    return F.flatten(F.array(*out))


def banded_distance(longer: Column, shorter: Column, tau: int) -> Column:
    """Edit distance of two strings if it is at most tau, else some number above tau.

    Bit k of the words VP and VN says whether the cell of row j-tau+k is one above or one
    below its upper neighbour in column j; the band moves down one row with each column,
    so what has left it is shifted out. The diagonal through the last cell is followed.
    """
    width = 2 * tau + 1
    full = F.lit((1 << width) - 1).cast("long")
    p, t = F.split(longer, ""), F.split(shorter, "")

    def on(p: Column, t: Column) -> Column:
        delta = F.size(p) - F.size(t)
        mark = F.lit(tau) + delta

        def step(s: Column, j: Column) -> Column:
            c = F.get(t, j)
            same = F.lit(0).cast("long")
            for k in range(width):
                row = j + (k - tau)
                same = same.bitwiseOR(F.when(F.get(p, row) == c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))

            def after(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full)
                return let(d0, lambda d: F.struct(
                    moved(d, vp, vn)[0].alias("vp"), moved(d, vp, vn)[1].alias("vn"),
                    (s["n"] + F.lit(1) - F.call_function("getbit", d, mark).cast("int")).alias("n")))

            return F.when(s["n"] > tau, s).otherwise(let(same, after))

        def moved(d: Column, vp: Column, vn: Column) -> tuple[Column, Column]:
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(full))
            hn = vp.bitwiseAND(d)
            down = F.shiftright(d, 1)
            return hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(full)), down.bitwiseAND(hp)

        start = F.struct(F.lit(((1 << width) - 1) & ~((1 << tau) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), delta.alias("n"))
        return F.when(F.size(t) == 0, delta).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step)["n"])

    return let(F.struct(p.alias("p"), t.alias("t")), lambda x: on(x["p"], x["t"]))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def lines_of(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, place, line, id, other, spot) of every line with ``min_words`` words or more; spot is a number of the place, other a second hash of the line."""
    rows = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    if min_words > 0:
        lines = lines.where(F.col("line").rlike(GAP_OR_START + (WORD + GAP) * (min_words - 1) + WORD[:-1]))
    return lines.withColumn("id", line_id(F.col("line"))).withColumn("other", F.xxhash64(F.lit(1), "line")).withColumn("spot", F.xxhash64("row", "place"))


def told_apart(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """``lines`` whose id, where it is one of ``shared(id)`` that different lines have, is made of both hashes."""
    return (lines.join(near(shared.select(F.col("id").alias("__shared"))), F.col("id") == F.col("__shared"), "left")
            .withColumn("id", F.when(F.col("__shared").isNull(), F.col("id")).otherwise(F.xxhash64("id", "other"))).drop("__shared"))


def near(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """Marked for broadcast where it has few rows; else joins shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def meeting(keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed(id, key, probe)`` whose key an own segment of one line shares with another line; one shuffle by key. Rows with probe 2 pass."""
    by_key = Window.partitionBy("key")
    return (keyed.withColumns({"lo": F.min("id").over(by_key), "hi": F.max("id").over(by_key), "own": F.min("probe").over(by_key)})
            .where("(lo <> hi and own = 0) or probe = 2").select("key", "id", "probe").distinct())


def paired(rows: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Candidates (a, b) among ``rows(key, id, probe)`` of one key whose letter counts allow ``tau`` edits."""
    counted = rows.join(texts.select("id", "counts"), "id")
    index = counted.where("probe = 0").select("key", F.col("id").alias("a"), F.col("counts").alias("ca"))
    probe = counted.select("key", F.col("id").alias("b"), F.col("counts").alias("cb"), "probe")
    pair = (F.col("i.key") == F.col("p.key")) & (F.col("a") != F.col("b")) & ((F.col("p.probe") == 1) | (F.col("a") < F.col("b"))) & (count_distance(F.col("ca"), F.col("cb")) <= 2 * tau)
    return index.alias("i").join(probe.alias("p"), pair).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def edit_links(lines: DataFrame, twice: DataFrame, tau: int, min_chars: int, per_edit: int = 0) -> DataFrame:
    """Verified links (a, b) between the line ids of ``lines(id, spot, line)``.

    ``twice(id, first)``: where lines that occur more than once are to be read. ``per_edit``: characters of the shorter line for each edit; 0 asks for none.
    """
    if min_chars < 3 * (tau + 1):
        raise ValueError("min_chars must be three times the number of segments at least")
    again = near(twice.select(F.col("id").alias("__id"), "first"))
    once = (lines.where(F.length("line") >= min_chars).join(again, F.col("id") == F.col("__id"), "left")
            .where(F.col("first").isNull() | (F.col("first") == F.col("spot"))).select("id", "line"))

    def keys(of: DataFrame, cut=segment_keys) -> DataFrame:
        rows = of.select("id", F.explode(cut(F.col("line"), F.length("line"), tau, per_edit)).alias("k"))
        return rows.select("id", F.shiftright("k", 1).alias("key"), F.col("k").bitwiseAND(F.lit(1)).cast("int").alias("probe"))

    some = once.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(SAMPLED)) == 0)
    enough = HOT_LINES // SAMPLED if tau <= 2 else 1 << 62  # lines are cut further for up to two edits
    hot = stored(keys(some).groupBy("key").count().where(F.col("count") >= enough).select(F.col("key").alias("hot")), "hot-segments")
    # A hot segment's rows only name their lines, each under a key of its own.
    marked = (keys(once).join(near(hot), F.col("key") == F.col("hot"), "left")
              .select("id", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64(F.lit(3), "id")).alias("key"),
                      F.when(F.col("hot").isNull(), F.col("probe")).otherwise(F.lit(2)).alias("probe")))
    shared = stored(meeting(marked), "shared-segments")
    ids = shared.select(F.col("id").alias("__want")).distinct()
    texts = stored(once.join(near(ids), F.col("id") == F.col("__want"), "left_semi").dropDuplicates(["id"]).select("id", "line", letter_counts(F.col("line")).alias("counts")), "candidate-lines")
    hot_lines = stored(texts.join(near(shared.where("probe = 2").select(F.col("id").alias("__hot")).distinct()), F.col("id") == F.col("__hot"), "left_semi").select("id", "line"), "hot-lines")
    near_pieces, small, kept = template_links(hot_lines, tau, per_edit)
    found = stored(paired(reduce(DataFrame.unionAll, [shared.where("probe < 2"), *small]), texts, tau).distinct(), "candidates")
    both = (found.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b"))
    first = F.length("la") >= F.length("lb")
    ordered = both.select("a", "b", F.when(first, F.col("la")).otherwise(F.col("lb")).alias("p"), F.when(first, F.col("lb")).otherwise(F.col("la")).alias("t"))
    most = allowed(F.length("t"), tau, per_edit)
    close = ordered.where(F.length("p") - F.length("t") <= most).where(banded_distance(F.col("p"), F.col("t"), tau) <= most)
    links = stored(reduce(DataFrame.unionAll, [close.select("a", "b"), *near_pieces]).distinct(), "line-links")
    for made in (hot, shared, hot_lines, texts, found, *near_pieces, *kept):
        drop_stored(made)
    return links


def line_classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", per_edit: int = PER_EDIT) -> DataFrame:
    """(row, doc_id, line_no, first_doc, first_line, kept) of every line with ``min_words`` words or more.

    (first_doc, first_line) names the class: its first line by doc_id, then place from 0.
    """
    named = lines_of(docs, min_words, id_col, text_col)
    placed = stored(named.select("row", "doc_id", "place", "id", "other", "spot"), "lines")
    met = stored(placed.groupBy("id").agg(F.count("*").alias("n"), F.min("spot").alias("first"), F.min("other").alias("lo"), F.max("other").alias("hi")).where("n > 1"), "met-lines")
    shared = stored(met.where("lo <> hi").select("id"), "shared-ids")
    twice = met.where("lo = hi").select("id", "first")
    if not shared.isEmpty():
        named, placed = told_apart(named, shared), told_apart(placed, shared)
        apart = placed.join(met.where("lo <> hi").select(F.col("id").alias("__id")), F.xxhash64("__id", "other") == F.col("id"))
        twice = stored(twice.unionAll(apart.groupBy("id").agg(F.count("*").alias("n"), F.min("spot").alias("first")).where("n > 1").select("id", "first")), "repeated-lines")
    links = edit_links(named.select("id", "spot", "line"), twice, tau, min_chars, per_edit)
    classes = stored(components(links), "classes")
    drop_stored(links)
    # A class is named by its edit component or by the line; the others are lines that occur once and stay.
    several = stored(twice.select("id").join(classes.withColumnRenamed("node", "id"), "id", "full_outer").select(F.col("id").alias("__id"), F.coalesce("component", "id").alias("class")), "several")
    lined = placed.join(near(several), F.col("id") == F.col("__id"), "left").select("row", "doc_id", "place", "class")
    spot = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first_doc"), F.col("row").alias("first_row"), F.col("place").alias("first_line"))
    lead = lined.where("class is not null").groupBy("class").agg(F.min(spot).alias("x"))
    lead = stored(lead.select("class", "x.first_doc", "x.first_row", "x.first_line"), "first-lines")
    for made in (met, classes):
        drop_stored(made)
    out = lined.join(near(lead), "class", "left")
    alone = F.col("first_row").isNull()
    return out.select("row", "doc_id", F.col("place").cast("long").alias("line_no"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("first_doc")).alias("first_doc"),
                      F.when(alone, F.col("place")).otherwise(F.col("first_line")).cast("long").alias("first_line"),
                      (alone | ((F.col("row") == F.col("first_row")) & F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("place") == F.col("first_line")))).alias("kept"))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, drop_empty: bool = True, id_col: str = "doc_id", text_col: str = "text", per_edit: int = PER_EDIT) -> DataFrame:
    """``docs`` without the lines that an earlier line stands for; all columns stay."""
    row, gone, kept, key, owner = free_name(docs, "__row", "__gone", "__kept", "__key", "__owner")
    lost = line_classes(docs, tau, min_chars, min_words, id_col, text_col, per_edit).where("not kept")
    lost = stored(lost.groupBy(F.col("row").alias(row), F.col("doc_id").alias(owner)).agg(F.collect_set(F.col("line_no").cast("int")).alias(gone)), "gone-lines")
    text = F.col(text_col).cast("string")
    # A set difference of places, so long texts take time in proportion.
    left = let(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"))
    same = (F.col(key) == F.col(row)) & F.col(id_col).cast("long").eqNullSafe(F.col(owner))
    new = docs.withColumn(key, row_key(id_col, text_col)).join(near(lost), same, "left").withColumn(kept, F.when(F.col(gone).isNull(), text).otherwise(left))
    if drop_empty:
        blank = F.length(F.regexp_replace(F.coalesce(F.col(kept), F.lit("")), GAP, "")) == 0
        new = new.where(F.col(gone).isNull() | ~blank)
    return new.withColumn(text_col, F.col(kept)).select(*docs.columns)
