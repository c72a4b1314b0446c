"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose feature exceeds a cutoff. Cutoffs are tested on labelled
holdout rows of each stratum: a cutoff is safe if the exact binomial tail
P(Bin(n, alpha) <= k), for k of the stratum's n good rows rejected, is at most
delta divided by the number of tests made (Bonferroni over strata, rules and cutoffs), which
is to say that the Clopper-Pearson upper bound of its false rejection rate is at most alpha.
The strictest safe cutoff of a rule applies in its stratum; where none is safe the rule
does not apply there. Texts of strata without labels are kept.

Defined results: null texts have no words and fail the base rule; whole texts are read;
repeated labels of an id count once, the largest; repeated rows are judged each and alike; a feature equal to a cutoff passes it; rules that
tie all apply; very long texts take time in proportion to their words and the logarithm of their number; extra columns are ignored, whatever their names; an empty table of
documents gives an empty table, and without labels only the base rule rejects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, drop_stored, stored, words

SYMBOLS = "[#*$%&|<>]"
#: Rules: feature and the cutoffs that are tried, fixed before any label is seen.
CUTOFFS = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3),
    "bang_share": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeat_share": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "bare_word_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
}
ALPHA, DELTA = 0.01, 0.05


def repeated_words(found: Column, width: int = 5) -> Column:
    """How many words of the array lie in windows of ``width`` words that the array holds twice or more.

    Windows are sorted as one long each: 43 bits of the window's hash over 20 bits of its
    place. Places whose hash bits meet another's are then compared by their words, so the
    count is exact; texts of 2^20 words and more use structs in place of packed longs.
    """
    def window_hash(h: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i + j) for j in range(width)])

    def twins(s: Column, part) -> Column:
        """Members of a sorted array whose ``part`` equals that of the one before or after."""
        def met(x: Column, i: Column) -> Column:
            same = [F.coalesce(part(F.get(s, i + step)) == part(x), F.lit(False)) for step in (-1, 1)]
            return same[0] | same[1]

        return F.filter(s, met)

    def places_of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        mask = F.lit((1 << 63) - 1)
        packed = F.sort_array(F.transform(places, lambda i: F.shiftleft(window_hash(h, i), 20).bitwiseAND(mask).bitwiseOR(i.cast("long"))))
        near = let(packed, lambda s: F.transform(twins(s, lambda x: F.shiftright(x, 20)), lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")))
        wide = F.sort_array(F.transform(places, lambda i: F.struct(window_hash(h, i).alias("h"), i.alias("i"))))
        near_wide = let(wide, lambda s: F.transform(twins(s, lambda x: x["h"]), lambda x: x["i"]))
        return F.when(F.size(h) < (1 << 20), near).otherwise(near_wide)

    def exact(candidates: Column) -> Column:
        named = F.sort_array(F.transform(candidates, lambda i: F.struct(F.array_join(F.slice(found, i + 1, width), " ").alias("w"), i.alias("i"))))
        return let(named, lambda s: F.sort_array(F.transform(twins(s, lambda x: x["w"]), lambda x: x["i"])))

    at = exact(let(F.transform(found, lambda w: F.xxhash64(w)), places_of))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
                          lambda s, i: F.struct((i + width).alias("to"), (s["n"] + (i + width - F.greatest(i, s["to"])).cast("long")).alias("n")))
    return covered["n"]


def let(value: Column, body) -> Column:
    """``body`` of a value computed once: inside a lambda a plain expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features) of every row."""
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce((F.lit("all") if stratum is None else stratum).cast("string"), F.lit("")).alias("stratum"),
                       F.col(text_col).cast("string").alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    marks = F.regexp_replace(text, r"[^#*$%&|<>!A-Z]+", "")
    bare = F.size(F.filter("w", lambda w: ~w.rlike(r"[\p{L}\p{N}]")))
    rows = (rows.withColumn("n_words", F.size("w").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
            .withColumn("marks", marks).withColumn("lines", lines)
            .withColumn("n_symbols", F.regexp_count("marks", F.lit(SYMBOLS)).cast("long"))
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("n_repeat_words", F.when(F.col("n_words") < 6, F.lit(0)).otherwise(let(F.col("w"), lambda w: repeated_words(w))).cast("long")))
    share = {
        "symbol_share": F.try_divide("n_symbols", "word_chars"),
        "bang_share": F.try_divide(F.regexp_count("marks", F.lit("!")), "word_chars"),
        "upper_share": F.try_divide(F.regexp_count("marks", F.lit("[A-Z]")), "word_chars"),
        "repeat_share": F.try_divide("n_repeat_words", "n_words"),
        "dup_line_share": F.try_divide("n_dup_lines", F.size("lines")),
        "bare_word_share": F.try_divide(bare, "n_words"),
    }
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(k) for k, x in share.items()])


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series after a shift by eight."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    shift = x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    return series - F.log(shift)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) to about 1e-9; 1 where k exceeds n*p, so the terms summed fall from k downwards."""
    nd, kd = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    terms = F.least(k, (F.lit(60) * F.sqrt(kd + 1) + 200).cast("long"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), terms), F.struct(top.alias("t"), F.lit(0.0).alias("s")),
                        lambda a, i: F.struct((a["t"] * (kd - i) * (1 - p) / ((nd - kd + i + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")))
    return F.when(kd > nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total["s"]))


def safe_cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """The stored counts, and (stratum, rule, cutoff): the strictest safe cutoff of each rule and stratum.

    ``rows`` come from ``measured``. Counts of a stratum are one partial aggregate; nothing grows beyond
    strata x rules x cutoffs rows.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    good = rows.join(marks.where("y = 1"), "doc_id", "left_semi").where(~base_failed())
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for rule, cs in CUTOFFS.items() for i, c in enumerate(cs)])
    each = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, cs in CUTOFFS.items() for i, c in enumerate(cs)]
    counts = stored(counts, "rule-counts")
    tests = max(1, counts.count()) * len(each)
    tested = counts.select("stratum", "n", F.explode(F.array(*each)).alias("x")).select("stratum", "n", "x.*")
    return counts, tested.where(binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / tests).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """Counts of every row with base_failed and kept."""
    rows = stored(measured(docs, id_col, text_col, stratum), "rules")
    counts, cut = safe_cutoffs(rows, labels, alpha, delta)
    wide = cut.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff"))
    wide = stored(wide.select(F.col("stratum").alias("s"), *[F.col(r).alias(f"{r}_cut") for r in CUTOFFS]), "cutoffs")
    drop_stored(counts)
    out = rows.join(wide, F.col("stratum") == F.col("s"), "left").withColumn("base_failed", base_failed())
    hit = F.lit(False)
    for rule in CUTOFFS:
        hit = hit | F.coalesce(F.col(rule) > F.col(f"{rule}_cut"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~hit).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
