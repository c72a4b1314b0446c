"""Secret scans, in DataFrame and ML functions only.

Candidates are all maximal runs of ``LEAST`` token characters or more, and shorter ones from ``LEAST_ASSIGNED`` on that a
``:`` or ``=`` stands before; no upper bound, no digit is asked for. ``=`` ends a run (but for padding), so the name in ``NAME=value`` is no part of it.
A random forest on a candidate's length, character transitions,
dictionary coverage, its path and the words beside it then removes false positives. It is
trained on labelled findings, a table (candidate, before, after, path, label).

Where there is no table of reviewed findings, ``seed_label`` labels candidates by what is assigned to them: 1 to a credential name,
0 to an innocent name, 0 to plain words and numbers in running text without such names; other bare candidates teach nothing. The forest then never sees the assignment it was
labelled by: it is cut from the neighbourhood before features are made (``withheld``). So it learns what secrets look like, and
judges assigned words as well as secrets that stand bare.

The forest is one pipeline of Spark ML; a bounded number of labelled findings trains it
(``MAX_FINDINGS``, chosen by hash), every text is scanned whole. The dictionary is the set of
common character trigrams of the texts' own lower-case words, counted at every place of all texts and
cut at a fixed size (``TRIGRAMS``), so it is sent to tasks as a literal of known bound.

Defined results: null texts have no candidates; a candidate that repeats in a text is found each time, and rows that repeat are scanned each;
very long texts and runs are read whole, in time proportional to their length; trigrams of one count are taken by name; columns other than those named are not read,
so names cannot clash; empty tables give empty tables; without labels of both kinds the rule that made
the seeds decides alone.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hash60, stored

LEAST, LEAST_ASSIGNED = 16, 8
TOKEN = r"A-Za-z0-9+/_.\-"
CANDIDATE = rf"(?<![{TOKEN}])(?:[{TOKEN}]{{{LEAST},}}={{0,2}}|(?<=[:=][\x22'` ]{{0,2}})[{TOKEN}]{{{LEAST_ASSIGNED},}}={{0,2}})"
BESIDE = 48  #: characters kept on either side
#: Words that name a credential, and words that name what only looks like one (fixed values).
NAMING = ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "auth", "bearer", "credential", "private", "access")
INNOCENT = ("commit", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "rev", "revision", "etag", "example", "isbn", "url", "href")
NEIGHBOURS = 12  #: buckets of hashed neighbouring words
FEATURES = ("length", "digit_share", "upper_share", "separator_share", "hex_only", "transitions", "class_changes", "entropy", "coverage", "vowel_pairs", "named", "innocent", "assigned", "quoted",
            "path_code", "path_docs", "path_depth", *(f"beside_{k}" for k in range(NEIGHBOURS)))
TRIGRAMS = 500
MAX_FINDINGS = 20_000
TREES, DEPTH = 40, 6
MARK = "\u0001"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """(doc_id, path, place, candidate, before, after) of every candidate of every whole text.

    One pass marks the runs and one cut at the marks gives them and what lies between in turn, so no text is copied for each of its candidates.
    """
    text = F.replace(F.col(text_col).cast("string"), F.lit(MARK), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(None) if path is None else path).cast("string").alias("path"),
                       F.split(F.regexp_replace(text, f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK, -1).alias("parts")).where(F.size("parts") > 1)
    rows = rows.withColumns({"tails": F.transform("parts", lambda p: F.right(p, F.lit(BESIDE))), "heads": F.transform("parts", lambda p: F.substring(p, 1, BESIDE))})
    # So many parts hold BESIDE characters whatever lies between: every second one is a candidate.
    reach = 2 * -(-BESIDE // LEAST_ASSIGNED)

    def found(k: Column) -> Column:
        at = 2 * k + 1  # from 0
        before = F.slice("tails", F.greatest(F.lit(1), at + 1 - reach), F.least(at, F.lit(reach)))
        return F.struct(k.cast("int").alias("place"), F.get("parts", at).alias("candidate"), F.right(F.array_join(before, ""), F.lit(BESIDE)).alias("before"),
                        F.substring(F.array_join(F.slice("heads", at + 2, F.lit(reach)), ""), 1, BESIDE).alias("after"))

    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("parts") / 2).cast("int") - 1), found)
    return rows.select("doc_id", "path", F.explode(each).alias("x")).select("doc_id", "path", "x.*")


def common_trigrams(docs: DataFrame, text_col: str = "text", size: int = TRIGRAMS) -> list[str]:
    """The most frequent letter trigrams at any place of the texts' lower-case words, over all texts; ties by name."""
    pairs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit("(?=([a-z]{3}))"), F.lit(1))
    rows = docs.select(F.explode(pairs).alias("t")).groupBy("t").count()
    return [r.t for r in rows.orderBy(F.desc("count"), "t").limit(size).collect()]


def any_word(text: Column, found: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)(^|[^a-z])(" + "|".join(found) + r")([^a-z]|$)").cast("double")


def without_assignment(before: Column) -> Column:
    """What stands before a candidate, without the name that it is assigned to."""
    return F.regexp_replace(F.coalesce(before, F.lit("")), r"[A-Za-z0-9_.\-]*[\x22'`\]]?\s{0,3}[:=]{1,2}>?\s{0,3}[\x22'`]?$", " ")


def with_features(found: DataFrame, trigrams: list[str], withheld: bool = False) -> DataFrame:
    """The columns FEATURES beside what ``candidates`` gives; ``withheld`` leaves the assignment before a candidate, and its quote, out of sight."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001\u0002\u0003]", "\u0004")
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))).cast("double"))
    entropy = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
    low = ascii_lower(c)
    known = F.array(*[F.lit(t) for t in trigrams]) if trigrams else F.array().cast("array<string>")
    grams = F.array_distinct(F.regexp_extract_all(low, F.lit("(?=(...))"), F.lit(1)))
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    if withheld:
        before, after = without_assignment(before), F.regexp_replace(after, "^[\"'`]", " ")
    path = ascii_lower(F.coalesce("path", F.lit("")))
    beside = F.regexp_extract_all(ascii_lower(F.concat(before, F.lit(" "), after)), F.lit("[a-z_]{2,}"), F.lit(0))
    made = {
        "length": F.log1p(n),
        "digit_share": F.regexp_count(c, F.lit("[0-9]")) / n,
        "upper_share": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "separator_share": F.regexp_count(c, F.lit("[./_\\-]")) / n,
        "hex_only": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "transitions": F.regexp_count(c, F.lit("(?=[0-9][A-Za-z]|[A-Za-z][0-9])")) / n,
        "class_changes": F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")) / n,
        "entropy": entropy,
        "coverage": F.size(F.array_intersect(grams, known)) / F.greatest(F.lit(1), F.size(grams)),
        "vowel_pairs": F.regexp_count(low, F.lit("[aeiou][b-df-hj-np-tv-z]")) / n,
        "named": any_word(before, NAMING),
        "innocent": any_word(before, INNOCENT),
        "assigned": before.rlike(r"[:=]\s*[\x22'`]?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "path_code": path.rlike(r"\.(py|js|ts|java|go|env|ya?ml|json|toml|ini|cfg|sh|tf)$").cast("double"),
        "path_docs": path.rlike(r"(test|example|sample|doc|fixture)").cast("double"),
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
    }
    in_bucket = lambda k: F.filter("__beside", lambda w: F.pmod(F.xxhash64(w), F.lit(NEIGHBOURS)) == k)
    made |= {f"beside_{k}": F.size(in_bucket(k)) for k in range(NEIGHBOURS)}
    return found.withColumn("__beside", beside).withColumns({k: F.coalesce(made[k].cast("double"), F.lit(0.0)) for k in FEATURES}).drop("__beside")


def seed_label(before: Column, after: Column, candidate: Column) -> Column:
    """Labels of findings where no reviewed table is at hand: 1 for a value assigned to a credential name, quoted or not, 0 for one
    assigned to an innocent name, and 0 for words of small letters (hyphens, dots and slashes between them) and plain numbers that nothing assigns
    and no credential's name precedes; null for all else, so what stands bare and mixes letters and digits is judged without having been taught."""
    b = F.coalesce(before, F.lit(""))
    end = r"[a-z0-9_.\-]*[\x22'`\]]?\s{0,3}[:=]{1,2}>?\s{0,3}[\x22'`]?$"
    innocent, secret = (b.rlike(r"(?i)(" + "|".join(x) + ")" + end) for x in (INNOCENT, NAMING))
    bare = ~b.rlike(r"[:=]\s*[\x22'`]?$") & (any_word(b, NAMING) == 0)
    word = ~candidate.rlike("[0-9+=]") & ~F.substring(candidate, F.lit(2), F.length(candidate)).rlike("[A-Z]")
    number = ~candidate.rlike("[A-Za-z]")
    return F.when(secret & ~innocent, F.lit(1.0)).when(innocent & ~secret, F.lit(0.0)).when(bare & (word | number), F.lit(0.0))


def train(findings: DataFrame, trigrams: list[str], max_findings: int = MAX_FINDINGS, withheld: bool = False) -> PipelineModel | None:
    """Forest of ``findings(candidate, before, after, path, label)``; None without both labels."""
    rows = findings.where("label is not null and candidate is not null").select("candidate", "before", "after", "path", F.col("label").cast("double").alias("label")).distinct()  # a finding that repeats teaches once
    counts = {float(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if {0.0, 1.0} - set(counts):
        return None
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, max_findings / 2 / n))).otherwise(rate)
    picked = rows.where(hash60(F.concat_ws("|", "candidate", "before", "after", "path"), "find:") < rate * float(1 << 60))
    featured = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(picked, trigrams, withheld)).select("features", F.col("label").cast("double").alias("label"))
    # One order and few partitions: the forest's bootstrap then agrees between runs.
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, minInstancesPerNode=2)
    model = forest.fit(featured.orderBy(F.xxhash64(vector_to_array("features")), "label").coalesce(1))
    return PipelineModel([VectorAssembler(inputCols=list(FEATURES), outputCol="features"), model])


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, cutoff: float = 0.5) -> DataFrame:
    """(doc_id, place, candidate, before, after, score, secret) of every candidate.

    Without a table of reviewed ``findings`` the candidates that ``seed_label`` is sure of train the forest.
    """
    found = stored(candidates(docs, id_col, text_col, path), "candidates")
    trigrams, withheld = common_trigrams(docs, text_col), findings is None
    labelled = found.withColumn("label", seed_label(F.col("before"), F.col("after"), F.col("candidate"))) if findings is None else findings
    model = train(labelled, trigrams, withheld=withheld)
    if model is None:
        scored = found.withColumn("score", F.coalesce(seed_label(F.col("before"), F.col("after"), F.col("candidate")), F.lit(0.0)))
    else:
        scored = model.transform(with_features(found, trigrams, withheld)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", F.col("place").cast("long").alias("place"), "candidate", "before", "after", "score", (F.col("score") >= cutoff).alias("secret"))
