"""Ranked lexical search: term-bucketed postings, integer scores, top-k by window.

- ``postings`` counts terms of each document into rows (bucket, term, doc_id, tf). A bucket is a hash of the term; the table is
  dealt by (term, document), so a term that most documents hold is spread over all tasks, and sorted by bucket and term in each
  file, so a reader of a few terms skips the other row groups.
- ``search`` reads the postings of the items' terms only, weighs each by a global statistic of its term and by its document's length, joins
  the items' terms, sums by item and document in the tasks that hold the document, and keeps each item's first ``k`` rows by ``row_number``,
  which Spark cuts to k before the shuffle by item.

Scores are 64-bit integers but for the logarithm of a term's weight, so they do not depend on the order of sums.

Defined results: null texts and texts without a term are no documents; very long texts are read whole; rows that share a doc_id are one
document, whose terms add up, and rows without a doc_id are one document that comes last among equal scores; rows that share an item_id (null
too) are one item, whose terms count once each; an item without terms, or whose terms no document holds, has no rows; empty tables give an empty
table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_stored, stored
from .linededup import near

BUCKETS = 64
#: Terms are maximal runs of ASCII letters and digits and of everything beyond ASCII; other ASCII characters part them.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
LENGTH = ""  #: no term; its postings hold the documents' lengths


def terms(text: Column) -> Column:
    """Array of the terms of a text in order, A-Z lower-cased, repeats included."""
    parted = F.translate(F.coalesce(text.cast("string"), F.lit("")), PARTING + UPPER, " " * len(PARTING) + LOWER)
    return F.filter(F.split(parted, " "), lambda t: t != "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) of every item, once each."""
    return items.select(F.col(id_col).alias("item_id"), F.explode(terms(F.col(text_col))).alias("term")).distinct()


def postings(docs: DataFrame, wanted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, term, doc_id, tf) of every document, and its number of terms as tf of the term LENGTH.

    ``wanted(term)`` leaves other terms out before anything is shuffled.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), terms(F.col(text_col)).alias("t"))
    sized = texts.select("doc_id", "t", F.size("t").cast("long").alias("n")).where("n > 0")
    rows = sized.select("doc_id", "n", F.explode(F.concat("t", F.array(F.lit(LENGTH)))).alias("term"))
    if wanted is not None:
        kept = wanted.select(F.col("term").alias("__term")).unionAll(docs.sparkSession.range(1).select(F.lit(LENGTH).alias("__term")))
        rows = rows.join(near(kept), F.col("term") == F.col("__term"), "left_semi")
    counted = rows.groupBy("term", "doc_id").agg(F.sum(F.when(F.col("term") == LENGTH, F.col("n")).otherwise(F.lit(1).cast("long"))).alias("tf"))
    return counted.select(bucket(F.col("term")).alias("bucket"), "term", "doc_id", "tf").sortWithinPartitions("bucket", "term")


def weights(index: DataFrame, n_docs: int) -> DataFrame:
    """(bucket, term, w): a thousand times the logarithm of how rare a term is, rounded down."""
    held = index.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    return held.select("bucket", "term", F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, equal scores by ascending doc_id."""
    asked = stored(item_terms(items, item_col, item_text), "item-terms")
    index = stored(postings(docs, asked.select("term").distinct(), id_col, text_col), "postings")
    lengths = index.where((F.col("bucket") == bucket(F.lit(LENGTH))) & (F.col("term") == LENGTH))
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    weighed = stored(weights(index, n).join(asked, "term").select("bucket", "term", "item_id", "w"), "weighed-terms")
    # m: half of 100, and half of a document's length in hundredths of the mean. A null id is told by a column of its own, so that
    # the sum by item and document finds the rows where the join has put them.
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc")]
    long = lengths.select(*key, F.expr(f"100 - 50 + ((50L * tf * {n}L) div {max(total, 1)}L)").alias("m"))
    matched = index.where(F.col("term") != LENGTH).select("bucket", "term", "tf", *key).join(long, ["none", "doc"]).join(near(weighed), ["bucket", "term"])
    scored = matched.groupBy("item_id", "none", "doc").agg(F.sum(F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")).alias("score")).where("score > 0")
    scored = scored.select("item_id", F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "score")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = stored(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    for made in (asked, index, weighed):
        drop_stored(made)
    return out
