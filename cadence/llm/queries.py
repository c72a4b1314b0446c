"""The queries opN_<name> over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, convtrie, decontam, langid, lexical, linededup, lmscore, mixing, puquality, quality_rules, secrets, simhash, sql, urlfilter
from .common import drop_stored, fold, stored, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's score; a document's source stands for its path."""
    return secrets.scan(table(spark, sf_dir, "documents"), path=F.col("source"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by nearest centroid; fold 0 of 5 is held out of all learning."""
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, cap=2.0, cycle=(5.0, 2.0, 1.0))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "first_doc", "first_line", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels, stratum=F.col("lang"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores; fold 1 of 5 is held out of all counts and training."""
    docs = table(spark, sf_dir, "documents")
    scored = lmscore.lm_scores(docs, fold(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by positive-unlabelled learning; labels of fold 1 of 3 are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = puquality.train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    scored = puquality.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that share first turns in groups of twenty."""
    turns = stored(convtrie.hashed(convtrie.turns(table(spark, sf_dir, "conversations"))), "turns")
    rows, members = convtrie.with_shared_heads(turns, group=20, heads=4)
    out = convtrie.prefix_trie(rows, members)
    drop_stored(turns)
    drop_stored(members)
    return out


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), bpe.path("word_bpe_49k.json")), bpe.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_language_id, op3_simhash_near_dedup, op4_source_mixing, op5_line_dedup, op6_url_filter,
        op7_benchmark_decontamination, op8_quality_rules, op9_lm_scoring, op10_quality_classifier, op11_prefix_trie, op12_bpe_encoding, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixing": sql.MIXING,
        "op5_line_dedup": sql.LINE_DEDUP,
        "op7_benchmark_decontamination": sql.DECONTAMINATION,
        "op11_prefix_trie": sql.PREFIX_TRIE,
        "op13_lexical_search": sql.LEXICAL_SEARCH,
        "op8_quality_rules": sql.quality_rules(quality_rules.CUTOFFS, quality_rules.ALPHA, quality_rules.DELTA),
    }
