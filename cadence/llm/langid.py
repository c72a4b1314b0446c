"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of the hashed byte n-grams of its small letters; ASCII marks and
digits, which tell no language, are left out. Document frequencies come from all training rows. A bounded sample of each
language (``SAMPLE`` rows shared among the languages, chosen by hash) is clustered
into several centroids by spherical k-means; a text gets the language of the centroid of
largest cosine. A text whose distance to it exceeds the distance that all but a small share of
that language's sample keeps is marked ``rejected``.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
whole texts are read, however long; ties go to the first language by name; rows that repeat are judged alike and count as often as
they stand in training; rows with a null id keep it; an empty table gives an empty table; columns other than those named are not read, whatever their names; with no
training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash60, slices

DIM = 4096
SAMPLE = 4000
CENTROIDS = 4
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")
MARKS = bytes(c for c in range(33, 128) if not chr(c).isalpha())


def folded(text: bytes) -> bytes:
    """Small letters without ASCII marks and digits, which tell no language; white space stays."""
    return text.decode().lower().encode().translate(None, MARKS)


def gram_counts(text: bytes, dim: int = DIM) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of a whole text; long texts are read in overlapping chunks."""
    total = np.zeros(dim, np.int64)
    for at in range(0, max(1, len(text)), CHUNK):
        a = np.frombuffer(text[at:at + CHUNK + 2].lower(), np.uint8).astype(np.uint32)
        if len(a) < 2:
            continue
        two = a[:-1] * np.uint32(0x01000193) + a[1:] * np.uint32(0x85EBCA6B)
        own = two[:CHUNK]
        total += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=dim)
        if len(a) > 2:
            three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
            total += np.bincount((three[:CHUNK] * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=dim)
    return total


def vectors(texts: list[bytes | None], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.sqrt(gram_counts(folded(t)))
    out *= idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def has_letter(text: bytes | None) -> bool:
    return text is not None and LETTER.search(text.decode()) is not None


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are spread by farthest-first choice, so reruns agree."""
    picks = [0]
    best = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        picks.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[picks[-1]])
    c = x[picks].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of every gram over all ``rows(text)``; tasks add up before a row for each gram is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for b in slices(batches):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t:
                    df[:DIM] += gram_counts(folded(t)) > 0
                    n += 1
        df[DIM] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(df)], ["gram", "df"])

    found = rows.mapInArrow(run, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(DIM + 1, np.int64)
    out[found["gram"]] = found["df"]
    return out[:DIM], int(out[DIM])


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, owner: np.ndarray, reach: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.owner, self.reach, self.idf = langs, centroids, owner, reach, idf


def train(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, outside: float = 0.01) -> Model:
    """``rows(doc_id, text, lang)`` of training; null languages are left out."""
    rows = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    df, n = document_frequencies(rows.select(F.col("text").cast("string")))
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + np.float32(1e-3)
    each = max(10, sample // max(1, len(langs)))
    rate = F.lit(0.0)
    for lang in langs:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, each / counts[lang]))).otherwise(rate)
    picked = rows.where(hash60(F.col("doc_id"), "lang:") < rate * float(1 << 60)).select("doc_id", "lang", F.col("text").cast("string").alias("text"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        texts = [t.encode() for t in pdf["text"]]
        texts = [t for t in texts if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "c": [], "reach": []})
        x = vectors(texts, idf)
        c = spherical_kmeans(x, centroids)
        reach = float(np.quantile((x @ c.T).max(1), outside))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "c": [v.astype(np.float32).tobytes() for v in c], "reach": reach})

    got = picked.groupBy("lang").applyInPandas(fit, "lang string, c binary, reach double").toPandas().sort_values(["lang", "c"])
    c = np.array([np.frombuffer(b, np.float32) for b in got["c"]], np.float32).reshape(-1, DIM)
    return Model(langs, c, np.array([langs.index(v) for v in got["lang"]], int), got["reach"].to_numpy(float), idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; score is the cosine to the nearest centroid."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            if b.num_rows:
                texts = b.column(1).cast(pa.binary()).to_pylist()
                ok = np.array([has_letter(t) for t in texts], bool) & (len(m.langs) > 0)
                lang, score, far = np.array(["und"] * len(texts), object), np.zeros(len(texts)), ~ok
                if ok.any() and len(m.centroids):
                    sim = vectors([t for t, o in zip(texts, ok) if o], m.idf) @ m.centroids.T
                    at = sim.argmax(1)
                    best = sim[np.arange(len(at)), at]
                    lang[ok] = np.array(m.langs, object)[m.owner[at]]
                    score[ok] = np.clip(best, 0, 1)
                    far[ok] = best < m.reach[at]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
