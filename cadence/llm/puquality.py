"""Quality classifier by positive-unlabelled learning.

A linear model on hashed byte n-grams and a few text statistics minimises the
non-negative unbiased risk  pi*R_p(+) + max(0, R_u(-) - pi*R_p(-))  of trusted positives
and unlabelled web text. The class prior pi is estimated from the scores of both alone (``class_prior``); no label 0 is read, but that
labelled rows are not unlabelled text. The fit uses bounded samples chosen by hash (``POSITIVES`` and
``UNLABELLED`` rows in expectation, ``MAX_FIT`` at most); scoring reads every whole text.

Defined results: null and empty texts get the score of a text without grams;
whole texts are read, however long; with no positives or no unlabelled text the score is 0.5; labels
that repeat for an id count once, their largest value; rows that repeat are scored each and alike; a score of exactly 0.5 is predicted 1;
empty tables give empty tables; columns other than those named are not read and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash60, slices
from .langid import gram_counts

GRAMS = 4096
FOLDED = 2048
STATS = 14
POSITIVES, UNLABELLED, MAX_FIT = 3000, 4500, 6000
EPOCHS = 60
SLACK = 0.02  #: what the calibration adds to the estimated prior, which errs downwards
SPARED = 0.002  #: share of trusted positives that calibration may put below 0.5


def features(text: bytes | None) -> np.ndarray:
    """Unit vector of square-rooted gram counts, then bounded statistics of the text."""
    t = text or b""
    out = np.zeros(FOLDED + STATS, np.float32)
    grams = np.sqrt(gram_counts(t).reshape(2, -1).sum(0))
    out[:FOLDED] = grams / max(1.0, float(np.linalg.norm(grams)))
    a = np.frombuffer(t, np.uint8)
    n = max(1, len(a))
    hist = np.bincount(a, minlength=256)
    found = t.split()
    nw = max(1, len(found))
    lines = [x for x in t.split(b"\n") if x.strip()]
    symbols = sum(int(hist[c]) for c in b"#*$%&|<>")
    out[FOLDED:] = 2 * np.array([
        min(1.0, 10 * symbols / n), min(1.0, 20 * int(hist[ord("!")]) / n), hist[65:91].sum() / n, min(1.0, 5 * hist[48:58].sum() / n), min(1.0, hist[128:].sum() / n),
        min(1.0, 10 * int(hist[10]) / n), min(1.0, len(t) / nw / 20), len(set(found)) / nw, len(set(lines)) / max(1, len(lines)), min(1.0, np.log1p(nw) / 10),
        min(1.0, sum(len(w) == 1 for w in found) / nw * 4), min(1.0, 20 * int(hist[ord(".")]) / n), min(1.0, 30 * int(hist[ord(",")]) / n), 0.5,
    ], np.float32)
    return out


def nnpu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative PU risk with the logistic loss."""
    rng = np.random.default_rng(7)
    w, b = np.zeros(pos.shape[1], np.float64), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    step, size = 0, 512
    for _ in range(epochs):
        up, pp = rng.permutation(len(unl)), rng.permutation(len(pos))
        blocks = max(1, len(unl) // size)
        for xu, xp in zip(np.array_split(up, blocks), np.array_split(pp, blocks)):
            u, p = unl[xu].astype(np.float64), pos[xp].astype(np.float64)
            if not len(p):
                continue
            zu, zp = u @ w + b, p @ w + b
            su, sp = 1 / (1 + np.exp(-zu)), 1 / (1 + np.exp(-zp))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_neg = np.append(u.T @ su / len(u) - prior * (p.T @ sp) / len(p), su.mean() - prior * sp.mean())
            g_pos = -prior * np.append(p.T @ (1 - sp) / len(p), (1 - sp).mean())
            g = g_pos + g_neg if negative >= 0 else -g_neg  # below zero the negative risk is raised again
            g[:-1] += decay * w
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
    return w, float(b)


def class_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.5) -> float:
    """Share of positives among unlabelled scores: above any threshold lie at least that share of what positives have above it.

    So the least ratio of both shares, over thresholds that keep ``least`` of the positives or more, bounds it, and meets it where some threshold leaves
    no negatives (Scott, 2015). The scores must come from a fit that saw none of the rows. One half where nothing is known.
    """
    if not len(pos) or not len(unl):
        return 0.5
    at = np.quantile(pos, np.linspace(0.0, 1 - least, 91))
    kept = 1 - np.searchsorted(np.sort(pos), at) / len(pos)
    ratio = (1 - np.searchsorted(np.sort(unl), at) / len(unl)) / np.maximum(kept, 1e-9)
    return float(np.clip(ratio.min(), 1 / (len(unl) + 2), 0.98))


def unseen_margins(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of every row by a fit on the other half of the rows, each half's centred on its own fit's unlabelled rows."""
    out = []
    for half in (0, 1):
        w, b = nnpu_fit(pos[half::2], unl[half::2], 0.5, epochs=EPOCHS // 2, decay=1e-2) if len(pos) > 1 and len(unl) > 1 else (np.zeros(pos.shape[1]), 0.0)
        p, u = margins(pos[1 - half::2], w, b), margins(unl[1 - half::2], w, b)
        mid, spread = (float(np.median(u)), float(np.std(u)) or 1.0) if len(u) else (0.0, 1.0)
        out.append(((p - mid) / spread, (u - mid) / spread))
    return np.concatenate([out[0][0], out[1][0]]), np.concatenate([out[0][1], out[1][1]])


def sampled(rows: DataFrame, want: int, seed: str, kind: int) -> DataFrame:
    """(kind, h, x): features of about ``want`` rows of ``rows(doc_id, text)``, MAX_FIT at most, chosen by hash."""
    h = hash60(F.col("doc_id"), seed)
    picked = rows.where(h < F.lit(min(1.0, want / max(1, rows.count())) * float(1 << 60))).select(h.alias("h"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).astype(np.float16).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["h", "x"])

    return picked.mapInArrow(run, "h long, x binary").orderBy("h", "x").limit(MAX_FIT).withColumn("kind", F.lit(kind))


def margins(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.concatenate([np.zeros(0)] + [x[i:i + 512].astype(np.float64) @ w for i in range(0, len(x), 512)]) + b


class Model:
    def __init__(self, w: np.ndarray, b: float, prior: float):
        self.w, self.b, self.prior = w.astype(np.float32), b, prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """``labels`` holds training rows only; documents without a training label are the unlabelled text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    both = sampled(rows.join(marks.where("y = 1"), "doc_id", "left_semi"), POSITIVES, "pos:", 1).unionByName(sampled(rows.join(marks, "doc_id", "left_anti"), UNLABELLED, "web:", 0))

    def fit(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        x = np.array([np.frombuffer(v, np.float16) for v in t.column("x").to_pylist()], np.float16)
        x, kind = (v[np.lexsort((t.column("h").to_numpy(), kind))] for v in (x, kind))
        pos, unl = x[kind == 1], x[kind == 0]
        if not len(pos) or not len(unl):
            return pa.table({"w": pa.array([], pa.binary()), "b": pa.array([], pa.float64()), "prior": pa.array([], pa.float64())})
        prior = class_prior(*unseen_margins(pos, unl))
        w, b = nnpu_fit(pos, unl, prior)
        # Score 0.5 lies where the prior's share of unlabelled rows passes, but no trusted positive beyond SPARED fails.
        cut = min(float(np.quantile(margins(unl, w, b), 1 - min(0.98, prior + SLACK))), float(np.quantile(margins(pos, w, b), SPARED)))
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "b": [b - cut], "prior": [prior]})

    # The bounded sample is fitted in one task, so the driver only gets the weights.
    got = both.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "w binary, b double, prior double").collect()
    if not got:
        return Model(np.zeros(FOLDED + STATS), 0.0, 0.5)
    return Model(np.frombuffer(bytes(got[0].w), np.float64), got[0].b, got[0].prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(b.column(1).cast(pa.binary()).to_pylist(), sent.value))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def score_texts(texts: list[bytes | None], model: Model) -> np.ndarray:
    z = np.array([float(features(t) @ model.w) for t in texts], np.float64) + model.b
    return 1 / (1 + np.exp(-z))


def keep_good(docs: DataFrame, model: Model, cutoff: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` whose score reaches ``cutoff``; all columns stay and nothing is shuffled."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(score_texts(b.column(at).cast(pa.binary()).to_pylist(), sent.value) >= cutoff))

    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return out.mapInArrow(run, out.schema)
