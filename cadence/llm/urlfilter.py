"""URL filter: rules first, then the ratio of two character language models.

A rule names a host and a path prefix; it fits the host and its subdomains, and the
longest fitting rule decides. URLs that no rule fits are judged by two smoothed
variable-order Markov models, one of accepted and one of rejected URLs (those that rules
decided): the probability of a character mixes the orders from ``ORDER`` down to a uniform
one, each order weighted by how often and how variedly its context was seen
(Witten-Bell). The verdict is the sign of the log-likelihood difference for
each character less a cutoff calibrated on URLs kept out of the counts.

The models count at most ``SAMPLE`` URLs of each kind, chosen by hash, so what is sent to
tasks is bounded; every URL is judged. Defined results: null URLs and URLs without
``://`` have an empty host and path, no rule fits them and an empty text is
allowed; repeated rows count again and are judged alike; with no URLs of one kind everything else is allowed; a difference equal to the cutoff
allows; URLs are read whole, however long; rules of one length are tried in order of their text, the last that fits decides; an empty table gives an empty
table; columns other than those named are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hash60

#: (host, path prefix, verdict) of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER = 4
SAMPLE = 5_000
ALPHABET = 257


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, by the length of host plus path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Markov:
    """Counts of characters after contexts of every order up to ``order``."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            raw = b"\x02" + t.encode()
            for i in range(1, len(raw) + 1):
                c = raw[i] if i < len(raw) else 256
                for n in range(min(order, i) + 1):
                    self.counts[raw[i - n:i]][c] += 1
        self.counts = {k: dict(v) for k, v in self.counts.items()}
        self.mass = {k: (sum(v.values()), len(v)) for k, v in self.counts.items()}
        self.known: dict[bytes, float] = {}

    def log_p(self, context: bytes, c: int) -> float:
        key = context + (bytes([c]) if c < 256 else b"\xff\xff\xff")
        found = self.known.get(key)
        if found is None:
            p = 1.0 / ALPHABET
            for n in range(len(context) + 1):
                part = context[len(context) - n:]
                at = self.mass.get(part)
                if at is None:
                    break
                p = (self.counts[part].get(c, 0) + at[1] * p) / (at[0] + at[1])
            found = float(np.log(p))
            if len(self.known) < 200_000:
                self.known[key] = found
        return found

    def score(self, text: str) -> float:
        raw = b"\x02" + text.encode()
        return sum(self.log_p(raw[max(0, i - self.order):i], raw[i] if i < len(raw) else 256) for i in range(1, len(raw) + 1))


class Ratio:
    """The two models with the calibrated cutoff; ``judge`` gives the difference for each character less the cutoff."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        self.ready = bool(accepted and rejected)
        held = [accepted[::5], rejected[::5]]
        fit = [[t for i, t in enumerate(x) if i % 5] or x for x in (accepted, rejected)]
        self.good, self.bad, self.cutoff = Markov(fit[0]), Markov(fit[1]), 0.0
        if self.ready:
            self.cutoff = self._calibrate(*[np.array([self._raw(t) for t in x]) for x in held])

    def _raw(self, text: str) -> float:
        return (self.good.score(text) - self.bad.score(text)) / (len(text.encode()) + 1)

    @staticmethod
    def _calibrate(good: np.ndarray, bad: np.ndarray) -> float:
        """Cutoff of least balanced error; the middle of the best interval."""
        at = np.unique(np.concatenate([good, bad]))
        mids = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
        g, b = np.sort(good), np.sort(bad)
        error = np.searchsorted(g, mids) / len(g) + 1 - np.searchsorted(b, mids) / len(b)
        best = np.flatnonzero(error <= error.min() + 1e-12)
        return float(mids[best[len(best) // 2]])

    def judge(self, text: str) -> float:
        return self._raw(text) - self.cutoff if self.ready and text else 0.0


def train(judged: DataFrame, sample: int = SAMPLE) -> Ratio:
    """``judged(text, verdict)`` of URLs that rules decided."""
    counts = {r["verdict"]: r["count"] for r in judged.where("text <> ''").groupBy("verdict").count().collect()}
    kinds = []
    for verdict in ("allow", "block"):
        rate = min(1.0, sample / max(1, counts.get(verdict, 0)))
        h = hash60(F.col("text"), "url:")
        rows = judged.where((F.col("verdict") == verdict) & (F.col("text") != "") & (h < F.lit(rate * float(1 << 60)))).select(h.alias("h"), "text")
        kinds.append([r.text for r in rows.orderBy("h", "text").limit(sample).collect()])
    return Ratio(*kinds)


_held: dict = {}


def filter_urls(pages: DataFrame, rules: tuple = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) of every row; margin is null where a rule decides."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "").alias("text"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    model = train(rows.where("r is not null").select("text", F.col("r.verdict").alias("verdict")), sample)
    sent, key = pages.sparkSession.sparkContext.broadcast((model.good.counts, model.bad.counts, model.cutoff, model.ready)), uuid.uuid4().hex
    margin = F.pandas_udf(margins(sent, key), "double")
    rows = rows.withColumn("margin", F.when(F.col("r").isNull(), margin(F.when(F.col("r").isNull(), F.col("text")))))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("margin") >= 0, F.lit("allow")).otherwise(F.lit("block")))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "margin")


def margins(sent, key: str):
    def run(texts: pd.Series) -> pd.Series:
        if key not in _held:
            _held.clear()
            _held[key] = restored(*sent.value)
        model = _held[key]
        return pd.Series([None if t is None else model.judge(t) for t in texts], dtype="float64")

    return run


def restored(good: dict, bad: dict, cutoff: float, ready: bool) -> Ratio:
    out = Ratio([], [])
    for m, counts in ((out.good, good), (out.bad, bad)):
        m.counts = counts
        m.mass = {k: (sum(v.values()), len(v)) for k, v in counts.items()}
    out.cutoff, out.ready = cutoff, ready
    return out
