"""Stacked ensembles: non-negative least squares of every key's model predictions, on aggregated Gram matrices."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regression import backward, cholesky, dot, doubles, matrices, products, running

NEGLIGIBLE = 1e-12  #: share of what a set explains that makes no difference


def wide(rows: DataFrame, by: Sequence[str], models: Sequence[str]) -> DataFrame:
    """(by, actual, predictions of each model as m0, m1, ...) of tall rows (by, model, actual, predicted)."""
    each = [F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(f"m{j}") for j, m in enumerate(models)]
    return rows.groupBy(*by).agg(F.first("actual", True).alias("actual"), *each)


def non_negative(a: Column, p: int) -> Column:
    """Least-squares weights of p features that are at least 0, from a bordered Gram matrix.

    Every set of features is solved on its own (2^p systems of the key's small matrix); of those without a negative weight the one of least
    squared errors is the answer. Ties go to the smaller set, then to the earlier models.
    """
    sets = sorted(itertools.product((0.0, 1.0), repeat=p), key=lambda s: (sum(s), [-v for v in s]))
    total = F.get(F.get(a, F.lit(p)), F.lit(p))
    masks = F.array(*[doubles(*s, 1.0) for s in sets])
    masked = lambda m: F.transform(a, lambda row, i: F.zip_with(row, m, lambda v, k: v * k * F.get(m, i)))

    def answer(m: Column) -> Column:
        lower = cholesky(masked(m), p)
        last = F.element_at(F.element_at(lower, -1), -1)
        return F.struct((last * last).alias("sse"), backward(lower, p).alias("w"))

    solved = F.filter(F.transform(masks, answer), lambda s: ~F.exists(s["w"], lambda v: v < 0))
    best = F.aggregate(solved, F.struct(F.lit(1e300).alias("sse"), F.array_repeat(F.lit(0.0), p).alias("w")),
                       lambda b, s: F.when(b["sse"] - s["sse"] > NEGLIGIBLE * (total - s["sse"]), s).otherwise(b))
    return best["w"]


def stacked(rows: DataFrame, keys: Sequence[str], models: Sequence[str], t: str = "date") -> DataFrame:
    """(keys, weights): non-negative weights of ``models`` on the rows (keys, date, model, actual, predicted) for which all have a prediction."""
    if not 1 <= len(models) <= 6:
        raise ValueError("between one and six models can be stacked")
    p = len(models)
    parts = products(wide(rows, [*keys, t], models), keys, [F.col(f"m{j}") for j in range(p)], F.col("actual"))
    return matrices(parts, keys, p).select(*keys, non_negative(F.col("a"), p).alias("weights"))


def walkforward(rows: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """(keys, te, h, date, actual, predicted, weights): at each origin the models' forecasts ``rows(keys, te, h, date, model, actual, predicted)`` are weighed by what was known then.

    A forecast counts for the origins from te + h on, whose past holds its actual value; the matrices of later origins are running sums. Origins
    without a past weigh all models alike, and so do those whose models were all worse than nothing.
    """
    names, p = list(keys), len(models)
    if not 1 <= p <= 6:
        raise ValueError("between one and six models can be stacked")
    table = wide(rows, [*names, "te", "h", "date"], models)
    tes = table.groupBy(*names).agg(F.sort_array(F.collect_set("te")).alias("tes"))
    known = table.join(tes, names).withColumn("te", F.get(F.filter("tes", lambda e: e >= F.col("te") + F.col("h")), F.lit(0))).where("te is not null")
    parts = products(known, [*names, "te"], [F.col(f"m{j}") for j in range(p)], F.col("actual"))
    fits = matrices(running(parts, names, tes, p + 1), [*names, "te"], p).select(*names, "te", non_negative(F.col("a"), p).alias("__w"))
    alike = F.array_repeat(F.lit(1.0 / p), p)
    out = table.join(fits, [*names, "te"], "left").withColumn("weights", F.when(F.exists("__w", lambda v: v > 0), F.col("__w")).otherwise(alike))
    return out.select(*names, "te", "h", "date", "actual", dot(F.col("weights"), F.array(*[f"m{j}" for j in range(p)])).alias("predicted"), "weights")
