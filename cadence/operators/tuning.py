"""Hyperparameter search as one plan: trials by keys in one frame, scored by folds, thinned by successive halving. No driver loop, no job of its own."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import arrays
from .trees import choices

#: One-step predictions of every value from those before it, an array as long as the series, null where there is none.
Predictions = Callable[[Column, dict[str, Column]], Column]


def exponential(y: Column, p: dict[str, Column]) -> Column:
    """Exponential smoothing by ``alpha`` that starts at the first value, pulled to the mean so far of the levels by ``pull`` (0 for none)."""
    alpha, pull = p["alpha"], p.get("pull", F.lit(0.0))

    def step(s: Column, v: Column) -> Column:
        level = alpha * v + (1 - alpha) * s["level"]
        mean = (s["mean"] * s["n"] + v) / (s["n"] + 1)
        guess = (1 - pull) * s["level"] + pull * s["mean"]
        return F.struct(level.alias("level"), mean.alias("mean"), (s["n"] + 1).alias("n"), F.concat(s["out"], F.array(guess)).alias("out"))

    first = F.get(y, F.lit(0))
    start = F.struct(first.alias("level"), first.alias("mean"), F.lit(1.0).alias("n"), F.array(F.lit(None).cast("double")).alias("out"))
    return F.aggregate(F.slice(y, F.lit(2), F.greatest(F.lit(0), F.size(y) - 1)), start, step)["out"]


def seasonal_blend(y: Column, p: dict[str, Column]) -> Column:
    """``share`` of the value a ``season`` before, the rest from the last value."""
    season = p["season"].cast("int")
    return F.transform(y, lambda v, i: F.when(i >= season, p["share"] * F.get(y, i - season) + (1 - p["share"]) * F.get(y, i - 1)))


def loss(metric: str, y: Column, guess: Column, rows: Column) -> Column:
    """mae, rmse or smape of the last ``rows`` values that have a prediction; null without any. Pairs of zeros do not count for smape."""
    pairs = F.filter(F.slice(F.zip_with(y, guess, lambda a, g: F.struct(a.alias("a"), g.alias("g"))), -rows, rows), lambda x: x["a"].isNotNull() & x["g"].isNotNull())
    error = lambda x: F.abs(x["a"] - x["g"])
    if metric == "smape":
        pairs = F.filter(pairs, lambda x: F.abs(x["a"]) + F.abs(x["g"]) > 2e-10)
        each = F.transform(pairs, lambda x: 200 * error(x) / (F.abs(x["a"]) + F.abs(x["g"])))
    elif metric == "rmse":
        each = F.transform(pairs, lambda x: error(x) * error(x))
    elif metric == "mae":
        each = F.transform(pairs, error)
    else:
        raise ValueError(f"metric must be mae, rmse or smape, not {metric}")
    mean = F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.size(each))
    return F.sqrt(mean) if metric == "rmse" else mean


def tuned(df: DataFrame, keys: Sequence[str], t: str, value: str, space: dict[str, Sequence[float]], model: Predictions = exponential, metric: str = "mae", validation: int = 52,
          n: int | None = None, seed: int = 42, rungs: int = 3, eta: int = 3) -> DataFrame:
    """(keys, trial, parameters, loss, rung, rank, best): every trial of every key; a space is searched whole, or by ``n`` draws without repeats.

    All trials are scored on the last validation rows divided by ``eta`` for each rung below the top; the best one of ``eta`` goes on to the next rung, the last rung
    reads all ``validation`` rows. ``rung`` is the last one a trial reached, from 0, ``rank`` its place there, ``loss`` its error there; ``best`` marks the first place of the top.
    Ties go to the earlier trial; trials without an error come last. The rows before the validation rows only warm the model up.
    """
    names, sets = list(keys), choices(space, n, seed)
    tried = F.array(*[F.struct(F.lit(i).alias("trial"), F.create_map(*[c for k, v in s.items() for c in (F.lit(k), F.lit(float(v)))]).alias("parameters")) for i, s in enumerate(sets)])
    rows = arrays(df, names, t, value).select(*names, "y", F.inline(tried))
    rows = rows.withColumn("__g", model(F.col("y"), {k: F.col("parameters")[k] for k in space})).withColumns({"loss": F.lit(None).cast("double"), "rung": F.lit(-1), "rank": F.lit(0)})
    size, alive, left = F.size("y"), F.lit(True), len(sets)
    for r in range(rungs):
        part = F.least(F.lit(math.ceil(validation / eta ** (rungs - 1 - r))), size)
        score = F.when(alive, loss(metric, F.col("y"), F.col("__g"), part))
        rows = rows.withColumns({"__alive": alive, "__loss": score})
        order = Window.partitionBy(*names).orderBy(F.desc("__alive"), F.asc_nulls_last("__loss"), "trial")
        rows = rows.withColumn("__rank", F.row_number().over(order)).withColumns({
            "loss": F.when(F.col("__alive"), F.col("__loss")).otherwise(F.col("loss")), "rung": F.when(F.col("__alive"), F.lit(r)).otherwise(F.col("rung")), "rank": F.when(F.col("__alive"), F.col("__rank")).otherwise(F.col("rank"))})
        left = max(1, math.ceil(left / eta))
        alive = F.col("__alive") & (F.col("__rank") <= left)
    top = (F.col("rung") == rungs - 1) & (F.col("rank") == 1) & F.col("loss").isNotNull()
    return rows.select(*names, "trial", "parameters", "loss", "rung", "rank", top.alias("best"))
