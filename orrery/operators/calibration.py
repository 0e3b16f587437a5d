"""Hold-out calibration: accuracy, threshold curves with Wilson bounds, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import round4

Z = 1.96
THRESHOLDS = [round(0.20 + 0.05 * i, 2) for i in range(15)]
LEAST_THRESHOLD, LEAST_AUTO, LEAST_ACCURACY, LEAST_HOLDOUT = 0.35, 10, 0.85, 20


def wilson_low(k: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of the Wilson interval, four digits; null if n is 0."""
    n = n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, round4(low))


def overall(h: DataFrame) -> DataFrame:
    """h: gold, pred, gold_unit, pred_unit, score. One row of metrics."""
    right = F.count_if(F.col("gold") == F.col("pred"))
    n = F.count(F.lit(1))
    return h.agg(n.alias("n"), right.alias("correct"), F.count_if(F.col("gold_unit") == F.col("pred_unit")).alias("unit_correct")).withColumns({"accuracy": round4(F.col("correct") / F.nullif(F.col("n"), F.lit(0))), "accuracy_lo95": wilson_low(F.col("correct"), F.col("n")), "unit_accuracy": round4(F.col("unit_correct") / F.nullif(F.col("n"), F.lit(0)))})


def curve(h: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """A row per threshold: what would be confirmed, and how well. Null units that agree count here."""
    each = h.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    auto = F.col("score") >= F.col("threshold")
    g = each.groupBy("threshold").agg(F.count_if(auto).alias("auto"), F.count_if(auto & (F.col("gold") == F.col("pred"))).alias("auto_correct"), F.count_if(auto & F.col("gold_unit").eqNullSafe(F.col("pred_unit"))).alias("unit_correct"), F.count(F.lit(1)).alias("n"))
    d = F.nullif(F.col("auto"), F.lit(0))
    return g.select("threshold", "auto", round4(F.col("auto") / F.col("n")).alias("auto_rate"), round4(F.col("auto_correct") / d).alias("accuracy"), wilson_low(F.col("auto_correct"), F.col("auto")).alias("accuracy_lo95"), round4(F.col("unit_correct") / d).alias("unit_accuracy"), (F.col("n") - F.col("auto")).alias("queued"), "n")


def recommended(c: DataFrame) -> DataFrame:
    """The smallest threshold whose point accuracy and counts suffice; null if none."""
    ok = (F.col("threshold") >= LEAST_THRESHOLD) & (F.col("auto") >= LEAST_AUTO) & (F.col("accuracy") >= LEAST_ACCURACY) & (F.col("n") >= LEAST_HOLDOUT)
    return c.agg(F.min(F.when(ok, F.col("threshold"))).alias("threshold"))


def confidence(rows: DataFrame, c: DataFrame, score: str = "score", floor: float = LEAST_THRESHOLD, least: int = LEAST_AUTO) -> DataFrame:
    """Add confidence: the best lower bound among curve points at or below the score.

    The curve has a row per threshold; it is carried as one array.
    """
    points = c.filter((F.col("threshold") >= floor) & (F.col("auto") >= least)).agg(F.collect_list(F.struct("threshold", "accuracy_lo95")).alias("_points"))
    best = F.array_max(F.transform(F.filter("_points", lambda p: p["threshold"] <= F.col(score)), lambda p: p["accuracy_lo95"]))
    return rows.crossJoin(F.broadcast(points)).withColumn("confidence", best).drop("_points")
