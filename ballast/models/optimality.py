"""Whether a fitted linear model is where its objective has no slope left."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def steepest_slope(model: LogisticRegressionModel, rows: DataFrame) -> float:
    """The largest entry of the gradient of the weighted, L2-penalised log-loss at the model's coefficients.

    ``rows`` hold ``features``, ``label`` and, for a weighted model, its weight column. One pass: a partial sum
    for each feature and task is all that is shuffled.
    """
    weight = F.col(model.getWeightCol()) if model.isDefined(model.weightCol) and model.getWeightCol() else F.lit(1.0)
    scored = model.transform(rows.withColumn("_weight", weight.cast("double")))
    error = F.col("_weight") * (vector_to_array("probability")[1] - F.col("label"))
    # The intercept is the slope of a feature that is always 1.
    inputs = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    cells = scored.select("_weight", error.alias("error"), F.posexplode(inputs).alias("j", "x"))
    sums = cells.groupBy("j").agg((F.sum(F.col("error") * F.col("x")) / F.sum("_weight")).alias("slope")).collect()
    penalty = model.getRegParam() * (1 - model.getElasticNetParam())
    pull = [penalty * float(c) for c in model.coefficients] + [0.0]
    return max(abs(r["slope"] + pull[r["j"]]) for r in sums)
