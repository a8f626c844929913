"""Linear support-vector score of a picture: stratified folds, scaled features, one class against the rest."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle
from .prep import drop_rare, label_codes
from .sampling import hash_key


def svc_accuracy(pts: DataFrame, column: str, label: str, folds: int = 5, seed: int = 42, steps: int = 20) -> DataFrame:
    """(svc_accuracy): mean over folds of the share of held-out points that are classified right.

    Labels of one point are left out; there are no more folds than points of the rarest label. The solver is Spark's, one
    label against the rest, so scores are near to those of other solvers, not equal. NaN where fewer than two labels are left.
    """
    some = drop_rare(pts, label, 2)
    sizes = some.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("labels")).first()
    if (sizes["labels"] or 0) < 2:
        return pts.sparkSession.createDataFrame([(float("nan"),)], "svc_accuracy double")
    k = max(2, min(folds, sizes["least"]))
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_key(seed, "id"), "id")) - 1
    rows = label_codes(some.withColumn("fold", place % k), label)
    rows = rows.select("fold", F.col("code").cast("double").alias("label"), F.col(column).alias("x"))
    rows = settle(rows, "svc").select("fold", "label", array_to_vector("x").alias("raw"))
    parts = None
    for fold in range(k):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
        model = OneVsRest(classifier=LinearSVC(maxIter=steps), parallelism=8).fit(scaler.transform(train))
        right = model.transform(scaler.transform(test)).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"))
        parts = right if parts is None else parts.unionByName(right)
    return parts.agg(F.avg("a").alias("svc_accuracy"))
