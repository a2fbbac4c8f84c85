"""Quality of the scores against star ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed


def labelled_comments(comment_degrees: DataFrame, comments: DataFrame) -> DataFrame:
    """Every scored comment with its predicted label, and its actual one when it is rated."""
    predicted = F.when(F.col("cDegValue") > fixed.GOOD_DEGREE, 1).otherwise(-1)
    actual = F.when(F.col("score") > fixed.GOOD_SCORE, 1).otherwise(-1)
    rated = comments.select("pId", "cId", actual.alias("actual"))
    return comment_degrees.select("pId", "cId", predicted.alias("predicted")).join(
        rated, ["pId", "cId"], "left"
    )


def classification_quality(comment_degrees: DataFrame, comments: DataFrame) -> DataFrame:
    """Precision, recall and F of the positive class over all products, one row."""
    predicted, actual = F.col("predicted") > 0, F.col("actual") > 0
    p, r = F.col("p"), F.col("r")
    return (
        labelled_comments(comment_degrees, comments)
        .agg(
            F.count_if(predicted & actual).alias("tp"),
            F.count_if(predicted).alias("predicted_true"),
            F.count_if(actual).alias("actual_true"),
            F.count(F.lit(1)).alias("all_count"),
        )
        .withColumn("p", F.try_divide("tp", "predicted_true"))
        .withColumn("r", F.try_divide("tp", "actual_true"))
        .withColumn("f", F.try_divide(p * r * 2, p + r))
    )
