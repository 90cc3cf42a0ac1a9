"""Recall rules of place recognition (A28-A32): what counts as a true match, over many score thresholds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evidence(nodes: DataFrame, found: DataFrame, truth: DataFrame, reach: float, n: int = 10) -> DataFrame:
    """One row for each node (id): its best candidate and what the rules need of the first n and of the truths.

    found: id, cand, dist, score (lower is better); truth: id, place, dist. Ties go to the smaller id. Nodes without
    candidates or truths have nulls there and exists = false.
    """
    w = Window.partitionBy("id").orderBy("score", "cand")
    first = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    best = first.groupBy("id").agg(F.min(F.struct("score", "cand", "dist")).alias("b"), F.min(F.when(F.col("dist") < reach, F.col("score"))).alias("near_score"))
    w = Window.partitionBy("id").orderBy("dist", "place")
    three = truth.withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    places = three.groupBy("id").agg(F.max(F.when(F.col("_n") == 1, F.col("place"))).alias("place"), F.collect_list("place").alias("places"))
    return nodes.select("id").join(best, "id", "left").join(places, "id", "left").select(
        "id", F.col("b.score").alias("score"), F.col("b.dist").alias("dist"), "near_score",
        F.coalesce(F.col("b.cand") == F.col("place"), F.lit(False)).alias("exact"),
        F.coalesce(F.array_contains("places", F.col("b.cand")), F.lit(False)).alias("top3"), F.col("place").isNotNull().alias("exists"),
    )


def counts(rows: DataFrame, thresholds: list[float], reach: float) -> DataFrame:
    """tp, fp, fn, tn, precision and recall by rule and threshold. A match is claimed if its score is below the threshold.

    exact_id (A28): the best candidate is the nearest truth. any_truth (A29): there is a truth at all. top3_truth (A30): the best
    candidate is one of the three nearest. top1_distance (A31): it lies within reach. top_n_distance (A32): one of the first n,
    claimed too, does. In the first three rules a wrong claim is a false positive and, if there was a truth, a false negative
    as well (Q5; for any_truth only if the claim lies beyond reach); in the last two each node counts once.
    """
    claimed = F.coalesce(F.col("score") < F.col("thr"), F.lit(False))
    within = F.coalesce(F.col("dist") < reach, F.lit(False))
    beyond = F.coalesce(F.col("dist") > reach, F.lit(False))
    deep = F.coalesce(F.col("near_score") < F.col("thr"), F.lit(False))
    rules = {
        "exact_id": (F.col("exact"), ~F.col("exact")), "any_truth": (F.col("exists"), beyond), "top3_truth": (F.col("top3"), ~F.col("top3")),
        "top1_distance": (within, F.lit(False)), "top_n_distance": (deep, F.lit(False)),
    }
    sums = [
        F.struct(
            F.lit(name).alias("rule"), F.count_if(claimed & right).alias("tp"), F.count_if(claimed & ~right).alias("fp"),
            F.count_if(F.col("exists") & (~claimed | again)).alias("fn"), F.count_if(~claimed & ~F.col("exists")).alias("tn"),
        )
        for name, (right, again) in rules.items()
    ]
    each = rows.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = each.groupBy("thr").agg(F.array(*sums).alias("r")).select("thr", F.inline("r"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
