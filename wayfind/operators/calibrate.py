"""Comparison of weights: which of several would rank judged queries best, all in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind.operators import score
from wayfind.operators.diagnostics import ranking_quality
from wayfind.operators.score import Weights

#: What is tried beside the weights in use. Fixed values.
CANDIDATES = {
    "relative 0.20": Weights(relative=0.20), "relative 0.30": Weights(relative=0.30), "mild penalties": Weights(short=0.05), "strong penalties": Weights(short=0.15, secondary=0.15, far=0.2),
    "floor 0.4": Weights(floor=0.4), "floor 0.6": Weights(floor=0.6),
}
IN_USE = "in use"


def weight_grid(parts: DataFrame, names: DataFrame, relevant: DataFrame, candidates: dict[str, Weights] | None = None) -> DataFrame:
    """(candidate, precision, reciprocal_rank, passed, chosen) for the weights in use and each of the candidates. parts: as from score.score_parts; names:
    (item_id, key, name_norm); relevant: (query_id, item_id). Hits do not depend on weights, so they are found once and each row is scored under every candidate.

    A query passes if a relevant item comes first. Chosen are the weights with the best mean reciprocal rank, then precision, among those with which at least as many
    queries pass as now; equal ones change nothing: the weights in use stay, then the first by name."""
    tried = {IN_USE: Weights(), **(CANDIDATES if candidates is None else candidates)}
    weights = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), *[F.lit(float(v)).alias(k) for k, v in vars(w).items()]) for n, w in tried.items()])).alias("w")
    rows = parts.select("*", weights)
    of = Weights(**{k: F.col(f"w.{k}") for k in vars(Weights())})
    pair = F.struct(F.col("w.candidate").alias("candidate"), F.col("query_id").alias("query")).alias("query_id")
    scored = rows.select(pair, "item_id", F.round(score.score_of(of), 9).alias("score"), "coverage", F.col("w.relative").alias("relative"))
    ranked = score.rank(scored, names, relative=F.col("relative"))
    judged = relevant.select(F.explode(F.array(*map(F.lit, tried))).alias("candidate"), F.col("query_id").alias("query"), "item_id").select(F.struct("candidate", "query").alias("query_id"), "item_id")
    found = ranking_quality(ranked, judged).groupBy("query_id.candidate").agg(
        F.round(F.avg("precision"), 9).alias("precision"), F.round(F.avg("reciprocal_rank"), 9).alias("reciprocal_rank"), F.count_if(F.col("reciprocal_rank") == 1).alias("passed")
    )
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row a candidate
    now = F.max(F.when(F.col("candidate") == IN_USE, F.col("passed"))).over(every)
    worth = F.when(F.col("passed") >= F.col("now"), F.struct(F.col("reciprocal_rank").alias("r"), F.col("precision").alias("p"), (F.col("candidate") == IN_USE).alias("u")))
    found = found.withColumn("now", now).withColumn("worth", worth).withColumn("best", F.max("worth").over(every))
    first = F.min(F.when(F.col("worth") == F.col("best"), F.col("candidate"))).over(every)
    return found.withColumn("first", first).select("candidate", "precision", "reciprocal_rank", "passed", (F.col("candidate") == F.col("first")).alias("chosen"))
