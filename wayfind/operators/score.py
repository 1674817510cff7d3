"""Scores, coverage, penalties and ranking of what matched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
CONCEPT, FLOOR, LEAST, RELATIVE, MOST = 0.9, 0.5, 0.15, 0.25, 300
SHORT_PREFIX, FAR, SECONDARY = 0.1, 0.15, 0.1
SECONDARY_FIELDS = ("mod", "author", "dlc")


@dataclass(frozen=True)
class Weights:
    """What a score takes off and where results are cut; numbers, or columns in a comparison of several."""

    short: float | Column = SHORT_PREFIX
    far: float | Column = FAR
    secondary: float | Column = SECONDARY
    floor: float | Column = FLOOR
    relative: float | Column = RELATIVE


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def sum_in_order(value: str, *order: str | Column) -> Column:
    """The sum of a group's few numbers in a fixed order: of three or more it depends on the order in the last digit, and ranks compare all digits."""
    rows = F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_value")))
    return F.aggregate(F.array_sort(rows), F.lit(0.0), lambda s, x: s + x["_value"])


def merge_phrases(best: DataFrame, phrases: DataFrame, terms: DataFrame, fields: DataFrame, weigh) -> DataFrame:
    """best with phrase hits where they are worth more. phrases: as from phrase_hits; terms: (query_id, pos, seq)."""
    items = phrases.join(fields.select(F.col("norm").alias("matched"), "item_id", "field", "prio"), "matched")
    kind = F.when(F.col("dist") <= 1, "fuzzy1").otherwise("fuzzy2")
    items = items.withColumn("kind", kind).withColumn("value", weigh)
    one = F.min_by(F.struct("value", "field", "kind", F.col("matched").alias("token"), "sim", (F.col("dist") >= F.col("d")).alias("far"), "dist"), F.struct(-F.col("value"), "prio"))
    items = items.groupBy("query_id", "item_id", "first", "width").agg(one.alias("b"))
    covered = items.select("query_id", "item_id", F.explode(F.sequence("first", F.col("first") + F.col("width") - 1)).alias("seq"), "b.*")
    covered = covered.join(terms.select("query_id", "seq", "pos"), ["query_id", "seq"]).drop("seq")
    names = ("value", "field", "kind", "token", "sim", "far", "dist", "phrase")
    both = best.withColumns({"far": F.lit(False), "dist": F.lit(0), "phrase": F.lit(False)}).unionByName(covered.withColumn("phrase", F.lit(True)).select("query_id", "pos", "item_id", *names))
    pick = F.max_by(F.struct(*names), F.struct("value", ~F.col("far")))
    return both.groupBy("query_id", "pos", "item_id").agg(pick.alias("b")).select("query_id", "pos", "item_id", "b.*")


def score_parts(best: DataFrame, terms: DataFrame, concept_hits: DataFrame | None = None, concepts: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, raw, most, coverage, n_short, n_far, side): all that scores are made of, before weights. best: term hits with value, field,
    kind, far; terms: (query_id, pos, text, idf); concept_hits: (query_id, c, item_id, value); concepts: (query_id, c, confidence)."""
    t = terms.select("query_id", "pos", "text", "idf")
    total = t.groupBy("query_id").agg(sum_in_order("idf", "pos").alias("most"), F.count(F.lit(1)).alias("n"))
    rows = best.join(t, ["query_id", "pos"])
    short = (F.col("kind") == "prefix") & (F.length("text") <= 3)
    rows = rows.select("query_id", "item_id", F.col("pos").alias("at"), (F.col("value") * F.col("idf")).alias("raw"), F.lit(1).alias("term"), short.cast("int").alias("short"), F.col("far").cast("int").alias("away"), F.col("field").isin(*SECONDARY_FIELDS).alias("side"))
    if concepts is not None and concept_hits is not None:
        more = concept_hits.select("query_id", "item_id", F.col("c").alias("at"), F.col("value").alias("raw"), F.lit(0).alias("term"), F.lit(0).alias("short"), F.lit(0).alias("away"), F.lit(None).cast("boolean").alias("side"))
        rows = rows.unionByName(more)
        of = concepts.groupBy("query_id").agg((sum_in_order("confidence", "c") * CONCEPT).alias("most"), F.count(F.lit(1)).alias("n"))
        total = total.unionByName(of).groupBy("query_id").agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
    sums = rows.groupBy("query_id", "item_id").agg(sum_in_order("raw", -F.col("term"), "at").alias("raw"), F.count(F.lit(1)).alias("hits"), F.sum("term").alias("term_hits"), F.sum("short").alias("n_short"), F.sum("away").alias("n_far"), F.bool_and("side").alias("side"))
    out = sums.join(total, "query_id")
    return out.select("query_id", "item_id", "raw", "most", (F.col("hits") / F.col("n")).alias("coverage"), "n_short", "n_far", ((F.col("term_hits") > 0) & F.coalesce("side", F.lit(False))).alias("side"))


def score_of(w: Weights = Weights()) -> Column:
    """The score of a row of score_parts()."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    penalty = F.col("n_short") * value(w.short) + F.col("n_far") * value(w.far) + F.when(F.col("side"), value(w.secondary)).otherwise(0.0)
    score = clamp(F.col("raw") / F.col("most") * (value(w.floor) + (1 - value(w.floor)) * F.col("coverage")) - penalty)
    return F.when(F.col("most") > 0, score).otherwise(0.0)


def score_items(best: DataFrame, terms: DataFrame, concept_hits: DataFrame | None = None, concepts: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """(query_id, item_id, score, coverage, raw)."""
    return score_parts(best, terms, concept_hits, concepts).select("query_id", "item_id", score_of(weights).alias("score"), "coverage", "raw")


def rank(scored: DataFrame, items: DataFrame, most: int = MOST, relative: float | Column = RELATIVE, least: float = LEAST) -> DataFrame:
    """(query_id, rank, item_id, key, score, coverage): by score, coverage, normalised name and key; below the cut, and beyond ``most``, results go.
    items: (item_id, key, name_norm)."""
    best = F.max("score").over(W.partitionBy("query_id"))
    rows = scored.withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(least), relative * F.col("best")))
    rows = rows.join(items, "item_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("coverage"), "name_norm", "key", "item_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "item_id", "key", "score", "coverage")


#: Why no target was taken.
NOT_FOUND, AMBIGUOUS = "compatibility target not found", "ambiguous compatibility target"


def judge_targets(ranked: DataFrame, least: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(query_id, item_id, warning) of each query with a result: the first one is the target if it is good enough and clearly ahead of the second; else the warning says what it lacks."""
    second = F.lead("score").over(W.partitionBy("query_id").orderBy("rank"))
    rows = ranked.withColumn("second", second).where("rank = 1")
    return rows.select("query_id", "item_id", F.when(F.col("score") < least, NOT_FOUND).when(F.col("score") - F.col("second") < margin, AMBIGUOUS).alias("warning"))


def resolve_targets(ranked: DataFrame, least: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(query_id, item_id): the first result where it is good enough and clearly ahead of the second."""
    return judge_targets(ranked, least, margin).where("warning is null").select("query_id", "item_id")
