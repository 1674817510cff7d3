"""Filters that take items out: numeric ranges, the first spec an item has, facets, and their intersection.

Ranges include both ends. Without any filter a query is unrestricted, which is not the same as a filter that nothing passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import text as T

#: Which specs a quantity may mean, in order. Fixed values.
QUANTITY_SPECS = {"power": ("power", "neededPower"), "volume": ("capacity",), "length": ("workingWidth",), "speed": ("maxSpeed",), "mass": ("weight",), "money": ("price",)}


def within(value: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


def in_range(numeric: DataFrame, spec: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """item ids with the spec in the range; comparisons with constants, which reach the scan."""
    out = numeric.where(F.col("spec_id") == spec)
    out = out if low is None else out.where(F.col("value") >= low)
    out = out if high is None else out.where(F.col("value") <= high)
    return out.select("item_id").distinct()


def spanned(numeric: DataFrame, ranges: DataFrame) -> DataFrame:
    """numeric within the least stretch of specs and of values that holds all of ranges (spec_id, low, high): comparisons with constants, which reach the scan and pass over
    files and row groups. ranges is read once for it."""
    low, high = F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))), F.coalesce(F.col("high").cast("double"), F.lit(float("inf")))
    of = ranges.agg(F.min("spec_id").alias("first"), F.max("spec_id").alias("last"), F.min(low).alias("low"), F.max(high).alias("high")).first()
    if of["first"] is None:
        return numeric.where("false")
    out = numeric.where(F.col("spec_id").between(of["first"], of["last"]))
    out = out if of["low"] == float("-inf") else out.where(F.col("value") >= of["low"])
    return out if of["high"] == float("inf") else out.where(F.col("value") <= of["high"])


def first_specs(numeric: DataFrame, quantities: dict[str, tuple[str, ...]] = QUANTITY_SPECS) -> DataFrame:
    """(item_id, quantity, spec_id, value): for each quantity, the first of its specs that the item has."""
    rank = numeric.sparkSession.createDataFrame([(q, s, i) for q, specs in quantities.items() for i, s in enumerate(specs)], "quantity string, spec_id string, n int")
    rows = numeric.join(F.broadcast(rank), "spec_id")  # a constant table
    return rows.groupBy("item_id", "quantity").agg(F.min_by(F.struct("spec_id", "value"), "n").alias("s")).select("item_id", "quantity", "s.*")


#: Bins of a quantity, each with about as many items.
BINS = 256


def value_cuts(firsts: DataFrame) -> DataFrame:
    """(quantity, cuts): values that part a quantity's items into bins of about one size; a row for each quantity."""
    return firsts.groupBy("quantity").agg(F.array_distinct(F.percentile_approx("value", [i / BINS for i in range(1, BINS)], 16 * BINS)).alias("cuts"))


def bin_of(cuts: Column, value: Column) -> Column:
    """How many cuts lie below the value; it never falls as the value rises."""
    return F.size(F.filter(cuts, lambda c: c < value))


def with_bins(firsts: DataFrame, cuts: DataFrame) -> DataFrame:
    """firsts with ``bin``."""
    return firsts.join(F.broadcast(cuts), "quantity").withColumn("bin", bin_of(F.col("cuts"), F.col("value"))).drop("cuts")  # a row for each of few quantities


def constraint_hits(constraints: DataFrame, firsts: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(query_id, n, item_id, spec_id, value): constraints (query_id, n, quantity, low, high) with the items that pass. A constraint meets only the bins that its range touches, so the join is
    by (quantity, bin), and a quantity that most items have is dealt over its bins; values in the bins at the borders are compared. firsts and cuts: with bins, as an index has them."""
    if cuts is None:
        cuts = value_cuts(firsts)
        firsts = with_bins(firsts, cuts)
    place = lambda c, open_: F.when(F.col(c).isNull(), open_).otherwise(bin_of(F.col("cuts"), F.col(c)))
    wanted = constraints.join(F.broadcast(cuts), "quantity").withColumns({"_from": place("low", F.lit(0)), "_to": place("high", F.size("cuts"))}).where("_from <= _to")  # a row for each of few quantities
    wanted = wanted.select("query_id", "n", "quantity", "low", "high", F.explode(F.sequence("_from", "_to")).alias("bin"))
    return wanted.join(firsts, ["quantity", "bin"]).where(within(F.col("value"), F.col("low"), F.col("high"))).select("query_id", "n", "item_id", "spec_id", "value")


def facet_hits(chosen: DataFrame, facets: DataFrame) -> DataFrame:
    """(query_id, n, item_id) for chosen (query_id, facet, id): any id of a facet; each facet is a set of its own."""
    out = chosen.join(facets, ["facet", "id"]).select("query_id", F.concat(F.lit("facet:"), "facet").alias("n"), "item_id")
    return out.distinct()


def intersect(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, item_id) in all of a query's sets. sets: (query_id, n, item_id); asked: (query_id, n_sets)."""
    held = sets.select("query_id", "n", "item_id").distinct().groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("held"))
    return held.join(asked, "query_id").where("held = n_sets").select("query_id", "item_id")


def matching_facets(concepts: DataFrame, facets: DataFrame) -> DataFrame:
    """(query_id, c, item_id): concepts (query_id, c, kind, value) joined with the facet ids, few, that their pattern fits; then with items."""
    ids = facets.select(F.col("facet").alias("kind"), "id").distinct()
    fits = concepts.join(ids, "kind").where(T.wildcard_matches(F.col("value"), F.col("id")))
    return fits.select("query_id", "c", F.col("kind").alias("facet"), "id").join(facets, ["facet", "id"]).select("query_id", "c", "item_id").distinct()


#: Steps that a user can choose from: price, power in cv and capacity in litres. Fixed values.
PRESETS = {"price": (0, 50_000, 150_000, 300_000), "power": (0, 100, 200, 300, 400), "capacity": (0, 2_000, 5_000, 10_000)}
PRESET_FACTOR = {"price": 1.0, "power": 0.7355, "capacity": 1.0}


def preset_ranges(spec: str) -> list[tuple[int, float, float | None]]:
    """(number, low, high) in the spec's own unit; a value at a border is in both steps, the last has no upper end."""
    steps, f = PRESETS[spec], PRESET_FACTOR[spec]
    return [(i, low * f, steps[i + 1] * f if i + 1 < len(steps) else None) for i, low in enumerate(steps)]


def number_text(value: Column) -> Column:
    """Whole from 100 on or where nothing is left over; else one digit, halves to even."""
    whole = (F.abs(value) >= 100) | (value == F.floor(value))
    return F.when(whole, F.format_string("%.0f", F.bround(value, 0))).otherwise(F.format_string("%.1f", F.bround(value, 1)))
