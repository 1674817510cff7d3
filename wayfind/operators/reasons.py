"""Why an item is among the results: reasons of its terms, concepts and constraints, and their lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind.operators.filters import number_text
from wayfind.operators.match import choose_text

#: Labels by kind, display of units, and the words of details. Fixed values.
LABELS = {"exact": "Exact match", "prefix": "Exact match", "fuzzy1": "Approximate match", "fuzzy2": "Approximate match", "alias": "Recognized synonym", "constraint": "Specification", "compat": "Compatibility"}
UNITS = {"kw": "kW", "l": "L", "lt": "L", "kmh": "km/h", "m3": "m³"}
CANONICAL = {"power": "kw", "volume": "l", "length": "m", "speed": "kmh", "mass": "kg"}
DISTANCE, PHRASE, CONFIDENCE, TOO_WEAK = "distância ", "frase, distância ", "confiança ", " (potência insuficiente)"
LINES = 4


def unit_label(unit: Column) -> Column:
    out = unit
    for k, v in UNITS.items():
        out = F.when(unit == k, F.lit(v)).otherwise(out)
    return out


def value_text(value: Column, quantity: Column, unit: Column, factor: Column) -> Column:
    """A value in its quantity's own unit, and in the unit that was asked for where that is another one; money has no unit."""
    own = choose_text(quantity, CANONICAL)
    other = (unit != own) & (factor > 0) & (factor != 1)
    shown = F.concat(number_text(value), F.lit(" "), unit_label(own))
    converted = F.concat(shown, F.lit(" ("), number_text(value / factor), F.lit(" "), unit_label(unit), F.lit(")"))
    return F.when((quantity == "money") | own.isNull(), number_text(value)).when(other, converted).otherwise(shown)


def range_text(value: Column, quantity: Column, unit: Column, factor: Column, low: Column, high: Column) -> Column:
    """Such as ``184 kW (250 cv) ∈ [147.1, 220.7]``; open ends are -inf and +inf."""
    end = lambda x, none: F.when(x.isNull(), F.lit(none)).otherwise(F.format_string("%.1f", F.bround(x, 1)))
    return F.concat(value_text(value, quantity, unit, factor), F.lit(" ∈ ["), end(low, "-inf"), F.lit(", "), end(high, "+inf"), F.lit("]"))


def line(kind: Column, field: Column, detail: Column) -> Column:
    """``✓ label (field): detail``; the kind stands for a label that is not known."""
    text = F.concat(F.lit("✓ "), F.coalesce(choose_text(kind, LABELS), kind), F.lit(" ("), F.coalesce(field, F.lit("?")), F.lit(")"))
    return F.when(F.coalesce(detail, F.lit("")) == "", text).otherwise(F.concat(text, F.lit(": "), detail))


def lines(reasons: Column, most: int = LINES) -> Column:
    return F.transform(F.slice(reasons, 1, most), lambda r: line(r["kind"], r["field"], r["detail"]))


def term_reasons(best: DataFrame) -> DataFrame:
    """(query_id, item_id, part, n, kind, field, detail): one for each matched term; terms in a row that one phrase covers have one."""
    order = W.partitionBy("query_id", "item_id").orderBy("pos")
    same = F.lag(F.struct("kind", "field", "token", "phrase")).over(order) == F.struct("kind", "field", "token", "phrase")
    near = F.when(F.col("phrase"), F.concat(F.lit(PHRASE), F.col("dist").cast("string"))).when(F.col("kind") == "fuzzy1", DISTANCE + "1").when(F.col("kind") == "fuzzy2", DISTANCE + "2+")
    rows = best.withColumn("again", F.col("phrase") & F.coalesce(same, F.lit(False))).where("not again")
    return rows.select("query_id", "item_id", F.lit(0).alias("part"), F.col("pos").alias("n"), "kind", "field", near.alias("detail"))


def concept_reasons(facet_items: DataFrame, concepts: DataFrame) -> DataFrame:
    shown = F.regexp_replace(F.col("confidence").cast("string"), "\\.0$", "")
    of = facet_items.join(concepts.select("query_id", "c", "kind", "confidence"), ["query_id", "c"])
    return of.select("query_id", "item_id", F.lit(1).alias("part"), F.col("c").alias("n"), F.lit("alias").alias("kind"), F.col("kind").alias("field"), F.concat(F.lit(CONFIDENCE), shown).alias("detail"))


def constraint_reasons(ranked: DataFrame, constraints: DataFrame, firsts: DataFrame) -> DataFrame:
    """For ranked items only: each constraint with the item's first spec of its quantity."""
    asked = ranked.select("query_id", "item_id").join(constraints, "query_id").join(firsts, ["item_id", "quantity"])
    text = range_text(*[F.col(c) for c in ("value", "quantity", "unit", "factor", "low", "high")])
    return asked.select("query_id", "item_id", F.lit(2).alias("part"), "n", F.lit("constraint").alias("kind"), F.concat(F.lit("spec."), "spec_id").alias("field"), text.alias("detail"))


def gathered(rows: DataFrame) -> DataFrame:
    """(query_id, item_id, reasons, lines): terms, then concepts, then constraints."""
    out = rows.groupBy("query_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "kind", "field", "detail"))).alias("all"))
    out = out.select("query_id", "item_id", F.transform("all", lambda r: F.struct(r["kind"].alias("kind"), r["field"].alias("field"), r["detail"].alias("detail"))).alias("reasons"))
    return out.withColumn("lines", lines(F.col("reasons")))
