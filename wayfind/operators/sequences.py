"""Ordered work on keys of any size: no key, however many rows it has, is sorted, folded or ranked by one task.

Rows are put in order once, by ranges of (key, order), and numbered in it without gaps. Stretches of consecutive numbers, ``CHUNK`` rows at most, then stand for what a window over
a whole key would do: a fold becomes one function for each stretch, and the functions are composed; a sliding frame gets the rows before its stretch as a halo.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind.sources.workspace import kept

#: Rows of a stretch, and stretches that are composed at once.
CHUNK, FAN = 4096, 1024


def numbered(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """rows, written in the order of ``by`` (nulls first), with ``pos``: 0, 1, 2, ... over all rows. The first two columns deal the ranges; rows that are equal in these stay together."""
    order = [F.col(c).asc_nulls_first() for c in by]
    local = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn(pos, F.monotonically_increasing_id())
    local = kept(local, "numbered")
    part, place = F.shiftright(pos, 33), F.col(pos).bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part")
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a task of the sort
    return local.withColumn("part", part).join(F.broadcast(before), "part").withColumn(pos, F.col("before") + place).select(*rows.columns, pos)


def composed(rows: DataFrame, key: str, unit: Callable[[Column], Column], joined: Callable[[Column, Column], Column], x: str = "x", pos: str = "pos") -> DataFrame:
    """(key, f): the functions of a key's rows, composed in their order. unit(x): the function of one row; joined(f, g): first f, then g."""
    fold = lambda of, make: F.aggregate(F.slice(of, 2, F.greatest(F.size(of) - 1, F.lit(0))), make(F.element_at(of, 1)), lambda f, y: joined(f, make(y)))
    listed = lambda df, size, c: df.groupBy(key, F.floor(F.col(pos) / size).alias(pos)).agg(F.array_sort(F.collect_list(F.struct(F.col(f"{pos}").alias("at"), F.col(c).alias("v")))).alias("vs"))
    values = F.transform("vs", lambda s: s.v)
    first = listed(rows.select(key, pos, x), CHUNK, x).select(key, pos, fold(values, unit).alias("f"))
    second = listed(first, FAN, "f").select(key, pos, fold(values, lambda f: f).alias("f"))
    last = second.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("at"), F.col("f").alias("v")))).alias("vs"))  # a row for CHUNK * FAN rows
    return last.select(key, fold(values, lambda f: f).alias("f"))


def with_halo(rows: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """rows with ``chunk``, and copies (halo) of the last ``size`` rows before each stretch, for frames that reach back."""
    step = max(CHUNK, 4 * size)
    chunk = F.floor(F.col(pos) / step)
    near = F.col(pos) % step >= step - size
    both = F.when(near, F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("halo")), F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))))
    return rows.select(*rows.columns, F.explode(both).alias("c")).select(*rows.columns, "c.chunk", "c.halo")


def rolling(rows: DataFrame, key: str, order: list[str], value: str, size: int, made: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """rows with aggregates over each row and the size - 1 rows before it of the same key."""
    ready = with_halo(numbered(rows, [key, *order]), size - 1)
    w = W.partitionBy(key, "chunk").orderBy("pos").rowsBetween(-(size - 1), 0)
    out = ready.withColumns({name: f(F.col(value)).over(w) for name, f in made.items()})
    return out.where(~F.col("halo")).select(*rows.columns, *made)


def selected(values: DataFrame, by: str, value: str, ps: tuple[float, ...], cuts: int = 64) -> DataFrame:
    """(by, p, value): the value at rank ceil(p n) of each key's non-null values, by narrowing brackets: each round counts the values between approximate quantiles of what is left
    and goes on in the part that holds the rank. Only counts are shuffled; no task holds a key's values."""
    rows = values.where(F.col(value).isNotNull()).select(F.col(by).alias("k"), F.col(value).alias("v"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rank = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.lit(p) * F.col("n"))))
    asked = sizes.select("k", "low", "high", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), rank(p).alias("r")) for i, p in enumerate(ps)])).alias("a")).select("k", "low", "high", "a.i", "a.r")
    asked, found = kept(asked, "brackets"), None
    of = {c: f"_{c}" for c in ("k", "low", "high", "r")}
    while True:
        done = asked.where("low = high").select("k", "i", F.col("low").alias("v"))
        found = done if found is None else found.unionByName(done)
        open_ = asked.where("low <> high")
        if open_.isEmpty():
            break
        left = rows.join(open_.withColumnsRenamed(of), F.col("k").eqNullSafe(F.col("_k")) & F.col("v").between(F.col("_low"), F.col("_high"))).select("k", "i", F.col("_r").alias("r"), "v")
        marks = left.groupBy("k", "i").agg(F.array_distinct(F.percentile_approx("v", [j / cuts for j in range(1, cuts)], 64 * cuts)).alias("cuts"))
        marks = kept(marks, "cuts").withColumnsRenamed({"k": "_k", "i": "_i"})
        # Values between two cuts, and those at a cut, which are all equal: so each round leaves out some, however often one value occurs.
        at = (2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")).alias("at")
        parts = left.join(marks, F.col("k").eqNullSafe(F.col("_k")) & (F.col("i") == F.col("_i"))).groupBy("k", "i", "r", at).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = W.partitionBy("k", "i").orderBy("at")  # at most 2 ``cuts`` rows
        parts = parts.withColumn("before", F.sum("n").over(w) - F.col("n")).where("before < r and r <= before + n")
        asked = kept(parts.select("k", "low", "high", "i", (F.col("r") - F.col("before")).alias("r")), "brackets")
    names = F.array(*[F.lit(float(p)) for p in ps])
    return found.select(F.col("k").alias(by), F.element_at(names, F.col("i") + 1).alias("p"), F.col("v").alias("value"))
