"""Latency, failures, states and ranking quality, as batch operators over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind.operators import sequences
from wayfind.sources.workspace import kept

#: Allowed transitions of the engine's states.
TRANSITIONS = {("uninitialized", "indexing"), ("indexing", "ready"), ("ready", "indexing"), ("uninitialized", "degraded"), ("indexing", "degraded"), ("ready", "degraded")}


def percentiles(values: DataFrame, by: str, value: str, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles: an observed value, at ceil(p n)."""
    found = sequences.selected(values, by, value, ps)
    return found.groupBy(by).agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"p{round(p * 100)}") for p in ps])


def ring(values: DataFrame, by: str, order: list[str], value: str, size: int = 100) -> DataFrame:
    """For each row, count, mean and maximum of the last ``size`` values of its key."""
    return sequences.rolling(values, by, order, value, size, {"n_ring": F.count, "mean_ring": F.avg, "max_ring": F.max})


def degraded(events: DataFrame, context: str, order: list[str], failed, limit: int = 3) -> DataFrame:
    """The failure at which each context is given up: its ``limit``-th."""
    n = F.row_number().over(W.partitionBy(context).orderBy(*order))
    return events.where(failed).withColumn("n", n).where(F.col("n") == limit).drop("n")


def rate_limited(events: DataFrame, key: str, at: str, order: str, seconds: float) -> DataFrame:
    """(key, order, at, suppressed): rows that are let through, once in ``seconds`` since the last one let through, with the number held back before. Rows without a time are no lines.

    Each row has a successor, the row that is let through next if it is: the first one ``seconds`` later or more. It stands in the time bucket after its own, or is the first of a later
    one, so rows meet by (key, bucket). From the first row of each key, all rows let through are reached by doubling: the rows 2^j steps on, from the longest jump to the shortest."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ltz"))
    wait = round(seconds * 1_000_000)
    rows = sequences.numbered(events.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("at"), F.col(order).alias("o"), micros(at).alias("t")), ["k", "t", "o"])
    rows = kept(rows, "lines")
    bucket = F.floor(F.col("t") / wait)
    heads = rows.groupBy("k", bucket.alias("b")).agg(F.min("pos").alias("head"))  # a row for each bucket of time
    there = rows.select("k", bucket.alias("b"), "t", F.col("pos").alias("to"), F.lit(None).cast("long").alias("pos"))
    asking = rows.select("k", (bucket + 1).alias("b"), (F.col("t") + wait).alias("t"), F.lit(None).cast("long").alias("to"), "pos")
    # Latest first: the last row passed is the first that is late enough.
    back = W.partitionBy("k", "b").orderBy(F.desc("t"), F.desc_nulls_last("to")).rowsBetween(W.unboundedPreceding, 0)
    met = there.unionByName(asking).withColumn("to", F.last("to", ignorenulls=True).over(back)).where("pos is not null")
    # Where the bucket has none late enough: the first row of the next bucket that has any. The asked bucket itself may be missing.
    order_of = W.partitionBy("k").orderBy("b")
    every = heads.select("k", "b", "head").unionByName(asking.select("k", "b", F.lit(None).cast("long").alias("head"))).groupBy("k", "b").agg(F.min("head").alias("head"))
    later = every.select("k", "b", F.first("head", ignorenulls=True).over(order_of.rowsBetween(1, W.unboundedFollowing)).alias("later"))
    met = met.join(later.withColumnsRenamed({"k": "_k", "b": "_b"}), F.col("k").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b")), "left")
    jump = kept(met.select("pos", F.coalesce("to", "later").alias("to")).where("to is not null"), "successors")
    through = kept(rows.groupBy("k").agg(F.min("pos").alias("pos")), "firsts")
    jumps = [jump]
    while True:
        on = jumps[-1].select(F.col("pos").alias("to"), F.col("to").alias("then"))
        longer = kept(jumps[-1].join(on, "to").select("pos", F.col("then").alias("to")), "jumps")
        if longer.isEmpty():
            break
        jumps.append(longer)
    for jump in reversed(jumps):
        through = kept(through.unionByName(through.join(jump, "pos").select("k", F.col("to").alias("pos"))), "through")
    before = F.lag("pos").over(W.partitionBy("k").orderBy("pos"))  # only the rows let through
    held = through.select("pos", F.coalesce(F.col("pos") - before - 1, F.lit(0)).alias("suppressed"))
    return rows.join(held, "pos").select(F.col("k").alias(key), F.col("o").alias(order), F.col("at").alias(at), "suppressed")


def final_states(events: DataFrame, machine: str, order: list[str], to: str, start: str = "uninitialized", transitions: set[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """(machine, state, taken): each machine's state after its events; transitions that are not allowed are passed over.

    An event is a function of the state before it: (state after, transitions taken) for each state. Functions of consecutive events are composed."""
    states = sorted({s for pair in transitions for s in pair} | {start})
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(transitions)])
    at = {s: i + 1 for i, s in enumerate(states)}
    place = F.create_map(*[x for s, i in at.items() for x in (F.lit(s), F.lit(i))])

    def unit(x):
        ok = lambda s: F.array_contains(allowed, F.concat(F.lit(f"{s}>"), F.coalesce(x, F.lit(""))))
        return F.array(*[F.struct(F.when(ok(s), F.element_at(place, x)).otherwise(F.lit(i)).alias("to"), ok(s).cast("long").alias("taken")) for s, i in at.items()])

    def joined(f, g):
        return F.transform(f, lambda a: F.struct(F.element_at(g, a["to"])["to"].alias("to"), (a["taken"] + F.element_at(g, a["to"])["taken"]).alias("taken")))

    rows = sequences.numbered(events.select(machine, *order, F.col(to).alias("x")), [machine, *order])
    out = sequences.composed(rows, machine, unit, joined).select(machine, F.element_at("f", at[start]).alias("s"))
    return out.select(machine, F.element_at(F.array(*map(F.lit, states)), F.col("s.to")).alias("state"), F.col("s.taken").cast("int").alias("taken"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, reciprocal_rank, empty) for each query of ``relevant`` (query_id, item_id). Precision is at the lesser of k and the number
    of relevant items."""
    n = relevant.groupBy("query_id").agg(F.least(F.lit(k), F.count(F.lit(1))).alias("k"))
    hits = ranked.join(relevant.withColumn("good", F.lit(True)), ["query_id", "item_id"], "left")
    of = hits.join(n, "query_id").groupBy("query_id").agg(
        F.sum(F.when(F.col("good") & (F.col("rank") <= F.col("k")), 1).otherwise(0)).alias("found"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first")
    )
    out = n.join(of, "query_id", "left")
    return out.select("query_id", (F.coalesce("found", F.lit(0)) / F.col("k")).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.col("found").isNull().alias("empty"))
