"""Ranges met by value bins, and rings of latencies over several micro-batches."""

import random
import tempfile
from datetime import datetime, timedelta

from wayfind.operators import filters
from wayfind.streaming.incremental import latency_rings, newest


def test_constraints_by_bins_equal_comparing_all(spark):
    """Many equal values, ends that are values and cuts, open ends, and ranges that hold nothing."""
    rng = random.Random(6)
    values = [(i, q, "s", rng.choice([100.0, rng.random() * 1000, float(rng.randrange(20)), 0.0, 1e300])) for i in range(4000) for q in ("money",) + ("power",) * (i % 50 == 0)]
    ends = [None, 0.0, 100.0, 5.0, 19.0, 1e300, 250.5, -3.0]
    asked = [(q, n, quantity, a, b) for q, quantity in ((1, "money"), (2, "power"), (3, "speed")) for n, (a, b) in enumerate((a, b) for a in ends for b in ends)]
    firsts = spark.createDataFrame(values, "item_id long, quantity string, spec_id string, value double")
    constraints = spark.createDataFrame(asked, "query_id long, n int, quantity string, low double, high double")
    expected = {(q, n, i) for q, n, quantity, a, b in asked for i, of, _, v in values if of == quantity and (a is None or v >= a) and (b is None or v <= b)}
    cuts = filters.value_cuts(firsts)
    rows = filters.constraint_hits(constraints, filters.with_bins(firsts, cuts), cuts).select("query_id", "n", "item_id").collect()
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected
    assert filters.constraint_hits(constraints, firsts.where("false")).count() == 0


def test_rings_over_batches(spark):
    rng = random.Random(9)
    folder = tempfile.mkdtemp(prefix="spark-test-")
    rows = [(rng.choice(["a", "a", "b", None]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(300)), i, rng.choice([rng.random(), None]) if i % 9 == 0 else rng.random()) for i in range(600)]
    kind = "key string, at timestamp, seq long, value double"
    for n in range(3):
        spark.createDataFrame(rows[n::3], kind).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    latency_rings(source, f"file://{folder}/out", f"file://{folder}/checkpoint", size=20).trigger(availableNow=True).start().awaitTermination()
    got = {r["key"]: (r["n"], r["p50"], r["p95"]) for r in newest(spark, f"file://{folder}/out").collect() if r["key"]}
    for key in ("a", "b"):
        last = sorted((at, seq, v) for k, at, seq, v in rows if k == key and v is not None)[-20:]
        values = sorted(v for *_, v in last)
        assert got[key] == (20, values[9], values[18])
