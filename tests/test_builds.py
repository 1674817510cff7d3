"""Builds in steps, publication by several writers, and ordered work on hot keys."""

import random
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayfind.operators import diagnostics, sequences
from wayfind.operators import index as I
from wayfind.plans.engine import Engine
from wayfind.sources import catalogs
from wayfind.sources.workspace import create_once, exists
from wayfind.streaming.sliced import SlicedBuild


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-test-")


def rows_of(index):
    return {t: sorted(map(repr, getattr(index, t).drop("batch").collect())) for t in ("items", "fields", "postings", "vocabulary", "facets", "numeric", "firsts", "meta")}


def test_build_in_steps_equals_one_in_one_go(spark, folder):
    catalog = lambda: catalogs.generated(spark, 300)
    steps, engine = 1, Engine(spark, f"{folder}/a", catalog, slice_items=100)
    while engine.step(0.0):
        assert engine.is_busy() and engine.published() is None
        engine = Engine(spark, f"{folder}/a", catalog, slice_items=100)  # another session goes on
        steps += 1
    assert steps > 1 and engine.state == "ready" and not engine.is_busy() and not exists(spark, f"{folder}/a/builds/{engine.published()['signature'].replace(':', '-')}")
    whole = Engine(spark, f"{folder}/b", catalog)
    assert rows_of(engine.index) == rows_of(whole.rebuild())
    assert not engine.step(0.0) and engine.version == 1


def test_a_changed_catalog_starts_the_build_again(spark, folder):
    n = [200]
    engine = Engine(spark, folder, lambda: catalogs.generated(spark, n[0]), slice_items=50)
    assert engine.step(0.0)
    first, n[0] = engine.building, 150
    while engine.step(None):
        pass
    assert not exists(spark, first) and engine.status()["n_items"] == 150


def test_a_slice_that_is_cut_off_runs_again(spark, folder):
    build = SlicedBuild(spark, folder, lambda: catalogs.generated(spark, 90), slice_items=30)
    assert not build.step(0.0)
    once = spark.read.parquet(f"{folder}/items").count()
    spark.read.parquet(f"{folder}/items").limit(5).drop("batch").write.parquet(f"{folder}/items/batch=2")  # left behind by a slice that did not end
    assert once < 90 and build.step() and build.step()
    assert spark.read.parquet(f"{folder}/items").count() == 90


def test_two_writers_never_publish_one_version(spark, folder):
    assert create_once(spark, folder, "v1", "a") and not create_once(spark, folder, "v1", "b")
    a, b = (Engine(spark, f"{folder}/x", lambda: catalogs.generated(spark, 20)) for _ in range(2))
    stale = b.published
    a.rebuild()
    answers = [None]  # b looked before a had published
    b.published = lambda: answers.pop() if answers else stale()
    b.rebuild()
    assert (a.version, b.version) == (1, 2) and a.published()["version"] == 2
    a.rebuild()
    kept = spark.read.json(f"{folder}/x/published").collect()
    assert sorted((r["version"], exists(spark, r["path"])) for r in kept) == [(1, False), (2, True), (3, True)]


def hot_events(n):
    """A third of all rows have one key; times repeat, and some are null."""
    rng = random.Random(4)
    return [(i, "hot" if i % 3 == 0 else None if i % 29 == 1 else f"k{rng.randrange(20)}", rng.randrange(n // 2) if i % 97 else None, rng.choice(["indexing", "ready", "degraded", "idle", None]), rng.choice([rng.random(), 0.5, -1.0])) for i in range(n)]


@pytest.fixture
def small_stretches(monkeypatch):
    monkeypatch.setattr(sequences, "CHUNK", 64)
    monkeypatch.setattr(sequences, "FAN", 4)


def test_sequences_against_folds(spark, small_stretches):
    rows = hot_events(3000)
    df = spark.createDataFrame(rows, "id long, key string, at long, to string, v double")
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        by[r[1]].append(r)
    numbers = sorted((r["pos"], r["key"], r["at"], r["id"]) for r in sequences.numbered(df, ["key", "at", "id"]).collect())
    assert [p for p, *_ in numbers] == list(range(3000)) and [(k, i) for _, k, _, i in numbers] == [(r[1], r[0]) for k in sorted(by, key=lambda k: (k is not None, k or "")) for r in by[k]]
    # states
    expected = {}
    for key, rs in by.items():
        state, taken = "uninitialized", 0
        for r in rs:
            if (state, r[3]) in diagnostics.TRANSITIONS:
                state, taken = r[3], taken + 1
        expected[key] = (state, taken)
    got = {r["key"]: (r["state"], r["taken"]) for r in diagnostics.final_states(df, "key", ["at", "id"], "to").collect()}
    assert got == expected
    # rings
    expected = {}
    for rs in by.values():
        for i, r in enumerate(rs):
            last = [x[4] for x in rs[max(0, i - 9) : i + 1]]
            expected[r[0]] = (len(last), round(sum(last) / len(last), 9), max(last))
    got = {r["id"]: (r["n_ring"], round(r["mean_ring"], 9), r["max_ring"]) for r in diagnostics.ring(df, "key", ["at", "id"], "v", 10).collect()}
    assert got == expected
    # rates
    timed = df.withColumn("ts", F.timestamp_seconds("at"))
    expected = set()
    for key, rs in by.items():
        last, held = None, 0
        for r in (r for r in rs if r[2] is not None):
            if last is None or r[2] - last >= 40:
                expected.add((key, r[0], held))
                last, held = r[2], 0
            else:
                held += 1
    got = {(r["key"], r["id"], r["suppressed"]) for r in diagnostics.rate_limited(timed, "key", "ts", "id", 40).collect()}
    assert got == expected
    # percentiles
    for p, name in ((0.5, "p50"), (0.95, "p95"), (0.0, "p0"), (1.0, "p100")):
        expected = {k: sorted(x[4] for x in rs)[max(1, min(len(rs), -int(-p * len(rs) // 1))) - 1] for k, rs in by.items()}
        assert {r["key"]: r[name] for r in diagnostics.percentiles(df, "key", "v", (p,)).collect()} == expected
    empty = df.where("false")
    assert not any(x.count() for x in (diagnostics.final_states(empty, "key", ["at", "id"], "to"), diagnostics.ring(empty, "key", ["at", "id"], "v"), diagnostics.percentiles(empty, "key", "v"), diagnostics.rate_limited(timed.where("false"), "key", "ts", "id", 40)))


def test_rolling_signature_against_a_loop(spark, small_stretches):
    keys = [f"data/é{i}.xml" if i % 50 else None for i in range(1, 900)]
    h = 5381
    for k in keys:
        for b in (k or "").encode():
            h = (h * 33 + b) % (2**31 - 1)
    df = spark.createDataFrame(list(enumerate(keys)), "item_id long, key string").repartition(5)
    assert I.rolling_signature(df).first()["signature"] == f"899:{h}"
    assert I.rolling_signature(df.where("false")).first()["signature"] == "0:5381"
