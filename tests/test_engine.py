import pytest
from pyspark.sql import functions as F

from tests.test_search import catalog
from wayfind.operators import index as I  # noqa: E741
from wayfind.operators import reasons
from wayfind.plans.engine import Engine, SearchState
from wayfind.sources import catalogs


def test_raw_catalog_keeps_what_numbers_lose(spark):
    raw = "_xmlFilename string, _name string, _brand string, _brandTitle string, _categoryId string, _categoryTitle string, _species string, _price string, _origin string, _modName string, _modTitle string, _author string, _dlcTitle string, spec array<struct<_id string, _value string, _unit string>>"
    row = lambda key, price, specs: (key, "n", *[None] * 5, price, *[None] * 5, specs)
    rows = [
        row("a", "abc", [("power", "1", "kw"), ("power", "2", "kw"), (None, "3", None), ("price", "7", None)]),
        row("b", "-1", [("power", "nan", "kw"), ("weight", "x", "kg")]), row("c", "", None), row("d", None, []), row("e", "10", [("power", "x", None), ("power", "5", None)]),
    ]
    c = catalogs.from_raw(spark.createDataFrame(rows, raw))
    specs = {r["key"]: r["specs"] for r in c.collect()}
    assert specs["a"] == {"power": 2.0, "price": 7.0} and specs["e"] == {"power": 5.0} and specs["c"] == specs["d"] == {}
    assert {r["reason"]: r["n"] for r in I.skipped_of(c).collect()} == {"invalid-spec:price": 2, "invalid-spec:power": 1, "invalid-spec:weight": 1}
    assert sorted((r["spec_id"], r["value"]) for r in I.numeric_of(c).collect()) == [("power", 2.0), ("power", 5.0), ("price", 10.0)]


def test_constraint_texts(spark):
    cases = [(184.0, "power", "cv", 0.7355, 147.1, 220.65, "184 kW (250 cv) ∈ [147.1, 220.6]"), (184.0, "power", "kw", 1.0, 150.0, None, "184 kW ∈ [150.0, +inf]"), (24000.0, "mass", "t", 1000.0, 20000.0, None, "24000 kg (24 t) ∈ [20000.0, +inf]"), (90000.0, "money", None, None, None, 100000.0, "90000 ∈ [-inf, 100000.0]")]
    rows = spark.createDataFrame(cases, "value double, quantity string, unit string, factor double, low double, high double, want string")
    got = rows.select("want", reasons.range_text(*[F.col(c) for c in ("value", "quantity", "unit", "factor", "low", "high")]).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_engine(spark, tmp_path):
    rows = [{"name": "Alpha 700", "brand": "FENDT", "category": "TRACTORS", "specs": {"power": 184.0}}, {"name": "Beta", "brand": "CLAAS", "specs": {}}, {"name": "Gamma", "brand": "Kuhn"}]
    now = {"rows": rows[:2]}
    more = spark.createDataFrame([(1, "power", 90.0), (0, "power", 5.0), (1, "power", -3.0)], "item_id long, spec_id string, value double")
    e = Engine(spark, f"file://{tmp_path}", lambda: catalog(spark, now["rows"]), spec_ids=("power", "price"), second=lambda low: more.where(F.col("spec_id").isin(low)))
    assert e.status()["state"] == "uninitialized" and not e.is_busy()
    first = e.ensure()
    assert e.status() == {"state": "ready", "version": 1, "n_items": 2, "failures": 0, "low_specs": ["power", "price"]}
    assert {(r["item_id"], r["value"], r["source"]) for r in first.numeric.collect()} == {(0, 184.0, None), (1, 90.0, "secondary")}
    assert e.ensure() is first
    other = Engine(spark, f"file://{tmp_path}", e.catalog)
    assert other.ensure() is not None and other.version == 1
    now["rows"] = rows
    assert e.ensure() is not first and e.version == 2
    parsed, top = e.explain_query("alphs over 150 kw")
    got = top.collect()
    assert parsed.count() == 1 and [r["key"] for r in got] == ["k0"] and got[0]["lines"][-1] == "✓ Specification (spec.power): 184 kW ∈ [150.0, +inf]"
    assert e.explain_item("k0", "fendt").collect()[0]["lines"] == ["✓ Recognized synonym (brand): confiança 1"] and e.explain_item("k2", "fendt").count() == 0
    vehicles = spark.createDataFrame([("k0", 184.0, ["3pt"], [])], "key string, power double, joints array<string>, combinations array<string>")
    tools = spark.createDataFrame([("k1", 200.0, ["3pt"], []), ("k2", 100.0, [], ["k0"])], "key string, needed double, joints array<string>, combinations array<string>")
    for asked, key in (("compatible with alpha", None), ("compatible with this", "k0")):
        assert [(r["key"], round(r["score"], 3), r["detail"]) for r in e.compatible(asked, vehicles, tools, key).orderBy("rank").collect()] == [("k2", 1.0, "combination"), ("k1", 0.4, "3pt (potência insuficiente)")]
    assert e.compatible("compatible with alpah", vehicles, tools).count() == 0
    assert e.set_option("showReasons", "nao") is False
    with pytest.raises(KeyError):
        e.set_option("other", "1")
    e.dump(f"{tmp_path}/dump")
    assert catalogs.read_xml(spark, f"{tmp_path}/dump").count() == 3
    e.release()
    broken = Engine(spark, f"file://{tmp_path}/none", lambda: 1 / 0)
    for _ in range(3):
        with pytest.raises(ZeroDivisionError):
            broken.rebuild()
    assert broken.state == "degraded" and broken.ensure() is None
    s = SearchState("x", previous_category="c")
    s.clear()
    assert not s.is_active() and s.previous_category == "c"


def test_ranges_of_a_form(spark, tmp_path):
    from wayfind.plans.search import search_many

    index = I.build_index(catalog(spark, [{"name": f"Plow {i}", "price": 100.0 * i, "specs": {"power": float(i)}} for i in range(6)])).write(f"file://{tmp_path}/i")
    ranges = spark.createDataFrame([(1, "price", 100.0, None), (1, "power", None, 3.0)], "query_id long, spec_id string, low double, high double")
    got = search_many(index, spark.createDataFrame([(1, "plow"), (2, "plow 5")], "query_id long, text string"), ranges=ranges).collect()
    assert {r["key"] for r in got if r["query_id"] == 1} == {"k1", "k2", "k3"} and any(r["key"] == "k5" for r in got if r["query_id"] == 2)


def test_settings(spark, tmp_path):
    from wayfind.sources.settings import Settings

    s = Settings(spark, f"file://{tmp_path}")
    assert (s.get("search#maxResults"), s.get("ui#showReasons"), s.get("debug#logLevel", "warn"), s.get("other"), s.get("other", "x")) == (300.0, False, "warn", None, "x")
    s.set("ui#showReasons", True)
    s.set("search#maxResults", 50)
    s.set("search#maxResults", 40)
    with pytest.raises(ValueError):
        s.set("ui#incremental", "yes")
    for of in (s, Settings(spark, f"file://{tmp_path}")):
        assert (of.get("search#maxResults", 7.0), of.get("ui#showReasons"), of.get("ui#incremental")) == (40.0, True, True)


def test_weight_grid(spark):
    """Query 1: item 1 is right, and the short word's penalty puts it second; without it, it is first. Query 2 is right under all weights."""
    from wayfind.operators.calibrate import IN_USE, weight_grid
    from wayfind.operators.score import Weights

    parts = spark.createDataFrame(
        [(1, 1, 0.9, 1.0, 1.0, 1, 0, False), (1, 2, 0.85, 1.0, 1.0, 0, 0, False), (2, 3, 0.9, 1.0, 1.0, 0, 1, True), (2, 4, 0.1, 1.0, 1.0, 0, 0, False)],
        "query_id long, item_id long, raw double, most double, coverage double, n_short int, n_far int, side boolean",
    )
    names = spark.createDataFrame([(i, f"k{i}", f"n{i}") for i in range(1, 5)], "item_id long, key string, name_norm string")
    relevant = spark.createDataFrame([(1, 1), (2, 3), (3, 1)], "query_id long, item_id long")
    got = {r["candidate"]: r for r in weight_grid(parts, names, relevant, {"none": Weights(short=0.0), "zero": Weights(short=0.0), "far": Weights(short=0.0, far=5.0)}).collect()}
    assert [(round(got[c]["reciprocal_rank"], 4), got[c]["passed"]) for c in (IN_USE, "none", "far")] == [(0.5, 1), (0.6667, 2), (0.3333, 1)]
    assert [c for c in got if got[c]["chosen"]] == ["none"]
    same = weight_grid(parts, names, relevant, {"a": Weights()}).collect()
    assert [r["candidate"] for r in same if r["chosen"]] == [IN_USE]
    assert weight_grid(parts.where("false"), names, relevant.where("false"), {}).count() == 0
