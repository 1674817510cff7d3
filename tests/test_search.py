import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.operators import compat, filters
from wayfind.operators.index import build_index
from wayfind.plans.query_parser import osa_distance
from wayfind.plans.search import parse_queries, search_many
from wayfind.sources import catalogs

ITEMS = "item_id long, key string, name string, brand string, category string, mod string, author string, dlc string, species string, origin string, price double, specs map<string,double>"


def catalog(spark, rows):
    base = dict.fromkeys(x.split()[0] for x in ITEMS.split(", ", 11))
    names = ["item_id", "key", "name", "brand", "category", "mod", "author", "dlc", "species", "origin", "price", "specs"]
    return spark.createDataFrame([tuple({**base, "item_id": i, "key": f"k{i}", "specs": {}, **r}.get(n) for n in names) for i, r in enumerate(rows)], ITEMS)


def test_normalize(spark):
    cases = {"a\tb": "ab", "Väderstad 12m3/s": "vaderstad 12m3 s", "R$150,50": "r$ 150,50", "6m355": "6m355", "km/h 1.5.2, x": "kmh 1.5.2 x", "$150000": "", "Straße": "strasse", "3€": "3 €", "x100": "x 100", None: "", " A - b ": "a b"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string").select("raw", "want", T.normalize(F.col("raw")).alias("got")).collect()
    assert {r["raw"]: r["got"] for r in rows} == cases
    again = spark.createDataFrame([(v,) for v in cases.values()], "x string").select((T.normalize(F.col("x")) == F.col("x")).alias("same"))
    assert all(r["same"] for r in again.collect())


def test_osa_expression(spark):
    pairs = [("tratro", "trator"), ("ca", "abc"), ("jhon", "john"), ("abc", "xyz"), ("jon dere", "john deere"), ("", "ab"), ("ab", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.osa("a", "b").alias("d")).collect()
    assert [r["d"] for r in got] == [osa_distance(a.encode(), b.encode()) for a, b in pairs]


def test_worked_example(spark, tmp_path):
    """Terms that are misspelled together match as a phrase; values computed by hand."""
    c = catalog(spark, [{"name": "6215 TTV", "brand": "Deutz-Fahr"}, {"name": "Carreta", "brand": "Recker", "author": "farmerbr"}, {"name": "Deutz Classic", "brand": "Outra"}])
    q = spark.createDataFrame([(1, "deuts far")], "query_id long, text string")
    got = {r["key"]: round(r["score"], 3) for r in search_many(build_index(c).write(str(tmp_path)), q, locales=()).collect()}
    assert got == {"k0": 0.264, "k2": 0.21}


def test_concepts_constraints_and_nothing(spark, tmp_path):
    c = catalog(spark, [
        {"name": "Alpha", "brand": "FENDT", "category": "TRACTORS MEDIUM", "specs": {"power": 100.0}},
        {"name": "Beta", "brand": "CLAAS", "category": "TRACTORS LARGE", "specs": {"neededPower": 150.0}},
        {"name": "Gamma", "brand": "Fent", "category": "TRAILERS", "specs": {"power": 200.0, "neededPower": 100.0}},
        {"name": "No key", "key": "", "brand": "FENDT"}, {"name": None, "price": float("nan")},
    ])
    index = build_index(c).write(str(tmp_path))
    assert {r["reason"]: r["n"] for r in index.skipped.collect()} == {"no-id": 1}
    queries = spark.createDataFrame([(1, "fendt"), (2, "over 120 kw"), (3, ""), (4, None), (5, "tractor"), (6, "zzzz")], "query_id long, text string")
    got = {}
    for r in search_many(index, queries).collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    assert got[1][0] == "k0" and "k2" in got[1] and set(got[2]) == {"k1", "k2"} and set(got[5]) == {"k0", "k1"} and set(got) == {1, 2, 5}


def test_empty_catalog_and_queries(spark):
    index = build_index(catalog(spark, [{"name": "A"}]).where("false"))
    assert search_many(index, spark.createDataFrame([(1, "blue over 3 kw")], "query_id long, text string")).count() == 0
    assert parse_queries(spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_xml_round_trip(spark, tmp_path):
    c = catalog(spark, [{"name": "Édition (100%)", "brand": "X", "category": "Y", "species": "vehicle", "origin": "mod", "mod": "M", "price": 5.0, "specs": {"power": 3.0}}])
    c = c.withColumns({"brand_id": F.col("brand"), "category_id": F.col("category")})
    catalogs.write_xml(c, f"{tmp_path}/x")
    got = catalogs.read_xml(spark, f"{tmp_path}/x").first()
    assert (got["name"], got["key"], got["origin"], got["price"], got["specs"]) == ("Édition (100%)", "k0", "mod", 5.0, {"power": 3.0})


def test_compatibility(spark):
    schema = "key string, {} double, joints array<string>, combinations array<string>"
    v = spark.createDataFrame([("v1", 100.0, ["a"], ["i2"]), ("v2", None, ["b"], [])], schema.format("power"))
    i = spark.createDataFrame([("i1", 120.0, ["a", "b"], []), ("i2", 50.0, ["c"], []), ("i3", 1.0, [], [])], schema.format("needed"))
    got = {(r["vehicle"], r["implement"]): (r["level"], r["power_ok"], round(r["score"], 2)) for r in compat.compatible(v, i).collect()}
    assert got == {("v1", "i1"): ("joint", False, 0.4), ("v1", "i2"): ("declared", True, 1.0), ("v2", "i1"): ("joint", None, 0.7)}


@pytest.mark.parametrize("value, shown", [(2.25, "2.2"), (250.0, "250"), (147.1, "147"), (3.0, "3"), (0.15, "0.2")])
def test_number_text(spark, value, shown):
    assert spark.createDataFrame([(value,)], "x double").select(filters.number_text(F.col("x")).alias("s")).first() == Row(s=shown)
