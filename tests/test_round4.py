"""What the third round's findings asked for."""

from pyspark.sql import functions as F

from wayfind.operators import compat, index, score
from wayfind.plans import query_parser
from wayfind.sources import catalogs


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_gathered_after_joints_have_met(spark):
    schema = "key string, {} double, joints array<string>, combinations array<string>"
    v = spark.createDataFrame([("v1", 9.0, ["a", "b", "a"], ["i2", "i1"]), ("v1", None, ["c"], []), ("v2", 1.0, ["b", None], None), ("v3", 1.0, None, ["v3"]), (None, 1.0, ["a"], ["i1"])], schema.format("power"))
    i = spark.createDataFrame([("i1", 5.0, ["b", "a"], ["v2"]), ("i2", None, ["c"], []), ("v3", 2.0, ["b"], ["v3"]), ("combination", 1.0, ["combination"], ["v3"])], schema.format("needed"))
    out = compat.compatible(v, i)
    got = sorted(((r["vehicle"], r["implement"], r["level"], r["evidence"], r["power_ok"], round(r["score"], 2)) for r in out.collect()), key=str)
    want = [
        ("v1", "i1", "declared", "a; b; combination", True, 1.0), ("v1", "i1", "declared", "a; b; combination", None, 1.0), ("v1", "i2", "declared", "c; combination", None, 1.0), ("v1", "i2", "declared", "c; combination", None, 1.0),
        ("v1", "v3", "joint", "b", True, 0.7), ("v1", "v3", "joint", "b", None, 0.7), ("v2", "i1", "declared", "b; combination", False, 0.7), ("v2", "v3", "joint", "b", False, 0.4), ("v3", "combination", "declared", "combination", True, 1.0),
    ]
    assert got == sorted(want, key=str)
    # Above the join with implements of a class there is no aggregate: its rows are the result's.
    lines = plan_of(out).splitlines()
    join = next(n for n, x in enumerate(lines) if "Join Inner" in x and "share" in x)
    assert not any("Aggregate" in x for x in lines[:join] if x.index(next(c for c in x if c.isalpha())) < lines[join].index("Join"))
    assert out.where(F.col("level") == "joint").count() == 3


def test_texts_are_normalised_once_each(spark):
    """The normal forms are made of texts without repetitions, after a shuffle, not in the tasks that read the catalog."""
    c = index.valid_items(catalogs.generated(spark, 40).withColumn("name", F.when(F.col("item_id") > 1, F.concat(F.lit("Big-"), (F.col("item_id") % 3).cast("string")))))
    items = index.named(c)
    fields = index.item_fields(items)
    for df in (items, fields):
        lines = plan_of(df).splitlines()
        normal = [n for n, x in enumerate(lines) if "regexp" in x.lower() or "translate(" in x]
        assert normal and all("Aggregate" in lines[n] or "Aggregate" in lines[n + 1] for n in normal), df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["name"], r["name_norm"]) for r in items.select("name", "name_norm").distinct().collect()} == {(None, ""), ("Big-0", "big 0"), ("Big-1", "big 1"), ("Big-2", "big 2")}
    got = {(r["item_id"], r["field"]): (r["norm"], r["tokens"]) for r in fields.collect()}
    assert fields.columns == ["item_id", "field", "prio", "norm", "tokens"] and got[5, "name"] == ("big 2", ["big", "2"]) and (0, "name") not in got
    bare = {(r["item_id"], r["field"]): (r["norm"], r["tokens"]) for r in index.item_fields(c).collect()}
    assert bare == got


def test_sums_of_a_query_keep_the_order_of_its_terms(spark):
    idf = [2.2043674648485996, 1.0, 1.5400915660892769]
    best = spark.createDataFrame([(1, 1, 7, 1.0, "name", "exact", False)], "query_id long, pos int, item_id long, value double, field string, kind string, far boolean")
    for order in ([1, 2, 3], [3, 1, 2], [2, 3, 1]):
        terms = spark.createDataFrame([(1, p, "t", idf[p % 3]) for p in order], "query_id long, pos int, text string, idf double").coalesce(1)
        assert score.score_parts(best, terms).first()["most"] == (idf[1] + idf[2]) + idf[0]


def test_parser_tries_only_what_may_begin_or_be_near():
    """A word that no pattern begins with meets no pattern, one that repeats is looked up once, and lengths out of reach cost no trigram."""
    parser = query_parser.Parser(("pt", "en", "de", "fr"))
    tried, looked = [], []
    parser._range = lambda pattern, tokens, i: tried.append(pattern)
    assert parser.constraint(["anvil"], 0) is None and len(tried) < len(parser.ranges)
    book = query_parser.PhraseBook([(("john", "deere"), 1), (("fendt",), 2)])
    book._grams = lambda text: looked.append(text) or query_parser.PhraseBook._grams(text)
    assert [book.near(t, 2) for t in ("jhon deere", "jhon deere", "a text of far more letters", "fedt", "fnedt")] == [(1, "john deere"), (1, "john deere"), None, (1, "fendt"), (1, "fendt")]
    assert looked == ["jhon deere", "fedt", "fnedt"]
    words = [b"", b"ab", b"ba", b"abc", b"cab", b"acb", b"abdc", b"xyzabc", b"john", b"jhon", b"deere", b"dreee"]
    for a in words:
        for b in words:
            d = query_parser.osa_distance(a, b)
            assert all(query_parser.osa_distance(a, b, m) == d if d <= m else query_parser.osa_distance(a, b, m) > m for m in range(4))
