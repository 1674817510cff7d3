"""What the fourth round's findings asked for."""

import functools
import itertools
import operator

from pyspark.sql import functions as F

from wayfind.operators import compat, index, score
from wayfind.plans import search
from wayfind.sources import catalogs

BEST = "query_id long, pos int, item_id long, value double, field string, kind string, far boolean"


def test_items_with_the_same_hits_score_the_same(spark):
    """Whatever order an item's hits arrive in: its score is compared in all digits, before name and key."""
    idf = [2.2045, 1.0, 1.53069951034276]
    terms = spark.createDataFrame([(1, p, "t", idf[p % 3]) for p in (1, 2, 3)], "query_id long, pos int, text string, idf double")
    sums = {functools.reduce(operator.add, [idf[p % 3] * v for p, v in order]) for order in itertools.permutations([(1, 0.55125), (2, 1.0), (3, 1.0)])}
    hits = [(1, p, i, v, "name", "exact", False) for i, order in enumerate(itertools.permutations([(1, 0.55125), (2, 1.0), (3, 1.0)])) for p, v in order]
    best = spark.createDataFrame(hits, BEST).coalesce(1)
    concepts = spark.createDataFrame([(1, c, 1.0) for c in (1, 2)], "query_id long, c int, confidence double")
    for more in ((), (spark.createDataFrame([(1, c, i, 0.1 * (c + 2)) for i in range(6) for c in ((1, 2), (2, 1))[i % 2]], "query_id long, c int, item_id long, value double").coalesce(1), concepts)):
        got = {r["raw"] for r in score.score_parts(best, terms, *more).collect()}
        want = (0.55125 * idf[1] + idf[2]) + idf[0]
        assert len(sums) > 1 and got == {(want + 0.3) + 0.4 if more else want}


def test_copies_of_implements_are_not_broadcast(spark, monkeypatch):
    """Spark takes the copies of implements, one for each share of vehicles, for as small as one; the join must not pass them through the driver."""
    schema = "key string, {} double, joints array<string>, combinations array<string>"
    v = spark.createDataFrame([(f"v{n}", 1.0 * n, ["a", "b"][n % 2 :], [f"i{n}"]) for n in range(9)], schema.format("power"))
    i = spark.createDataFrame([(f"i{n}", 4.0, ["b"], []) for n in range(5)], schema.format("needed"))
    got = []
    for rows in (1, 3, 4096):
        monkeypatch.setattr(compat, "SHARE_ROWS", rows, raising=False)
        out = compat.compatible(v, i)
        got.append(sorted(map(tuple, out.collect())))
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("SortMergeJoin" in x and "share#" in x for x in lines) and not any("BroadcastHashJoin" in x and "share#" in x for x in lines)
    assert got[0] == got[1] == got[2] and len(got[0]) == 45
    targets = spark.createDataFrame([(1, "v2"), (2, "i3")], "query_id long, target string")
    assert {(r["query_id"], r["n"]) for r in compat.for_targets(targets, v, i).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 5), (2, 9)}


def test_names_of_the_catalog_are_not_broadcast_for_targets(spark, tmp_path):
    """A search for partners meets the catalog by shuffles: what looks small in compressed files would go through the driver with all its items."""
    built = index.build_index(catalogs.generated(spark, 40)).write(f"file://{tmp_path}/index")
    asked = search.kept(search.parse_queries(spark.createDataFrame([(1, "compatible with model 1003")], "query_id long, text string")))
    schema = "key string, {} double, joints array<string>, combinations array<string>"
    v = spark.createDataFrame([("bench/item_00003.xml", 9.0, ["a"], [])], schema.format("power"))
    i = spark.createDataFrame([("bench/item_00005.xml", 5.0, ["a"], []), ("bench/item_00006.xml", 10.0, ["a"], []), ("none", 1.0, ["a"], [])], schema.format("needed"))
    ranks, found = search._target_ranks(built, asked), search.search_compatible(built, asked, v, i)
    assert [r["key"] for r in ranks.where("rank = 1").collect()] == ["bench/item_00003.xml"]
    got = [(r["rank"], r["key"], round(r["score"], 2)) for r in found.orderBy("rank").collect()]
    assert got == [(1, "bench/item_00005.xml", 0.7), (2, "bench/item_00006.xml", 0.4)]
    for df in (ranks, found):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [item_id#" in x or "Join [key#" in x]
        assert joins and not any("BroadcastHashJoin" in x for x in joins)
