"""Settings that act, and warnings of compatibility queries."""

import tempfile

from wayfind.operators.score import AMBIGUOUS, NOT_FOUND
from wayfind.plans.engine import Engine
from wayfind.plans.search import kept, parse_queries, target_of, warnings_of
from wayfind.sources import catalogs


def test_settings_limit_and_explain_results(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="spark-test-")
    engine = Engine(spark, folder, lambda: catalogs.generated(spark, 60))
    assert engine.option("showReasons") is False and engine.option("incremental") is True
    found, warnings = engine.search("model")
    assert found.count() == 60 and "lines" not in found.columns and warnings.count() == 0
    engine.settings.set("search#maxResults", 7.0)
    engine.set_option("showReasons", "sim")
    other = Engine(spark, folder, lambda: catalogs.generated(spark, 60))  # reads what was stored
    found, _ = other.search("model")
    assert [r["rank"] for r in found.collect()] == list(range(1, 8)) and other.option("showReasons") and "lines" in found.columns


def test_warnings_say_why_there_is_no_target(spark):
    engine = Engine(spark, "file://" + tempfile.mkdtemp(prefix="spark-test-"), lambda: catalogs.generated(spark, 60))
    texts = [(1, "compatible with 1005"), (2, "compatible with model"), (3, "compatible with zzzzz"), (4, "model")]
    parsed = kept(parse_queries(spark.createDataFrame(texts, "query_id long, text string")))
    index = engine.ensure()
    assert {(r["query_id"], r["warning"]) for r in warnings_of(index, parsed).collect()} == {(2, AMBIGUOUS), (3, NOT_FOUND)}
    assert [r["query_id"] for r in target_of(index, parsed).collect()] == [1]


def test_ids_of_queries_survive_nulls(spark):
    big = 2**53 + 1
    parsed = parse_queries(spark.createDataFrame([(big, "blue"), (None, "red"), (big + 2, None)], "query_id long, text string"))
    assert {r["query_id"] for r in parsed.collect()} == {big, None, big + 2}
