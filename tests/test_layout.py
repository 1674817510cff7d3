"""How an index lies on disk, and that searches use it so."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from wayfind.operators import filters, match
from wayfind.operators import index as I  # noqa: E741
from wayfind.plans.search import search_many
from wayfind.sources import buckets
from wayfind.sources.buckets import Buckets

from .test_search import catalog


def plan_of(df):
    with contextlib.redirect_stdout(text := io.StringIO()):
        df.explain()
    return text.getvalue()


@pytest.fixture
def items(spark):
    rows = [{"name": f"plough {i} {'steel' if i % 2 else 'iron'}", "brand": f"b{i % 3}", "specs": {"power": float(i), "weight": 1000.0 - i}} for i in range(40)]
    return catalog(spark, rows)


def no_broadcast(spark):
    """Settings as beyond the size of a broadcast."""
    return {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@contextlib.contextmanager
def configured(spark, settings):
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def many_buckets(monkeypatch, items, path):
    monkeypatch.setattr(buckets, "ROWS", 20)
    monkeypatch.setattr(I, "wide_of", lambda v, most=7: v.where(F.col("df") > most).select("token", F.ceil(F.col("df") / most).cast("int").alias("shards")))
    return I.build_index(items).write(path)


def test_number_of_buckets():
    assert [Buckets.of(("a",), n).number for n in (None, 0, 1, buckets.ROWS, buckets.ROWS + 1, 3 * buckets.ROWS)] == [1, 1, 1, 1, 2, 4]


def test_postings_and_trigrams_are_not_shuffled(spark, items, tmp_path, monkeypatch):
    index = many_buckets(monkeypatch, items, f"file://{tmp_path}/i")
    terms = spark.createDataFrame([(1, 0, "plough", 1), (1, 1, "stel", 1)], "query_id long, pos int, text string, d int")
    with configured(spark, no_broadcast(spark)):
        hits = match.spread(match.exact_hits(terms, index.vocabulary), index.wide)
        for df, table in ((hits.join(index.postings, ["token", "shard"]), "postings"), (match.gram_candidates(terms, index.trigrams), "trigrams")):
            lines = plan_of(df).splitlines()
            at = next(i for i, line in enumerate(lines) if "FileScan" in line and f"_{table}[" in line)
            assert "Bucketed: true" in lines[at]
            above, depth = [], lines[at].index("FileScan")
            for line in reversed(lines[:at]):  # the operators from the scan up to the join
                here = len(line) - len(line.lstrip(" :+-"))
                if here < depth:
                    depth = here
                    above.append(line)
                    if "Join" in line:
                        break
            assert "Join" in above[-1] and not any("Exchange" in line for line in above)


def test_layout_changes_no_result(spark, items, tmp_path, monkeypatch):
    """Tokens that most items have in several shards, several buckets, another session: the same results."""
    queries = spark.createDataFrame([(1, "plough"), (2, "steel 7"), (3, "plugh irn"), (4, "b1 iron"), (5, "over 30 kw"), (6, "none")], "query_id long, text string")
    found = lambda index: sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 9)) for r in search_many(index, queries).collect())
    plain = found(I.build_index(items).write(f"file://{tmp_path}/plain"))
    dealt = many_buckets(monkeypatch, items, f"file://{tmp_path}/dealt")
    assert dealt.wide.where("token = 'plough'").first()["shards"] == 6 and dealt.postings.where("token = 'plough'").select("shard").distinct().count() > 1
    assert max(b.number for b in buckets.layout(spark, f"file://{tmp_path}/dealt").values()) > 1
    assert plain and found(dealt) == plain
    other = spark.newSession()
    I.Index.forget(spark, f"file://{tmp_path}/dealt")
    assert found(I.Index.read(other.getActiveSession() or other, f"file://{tmp_path}/dealt")) == plain


def test_index_without_layout_is_read_plainly(spark, items, tmp_path):
    index = I.build_index(items).write(f"file://{tmp_path}/i")
    rows = sorted(map(tuple, index.postings.collect()))
    (tmp_path / "i" / "layout").rename(tmp_path / "gone")
    assert sorted(map(tuple, I.Index.read(spark, f"file://{tmp_path}/i").postings.collect())) == rows


def test_empty_catalog_has_buckets(spark, items, tmp_path):
    index = I.build_index(items.where("false")).write(f"file://{tmp_path}/i")
    assert index.postings.count() == 0 and search_many(index, spark.createDataFrame([(1, "plough")], "query_id long, text string")).count() == 0


def test_ranges_reach_the_scan(spark, items, tmp_path):
    index = I.build_index(items).write(f"file://{tmp_path}/i")
    ranges = spark.createDataFrame([(1, "power", 3.0, 6.0), (2, "power", 5.0, 8.0)], "query_id long, spec_id string, low double, high double")
    near = filters.spanned(index.numeric, ranges)
    with configured(spark, {"spark.sql.maxMetadataStringLength": "10000"}):
        plan = plan_of(near)
    assert "GreaterThanOrEqual(value,3.0)" in plan and "LessThanOrEqual(value,8.0)" in plan and "GreaterThanOrEqual(spec_id,power)" in plan
    assert sorted(r["value"] for r in near.collect()) == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    files = index.numeric.where("spec_id = 'power'").select(F.input_file_name().alias("f")).distinct().count()
    assert files <= index.numeric.select(F.input_file_name().alias("f")).distinct().count()
    open_ended = spark.createDataFrame([(1, "power", None, 6.0)], ranges.schema)
    assert filters.spanned(index.numeric, open_ended).count() == 7 and filters.spanned(index.numeric, ranges.where("false")).count() == 0
