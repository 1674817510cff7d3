"""Rows and files that cannot be read are counted and left out."""

from wayfind.functions import text as T
from wayfind.operators.index import skipped_of, valid_items
from wayfind.sources import catalogs


def test_second_source_survives_broken_files(spark):
    good = "<vehicle><storeData><specs><power>120</power><maxSpeed>x</maxSpeed></specs></storeData><attacherJoint jointType='a'/></vehicle>"
    files = spark.createDataFrame([(1, good), (2, "<vehicle><storeData>"), (3, None), (4, "<vehicle/>")], "item_id long, xml string")
    assert [tuple(r) for r in catalogs.secondary_specs(files).collect()] == [(1, "power", 120.0)]
    assert [tuple(r) for r in catalogs.secondary_errors(files).collect()] == [("secondary-error", 1)]
    assert catalogs.secondary_errors(files.where("item_id <> 2")).count() == 0
    infos = {r["key"]: r["joints"] for r in catalogs.compat_infos(files.withColumnRenamed("item_id", "key")).collect()}
    assert infos[1] == ["a"] and set(infos) == {1, 2, 3, 4}


def test_broken_items_are_counted(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<catalog>\n<item xmlFilename="a" name="A"/>\n<item xmlFilename="" name="C"/>\n<item xmlFilename="b" name="B"><spec id="p" </item>\n</catalog>')
    c = catalogs.read_xml(spark, f"file://{tmp_path}/c.xml")
    assert {r["reason"]: r["n"] for r in skipped_of(c).collect()} == {"build-error": 1, "no-id": 1}
    assert [r["key"] for r in valid_items(c).collect()] == ["a"]


def test_joined_form(spark):
    d = spark.createDataFrame([("6R 155-M, 2.5t",), (None,)], "x string")
    assert [r[0] for r in d.select(T.joined(d["x"])).collect()] == ["6r 155 m 2.5t", ""]
