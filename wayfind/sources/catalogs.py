"""Catalogs: XML files, tables of the test data seen as catalogs, and a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = ("name", "brand", "category", "mod", "author", "dlc")
XML_ITEM = (
    "_xmlFilename string, _name string, _brand string, _brandTitle string, _categoryId string, _categoryTitle string, _species string, _price string, _origin string, "
    "_modName string, _modTitle string, _author string, _dlcTitle string, spec array<struct<_id string, _value string, _unit string>>"
)


def first_text(*names: str):
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def from_raw(raw: DataFrame) -> DataFrame:
    """A catalog from raw rows as in the XML files: fallbacks from titles to ids, numbers from texts, origin from what the item has. Of specs with one
    id the last counts. A spec whose text is no number is null, and
    ``price_text`` keeps the price as it was written, for the index's counters; ``broken`` marks rows that could not be read."""
    number = lambda c: c.try_cast("double")
    given = F.filter(F.coalesce("spec", F.array().cast("array<struct<_id string, _value string, _unit string>>")), lambda x: x["_id"].isNotNull())
    later = lambda x, i: F.exists(F.slice(given, i + 2, F.greatest(F.size(given), F.lit(1))), lambda y: y["_id"] == x["_id"])
    last = F.filter(given, lambda x, i: ~later(x, i))
    specs = F.map_from_entries(F.transform(last, lambda x: F.struct(x["_id"], number(x["_value"]))))
    origin = F.when(first_text("_origin").isNotNull(), F.col("_origin")).when(first_text("_modName").isNotNull(), "mod").when(first_text("_dlcTitle").isNotNull(), "dlc").otherwise("base")
    return raw.select(
        F.xxhash64("_xmlFilename", "_name").alias("item_id"), F.col("_xmlFilename").alias("key"), F.col("_name").alias("name"), first_text("_brandTitle", "_brand").alias("brand"), F.col("_brand").alias("brand_id"),
        first_text("_categoryTitle", "_categoryId").alias("category"), F.col("_categoryId").alias("category_id"), first_text("_modTitle", "_modName").alias("mod"), F.col("_author").alias("author"),
        F.col("_dlcTitle").alias("dlc"), F.col("_species").alias("species"), origin.alias("origin"), number(F.col("_price")).alias("price"), specs.alias("specs"),
        first_text("_price").alias("price_text"), *([F.col("_unread").isNotNull().alias("broken")] if "_unread" in raw.columns else []),
    )


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """An element that is no proper XML is a row marked as broken, which the index counts and leaves out. It ends its file, as nothing tells where the next begins."""
    options = {"rowTag": "item", "attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}
    return from_raw(spark.read.format("xml").options(**options).schema(f"{XML_ITEM}, _unread string").load(path))


def write_xml(catalog: DataFrame, path: str) -> None:
    """A dump that read_xml() reads. Catalogs without ids of brands and categories have their titles as ids."""
    of = lambda *names: F.col(next(n for n in names if n in catalog.columns))
    spec = F.transform(F.map_entries("specs"), lambda e: F.struct(e["key"].alias("_id"), e["value"].cast("string").alias("_value"), F.lit("").alias("_unit")))
    rows = catalog.select(
        F.col("key").alias("_xmlFilename"), F.col("name").alias("_name"), of("brand_id", "brand").alias("_brand"), F.col("brand").alias("_brandTitle"), of("category_id", "category").alias("_categoryId"),
        F.col("category").alias("_categoryTitle"), F.col("species").alias("_species"), of("price_text", "price").cast("string").alias("_price"), F.col("origin").alias("_origin"), F.col("mod").alias("_modTitle"),
        F.col("author").alias("_author"), F.col("dlc").alias("_dlcTitle"), spec.alias("spec"),
    )
    rows.write.format("xml").option("rootTag", "catalog").option("rowTag", "item").option("attributePrefix", "_").mode("overwrite").save(path)


def in_scope(store: DataFrame, placeables: bool = False) -> DataFrame:
    """Items shown in the shop that are no bundles, of the wanted species."""
    species = ["vehicle", "handtool", *(["placeable"] if placeables else [])]
    return store.where(F.col("show") & ~F.col("bundle") & F.lower("species").isin(species))


def _unreadable():
    """Whether ``xml`` is given and no proper XML. Paths are only followed in other texts, as they would end the job in these."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread", "attributePrefix": "_"}
    return F.coalesce(F.from_xml("xml", "_none string, _unread string", options)["_unread"].isNotNull(), F.lit(False))


def secondary_errors(files: DataFrame) -> DataFrame:
    """(reason, n): how many of the files (item_id, xml) could not be read."""
    return files.where(_unreadable()).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("secondary-error").alias("reason"), "n")


def secondary_specs(files: DataFrame) -> DataFrame:
    """(item_id, spec_id, value) from files (item_id, xml): what the shop does not list. Files that cannot be read give nothing."""
    files = files.withColumn("xml", F.when(~_unreadable(), F.col("xml")))
    paths = {"power": "vehicle/storeData/specs/power", "neededPower": "vehicle/storeData/specs/neededPower", "workingWidth": "vehicle/storeData/specs/workingWidth", "maxSpeed": "vehicle/storeData/specs/maxSpeed"}
    found = files.select("item_id", *[F.xpath_string("xml", F.lit(p)).try_cast("double").alias(s) for s, p in paths.items()])
    return found.unpivot("item_id", list(paths), "spec_id", "value").where("value is not null")


def compat_infos(files: DataFrame) -> DataFrame:
    """(key, joints, input_joints, combinations) from files (key, xml): attacher joints and declared partners. Files that cannot be read give none."""
    files = files.withColumn("xml", F.when(~_unreadable(), F.col("xml")))
    of = lambda p: F.array_distinct(F.xpath("xml", F.lit(p)))
    return files.select("key", of("//attacherJoint/@jointType").alias("joints"), of("//inputAttacherJoint/@jointType").alias("input_joints"), of("//combination/@xmlFilename").alias("combinations"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_of(spark.read.parquet(f"{sf_dir}/part.parquet"))


def parts_of(p: DataFrame) -> DataFrame:
    """A part table as a catalog: names, brands and types, the price, and the size as a spec ``power``."""
    none = F.lit(None).cast("string")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        none.alias("mod"), none.alias("author"), none.alias("dlc"), F.lit("vehicle").alias("species"), F.lit("base").alias("origin"), F.col("p_retailprice").alias("price"),
        F.create_map(F.lit("power"), F.col("p_size").cast("double")).alias("specs"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a catalog: the text is the name, language and source are category and brand."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("name"), F.col("source").alias("brand"), F.col("lang").alias("category"),
        none.alias("mod"), none.alias("author"), none.alias("dlc"), F.lit("vehicle").alias("species"), F.lit("base").alias("origin"), F.col("n_chars").cast("double").alias("price"),
        F.expr("cast(map() as map<string,double>)").alias("specs"),
    )


def generated(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n items of eight brands and seven categories with prices from 50000 and powers from 50; by hashes of their numbers, so in any number of tasks."""
    brands, categories = ["John Deere", "Fendt", "Claas", "Valtra", "Kuhn", "Krone", "Lemken", "Horsch"], ["TRACTORS", "SPRAYERS", "SEEDERS", "TRAILERS", "HARVESTERS", "BALERS", "PLOWS"]
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k)).cast("int")
    of = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), pick(salt, len(names)) + 1)
    rows = spark.range(n).withColumns({"brand": of(brands, 1), "category": of(categories, 2)})
    is_mod = pick(5, 10) == 0
    return rows.select(
        F.col("id").alias("item_id"), F.format_string("bench/item_%05d.xml", F.col("id")).alias("key"), F.concat("brand", F.lit(" Model "), (1000 + F.col("id")).cast("string")).alias("name"), "brand", "category",
        F.when(is_mod, "Bench Mod").alias("mod"), F.when(is_mod, "author").alias("author"), F.lit(None).cast("string").alias("dlc"), F.lit("vehicle").alias("species"), F.when(is_mod, "mod").otherwise("base").alias("origin"),
        (50_000 + pick(3, 500_000)).cast("double").alias("price"), F.create_map(F.lit("power"), (50 + pick(4, 350)).cast("double")).alias("specs"),
    )
