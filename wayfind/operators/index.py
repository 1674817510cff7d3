"""The index of a catalog, as DataFrames that are written once and read by every query.

A catalog has the columns item_id, key, name, brand, category, mod, author, dlc, species, origin, price (double) and specs (map<string, double>).
Items without a key are not indexed; specs and prices that are not finite and non-negative are left out, and both are counted in ``skipped``. A
catalog may also have price_text, the price as it was written, which only the counters read,
and broken, which marks rows that could not be read.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.operators import sequences
from wayfind.operators.filters import first_specs, value_cuts, with_bins
from wayfind.sources import buckets
from wayfind.sources.buckets import Buckets

#: Searched fields by priority at equal value. Fixed values.
FIELDS = ("name", "brand", "category", "mod", "author", "dlc")
FACETS = ("brand", "category", "origin", "species")
#: Items of a token that stand under one key; a token of more items is dealt over several.
SHARD_ITEMS = 1_000_000


@dataclass
class Index:
    items: DataFrame
    fields: DataFrame
    postings: DataFrame
    wide: DataFrame
    vocabulary: DataFrame
    trigrams: DataFrame
    phrases: DataFrame
    phrase_trigrams: DataFrame
    facets: DataFrame
    numeric: DataFrame
    firsts: DataFrame
    cuts: DataFrame
    skipped: DataFrame
    meta: DataFrame

    TABLES = ("items", "fields", "postings", "wide", "vocabulary", "trigrams", "phrases", "phrase_trigrams", "facets", "numeric", "firsts", "cuts", "skipped", "meta")

    def write(self, path: str, more: DataFrame | None = None, ready: DataFrame | None = None) -> Index:
        """To a new path: readers change over when all is there. Each table is made from tables already written, so texts are normalised once, and
        tables that do not need each other are written side by side. What searches join is kept in buckets of the joined columns (BUCKETED), so that
        a search shuffles none of it; numeric specs are parted by ranges of (spec, value), so a range reads the files that hold it. more: specs of a second source, as for fill_specs;
        ready: fields that were already made of the items."""
        spark = self.items.sparkSession
        kept: dict[str, Buckets] = {}

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        def put_bucketed(name: str, df: DataFrame, rows: int | None) -> DataFrame:
            kept[name] = Buckets.of(self.BUCKETED[name], rows)
            return buckets.put(df, path, name, kept[name])

        def put_numeric() -> None:
            numeric = put("numeric", numeric_specs(items, more).repartitionByRange("spec_id", "value").sortWithinPartitions("spec_id", "value"))
            firsts = first_specs(numeric)
            put("firsts", with_bins(firsts, put("cuts", value_cuts(firsts))).sortWithinPartitions("quantity", "bin"))

        def put_words(rows: int) -> None:
            vocabulary = put("vocabulary", vocabulary_of(postings_of(fields), n_items).sortWithinPartitions("token"))
            wide = put("wide", wide_of(vocabulary))
            more_jobs = [
                pool.submit(put_bucketed, "postings", sharded(postings_of(fields), wide), rows),
                pool.submit(put_bucketed, "trigrams", trigrams_of(vocabulary, "token"), vocabulary.agg(F.sum(F.octet_length("token"))).first()[0]),
            ]
            for job in more_jobs:
                job.result()

        with ThreadPoolExecutor(len(self.TABLES)) as pool:
            jobs = [pool.submit(put, t, getattr(self, t)) for t in ("skipped", "meta")]
            items = put("items", self.items)
            n_items = items.count()
            jobs += [pool.submit(put_numeric), pool.submit(put, "facets", facets_of(items))]
            fields = put("fields", item_fields(items) if ready is None else ready)
            n = fields.agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.octet_length("norm")).alias("grams")).first()
            jobs += [pool.submit(put_words, n["tokens"]), pool.submit(put, "phrases", phrases_of(fields)), pool.submit(put_bucketed, "phrase_trigrams", trigrams_of(fields, "norm"), n["grams"])]
            for job in jobs:
                job.result()
        buckets.describe(spark, path, kept)
        return self.read(spark, path)

    #: Tables in buckets, with the columns that searches join them on.
    BUCKETED = {"postings": ("token", "shard"), "trigrams": ("gram", "size"), "phrase_trigrams": ("gram", "size")}

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        have = buckets.layout(spark, path)
        return cls(**{t: buckets.opened(spark, path, t, have[t]) if t in have else spark.read.parquet(f"{path}/{t}") for t in cls.TABLES})

    @classmethod
    def forget(cls, spark: SparkSession, path: str) -> None:
        """Takes an index whose folder goes out of the session's catalog."""
        buckets.forget(spark, path, tuple(cls.BUCKETED))


def _broken(catalog: DataFrame):
    return F.coalesce("broken", F.lit(False)) if "broken" in catalog.columns else F.lit(False)


def valid_items(catalog: DataFrame) -> DataFrame:
    return catalog.where((F.col("key").isNotNull()) & (F.col("key") != "") & ~_broken(catalog))


def named(items: DataFrame) -> DataFrame:
    """items with ``name_norm``, the name as it is searched and sorted."""
    if "name_norm" in items.columns:
        return items
    forms = normal_forms(items.select("name")).withColumnRenamed("norm", "name_norm")
    return items.join(forms, "name", "left").select(*[items[c] for c in items.columns], F.coalesce("name_norm", F.lit("")).alias("name_norm"))


def normal_forms(texts: DataFrame) -> DataFrame:
    """The one column of texts without repetitions, and ``norm``. Normalising costs far more than all else that is done with a short text, so each is normalised once,
    in as many tasks as a shuffle has rather than in those of a file."""
    (name,) = texts.columns
    return texts.where(F.col(name).isNotNull()).distinct().withColumn("norm", T.normalize(F.col(name)))


def item_fields(items: DataFrame) -> DataFrame:
    """(item_id, field, prio, norm, tokens): fields with an empty form are left out."""
    norm = lambda f: F.col("name_norm") if f == "name" and "name_norm" in items.columns else F.lit(None).cast("string")
    long = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("prio"), F.col(f).alias("raw"), norm(f).alias("done")) for i, f in enumerate(FIELDS)])).alias("x"))
    long = long.select("item_id", "x.*").where("raw is not null")
    forms = normal_forms(long.where("done is null").select("raw"))
    long = long.join(forms, "raw", "left").select("item_id", "field", "prio", F.coalesce("done", "norm").alias("norm"))
    return long.where("norm <> ''").withColumn("tokens", T.tokens(F.col("norm")))


def postings_of(fields: DataFrame) -> DataFrame:
    return fields.select(F.explode(F.array_distinct("tokens")).alias("token"), "item_id", "field", "prio")


def wide_of(vocabulary: DataFrame, most: int = SHARD_ITEMS) -> DataFrame:
    """(token, shards) of the tokens that more than ``most`` items have. There are at most as many as postings / most."""
    return vocabulary.where(F.col("df") > most).select("token", F.ceil(F.col("df") / most).cast("int").alias("shards"))


def sharded(postings: DataFrame, wide: DataFrame) -> DataFrame:
    """postings with ``shard``: a wide token's items are dealt over its shards, all others are in shard 0."""
    out = postings.join(wide, "token", "left")
    return out.select(*postings.columns, F.coalesce(F.pmod(F.xxhash64("item_id"), "shards").cast("int"), F.lit(0)).alias("shard"))


def vocabulary_of(postings: DataFrame, n_items: int) -> DataFrame:
    """(token, df, idf): documents are items, idf = ln(1 + n / df)."""
    return postings.groupBy("token").agg(F.count_distinct("item_id").alias("df")).withColumn("idf", F.log(1 + F.lit(n_items) / F.col("df")))


def trigrams_of(words: DataFrame, column: str) -> DataFrame:
    """(gram, word, times, size): ``times`` as a repeated gram counts each time; sizes in bytes."""
    words = words.select(F.col(column).alias("word")).distinct().withColumn("b", T.as_bytes(F.col("word")))
    return words.select("word", F.length("b").alias("size"), F.explode(T.grams(F.col("b"))).alias("gram")).groupBy("gram", "word", "size").agg(F.count(F.lit(1)).alias("times"))


def facets_of(items: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f"{f}_id" if f"{f}_id" in items.columns else f).alias("id")) for f in FACETS])
    return items.select("item_id", F.explode(pairs).alias("x")).select("x.facet", "x.id", "item_id").where("id is not null and id <> ''")


def facet_counts(items: DataFrame) -> DataFrame:
    """All facets in one pass over the items, by grouping sets."""
    ids = items.select(*[F.col(f"{f}_id" if f"{f}_id" in items.columns else f).alias(f) for f in FACETS])
    sets = [[F.col(f)] for f in FACETS]
    out = ids.groupingSets(sets, *[F.col(f) for f in FACETS]).agg(F.count(F.lit(1)).alias("n_items"), *[F.grouping(f).alias(f"g_{f}") for f in FACETS])
    facet, value = F.lit(None).cast("string"), F.coalesce(*[F.col(f) for f in FACETS])
    for f in FACETS:
        facet = F.when(F.col(f"g_{f}") == 0, F.lit(f)).otherwise(facet)
    return out.select(facet.alias("facet"), value.alias("id"), "n_items").where("id is not null and id <> ''")


def numeric_of(items: DataFrame) -> DataFrame:
    """(spec_id, value, item_id, source), with the price as the spec ``price``, which stands before a spec of that name."""
    specs = items.select("item_id", F.explode("specs").alias("spec_id", "value")).where("spec_id <> 'price'")
    rows = specs.unionByName(items.select("item_id", F.lit("price").alias("spec_id"), F.col("price").cast("double").alias("value")))
    return rows.where(T.finite(F.col("value"))).select("spec_id", "value", "item_id", F.lit(None).cast("string").alias("source"))


def skipped_of(catalog: DataFrame) -> DataFrame:
    """(reason, n): rows that could not be read, items without a key, and invalid specs and prices by id."""
    broken, empty = _broken(catalog), F.coalesce(F.col("key") == "", F.lit(True))
    counts = catalog.agg(F.count(F.when(~broken & empty, 1)).alias("no-id"), F.count(F.when(broken, 1)).alias("build-error"))
    no_key = counts.unpivot([], ["no-id", "build-error"], "reason", "n").where("n > 0")
    items = valid_items(catalog)
    bad = items.select(F.explode("specs").alias("spec", "value")).where(~T.finite(F.col("value"))).select("spec")
    if "price" in items.columns:
        price = F.col("price").cast("double")
        given = F.coalesce(F.col("price_text") != "", F.lit(False)) if "price_text" in items.columns else price.isNotNull() & ~F.isnan(price)  # without a text, not a number is no price
        bad = bad.unionByName(items.where(given & ~F.coalesce(T.finite(price), F.lit(False))).select(F.lit("price").alias("spec")))
    return no_key.unionByName(bad.groupBy(F.concat(F.lit("invalid-spec:"), "spec").alias("reason")).agg(F.count(F.lit(1)).alias("n")))


def signature_of(catalog: DataFrame) -> DataFrame:
    """One row: an order-free signature of the keys, so a changed catalog is noticed without a sort."""
    return catalog.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum(F.xxhash64("key").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash")).select(
        "n_items", F.concat_ws(":", F.col("n_items").cast("string"), "hash").alias("signature")
    )


#: The rolling hash of keys: h = (33 h + byte) mod 2^31 - 1, from 5381 on. Fixed values.
FACTOR, MODULUS, FIRST = 33, 2**31 - 1, 5381


def rolling_signature(catalog: DataFrame, order: str = "item_id") -> DataFrame:
    """One row (n_items, signature): the rolling hash of all keys in the catalog's order. A text is the function h -> (m h + a) mod MODULUS, with m = 33^length; such functions compose, so
    stretches of the catalog are hashed side by side. Null keys count as empty."""
    byte = F.split(T.as_bytes(F.coalesce("key", F.lit(""))), "")
    byte = F.filter(byte, lambda c: c != "")
    a = F.aggregate(byte, F.lit(0).cast("long"), lambda h, c: (h * FACTOR + F.ascii(c)) % MODULUS)
    m = F.aggregate(byte, F.lit(1).cast("long"), lambda m, c: m * FACTOR % MODULUS)
    rows = sequences.numbered(catalog.select(F.lit(0).alias("k"), F.col(order).alias("o"), "key"), ["o", "key"])
    rows = rows.select("k", "pos", F.struct(m.alias("m"), a.alias("a")).alias("x"))
    whole = sequences.composed(rows, "k", lambda x: x, lambda f, g: F.struct((f["m"] * g["m"] % MODULUS).alias("m"), ((f["a"] * g["m"] + g["a"]) % MODULUS).alias("a")))
    n = catalog.agg(F.count(F.lit(1)).alias("n_items"))
    one = n.join(F.broadcast(whole.select(((F.lit(FIRST) * F.col("f.m") + F.col("f.a")) % MODULUS).alias("h"))), how="left")  # a row each
    return one.select("n_items", F.concat_ws(":", F.col("n_items").cast("string"), F.coalesce("h", F.lit(FIRST)).cast("string")).alias("signature"))


def phrases_of(fields: DataFrame) -> DataFrame:
    return fields.select("norm", "field").distinct()


def numeric_specs(items: DataFrame, more: DataFrame | None = None) -> DataFrame:
    return numeric_of(items) if more is None else fill_specs(numeric_of(items), more)


def build_index(catalog: DataFrame) -> Index:
    items = named(valid_items(catalog))
    return index_of(catalog, items, item_fields(items))


def index_of(catalog: DataFrame, items: DataFrame, fields: DataFrame) -> Index:
    """The index of a catalog with its valid items and their fields."""
    postings = postings_of(fields)
    vocabulary = vocabulary_of(postings, items.count())
    wide = wide_of(vocabulary)
    numeric = numeric_of(items)
    firsts = first_specs(numeric)
    cuts = value_cuts(firsts)
    return Index(
        items=items, fields=fields, postings=sharded(postings, wide), wide=wide, vocabulary=vocabulary, trigrams=trigrams_of(vocabulary, "token"), phrases=phrases_of(fields), phrase_trigrams=trigrams_of(fields, "norm"),
        facets=facets_of(items), numeric=numeric, firsts=with_bins(firsts, cuts), cuts=cuts, skipped=skipped_of(catalog), meta=signature_of(catalog),
    )


def low_specs(coverage: DataFrame, least: float = 0.8) -> DataFrame:
    """Specs that fewer than ``least`` of the items have, for which a second source is read."""
    return coverage.where(F.col("coverage") < least)


def spec_coverage(items: DataFrame, numeric: DataFrame, specs: list[str]) -> DataFrame:
    """(spec_id, coverage): the share of items that have each spec; 0 for those that none has."""
    spark = items.sparkSession
    have = numeric.groupBy("spec_id").agg(F.count_distinct("item_id").alias("n"))
    asked = spark.createDataFrame([(s,) for s in specs], "spec_id string")
    total = items.agg(F.count(F.lit(1)).alias("total"))
    out = asked.join(have, "spec_id", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("spec_id", F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("coverage"))


def fill_specs(numeric: DataFrame, more: DataFrame) -> DataFrame:
    """numeric, with values of a second source for what an item lacks. more: (item_id, spec_id, value)."""
    more = more.where(T.finite(F.col("value"))).join(numeric.select("item_id", "spec_id"), ["item_id", "spec_id"], "left_anti")
    return numeric.unionByName(more.select("spec_id", "value", "item_id", F.lit("secondary").alias("source")))
