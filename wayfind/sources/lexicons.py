"""Vocabularies from XML files, ``<folder>/<locale>/<name>.xml``, as one table of words, and the rule by which earlier locales win.

The files are read whole, in one scan, and each is taken apart by a schema. A file that is missing or is no XML of its kind gives no words, and missing() names it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.plans.lexicon import Lexicon

#: The files of a locale, and their elements. Fixed values.
SCHEMAS = {
    "aliases": "concept array<struct<_kind string, _id string, term array<string>>>",
    "units": "quantity array<struct<_id string, unit array<struct<_alias string, _factor double>>>>, unit array<struct<_alias string, _canonical string>>",
    "numbers": "_decimal string, _thousands string, multiplier array<struct<_word string, _factor double>>, spelled array<struct<_word string, _value double>>",
    "comparators": "op array<struct<_id string, p array<string>>>, range struct<p array<string>>",
    "stopwords": "w array<string>",
    "context": "compat struct<p array<string>>, self struct<p array<string>>",
}
COMMON = "common"
ENTRY = "array<struct<part string, word string, a string, b string>>"
#: Parts in which a word has one meaning: that of the first locale that has it.
SINGLE = ("separators", "multiplier", "spelled", "unit", "local_unit", "stopword", "range")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(locale, name, xml): every file of the folder's locales."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.xml").text(f"{folder}/*")
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("locale"), F.regexp_extract(path, r"([^/]+)\.xml$", 1).alias("name"), F.col("value").alias("xml"))


def _one(part: str, word: Column, a: Column | None = None, b: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(part).alias("part"), word.alias("word"), (none if a is None else a.cast("string")).alias("a"), (none if b is None else b.cast("string")).alias("b"))


def _each(part: str, rows: Column, word=lambda x: x, a=lambda x: None, b=lambda x: None) -> Column:
    return F.coalesce(F.transform(rows, lambda x: _one(part, word(x), a(x), b(x))), F.array().cast(ENTRY))


def _nested(rows: Column, inner, make) -> Column:
    return F.coalesce(F.flatten(F.transform(rows, lambda x: F.coalesce(F.transform(inner(x), lambda y: make(x, y)), F.array().cast(ENTRY)))), F.array().cast(ENTRY))


def _entries(x: Column, name: str) -> Column:
    if name == "aliases":
        return _nested(x["concept"], lambda c: c["term"], lambda c, t: _one("alias", t, c["_kind"], c["_id"]))
    if name == "units":
        kept = _nested(x["quantity"], lambda q: q["unit"], lambda q, u: _one("unit", u["_alias"], q["_id"], u["_factor"]))
        return F.concat(kept, _each("local_unit", x["unit"], lambda u: u["_alias"], lambda u: u["_canonical"]))
    if name == "numbers":
        marks = F.array(_one("separators", F.lit("separators"), F.coalesce(x["_decimal"], F.lit(".")), F.coalesce(x["_thousands"], F.lit(","))))
        words = [_each(p, x[p], lambda w: w["_word"], lambda w, v=v: w[v]) for p, v in (("multiplier", "_factor"), ("spelled", "_value"))]
        return F.concat(marks, *words)
    if name == "comparators":
        return F.concat(_nested(x["op"], lambda o: o["p"], lambda o, p: _one("op", p, o["_id"])), _each("range", x["range"]["p"]))
    if name == "stopwords":
        return _each("stopword", x["w"])
    return F.concat(_each("compat", x["compat"]["p"]), _each("selected", x["self"]["p"]))


def parsed_files(files: DataFrame) -> DataFrame:
    """(locale, name, entries): entries is null for a file that is no XML of its kind; files of other names are left out."""
    entries = F.lit(None).cast(ENTRY)
    for name, schema in SCHEMAS.items():
        # A mark for records that cannot be read tells a broken file from one without words.
        x = F.from_xml("xml", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "attributePrefix": "_"})
        rooted = F.col("xml").rlike(rf"<{name}[\s/>]")
        entries = F.when((F.col("name") == name) & rooted & x["_broken"].isNull(), _entries(x, name).cast(ENTRY)).otherwise(entries)
    return files.where(F.col("name").isin(*SCHEMAS)).select("locale", "name", entries.alias("entries"))


def priorities(spark: SparkSession, locales: tuple[str, ...]) -> DataFrame:
    """(locale, prio); the units that all locales share come last."""
    return spark.createDataFrame([(x, i) for i, x in enumerate([*dict.fromkeys(locales), COMMON])], "locale string, prio int")


def missing(files: DataFrame, locales: tuple[str, ...]) -> DataFrame:
    """(locale, name, warning): a row for each file that the locales should have and that is absent or broken."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(x, n) for x in dict.fromkeys(locales) for n in SCHEMAS] + [(COMMON, "units")], "locale string, name string")
    good = parsed_files(files).where("entries is not null").select("locale", "name")
    return wanted.join(good, ["locale", "name"], "left_anti").withColumn("warning", F.concat(F.lit("no vocabulary: "), "locale", F.lit("/"), "name"))


def first_wins(words: DataFrame, *keys: str) -> DataFrame:
    """words with one row for each value of keys: that of the least ``prio``, and within it of the least ``n``."""
    rest = [c for c in words.columns if c not in keys]
    best = words.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("prio", "n")).alias("_best"))
    return best.select(*keys, "_best.*")


def words_of(files: DataFrame, locales: tuple[str, ...]) -> DataFrame:
    """(part, word, prio, n, a, b): the words of the locales in normalised spelling; of a word with one meaning, the first locale's."""
    rows = parsed_files(files).join(F.broadcast(priorities(files.sparkSession, locales)), "locale")  # a row for each locale asked for
    rows = rows.select("prio", F.posexplode("entries").alias("n", "x")).select("prio", "n", "x.*")
    slots = {"{a}": "slotaslot", "{b}": "slotbslot"}
    word = F.col("word")
    for slot, name in slots.items():
        word = F.replace(word, F.lit(slot), F.lit(f" {name} "))
    word = T.normalize(word)
    for slot, name in slots.items():
        word = F.replace(word, F.lit(name), F.lit(slot))
    # Signs of money are words that normalising sets apart; other units are spelled as queries are.
    rows = rows.withColumn("word", F.when(F.col("part") == "separators", F.col("word")).otherwise(word)).where("word <> ''")
    single = F.col("part").isin(*SINGLE)
    return first_wins(rows.where(single), "part", "word").select("part", "word", "prio", "n", "a", "b").unionByName(rows.where(~single).select("part", "word", "prio", "n", "a", "b"))


def load_lexicon(spark: SparkSession, folder: str, locales: tuple[str, ...]) -> Lexicon:
    """The vocabulary of a query language, which every task of the parser holds, from files."""
    rows = words_of(read_files(spark, folder), locales).orderBy("prio", "n", "word").collect()
    of = lambda part: [r for r in rows if r["part"] == part]
    split = lambda part: [tuple(r["word"].split()) for r in of(part)]
    out = Lexicon(
        aliases=[(tuple(r["word"].split()), (r["a"], r["b"])) for r in of("alias")], operators=[(r["a"], r["word"].split()) for r in of("op")], ranges=[list(p) for p in split("range")],
        multipliers={r["word"]: float(r["a"]) for r in of("multiplier")}, spelled={r["word"]: float(r["a"]) for r in of("spelled")},
        units={r["word"]: (r["a"], float(r["b"]), r["word"]) for r in of("unit")}, local_units={r["word"]: r["a"] for r in of("local_unit")},
        stopwords={r["word"] for r in of("stopword")}, compat=split("compat"), selected=split("selected"),
    )
    for r in of("separators"):
        out.decimal, out.thousands = r["a"], r["b"]
    return out
