"""Queries of the search engine by name, and the SQL that repeats them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind import oracle as O  # noqa: E741
from wayfind.functions import text as T
from wayfind.operators import calibrate, compat, diagnostics, filters, index, match, reasons, score
from wayfind.plans.lexicon import STOPWORDS
from wayfind.plans.search import explain, kept, parse_queries, search_compatible, search_many
from wayfind.sources import catalogs, lexicons
from wayfind.sources.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Texts to search for, with what is to be understood: terms, and power from and to in kW.
ASKED = [
    (1, "blue anvil", ["blue", "anvil"], None, None),
    (2, "gizmo 17", ["gizmo", "17"], None, None),
    (3, "anvl", ["anvl"], None, None),
    (4, "wigdet economy", ["wigdet", "economy"], None, None),
    (5, "plat", ["plat"], None, None),
    (6, "larg bolt 10 hp", ["larg", "bolt"], 10 * 0.7457 * 0.95, 10 * 0.7457 * 1.05),
    (7, "between 20 and 40 kw gear", ["gear"], 20.0, 40.0),
    (8, "over 45 kw", [], 45.0, None),
    (9, "ring under 15 kw", ["ring"], None, 15.0),
    (10, "co ring", ["co", "ring"], None, None),
    (11, "standrad small rod", ["standrad", "small", "rod"], None, None),
    (12, "zzzzzz", ["zzzzzz"], None, None),
]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, text) for i, text, *_ in ASKED], "query_id long, text string")


def asked_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n + 1, t) for i, _, terms, *_ in ASKED for n, t in enumerate(terms)], "query_id long, pos int, text string")


TERMS = "terms(query_id, pos, text) as (values " + ", ".join(f"({i}::bigint, {n + 1}, '{t}')" for i, _, terms, *_ in ASKED for n, t in enumerate(terms)) + ")"
ENDS = "ends(query_id, low, high) as (values " + ", ".join(f"({i}::bigint, {'null' if a is None else a}::double, {'null' if b is None else b}::double)" for i, _, _, a, b in ASKED if a or b) + ")"


def part_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, fields and postings of the parts; the fields are written, as plans read them several times."""
    items = index.valid_items(catalogs.parts(spark, sf_dir))
    fields = kept(index.item_fields(items), "fields")
    return items, fields, index.postings_of(fields)


def part_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, postings = part_fields(spark, sf_dir)
    return kept(index.vocabulary_of(postings, items.count()), "vocabulary")


# ---- text


@query("normalize_text", f"select doc_id, md5(norm) as norm_md5, length(norm)::bigint as n_chars from (select doc_id, {O.normalize('text')} as norm from documents)")
def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))
    return d.select("doc_id", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), F.length("norm").cast("long").alias("n_chars"))


_MODEL = "replace(p_brand, '#', '') || '-' || p_size || 'HP ' || p_name"


@query("joined_forms", f"select p_partkey, {O.normalize(_MODEL)} as norm, {O.normalize(_MODEL, apart=False)} as joined from part")
def joined_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_MODEL).alias("model"))
    return p.select("p_partkey", T.normalize(F.col("model")).alias("norm"), T.joined(F.col("model")).alias("joined"))


@query("fold_accents", f"select doc_id, md5({O.fold('text')}) as folded_md5 from documents")
def fold_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded_md5"))


@query("tokenize_positions", f"select p_partkey, pos::int as pos, t[pos] as token, (coalesce(list_sum(list_transform(t[1:pos-1], lambda x: strlen(x) + 1)), 0) + 1)::int as s, (coalesce(list_sum(list_transform(t[1:pos-1], lambda x: strlen(x) + 1)), 0) + strlen(t[pos]))::int as e from (select p_partkey, t, unnest(range(1, len(t) + 1)) as pos from (select p_partkey, string_split({O.normalize('p_name')}, ' ') as t from part))")
def tokenize_positions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", T.normalize(F.col("p_name")).alias("norm"))
    return p.select("p_partkey", F.explode(T.token_spans(F.col("norm"))).alias("x")).select("p_partkey", "x.*")


@query("prefix_keys", f"with {O.PARTS} select token, unnest(list_transform(range(2, least(6, length(token)) + 1), lambda i: token[1:i])) as prefix from vocabulary")
def prefix_keys(spark, sf_dir):
    return part_vocabulary(spark, sf_dir).select("token", F.explode(T.prefixes(F.col("token"))).alias("prefix"))


@query("trigram_grams", f"with {O.PARTS} select token as word, gram, times::bigint as times from words")
def trigram_grams(spark, sf_dir):
    return index.trigrams_of(part_vocabulary(spark, sf_dir), "token").select("word", "gram", "times")


# ---- the index


@query("field_fallback", "select c_custkey, coalesce(nullif(case when c_acctbal < 0 then '' else c_mktsegment end, ''), nullif(c_name, '')) as brand from customer")
def field_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("title", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", catalogs.first_text("title", "c_name").alias("brand"))


@query("finite_filter", "select c_custkey, c_acctbal from customer where c_acctbal is not null and not isnan(c_acctbal) and c_acctbal >= 0 and c_acctbal < 'infinity'::double")
def finite_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(T.finite(F.col("c_acctbal"))).select("c_custkey", "c_acctbal")


_PRICE = "case when c_custkey % 10 = 1 then 'abc' when c_custkey % 10 = 2 then '' when c_custkey % 10 = 3 then null else c_acctbal::varchar end"
_INVALID = "not coalesce(isfinite(try_cast({0} as double)) and try_cast({0} as double) >= 0, false)"


@query("skip_counters", f"select 'build-error' as reason, count(*) as n from customer where c_custkey % 50 = 7 having count(*) > 0 union all select 'no-id', count(*) as n from customer where c_nationkey = 0 and c_custkey % 50 <> 7 having count(*) > 0 union all select 'invalid-spec:balance', count(*) from customer where c_nationkey <> 0 and c_custkey % 50 <> 7 and not (c_acctbal >= 0) having count(*) > 0 union all select 'invalid-spec:price', count(*) from (select *, {_PRICE} as p from customer) where c_nationkey <> 0 and c_custkey % 50 <> 7 and p <> '' and {_INVALID.format('p')} having count(*) > 0")
def skip_counters(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_custkey").cast("string"))
    by = F.col("c_custkey") % 10
    price = F.when(by == 1, "abc").when(by == 2, "").when(by != 3, F.col("c_acctbal").cast("string"))
    rows = c.select(key.alias("key"), F.create_map(F.lit("balance"), F.col("c_acctbal")).alias("specs"), price.alias("price_text"), (F.col("c_custkey") % 50 == 7).alias("broken"))
    return index.skipped_of(rows.withColumn("price", F.col("price_text").try_cast("double")))


@query("low_coverage", "select spec_id, coverage from (select 'power' as spec_id, count(*) filter (p_size % 3 <> 0) / count(*) as coverage from part union all select 'price', count(p_retailprice) / count(*) from part union all select 'weight', 0.0::double) where coverage < 0.8")
def low_coverage(spark, sf_dir):
    items = catalogs.parts(spark, sf_dir)
    numeric = index.numeric_of(items).where("spec_id <> 'power' or value % 3 <> 0")
    return index.low_specs(index.spec_coverage(items, numeric, ["power", "price", "weight"]))


@query("origin_enrichment", "select s_suppkey, n_name as brand, r_name as category, case when s_acctbal < 0 then 'mod' when r_name = 'ASIA' then 'dlc' else 'base' end as origin from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def origin_enrichment(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # nation and region are the fixed small tables of this schema
    rows = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left").join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    origin = F.when(F.col("s_acctbal") < 0, "mod").when(F.col("r_name") == "ASIA", "dlc").otherwise("base")
    return rows.select("s_suppkey", F.col("n_name").alias("brand"), F.col("r_name").alias("category"), origin.alias("origin"))


@query("inverted_index", f"with {O.PARTS} select token, item_id, field from postings")
def inverted_index(spark, sf_dir):
    return part_fields(spark, sf_dir)[2].select("token", "item_id", "field")


@query("field_sets", f"with {O.PARTS} select token, item_id, string_agg(field, ',' order by field) as fields from postings group by token, item_id")
def field_sets(spark, sf_dir):
    return part_fields(spark, sf_dir)[2].groupBy("token", "item_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


@query("idf_table", f"with {O.PARTS} select token, df, round(idf, 6) as idf from vocabulary")
def idf_table(spark, sf_dir):
    return part_vocabulary(spark, sf_dir).select("token", "df", F.round("idf", 6).alias("idf"))


@query("document_frequency", f"with norms as (select doc_id, string_split({O.normalize('text')}, ' ') as t from documents) select token, count(distinct doc_id) as df from (select doc_id, unnest(t) as token from norms) where token <> '' group by token")
def document_frequency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(T.normalize(F.col("text"))))).alias("token"))
    return d.groupBy("token").agg(F.count_distinct("doc_id").alias("df"))


@query("facet_counts", "select 'brand' as facet, p_brand as id, count(*) as n_items from part group by p_brand union all select 'category', p_type, count(*) from part group by p_type union all select 'origin', 'base', count(*) from part having count(*) > 0 union all select 'species', 'vehicle', count(*) from part having count(*) > 0")
def facet_counts(spark, sf_dir):
    return index.facet_counts(catalogs.parts(spark, sf_dir))


@query("catalog_signature", "select count(*)::bigint as n_items, count(distinct p_partkey)::bigint as n_keys from part")
def catalog_signature(spark, sf_dir):
    """The signature is order-free: of the catalog and of the catalog read backwards it is the same."""
    c = catalogs.parts(spark, sf_dir)
    a, b = index.signature_of(c), index.signature_of(c.orderBy(F.desc("key")))
    keys = c.agg(F.count_distinct("key").alias("n_keys"))
    return a.join(b.select("signature"), "signature").select("n_items").crossJoin(F.broadcast(keys))  # one row each


_KEYS = "(select string_agg('part/' || p_partkey, '' order by p_partkey) as t, count(*) as n from part)"


@query("rolling_signature", f"select n::bigint as n_items, n || ':' || list_reduce(list_prepend(5381::bigint, list_transform(string_split(t, ''), lambda c: ascii(c)::bigint)), lambda h, b: (h * 33 + b) % 2147483647) as signature from {_KEYS}")
def rolling_signature(spark, sf_dir):
    return index.rolling_signature(catalogs.parts(spark, sf_dir))


@query("spec_coverage", "select s as spec_id, (case s when 'price' then (select count(*) from customer where c_acctbal >= 0) when 'late' then 0 else (select count(*) from customer where c_custkey % 3 = 0) end) / (select count(*) from customer) as coverage from (values ('price'), ('power'), ('late')) t(s)")
def spec_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("item_id", F.col("c_custkey"))
    return index.spec_coverage(c, _thin_numeric(c), ["price", "power", "late"])


def _thin_numeric(c: DataFrame) -> DataFrame:
    power = F.when(F.col("c_custkey") % 3 == 0, F.lit(50.0))
    return index.numeric_of(c.select(F.col("c_custkey").alias("item_id"), F.col("c_acctbal").alias("price"), F.create_map(F.lit("power"), power).alias("specs")))


@query("secondary_fill", "select c_custkey as item_id, case when c_custkey % 3 = 0 then 50.0::double else c_nationkey + 1.0::double end as value, case when c_custkey % 3 = 0 then null else 'secondary' end as source from customer")
def secondary_fill(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    more = c.select(F.col("c_custkey").alias("item_id"), F.lit("power").alias("spec_id"), (F.col("c_nationkey") + 1.0).alias("value"))
    return index.fill_specs(_thin_numeric(c).where("spec_id = 'power'"), more).select("item_id", "value", "source")


# ---- filters


@query("facet_filter", "select p_partkey as item_id from part where p_brand in ('Brand#10', 'Brand#11') and p_type = 'PROMO'")
def facet_filter(spark, sf_dir):
    chosen = spark.createDataFrame([(1, "brand", "Brand#10"), (1, "brand", "Brand#11"), (1, "category", "PROMO")], "query_id long, facet string, id string")
    sets = filters.facet_hits(chosen, index.facets_of(catalogs.parts(spark, sf_dir)))
    n = chosen.groupBy("query_id").agg(F.count_distinct("facet").alias("n_sets"))
    return filters.intersect(sets, n).select("item_id")


@query("wildcard_facet", "select 1::bigint as query_id, p_partkey as item_id from part where starts_with(p_type, 'S') union all select 2, p_partkey from part where p_brand = 'Brand#1'")
def wildcard_facet(spark, sf_dir):
    concepts = spark.createDataFrame([(1, 0, "category", "S*"), (2, 0, "brand", "Brand#1")], "query_id long, c int, kind string, value string")
    return filters.matching_facets(concepts, index.facets_of(catalogs.parts(spark, sf_dir))).select("query_id", "item_id")


@query("numeric_range", "select p_partkey as item_id from part where p_size between 10 and 20")
def numeric_range(spark, sf_dir):
    return filters.in_range(index.numeric_of(catalogs.parts(spark, sf_dir)), "power", 10, 20)


@query("open_range", "select p_partkey as item_id from part where p_retailprice >= 950")
def open_range(spark, sf_dir):
    return filters.in_range(index.numeric_of(catalogs.parts(spark, sf_dir)), "price", low=950)


@query("first_spec_rule", "select c_custkey as item_id, case when c_custkey % 2 = 0 then 'power' else 'neededPower' end as spec_id, (case when c_custkey % 2 = 0 then c_nationkey else c_nationkey + 100 end)::double as value from customer where (case when c_custkey % 2 = 0 then c_nationkey else c_nationkey + 100 end) >= 20")
def first_spec_rule(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    specs = F.create_map(F.lit("power"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("double")), F.lit("neededPower"), F.col("c_nationkey") + 100.0)
    numeric = index.numeric_of(c.select(F.col("c_custkey").alias("item_id"), F.lit(None).cast("double").alias("price"), specs.alias("specs")))
    wanted = spark.createDataFrame([(1, 0, "power", 20.0, None)], "query_id long, n int, quantity string, low double, high double")
    return filters.constraint_hits(wanted, filters.first_specs(numeric)).select("item_id", "spec_id", "value")


@query("range_join", "select n::int as n, count(*) as items from part join (values (0, 0.0, 905.0), (1, 905.0, 950.5), (2, 950.5, null)) t(n, low, high) on p_retailprice >= low and (high is null or p_retailprice <= high) group by n")
def range_join(spark, sf_dir):
    wanted = spark.createDataFrame([(1, 0, "money", 0.0, 905.0), (1, 1, "money", 905.0, 950.5), (1, 2, "money", 950.5, None)], "query_id long, n int, quantity string, low double, high double")
    firsts = filters.first_specs(index.numeric_of(catalogs.parts(spark, sf_dir)))
    return filters.constraint_hits(wanted, firsts).groupBy("n").agg(F.count(F.lit(1)).alias("items"))


@query("preset_buckets", "select n::int as step, count(*) as orders from orders join (values (0, 0.0, 50000.0), (1, 50000.0, 150000.0), (2, 150000.0, 300000.0), (3, 300000.0, null)) t(n, low, high) on o_totalprice >= low and (high is null or o_totalprice <= high) group by n")
def preset_buckets(spark, sf_dir):
    steps = filters.preset_ranges("price")
    hit = F.array_compact(F.array(*[F.when(filters.within(F.col("o_totalprice"), F.lit(a), F.lit(b).cast("double")), F.lit(n)) for n, a, b in steps]))
    return table(spark, sf_dir, "orders").select(F.explode(hit).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("orders"))


@query("unit_conversion", "select p_partkey, round(p_size * f::double, 6) as kw, u as unit from part, (values ('cv', 0.7355), ('hp', 0.7457), ('kw', 1.0)) t(u, f) where u = ['cv', 'hp', 'kw'][p_partkey % 3 + 1]")
def unit_conversion(spark, sf_dir):
    units = spark.createDataFrame([("cv", 0.7355), ("hp", 0.7457), ("kw", 1.0)], "unit string, factor double")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.element_at(F.array(*map(F.lit, ("cv", "hp", "kw"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("unit"))
    return p.join(F.broadcast(units), "unit").select("p_partkey", F.round(F.col("p_size") * F.col("factor"), 6).alias("kw"), "unit")  # a constant table


@query("filter_intersection", "select p_partkey as item_id from part where p_size between 5 and 30 and p_retailprice <= 960 and p_type = 'LARGE'")
def filter_intersection(spark, sf_dir):
    c = catalogs.parts(spark, sf_dir)
    wanted = spark.createDataFrame([(1, 0, "power", 5.0, 30.0), (1, 1, "money", None, 960.0)], "query_id long, n int, quantity string, low double, high double")
    sets = filters.constraint_hits(wanted, filters.first_specs(index.numeric_of(c))).select("query_id", F.col("n").cast("string").alias("n"), "item_id")
    sets = sets.unionByName(filters.facet_hits(spark.createDataFrame([(1, "category", "LARGE")], "query_id long, facet string, id string"), index.facets_of(c)))
    return filters.intersect(sets, spark.createDataFrame([(1, 3)], "query_id long, n_sets long")).select("item_id")


@query("set_difference", "select p_partkey as item_id from part where p_type = 'SMALL' and p_brand <> 'Brand#10'")
def set_difference(spark, sf_dir):
    f = index.facets_of(catalogs.parts(spark, sf_dir))
    return f.where("facet = 'category' and id = 'SMALL'").select("item_id").join(f.where("facet = 'brand' and id = 'Brand#10'"), "item_id", "left_anti")


# ---- matching


@query("exact_match", f"with {O.PARTS}, {TERMS} select query_id, pos, item_id, field from terms join postings on text = token")
def exact_match(spark, sf_dir):
    _, _, postings = part_fields(spark, sf_dir)
    hits = match.exact_hits(asked_terms(spark), postings.select("token").distinct())
    return hits.join(postings, "token").select("query_id", "pos", "item_id", "field")


@query("prefix_match", f"with {O.PARTS}, {TERMS}, {O.HITS} select query_id, pos, token, round(sim, 6) as sim from begun")
def prefix_match(spark, sf_dir):
    return match.prefix_hits(asked_terms(spark), part_vocabulary(spark, sf_dir)).select("query_id", "pos", "token", F.round("sim", 6).alias("sim"))


# Grams and distances are of bytes: each byte of a token as a character of its own.
_BYTES = "array_to_string(list_transform(range(strlen(token)), lambda i: chr(('0x' || substr(hex(encode(token)), (2 * i + 1)::int, 2))::int)), '')"
_DOC_WORDS = f"""named as (select distinct token from (select unnest(string_split({O.normalize('text')}, ' ')) as token from documents) where token <> ''),
vocabulary as (select token, {_BYTES} as b from named),
words as (select token, b, gram, count(*) as times from (select token, b, unnest({O.grams('b')}) as gram from vocabulary) group by all)"""
_MISSPELT = ["thatt", "tehre", "ofthe", "thign", "documnet", "schlich", "nicth", "porque"]


def _doc_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(T.normalize(F.col("text"))))).alias("token")).distinct()
    terms = spark.createDataFrame([(1, i + 1, w) for i, w in enumerate(_MISSPELT)], "query_id long, pos int, text string")
    return terms, index.trigrams_of(d, "token")


_DOC_TERMS = "terms(query_id, pos, text) as (values " + ", ".join(f"(1::bigint, {i + 1}, '{w}')" for i, w in enumerate(_MISSPELT)) + ")"
_DOC_NEAR = f"""shared as (
  select query_id, pos, text, d, token, b, sum(times) as shared from (select *, unnest({O.grams('text')}) as gram from (select *, {O.max_distance('length(text)')} as d from terms)) join words using (gram)
  where abs(length(b) - length(text)) <= d group by query_id, pos, text, d, token, b having sum(times) >= greatest(1, length(text) - 3 * d)
  qualify row_number() over (partition by query_id, pos order by sum(times) desc, token) <= 200)"""


@query("top_candidates", f"with {_DOC_WORDS}, {_DOC_TERMS}, {_DOC_NEAR} select pos, token as word, shared::bigint as shared from shared")
def top_candidates(spark, sf_dir):
    terms, grams = _doc_terms(spark, sf_dir)
    return match.gram_candidates(terms.withColumn("d", T.max_distance(F.length("text"))), grams).select("pos", "word", "shared")


@query("fuzzy_match", f"with {_DOC_WORDS}, {_DOC_TERMS}, {_DOC_NEAR}, near as (select *, {O.osa('text', 'b')} as dist from shared) select pos, token, dist::int as dist, round(1 - dist / greatest(length(text), length(b)), 6) as sim from near where dist <= d")
def fuzzy_match(spark, sf_dir):
    return match.fuzzy_hits(*_doc_terms(spark, sf_dir)).select("pos", "token", "dist", F.round("sim", 6).alias("sim"))


@query("osa_pairs", f"with {O.PARTS} select x.token as a, y.token as b, ({O.osa('x.token', 'y.token')})::int as dist from vocabulary x join vocabulary y on x.token[1] = y.token[1] or length(x.token) = length(y.token)")
def osa_pairs(spark, sf_dir):
    v = part_vocabulary(spark, sf_dir)
    x, y = v.select(F.col("token").alias("a")), v.select(F.col("token").alias("b"))
    # Two equi-joins, not one join with an alternative.
    first = x.join(y, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    size = x.join(y, (F.length("a") == F.length("b")) & (F.substring("a", 1, 1) != F.substring("b", 1, 1)))
    return first.unionByName(size).select("a", "b", T.osa("a", "b").alias("dist"))


@query("best_field_hit", f"with {O.PARTS}, {TERMS}, {O.HITS} select query_id, pos, item_id, round(value, 6) as value, field, kind, token from best")
def best_field_hit(spark, sf_dir):
    items, _, postings = part_fields(spark, sf_dir)
    v = kept(index.vocabulary_of(postings, items.count()), "vocabulary")
    best = match.best_fields(match.token_hits(asked_terms(spark), v, index.trigrams_of(v, "token")), postings)
    return best.select("query_id", "pos", "item_id", F.round("value", 6).alias("value"), "field", "kind", "token")


def _score_parts(spark, sf_dir):
    items, _, postings = part_fields(spark, sf_dir)
    items = index.named(items)
    v = kept(index.vocabulary_of(postings, items.count()), "vocabulary")
    terms = asked_terms(spark)
    best = match.best_fields(match.token_hits(terms, v, index.trigrams_of(v, "token")), postings).withColumn("far", F.lit(False))
    weighed = terms.join(v.select(F.col("token").alias("text"), "idf"), "text", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    return items, score.score_parts(best, weighed)


def _scored(spark, sf_dir):
    items, parts = _score_parts(spark, sf_dir)
    return items, parts.select("query_id", "item_id", score.score_of().alias("score"), "coverage")


@query("term_score", f"with {O.PARTS}, {TERMS}, {O.HITS}, {O.RANKED} select query_id, item_id, round(score, 6) as score, round(coverage, 6) as coverage from scored")
def term_score(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select("query_id", "item_id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def _ranked(spark, sf_dir):
    items, scored = _scored(spark, sf_dir)
    scored = scored.withColumn("score", F.round("score", 9))
    return score.rank(scored, items.select("item_id", "key", "name_norm"))


_RANK = f"with {O.PARTS}, {TERMS}, {O.HITS}, {O.RANKED}, candidates as (select query_id, item_id, round(score, 9) as score, coverage from scored), {O.CUT}"


@query("rank_cut", f"{_RANK} select query_id, rank::int as rank, key, round(score, 6) as score from ranked where rank <= 300")
def rank_cut(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "rank", "key", F.round("score", 6).alias("score"))


@query("target_resolution", f"{_RANK} select query_id, item_id from (select *, lead(score) over (partition by query_id order by rank) as second from ranked) where rank = 1 and score >= 0.6 and (second is null or score - second >= 0.1)")
def target_resolution(spark, sf_dir):
    return score.resolve_targets(_ranked(spark, sf_dir))


@query("ranking_quality", f"{_RANK}, relevant as (select query_id, item_id from (select distinct query_id from terms), items where name = 'blue anvil' or category = 'ECONOMY'), sized as (select query_id, least(5, count(*)) as k from relevant group by query_id), judged as (select query_id, count(*) filter (rel and rank <= k) as found, min(case when rel then rank end) as first from (select r.*, x.item_id is not null as rel from (select * from ranked where rank <= 300) r left join relevant x using (query_id, item_id)) join sized using (query_id) group by query_id) select query_id, round(coalesce(found, 0) / k, 6) as precision, round(coalesce(1 / first, 0), 6) as reciprocal_rank, found is null as empty from sized left join judged using (query_id)")
def ranking_quality(spark, sf_dir):
    good = catalogs.parts(spark, sf_dir).where("name = 'blue anvil' or category = 'ECONOMY'").select("item_id")
    relevant = asked_terms(spark).select("query_id").distinct().crossJoin(good)  # a stated set of judgements: each query with the relevant items
    out = diagnostics.ranking_quality(_ranked(spark, sf_dir), relevant)
    return out.select("query_id", F.round("precision", 6).alias("precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "empty")


_GRID = ", ".join(f"('{n}', {w.short}::double, {w.floor}::double, {w.relative}::double)" for n, w in {calibrate.IN_USE: score.Weights(), **calibrate.CANDIDATES}.items())


@query("weight_grid", f"""with {O.PARTS}, {TERMS}, {O.HITS}, weights as (select * from (values {_GRID}) w(candidate, short, floor, relative)
), weighed as (select t.*, coalesce(idf, 1.0) as idf from terms t left join vocabulary v on t.text = v.token
), totals as (select query_id, sum(idf) as most, count(*) as n from weighed group by query_id
), made as (
  select query_id, item_id, sum(value * idf) as raw, any_value(most) as most, count(*) / any_value(n) as coverage, sum(case when kind = 'prefix' and length(text) <= 3 then 1 else 0 end) as n_short
  from best join weighed using (query_id, pos) join totals using (query_id) group by query_id, item_id
), scored as (
  select candidate, relative, query_id, item_id, coverage, round(least(1.0, greatest(0.0, raw / most * (floor + (1 - floor) * coverage) - n_short * short)), 9) as score from made, weights
), ranked as (
  select candidate, query_id, item_id, row_number() over (partition by candidate, query_id order by score desc, coverage desc, norm, key, item_id) as rank
  from (select *, max(score) over (partition by candidate, query_id) as top from scored) join items using (item_id) join (select item_id, norm from fields where field = 'name') using (item_id)
  where score >= greatest(0.15, relative * top)
), relevant as (select query_id, item_id from (select distinct query_id from terms), items where name = 'blue anvil' or category = 'ECONOMY'
), sized as (select candidate, query_id, least(5, count(*)) as k from relevant, weights group by all
), judged as (
  select candidate, query_id, count(*) filter (rel and rank <= k) as found, min(case when rel then rank end) as first
  from (select r.*, x.item_id is not null as rel from (select * from ranked where rank <= 300) r left join relevant x using (query_id, item_id)) join sized using (candidate, query_id) group by all
), found as (
  select candidate, round(avg(coalesce(found, 0) / k), 9) as precision, round(avg(coalesce(1 / first, 0)), 9) as reciprocal_rank, count(*) filter (first = 1) as passed
  from sized left join judged using (candidate, query_id) group by candidate
), fit as (select * from found where passed >= (select passed from found where candidate = '{calibrate.IN_USE}'))
select candidate, round(precision, 6) as precision, round(reciprocal_rank, 6) as reciprocal_rank, passed,
  candidate = (select candidate from fit order by fit.reciprocal_rank desc, fit.precision desc, candidate = '{calibrate.IN_USE}' desc, candidate limit 1) as chosen from found""")
def weight_grid(spark, sf_dir):
    items, parts = _score_parts(spark, sf_dir)
    good = catalogs.parts(spark, sf_dir).where("name = 'blue anvil' or category = 'ECONOMY'").select("item_id")
    relevant = asked_terms(spark).select("query_id").distinct().crossJoin(good)  # as in ranking_quality
    out = calibrate.weight_grid(parts, items.select("item_id", "key", "name_norm"), relevant)
    return out.select("candidate", F.round("precision", 6).alias("precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "passed", "chosen")


@query("multi_query_search", f"with {O.PARTS}, {TERMS}, {ENDS}, {O.HITS}, {O.RANKED}, allowed as (select query_id, item_id from ends join items on (low is null or power >= low) and (high is null or power <= high)), candidates as (select query_id, item_id, score, coverage from scored s where query_id not in (select query_id from ends) or exists (select 1 from allowed a where a.query_id = s.query_id and a.item_id = s.item_id) union all select query_id, item_id, 1.0, 1.0 from allowed where query_id not in (select query_id from terms)), {O.CUT} select query_id, rank::int as rank, key, round(score, 6) as score, round(coverage, 6) as coverage from ranked where rank <= 300")
def multi_query_search(spark, sf_dir):
    built = index.build_index(catalogs.parts(spark, sf_dir)).write(new_folder(spark, "index"))
    return search_many(built, asked(spark)).select("query_id", "rank", "key", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query("parse_queries", "select i::bigint as query_id, t as terms, low, high from (values " + ", ".join(f"({i}, {terms or '[]::varchar[]'}, {'null' if a is None else a}::double, {'null' if b is None else b}::double)" for i, _, terms, a, b in ASKED) + ") x(i, t, low, high)")
def parsed(spark, sf_dir):
    p = parse_queries(asked(spark))
    return p.select("query_id", F.transform("terms", lambda t: t["text"]).alias("terms"), F.get("constraints", F.lit(0))["low"].alias("low"), F.get("constraints", F.lit(0))["high"].alias("high"))


@query("parse_conversations")
def parse_conversations(spark, sf_dir):
    """Every turn of the conversations as a query, in four locales' vocabularies."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("query_id"), "text")
    p = parse_queries(c, ("pt", "en", "de", "fr"))
    return p.select("query_id", F.size("terms").alias("n_terms"), F.size("concepts").alias("n_concepts"), F.size("constraints").alias("n_constraints"), "context")


@query("stopword_removal", f"select token, count(*) as n from (select unnest(string_split({O.normalize('text')}, ' ')) as token from conversations) where token <> '' and token not in ({', '.join(map(repr, sorted(set(STOPWORDS['en'].split()))))}) group by token")
def stopword_removal(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in sorted(set(STOPWORDS["en"].split()))], "token string")
    c = table(spark, sf_dir, "conversations").select(F.explode(T.tokens(T.normalize(F.col("text")))).alias("token"))
    return c.join(F.broadcast(stop), "token", "left_anti").groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # a constant table


@query("first_wins", "select p_type as word, p_brand as meaning, prio::int as prio from (select *, p_size % 3 as prio from part) qualify row_number() over (partition by p_type order by prio, p_partkey) = 1")
def first_wins(spark, sf_dir):
    """Types as words and brands as their meanings, sizes as locales."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("word"), (F.col("p_size") % 3).cast("int").alias("prio"), F.col("p_partkey").alias("n"), F.col("p_brand").alias("meaning"))
    return lexicons.first_wins(p, "word").select("word", "meaning", "prio")


_SPELT = [(1, 1, "blu"), (1, 2, "anvill"), (2, 1, "larg"), (2, 2, "bolt"), (2, 3, "xyz"), (3, 1, "blue"), (4, 1, "blu"), (4, 2, "anvil"), (4, 3, "bran"), (4, 4, "10"), (5, 1, "blue"), (5, 2, "anvil"), (6, 1, "gren"), (6, 2, "gizmo"), (6, 3, "redd"), (6, 4, "widgte")]
_PHRASES = f"""spelt(query_id, pos, text) as (values {', '.join(f"({q}::bigint, {p}, '{t}')" for q, p, t in _SPELT)}),
numbered as (select *, row_number() over (partition by query_id order by pos) as seq, count(*) over (partition by query_id) as n_terms, text in (select token from vocabulary) as known from spelt),
stretches as (
  select query_id, seq as first, w as width, case w when 2 then text || ' ' || t1 else text || ' ' || t1 || ' ' || t2 end as text
  from (select *, lead(text) over o as t1, lead(text, 2) over o as t2 from numbered where n_terms >= 2 window o as (partition by query_id order by pos)), (values (2), (3)) v(w)
), windows as (select *, {O.max_distance("length(replace(text, ' ', ''))")} as d from stretches where text is not null),
phrase_words as (select norm, gram, count(*) as times from (select norm, unnest({O.grams("norm")}) as gram from (select distinct norm from fields)) group by all),
alike as (
  select query_id, first, width, text, d, norm, sum(times) as shared from (select *, unnest({O.grams("text")}) as gram from windows where d > 0) join phrase_words using (gram)
  where abs(length(norm) - length(text)) <= d group by all having sum(times) >= greatest(1, length(text) - 3 * d)
), close as (
  select *, {O.osa("text", "norm")} as dist from (select * from alike qualify row_number() over (partition by query_id, first, width order by shared desc, norm) <= 200)
), chosen as (select * from close where dist <= d qualify row_number() over (partition by query_id, first, width order by dist, shared desc, norm) = 1
), widest as (select * from chosen qualify row_number() over (partition by query_id, first order by width desc) = 1
), helping as (
  select *, row_number() over (partition by query_id order by first) as n from widest w
  where exists (select 1 from numbered x where x.query_id = w.query_id and not x.known and x.seq >= w.first and x.seq < w.first + w.width)
), taken(query_id, n, ok, free) as (
  select query_id, n, true, first + width from helping where n = 1
  union all select h.query_id, h.n, h.first >= t.free, case when h.first >= t.free then h.first + h.width else t.free end from taken t join helping h on h.query_id = t.query_id and h.n = t.n + 1
)"""


@query("phrase_fuzzy", f"with recursive {O.PARTS}, {_PHRASES} select query_id, first::int as first, width::int as width, norm as matched, dist::int as dist, round(1 - dist / greatest(length(text), length(norm)), 6) as sim from helping join taken using (query_id, n) where ok")
def phrase_fuzzy(spark, sf_dir):
    """Stretches of two or three words near indexed phrases."""
    _, fields, postings = part_fields(spark, sf_dir)
    terms = spark.createDataFrame(_SPELT, "query_id long, pos int, text string")
    known = postings.select(F.col("token").alias("text"), F.lit(True).alias("known")).distinct()
    terms = terms.join(known, "text", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return match.phrase_hits(terms, index.trigrams_of(fields.select("norm").distinct(), "norm")).select("query_id", "first", "width", "matched", "dist", F.round("sim", 6).alias("sim"))


# ---- compatibility: customers as vehicles, suppliers as implements


_PAIRS = """bought as (select distinct o_custkey as v, l_suppkey as i from orders join lineitem on o_orderkey = l_orderkey),
pairs as (
  select v, i, max(l) as l, string_agg(distinct e, '; ' order by e) as e from (
    select v, i, 2 as l, 'combination' as e from bought where v in (select c_custkey from customer) and i in (select s_suppkey from supplier)
    union all select c_custkey, s_suppkey, 1, 'n' || c_nationkey from customer join supplier on c_nationkey = s_nationkey) group by v, i
), judged as (
  select 'c' || v as vehicle, 's' || i as implement, case when l = 2 then 'declared' else 'joint' end as level, e as evidence, c_acctbal >= s_acctbal as power_ok,
    case when l = 2 then 1.0::double else 0.7::double end - case when not (c_acctbal >= s_acctbal) then 0.3::double else 0.0::double end as score
  from pairs join customer on v = c_custkey join supplier on i = s_suppkey
)"""


def _sides(spark, sf_dir):
    c, s, o, li = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    bought = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("i")).distinct()
    bought = bought.groupBy("k").agg(F.collect_list("i").alias("combinations"))
    joint = lambda n: F.array(F.concat(F.lit("n"), F.col(n).cast("string")))
    none = F.array().cast("array<string>")
    v = c.join(bought, F.col("c_custkey") == F.col("k"), "left").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").alias("power"), joint("c_nationkey").alias("joints"), F.coalesce("combinations", none).alias("combinations"))
    i = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_acctbal").alias("needed"), joint("s_nationkey").alias("joints"), none.alias("combinations"))
    return v, i


@query("compat_pairs", f"with {_PAIRS} select vehicle, implement, level, evidence, power_ok, round(score, 6) as score from judged")
def compat_pairs(spark, sf_dir):
    return compat.compatible(*_sides(spark, sf_dir)).select("vehicle", "implement", "level", "evidence", "power_ok", F.round("score", 6).alias("score"))


@query("compat_rank", f"with {_PAIRS} select query_id, rank::int as rank, item, level, round(score, 6) as score from (select query_id, item, level, score, row_number() over (partition by query_id order by score desc, item) as rank from (select 1::bigint as query_id, implement as item, level, score from judged where vehicle = 'c1' union all select 2, vehicle, level, score from judged where implement = 's1')) where rank <= 300")
def compat_rank(spark, sf_dir):
    targets = spark.createDataFrame([(1, "c1"), (2, "s1")], "query_id long, target string")
    rows = compat.for_targets(targets, *_sides(spark, sf_dir)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")))
    return rows.where("rank <= 300").select("query_id", "rank", "item", "level", F.round("score", 6).alias("score"))


# ---- diagnostics


@query("latency_percentile", "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def latency_percentile(spark, sf_dir):
    return diagnostics.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("latency_ring", "select event_id, count(value) over w as n_ring, round(avg(value) over w, 9) as mean_ring, max(value) over w as max_ring from events window w as (partition by event_type order by ts, event_id rows between 99 preceding and current row)")
def latency_ring(spark, sf_dir):
    out = diagnostics.ring(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_id", "n_ring", F.round("mean_ring", 9).alias("mean_ring"), "max_ring")


@query("failure_degrade", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'error') where n = 3")
def failure_degrade(spark, sf_dir):
    return diagnostics.degraded(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("log_rate_limit", "with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events), f(user_id, n, event_id, last, held, let, gone) as (select user_id, n, event_id, ts, 0::bigint, true, 0::bigint from e where n = 1 union all select e.user_id, e.n, e.event_id, case when e.ts - f.last >= interval 6 hours then e.ts else f.last end, case when e.ts - f.last >= interval 6 hours then 0 else f.held + 1 end, e.ts - f.last >= interval 6 hours, f.held from f join e on e.user_id = f.user_id and e.n = f.n + 1) select user_id, event_id, gone as suppressed from f where let")
def log_rate_limit(spark, sf_dir):
    return diagnostics.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600).select("user_id", "event_id", "suppressed")


_TO = "case event_type when 'signup' then 'indexing' when 'purchase' then 'ready' when 'error' then 'degraded' else 'idle' end"


@query("state_machine", f"with recursive e as (select user_id, {_TO} as t, row_number() over (partition by user_id order by ts, event_id) as n from events), f(user_id, n, state, taken) as (select distinct user_id, 0::bigint, 'uninitialized', 0 from e union all select e.user_id, e.n, case when ok then e0.t else e0.state end, e0.taken + ok::int from (select f.*, e.n as m, e.t, (f.state || '>' || e.t) in ('uninitialized>indexing', 'indexing>ready', 'ready>indexing', 'uninitialized>degraded', 'indexing>degraded', 'ready>degraded') as ok from f join e on e.user_id = f.user_id and e.n = f.n + 1) e0 join e on e.user_id = e0.user_id and e.n = e0.m) select user_id, state, taken::int as taken from f qualify row_number() over (partition by user_id order by n desc) = 1")
def state_machine(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("to", F.expr(_TO))
    return diagnostics.final_states(e, "user_id", ["ts", "event_id"], "to")


@query("failure_sessions", "select user_id, count(*) as sessions from (select user_id, ts - lag(ts) over (partition by user_id order by ts) as gap from events) where gap is null or gap > interval 12 hours group by user_id")
def failure_sessions(spark, sf_dir):
    """An extension on event time: sessions that end after twelve quiet hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


_NUM = "case when abs({0}) >= 100 or {0} = floor({0}) then printf('%.0f', round_even({0}, 0)) else printf('%.1f', round_even({0}, 1)) end"


@query("constraint_text", f"select p_partkey, {_NUM.format('v')} || ' kW (' || {_NUM.format('(v / 0.7355)')} || ' cv) ∈ [' || printf('%.1f', round_even(v - 1, 1)) || ', ' || case when p_size > 25 then '+inf' else printf('%.1f', round_even(v + 1, 1)) end || ']' as power, {_NUM.format('p_retailprice')} || ' ∈ [-inf, 1000.0]' as price from (select *, p_size * 0.7355::double as v from part)")
def constraint_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("v", F.col("p_size") * F.lit(0.7355))
    none = F.lit(None).cast("double")
    power = reasons.range_text(F.col("v"), F.lit("power"), F.lit("cv"), F.lit(0.7355), F.col("v") - 1, F.when(F.col("p_size") <= 25, F.col("v") + 1))
    price = reasons.range_text(F.col("p_retailprice"), F.lit("money"), F.lit(None).cast("string"), none, none, F.lit(1000.0))
    return p.select("p_partkey", power.alias("power"), price.alias("price"))


@query("reason_lines", f"with {O.PARTS}, {TERMS}, {ENDS}, {O.HITS}, worded as (select query_id, item_id, pos, '✓ ' || case when kind in ('exact', 'prefix') then 'Exact match' else 'Approximate match' end || ' (' || field || ')' || case kind when 'fuzzy1' then ': distância 1' when 'fuzzy2' then ': distância 2+' else '' end as line from best where query_id in (1, 2, 3, 5, 10, 12)), {O.RANKED}, candidates as (select * from scored where query_id in (1, 2, 3, 5, 10, 12)), {O.CUT} select query_id, key, string_agg(line, chr(10) order by pos) as lines from ranked join worded using (query_id, item_id) where rank <= 300 group by query_id, key, rank")
def reason_lines(spark, sf_dir):
    """Lines of the results of queries of words (no phrase nor constraint)."""
    built = index.build_index(catalogs.parts(spark, sf_dir)).write(new_folder(spark, "index"))
    words = kept(parse_queries(asked(spark).where(F.col("query_id").isin(1, 2, 3, 5, 10, 12)), ()))
    return explain(built, words).select("query_id", "key", F.array_join("lines", "\n").alias("lines"))


@query("compat_search", f"with {_PAIRS} select 1::bigint as query_id, row_number() over (order by score desc, implement)::int as rank, implement as key, round(score, 6) as score from judged where vehicle = 'c7' qualify rank <= 300")
def compat_search(spark, sf_dir):
    """A query about an item by its name, and one about the selected item: partners of the one that its words name."""
    v, i = _sides(spark, sf_dir)
    none = F.lit(None).cast("string")
    of = lambda df, name: df.select(F.xxhash64("key").alias("item_id"), "key", name.alias("name"), *[none.alias(c) for c in ("brand", "category", "mod", "author", "dlc")], F.lit("vehicle").alias("species"), F.lit("base").alias("origin"), F.lit(None).cast("double").alias("price"), F.expr("cast(map() as map<string,double>)").alias("specs"))
    catalog = of(v, F.when(F.col("key") == "c7", "Tractor Seven").otherwise("Unit")).unionByName(of(i, F.lit("Implement")))
    built = index.build_index(catalog).write(new_folder(spark, "index"))
    asked_ = spark.createDataFrame([(1, "compatible with tractor seven"), (2, "compatible with tractr seven zzz"), (3, "compatible with unit")], "query_id long, text string")
    return search_compatible(built, kept(parse_queries(asked_)), v, i).select("query_id", "rank", "key", F.round("score", 6).alias("score"))


@query("generated_catalog")
def generated_catalog(spark, sf_dir):
    return catalogs.generated(spark, 3000).select("item_id", "key", "name", "brand", "category", "origin", "price")


@query("resumed_build", f"with {O.PARTS} select token, df, round(idf, 6) as idf from vocabulary")
def resumed_build(spark, sf_dir):
    """The part catalog's index, built in four slices by engines that each stop after one."""
    from wayfind.plans.engine import Engine

    folder, parts = new_folder(spark, "engine"), lambda: catalogs.parts(spark, sf_dir)
    size = max(1, -(-parts().count() // 4))
    while (engine := Engine(spark, folder, parts, slice_items=size)).step(0.0):
        pass
    return engine.index.vocabulary.select("token", "df", F.round("idf", 6).alias("idf"))


_RING = "row_number() over (partition by event_type order by ts desc, event_id desc) <= 100"


@query("stream_latency_ring", f"select event_type, count(*)::int as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from (select * from events qualify {_RING}) group by event_type")
def stream_latency_ring(spark, sf_dir):
    """Percentiles of the last 100 values of each event type, as a stream over the events leaves them."""
    from wayfind.streaming.incremental import latency_rings, newest

    root, schema = new_folder(spark, "stream"), table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "value")
    latency_rings(events, f"{root}/rings", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return newest(spark, f"{root}/rings").select(F.col("key").alias("event_type"), "n", "p50", "p95")


@query("stream_incremental_index", f"with {O.PARTS} select token, df, round(idf, 6) as idf from vocabulary")
def stream_incremental_index(spark, sf_dir):
    """The part catalog read as a stream, indexed by micro-batches, as it stands when all is read."""
    from wayfind.streaming.incremental import stream_parts

    return stream_parts(spark, sf_dir).select("token", "df", F.round("idf", 6).alias("idf"))
