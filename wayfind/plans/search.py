"""The search of many queries at once: parse, match, filter, score and rank, in one plan over the index tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.operators import compat, filters, match, reasons, score
from wayfind.operators.index import Index, named
from wayfind.plans.lexicon import Lexicon
from wayfind.plans.query_parser import Parser
from wayfind.sources.workspace import kept

PARSED = (
    "query_id string, terms array<struct<pos int, text string>>, concepts array<struct<c int, kind string, value string, confidence double, words int, text string>>, "
    "constraints array<struct<n int, quantity string, op string, low double, high double, unit string, factor double>>, context string, target array<string>, warnings array<string>"
)


def _parse(batches: Iterator[pd.DataFrame], locales: tuple[str, ...], lexicon: Lexicon | None = None) -> Iterator[pd.DataFrame]:
    parser = Parser(locales, lexicon)
    for pdf in batches:
        yield pd.DataFrame([(i, *parser.parse_normal(norm).as_row()) for i, norm in zip(pdf["id"], pdf["norm"], strict=True)], columns=["query_id", "terms", "concepts", "constraints", "context", "target", "warnings"])


def parse_queries(queries: DataFrame, locales: tuple[str, ...] = ("en",), lexicon: Lexicon | None = None) -> DataFrame:
    """queries (query_id, text) as their terms, concepts and constraints. Normalising is native; the scan of a short text is Python. lexicon: in place of
    the built-in vocabulary of the locales, as sources.lexicons.load_lexicon() reads it."""
    # Ids go through pandas as texts: a column of numbers with a null in it would become one of floats.
    rows = queries.select(F.col("query_id").cast("long").cast("string").alias("id"), T.normalize(F.col("text")).alias("norm"))
    out = rows.mapInPandas(functools.partial(_parse, locales=locales, lexicon=lexicon), PARSED)
    return out.withColumn("query_id", F.col("query_id").cast("long"))


@dataclass
class Matched:
    """What the parts of queries match: best hits of terms, items of concepts, and scores before ranking."""

    best: DataFrame
    facet_items: DataFrame
    concepts: DataFrame
    constraints: DataFrame
    scored: DataFrame


def matched(index: Index, parsed: DataFrame, chosen: DataFrame | None = None, ranges: DataFrame | None = None) -> Matched:
    """chosen: facets that a user picked, (query_id, facet, id); ranges: specs that a user limited, (query_id, spec_id, low, high)."""
    asking = parsed.where("context is null and size(terms) + size(concepts) + size(constraints) > 0")
    part = lambda name: asking.select("query_id", F.explode(name).alias("x")).select("query_id", "x.*")
    concepts, constraints = part("concepts"), part("constraints")
    known = index.vocabulary.select(F.col("token").alias("text"), "idf", F.lit(True).alias("known"))
    terms = part("terms").join(known, "text", "left").select("query_id", "pos", "text", F.coalesce("idf", F.lit(1.0)).alias("idf"), F.coalesce("known", F.lit(False)).alias("known"))
    terms = kept(terms)
    # Parts that no query of the batch has are known to be empty, so Catalyst leaves their joins out of the plan.
    n_unknown = terms.where("not known").count()
    n = asking.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("concepts", "constraints")]).first()
    concepts, constraints = (df if n[c] else df.where("false") for c, df in (("concepts", concepts), ("constraints", constraints)))
    # What kept() has written is of known size: Spark broadcasts a batch's queries, terms and hits if they are small enough, rather than shuffle the index.
    # What is allowed, for queries that restrict anything.
    sets = filters.constraint_hits(constraints, index.firsts, index.cuts).select("query_id", F.concat(F.lit("c:"), F.col("n").cast("string")).alias("n"), "item_id")
    asked = constraints.select("query_id", F.concat(F.lit("c:"), F.col("n").cast("string")).alias("n"))
    if chosen is not None:
        sets = sets.unionByName(filters.facet_hits(chosen, index.facets))
        asked = asked.unionByName(chosen.join(asking.select("query_id"), "query_id", "left_semi").select("query_id", F.concat(F.lit("facet:"), "facet").alias("n")).distinct())
    if ranges is not None:
        ranges = ranges.join(asking.select("query_id"), "query_id", "left_semi").withColumn("n", F.concat(F.lit("range:"), "spec_id"))
        ranges = kept(ranges)
        sets = sets.unionByName(ranges.join(filters.spanned(index.numeric, ranges).select("spec_id", "value", "item_id"), "spec_id").where(filters.within(F.col("value"), F.col("low"), F.col("high"))).select("query_id", "n", "item_id"))  # one row for each field of a form
        asked = asked.unionByName(ranges.select("query_id", "n").distinct())
    asked = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sets"))
    allowed = filters.intersect(sets, asked)
    # Terms.
    asked_words = terms.select("query_id", "pos", "text")
    hits = kept(match.token_hits(asked_words, index.vocabulary, index.trigrams, kept) if n_unknown else match.exact_hits(asked_words, index.vocabulary).unionByName(match.prefix_hits(asked_words, index.vocabulary)))
    best = match.best_fields(match.spread(hits, index.wide), index.postings)
    if n_unknown:  # a phrase must help an unknown term
        phrases = kept(match.phrase_hits(terms, index.phrase_trigrams))
        weigh = match.choose("field", match.FIELD_WEIGHT) * match.choose("kind", match.KIND_WEIGHT) * F.col("sim")
        numbered = terms.withColumn("seq", F.row_number().over(W.partitionBy("query_id").orderBy("pos")))
        best = score.merge_phrases(best, phrases, numbered, index.fields, weigh)
    else:
        best = best.withColumns({"far": F.lit(False), "dist": F.lit(0), "phrase": F.lit(False)})
    # Concepts: items of the facet; for one-word certain ones also items whose text resembles the word.
    facet_items = filters.matching_facets(concepts.select("query_id", "c", "kind", "value"), index.facets)
    if n["concepts"]:
        facet_items = kept(facet_items)
        of = facet_items.join(concepts.select("query_id", "c", "confidence"), ["query_id", "c"]).select("query_id", "c", "item_id", (F.col("confidence") * score.CONCEPT).alias("value"))
        plain = concepts.where("words = 1 and confidence >= 1 and kind in ('brand', 'category')").select("query_id", F.col("c").alias("pos"), "text")
        alike = match.best_fields(match.spread(kept(match.fuzzy_hits(plain, index.trigrams)), index.wide), index.postings).select("query_id", F.col("pos").alias("c"), "item_id", "value")
        concept_hits = of.unionByName(alike.join(facet_items, ["query_id", "c", "item_id"], "left_anti"))
        scored = score.score_items(best, terms, concept_hits, concepts).drop("raw")
    else:
        scored = score.score_items(best, terms).drop("raw")
    if n["constraints"]:  # constraints alone: all that pass, with score 1
        bare = asking.where("size(terms) + size(concepts) = 0").select("query_id")
        scored = scored.unionByName(allowed.join(bare, "query_id", "left_semi").select("query_id", "item_id", F.lit(1.0).alias("score"), F.lit(1.0).alias("coverage")))
    if n["constraints"] or chosen is not None or ranges is not None:
        restricted = scored.join(asked.select("query_id", F.lit(True).alias("restricted")), "query_id", "left").join(allowed.withColumn("ok", F.lit(True)), ["query_id", "item_id"], "left")
        scored = restricted.where("restricted is null or ok").drop("restricted", "ok")
    return Matched(best, facet_items, concepts, constraints, scored)


def names_of(index: Index) -> DataFrame:
    return named(index.items).select("item_id", "key", "name_norm")


def _shuffled(names: DataFrame) -> DataFrame:
    """names, never broadcast: a few columns of a compressed catalog look small to Spark, and all its items would go through the driver."""
    return names.hint("merge")


def search(index: Index, parsed: DataFrame, chosen: DataFrame | None = None, most: int = score.MOST, ranges: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, item_id, key, score, coverage)."""
    return score.rank(matched(index, parsed, chosen, ranges).scored, names_of(index), most)


def explain(index: Index, parsed: DataFrame, chosen: DataFrame | None = None, most: int = score.MOST) -> DataFrame:
    """The results of search() with their reasons, and at most four of them as lines of text."""
    m = matched(index, parsed, chosen)
    ranked = score.rank(m.scored, names_of(index), most)
    rows = reasons.term_reasons(m.best).unionByName(reasons.concept_reasons(m.facet_items, m.concepts))
    rows = rows.join(ranked.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi").unionByName(reasons.constraint_reasons(ranked, m.constraints, index.firsts))
    return ranked.join(reasons.gathered(rows), ["query_id", "item_id"], "left")


def target_of(index: Index, parsed: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(query_id, target): the item that a compatibility query is about: the selected one, (query_id, key), or the one that its words name
    exactly or begin, where that is clear. Misspelt words name none."""
    asked = parsed.where("context is not null")
    clear = kept(score.resolve_targets(_target_ranks(index, parsed)))  # at most one for each query, and known to be few
    found = clear.join(index.items.select("item_id", F.col("key").alias("target")), "item_id").select("query_id", "target")
    if selected is not None:
        found = found.unionByName(asked.where("context = 'selected'").select("query_id").join(selected.select("query_id", F.col("key").alias("target")), "query_id"))
    return found


def _target_ranks(index: Index, parsed: DataFrame) -> DataFrame:
    """The items that the words of each compatibility query name, ranked without a cut."""
    words = parsed.where("context = 'query'").select("query_id", F.posexplode("target").alias("pos", "text"))
    idf = index.vocabulary.select(F.col("token").alias("text"), "idf")
    words = words.join(idf, "text", "left").select("query_id", "pos", "text", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    hits = match.exact_hits(words, index.vocabulary).unionByName(match.prefix_hits(words, index.vocabulary))
    best = match.best_fields(kept(match.spread(hits, index.wide)), index.postings).withColumn("far", F.lit(False))
    return score.rank(score.score_items(best, words), _shuffled(names_of(index)), relative=0.0, least=0.0)


def warnings_of(index: Index, parsed: DataFrame) -> DataFrame:
    """(query_id, warning): what the parser passed over, and why a compatibility query has no target."""
    said = parsed.select("query_id", F.explode("warnings").alias("warning"))
    judged = score.judge_targets(_target_ranks(index, parsed)).select("query_id", "warning", F.lit(True).alias("seen"))
    asked = parsed.where("context = 'query'").select("query_id").join(judged, "query_id", "left")
    return said.unionByName(asked.select("query_id", F.when(F.col("seen").isNull(), score.NOT_FOUND).otherwise(F.col("warning")).alias("warning")).where("warning is not null"))


def search_compatible(index: Index, parsed: DataFrame, vehicles: DataFrame, implements: DataFrame, selected: DataFrame | None = None, most: int = score.MOST) -> DataFrame:
    """(query_id, rank, item_id, key, score, coverage, detail): partners of each compatibility query's target, by declared evidence only. vehicles and
    implements: as for compat.compatible."""
    found = compat.for_targets(target_of(index, parsed, selected), vehicles, implements).withColumnRenamed("item", "key")
    names = _shuffled(names_of(index))
    found = found.join(names.select("item_id", "key"), "key")
    found = found.withColumn("detail", F.concat("evidence", F.when(F.coalesce(~F.col("power_ok"), F.lit(False)), F.lit(reasons.TOO_WEAK)).otherwise(F.lit(""))))
    found = kept(found)  # read twice
    ranked = score.rank(found.select("query_id", "item_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"), F.lit(1.0).alias("coverage")), names, most)
    return ranked.join(found.select("query_id", "item_id", "detail"), ["query_id", "item_id"])


def search_many(index: Index, queries: DataFrame, locales: tuple[str, ...] = ("en",), chosen: DataFrame | None = None, ranges: DataFrame | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    return search(index, kept(parse_queries(queries, locales, lexicon)), chosen, ranges=ranges)
