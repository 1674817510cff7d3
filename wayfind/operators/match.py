"""Matching of query terms with the index: joins on tokens, prefixes and trigrams.

terms: (query_id, pos, text, ...). Hits: (query_id, pos, token, kind, sim, dist).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfind.functions import text as T

#: What a hit is worth by the field and by how it matched. Fixed values.
FIELD_WEIGHT = {"name": 1.0, "category": 0.9, "brand": 0.9, "spec": 0.8, "mod": 0.6, "dlc": 0.5, "author": 0.4}
KIND_WEIGHT = {"exact": 1.0, "alias": 0.9, "prefix": 0.85, "fuzzy1": 0.7, "fuzzy2": 0.45}
PREFIX_CAP, CANDIDATE_CAP = 50, 200


def choose(of: str, values: dict[str, float]):
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(F.col(of) == k, F.lit(v)).otherwise(out)
    return out


def choose_text(of, values: dict[str, str]):
    """The value for a key; null for others."""
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out


def exact_hits(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    out = terms.join(vocabulary.select("token"), F.col("text") == F.col("token"))
    return out.select("query_id", "pos", "token", F.lit("exact").alias("kind"), F.lit(1.0).alias("sim"), F.lit(0).alias("dist"))


def prefix_hits(terms: DataFrame, vocabulary: DataFrame, cap: int = PREFIX_CAP) -> DataFrame:
    """Longer tokens that begin with the term, among the first ``cap`` tokens of the term's bucket (its first six bytes), in token order."""
    bucket = F.substring("text", 1, T.PREFIX_MAX)
    asked = terms.where(F.length("text") >= T.PREFIX_MIN).select("query_id", "pos", "text", bucket.alias("prefix"))
    asked_buckets = asked.select("prefix").distinct()
    tokens = vocabulary.select("token", F.explode(T.prefixes(F.col("token"))).alias("prefix")).join(asked_buckets, "prefix", "left_semi")
    order = F.row_number().over(W.partitionBy("prefix").orderBy("token"))
    tokens = tokens.withColumn("n", order).where(F.col("n") <= cap)
    out = asked.join(tokens, "prefix").where(F.col("token").startswith(F.col("text")) & (F.col("token") != F.col("text")))
    sim = F.greatest(F.lit(0.5), F.octet_length("text") / F.octet_length("token"))
    return out.select("query_id", "pos", "token", F.lit("prefix").alias("kind"), sim.alias("sim"), F.lit(0).alias("dist"))


def gram_candidates(terms: DataFrame, trigrams: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """(query_id, pos, text, d, word, shared): words that share enough trigrams with a term to be within d edits; the ``cap`` best of a term.
    terms: (query_id, pos, text, d) with d > 0."""
    asked = terms.where("d > 0").withColumn("b", T.as_bytes(F.col("text")))
    asked = asked.select("query_id", "pos", "text", "d", F.length("b").alias("n"), T.grams(F.col("b")).alias("grams"))
    asked = asked.select("query_id", "pos", "text", "d", "n", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    # By gram and size, as the index keeps them, so a gram that most words have is dealt over their sizes.
    asked = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("d")), F.col("n") + F.col("d"))))
    pairs = asked.join(trigrams, ["gram", "size"])
    pairs = pairs.groupBy("query_id", "pos", "text", "d", "n_grams", "word").agg(F.sum("times").alias("shared"))
    pairs = pairs.where(F.col("shared") >= F.greatest(F.lit(1), F.col("n_grams") - 3 * F.col("d")))
    best = F.row_number().over(W.partitionBy("query_id", "pos").orderBy(F.desc("shared"), "word"))
    return pairs.withColumn("n", best).where(F.col("n") <= cap).drop("n", "n_grams")


def fuzzy_hits(terms: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Words within the edits that a term's length allows."""
    terms = terms.select("query_id", "pos", "text", T.max_distance(F.length("text")).alias("d"))
    found = gram_candidates(terms, trigrams).withColumns({"a": T.as_bytes(F.col("text")), "b": T.as_bytes(F.col("word"))})
    found = found.withColumn("dist", T.osa("a", "b")).where("dist <= d")
    sim = 1 - F.col("dist") / F.greatest(F.length("a"), F.length("b"))
    kind = F.when(F.col("dist") <= 1, "fuzzy1").otherwise("fuzzy2")
    return found.select("query_id", "pos", F.col("word").alias("token"), kind.alias("kind"), sim.alias("sim"), "dist")


def token_hits(terms: DataFrame, vocabulary: DataFrame, trigrams: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Exact and prefix hits; fuzzy ones only for terms that have neither, whatever the filters. keep: may write the former, which are read twice."""
    direct = keep(exact_hits(terms, vocabulary).unionByName(prefix_hits(terms, vocabulary)))
    unknown = terms.join(direct.select("query_id", "pos").distinct(), ["query_id", "pos"], "left_anti")
    return direct.unionByName(fuzzy_hits(unknown, trigrams))


def spread(hits: DataFrame, wide: DataFrame) -> DataFrame:
    """hits with ``shard``: a row for each shard that the token's postings are in."""
    shards = F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)
    return hits.join(wide, "token", "left").select(*hits.columns, F.explode(shards).alias("shard"))


def best_fields(hits: DataFrame, postings: DataFrame, field_weight: dict[str, float] = FIELD_WEIGHT, kind_weight: dict[str, float] = KIND_WEIGHT) -> DataFrame:
    """hits of an index's postings are those of spread(). (query_id, pos, item_id, value, field, kind, token, sim): a term's best hit in each item. Equal values: the field that comes first, then the token."""
    rows = hits.join(postings, [c for c in ("token", "shard") if c in hits.columns]).withColumn("value", choose("field", field_weight) * choose("kind", kind_weight) * F.col("sim"))
    best = F.min_by(F.struct("value", "field", "kind", "token", "sim"), F.struct(-F.col("value"), "prio", "token"))
    return rows.groupBy("query_id", "pos", "item_id").agg(best.alias("b")).select("query_id", "pos", "item_id", "b.*")


def phrase_windows(terms: DataFrame, widths: tuple[int, ...] = (3, 2)) -> DataFrame:
    """(query_id, pos, width, text, d): stretches of terms, with the edits that their letters allow."""
    order = W.partitionBy("query_id").orderBy("pos")
    seq = F.row_number().over(order).alias("seq")
    out = None
    rows = terms.select("query_id", "pos", seq, "text", *[F.lead("text", i).over(order).alias(f"t{i}") for i in range(1, max(widths))])
    for w in widths:
        parts = ["text", *[f"t{i}" for i in range(1, w)]]
        one = rows.where(F.col(parts[-1]).isNotNull()).select("query_id", F.col("seq").alias("pos"), F.lit(w).alias("width"), F.concat_ws(" ", *parts).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("d", T.max_distance(F.length(F.replace("text", F.lit(" "), F.lit("")))))


def phrase_hits(terms: DataFrame, phrase_grams: DataFrame) -> DataFrame:
    """(query_id, first, width, matched, dist, sim, d): indexed phrases near stretches of a query's terms.

    terms: (query_id, pos, text, known). At a position the wider stretch that matches counts; a match takes its terms, from left to right, and
    must help a term that the vocabulary does not know.
    """
    order = W.partitionBy("query_id").orderBy("pos")
    numbered = terms.withColumn("seq", F.row_number().over(order)).withColumn("n_terms", F.count(F.lit(1)).over(W.partitionBy("query_id")))
    asked = numbered.where("n_terms >= 2")
    windows = phrase_windows(asked.select("query_id", "pos", "text")).withColumn("at", F.col("pos") * 10 + F.col("width")).drop("pos")
    found = gram_candidates(windows.withColumnRenamed("at", "pos").select("query_id", "pos", "text", "d"), phrase_grams)
    found = found.withColumns({"a": T.as_bytes(F.col("text")), "b": T.as_bytes(F.col("word"))}).withColumn("dist", T.osa("a", "b")).where("dist <= d")
    found = found.withColumn("sim", 1 - F.col("dist") / F.greatest(F.length("a"), F.length("b")))
    pick = F.min_by(F.struct(F.col("word").alias("matched"), "dist", "sim", "d"), F.struct("dist", -F.col("shared"), "word"))
    best = found.groupBy("query_id", "pos").agg(pick.alias("m"))
    best = best.select("query_id", F.floor(F.col("pos") / 10).cast("int").alias("first"), (F.col("pos") % 10).cast("int").alias("width"), "m.*")
    widest = F.row_number().over(W.partitionBy("query_id", "first").orderBy(F.desc("width")))
    best = best.withColumn("n", widest).where("n = 1").drop("n")
    helped = best.join(numbered.where("not known").select("query_id", "seq"), "query_id").where("seq >= first and seq < first + width")
    best = best.join(helped.select("query_id", "first").distinct(), ["query_id", "first"], "left_semi")
    # Left to right: a match counts if it begins after the last one that counted ended. A query has few terms.
    rows = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "width", "matched", "dist", "sim", "d"))).alias("all"))
    taken = F.expr(
        "aggregate(all, named_struct('free', 0, 'got', filter(all, x -> false)), (s, x) -> if(x.first >= s.free, named_struct('free', x.first + x.width, 'got', concat(s.got, array(x))), s), s -> s.got)"
    )
    return rows.select("query_id", F.explode(taken).alias("x")).select("query_id", "x.*")
