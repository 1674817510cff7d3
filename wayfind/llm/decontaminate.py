"""Benchmark decontamination by SimHash of item-sized windows.

Items and documents are split into words (lower case, letters and digits only). Documents' positions whose word shingle occurs in an
item are kept; a window is any item-sized stretch (cut at the document's ends) that holds enough such positions for the asked similarity to be
possible, in documents that hold enough of the item's shingles. Every window and item gets a 64-bit SimHash of its shingles, each of weight 1.

*No window is lost before the fingerprints.* A window with a multiset Jaccard of ``least`` with an item of m shingles has at least least * m positions whose
shingle is the item's, so it is among the windows looked at, which are those with so many known positions (of any item), in documents that
hold all but (1 - least) * m of the item's distinct shingles. Sliding a window over all other places could only add windows that share too little.

*None is lost by the fingerprints.* Such a window has no more shingles than its item, so the two multisets differ by at most 2 m (1 - least) / (1 + least)
of the item's m shingles, and no bit's sum of votes can change by more. Bits of an item whose sum is further from 0 are *certain*: every similar
window has them, and the other bits bound the Hamming distance. An item is indexed under all values of its most certain 8-bit block, at most 256, that keep the
certain bits; windows are looked up by each of their blocks and must then have all certain bits. So the fingerprints leave out windows, but none that is
similar enough. Candidates are verified exactly: multiset Jaccard of their shingles (weights are multiplicities) of at least ``least``.

Cases: null or empty texts and items without words match nothing; an item of fewer than five words is one shingle of its whole sequence;
equal rows give equal results; null ids are kept; empty tables give an empty result; only ids and texts of the inputs are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small, documents, let, row_key

SHINGLE, LEAST, BLOCKS, BITS = 5, 0.8, 8, 8


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles of w, in order; empty with fewer words."""
    of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, of(w)).otherwise(F.array().cast("array<bigint>"))


def _packed(bits: Column) -> Column:
    """64 booleans as a number, the first one on top."""
    return F.aggregate(bits, F.expr("0L"), lambda acc, bit: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.when(bit, F.expr("1L")).otherwise(F.expr("0L"))))


def votes(g: Column) -> Column:
    """For each of 64 bits, how many more hashes have it than not."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(g, F.lit(0), lambda acc, x: acc + 2 * F.getbit(x, b).cast("int") - 1))


def fingerprint(g: Column) -> Column:
    """64-bit SimHash of shingle hashes."""
    return _packed(F.transform(votes(g), lambda v: v > 0))


def certain_bits(g: Column, change: Column) -> Column:
    """Bits that stay as they are if no sum of votes changes by more than ``change``."""
    return _packed(F.transform(votes(g), lambda v: (v > change) | (v <= -change)))


def block_of(fp: Column, j: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, F.lit(BITS * j)).bitwiseAND((1 << BITS) - 1).cast("int")


def block_values(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("block"), block_of(fp, j).alias("value")) for j in range(BLOCKS)])


def most_certain_block(fp: Column, sure: Column) -> Column:
    """The block with the most certain bits: its number, value and certain bits."""
    of = lambda j: F.struct(F.bit_count(block_of(sure, j)).alias("n"), F.lit(j).alias("block"), block_of(fp, j).alias("value"), block_of(sure, j).alias("sure"))
    return F.array_max(F.array(*[of(j) for j in range(BLOCKS)]))


def with_free_bits(value: Column, sure: Column) -> Column:
    """All values of a block that have the certain bits of ``value``."""
    free = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(sure, b) == 0)
    return F.aggregate(free, F.array(value.bitwiseAND(sure)), lambda acc, b: F.concat(acc, F.transform(acc, lambda v: v.bitwiseOR(F.call_function("shiftleft", F.lit(1), b)))))


def window_starts(at: Column, total: Column, n: Column, k: Column, n_words: Column, least: float) -> Column:
    """Starts of all windows of n words with enough of the positions ``at`` (ascending) to be similar enough to an item of ``total`` shingles.

    Two multisets of a and b elements need (a + b) least / (1 + least) common ones, so the item's size alone asks for least * total.
    """
    some = F.ceil(least * total - 1e-9).cast("int")
    size = lambda s: F.least(n_words, s + n) - F.greatest(s, F.lit(0)) - k + 1
    need = lambda s: F.greatest(F.ceil((total + size(s)) * (least / (1 + least)) - 1e-9).cast("int"), F.lit(1))

    def first_is(p: Column, i: Column) -> Column:
        """Starts of windows whose first position is p, the i-th."""
        low = F.greatest(F.coalesce(F.get(at, i - 1) + 1, p - total + 1), p - total + 1, F.get(at, i + some - 1) - total + 1)
        starts = F.when(low <= p, F.sequence(low, p)).otherwise(F.array().cast("array<int>"))
        return F.filter(starts, lambda s: F.coalesce(F.get(at, i + need(s) - 1) <= s + total - 1, F.lit(False)))

    # greatest() passes over nulls: without that many positions there is no window.
    return F.flatten(F.transform(at, lambda p, i: F.when(i + some <= F.size(at), first_is(p, i)).otherwise(F.array().cast("array<int>"))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays."""
    times = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    each = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, g: acc + F.least(times(a, g), times(b, g)))
    # Where one of the two has no repeats, each common shingle counts once.
    common = F.when((F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b)), F.size(F.array_intersect(a, b))).otherwise(each)
    return let(common, lambda c: c / (F.size(a) + F.size(b) - c))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): for each document and item with a window similar enough, the best window."""
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "leaks")
    items = items.select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    items = items.withColumn("g", _by_size(F.col("w"), F.col("k")))
    change = F.floor(F.size("g") * (2 * (1 - least) / (1 + least)) + 1e-9).cast("int")
    items = tables.write(items.withColumns({"fp": fingerprint(F.col("g")), "sure": certain_bits(F.col("g"), change), "distinct": F.size(F.array_distinct("g"))}), "items")
    found = items.select("item_id", "n", "k", "distinct", F.size("g").alias("total"), F.explode("g").alias("g"))
    postings = tables.write(found.select("g", "k", "item_id", "n", "distinct", "total").distinct(), "postings")
    known = tables.write(postings.select("g", "k").distinct(), "known")
    sizes = [r["k"] for r in known.select("k").distinct().collect()]  # five values at most
    k_t = row_key(docs, key, text)
    split = docs.select(docs[key].alias("doc_id"), *k_t, plain_words(docs[text]).alias("w"))
    hashes = F.array(*[F.struct(F.lit(n).alias("k"), shingle_hashes(F.col("w"), n).alias("gs")) for n in sizes or [SHINGLE]])
    hits = split.select("_k", "_t", "doc_id", F.size("w").alias("n_words"), F.explode(hashes).alias("x"))
    hits = hits.select("_k", "_t", "doc_id", "n_words", "x.k", F.posexplode("x.gs").alias("pos", "g"))
    hits = tables.write(hits.join(known, ["g", "k"], "left_semi"), "hits")
    # A window can only be similar enough if its document holds all but a few of the item's distinct shingles.
    anchors = hits.join(postings, ["g", "k"])
    held = anchors.groupBy("_k", "_t", "item_id", "distinct", "total").agg(F.count_distinct("g").alias("held"))
    held = held.where(F.col("held") >= F.greatest(F.lit(1.0), F.col("distinct") - F.lit(1 - least) * F.col("total") - 1e-9))
    windows = anchors.join(held.select("_k", "_t", "item_id"), ["_k", "_t", "item_id"], "left_semi")
    windows = windows.groupBy("_k", "_t", "item_id", "n", "k", "total").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("pos")).alias("at"))
    starts = window_starts(*[F.col(c) for c in ("at", "total", "n", "k", "n_words")], least)
    windows = tables.write(windows.select("_k", "_t", "doc_id", "n", "k", F.explode(starts).alias("start")).distinct(), "windows")
    stretch = F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n") + F.least(F.col("start"), F.lit(0)))
    # First the few documents with windows, so that the join with their windows does not shuffle the texts of all.
    texts = docs.select(*k_t, docs[text].alias("text")).join(broadcast_if_small(windows.select("_k", "_t").distinct()), ["_k", "_t"], "left_semi")
    windows = windows.join(texts.select("_k", "_t", plain_words(F.col("text")).alias("w")), ["_k", "_t"]).select("_k", "_t", "doc_id", "n", "start", _by_size(stretch, F.col("k")).alias("wg")).distinct()
    windows = tables.write(windows.withColumn("wfp", fingerprint(F.col("wg"))), "fingerprints")
    # An item stands under each value of its most certain block that has the certain bits.
    best = items.select("item_id", "n", "fp", "sure", most_certain_block(F.col("fp"), F.col("sure")).alias("b"))
    values = with_free_bits(F.col("b.value"), F.col("b.sure"))
    index = best.select("item_id", "n", "fp", "sure", "b.block", F.explode(values).alias("value"))
    probes = windows.select("_k", "_t", "doc_id", "n", "start", "wfp", F.explode(block_values(F.col("wfp"))).alias("x")).select("*", "x.block", "x.value").drop("x")
    near = probes.join(index, ["n", "block", "value"]).where(F.col("wfp").bitwiseXOR(F.col("fp")).bitwiseAND(F.col("sure")) == 0)
    near = near.select("_k", "_t", "doc_id", "n", "start", "item_id").distinct()
    pairs = near.join(windows.select("_k", "_t", "n", "start", "wg"), ["_k", "_t", "n", "start"]).join(items.select("item_id", "g"), "item_id")
    pairs = pairs.withColumn("similarity", weighted_similarity(F.col("wg"), F.col("g"))).where(F.col("similarity") >= least - 1e-12)
    best = pairs.groupBy("_k", "_t", "doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start", F.col("n").alias("n_words")), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), F.greatest(F.col("best.start"), F.lit(0)).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"))


def _by_size(w: Column, k: Column) -> Column:
    out = F.when(k == SHINGLE, shingle_hashes(w, SHINGLE))
    for n in range(1, SHINGLE):
        out = out.when(k == n, shingle_hashes(w, n))
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
