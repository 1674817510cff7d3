"""Mixing sources to target weights by fixed-length blocks.

Every source's words form one stream (documents in a pseudorandom order), packed into blocks of ``block`` words. A source with target t gets
each of its blocks as often as its whole stream fits into t, and for the rest as many more as hold so many words on average.

*Draw.* Each of a source's slots falls into an output shard at random; counted by shard, this is a multinomial draw of the
shards' source counts, conditioned on the sources' totals, so targets are met whatever the draw. *Slots.* Each shard gets as many consecutive slots of a
source as it has drawn. Slot j takes block P(j mod n): P is a swap-or-not permutation of the n block indexes, so no block is drawn more
than ``most`` times and no index table is kept. *Blocks* are joined by index.

Cases: a null text has size 0 and takes nothing; null sources are one source, last in order; equal rows are documents of their
own; sources without words have target 0; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Tables, documents, row_key

PRIME = 2147483647
#: Documents of a bucket, on average; buckets order a source's stream. The least number of buckets.
BUCKET_DOCS, BUCKETS = 10_000, 1024
ROUNDS = 8


def mix(x: Column, salt: int) -> Column:
    """A pseudorandom number below PRIME, by integer arithmetic that any SQL engine repeats."""
    for r in range(2):
        x = (x % PRIME + (salt * 7919 + r * 104729 + 12345)) % PRIME
        x = x * (x + 48271) % PRIME
    return x


def mix_sql(x: str, salt: int) -> str:
    for r in range(2):
        x = f"((({x}) % {PRIME} + {salt * 7919 + r * 104729 + 12345}) % {PRIME})"
        x = f"({x} * ({x} + 48271) % {PRIME})"
    return x


def size_of(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with rank and target: weights repeat in code-point order; targets over ``most`` times
    the size stop there and the rest is shared again. One row a source, so the windows are small."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights)).cast("int") + 1)
    out = sources.withColumns({"rank": n.cast("long"), "weight": w}).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # By cap per weight: the k first sources stop at their caps, the others share by weight.
    by_cap = W.orderBy((F.col("cap") / F.col("weight")), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(all_rows) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("c"), "rank", "level"))).over(all_rows)
    shared = F.coalesce(level["level"] * F.col("weight"), F.col("cap"))
    return out.withColumn("target", F.least("cap", shared)).select("source", "rank", "source_size", "target")


def permuted(slots: DataFrame) -> DataFrame:
    """slots (rank, slot, blocks, salt) with ``block``: slot mod blocks, permuted by swap-or-not. In each round an index changes
    places with its mirror, or not, as a pseudorandom bit of the pair says. A column for each step, as every one is used twice."""
    slots = slots.withColumn("block", F.col("slot") % F.col("blocks"))
    for r in range(ROUNDS):
        key = F.col("salt") * (r * 7 + 3) % PRIME * PRIME + (F.col("salt") * (r * 11 + 5) + 97) % PRIME  # below 2^62, so mirrors reach all blocks
        slots = slots.withColumn("mirror", F.pmod(key % F.col("blocks") - F.col("block"), "blocks"))
        slots = slots.withColumn("pair", (F.greatest("block", "mirror") + F.col("salt") + r * 15485863) % PRIME)
        slots = slots.withColumn("bit", F.shiftright(F.col("pair") * F.col("pair") % PRIME, 11) % 2)
        slots = slots.withColumn("block", F.when(F.col("bit") == 1, F.col("mirror")).otherwise(F.col("block")))
    return slots.drop("mirror", "pair", "bit")


class Mix:
    """The plan of a mix: ``docs`` (offsets in streams), ``slots`` (which block fills which output slot)."""

    def __init__(self, table: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], share: float, most: int, block: int, shard_words: int, seed: int = 7):
        spark: SparkSession = table.sparkSession
        self.table, self.block, self.key, self.text, self.source = table, block, key, text, source
        self.tables = Tables(spark, "mix")
        k, t = row_key(table, key, text)
        sized = table.select(table[key].alias("doc_id"), table[source].alias("source"), size_of(table[text]).alias("size"), k, t)
        n_buckets = max(BUCKETS, -(-table.count() // BUCKET_DOCS))
        sized = sized.withColumn("bucket", mix(F.pmod("_k", F.lit(PRIME)), seed) % n_buckets)
        sized = self.tables.write(sized, "sized")
        buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        self.targets = self.tables.write(targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
        # A position in its source's stream: words of earlier buckets, then of earlier documents of the bucket.
        base = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words")
        buckets = buckets.withColumn("base", base).drop("words")
        order = W.partitionBy("source", "bucket").orderBy("_k", "_t")
        docs = sized.withColumn("inner", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        docs = docs.withColumn("copy", F.row_number().over(order))
        buckets = buckets.withColumnsRenamed({"source": "_s", "bucket": "_b"})
        docs = docs.join(buckets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
        ranks = self.targets.select(F.col("source").alias("_s"), "rank", "source_size", "target")
        docs = docs.join(ranks, F.col("source").eqNullSafe(F.col("_s")))
        self.docs = self.tables.write(docs.select("doc_id", "_k", "_t", "copy", "size", "rank", "source_size", "target", (F.col("base") + F.col("inner")).alias("start")), "offsets")
        n = F.ceil(F.col("source_size") / block)
        whole = F.floor(F.col("target") / F.col("source_size"))
        more = F.floor((F.col("target") - whole * F.col("source_size")) * n / F.col("source_size") + 0.5)
        slots = self.targets.where("source_size > 0").select("rank", n.alias("blocks"), F.least(n * most, whole * n + more).cast("long").alias("n_slots"))
        slots = self.tables.write(slots.where("n_slots > 0").withColumn("salt", mix(F.col("rank"), seed)), "sources")
        total = slots.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
        self.tasks = max(1, -(-total // 500_000))
        self.counts = self.tables.write(self.draw(slots, max(1, -(-total * block // shard_words)), seed), "draw")
        before = F.sum("blocks_drawn").over(W.partitionBy("rank").orderBy("shard")) - F.col("blocks_drawn")
        slots = self.counts.withColumn("first", before).repartition(self.tasks, "rank", "shard")
        slots = slots.select("rank", "shard", "blocks", "salt", F.explode(F.sequence("first", F.col("first") + F.col("blocks_drawn") - 1)).alias("slot"))
        self.slots = self.tables.write(permuted(slots).select("rank", "slot", "block", "shard"), "slots")  # written: filters pushed through the rounds would repeat them

    def draw(self, slots: DataFrame, shards: int, seed: int, step: int = 4096) -> DataFrame:
        """(rank, shard, blocks, salt, blocks_drawn): the draw of each source's blocks by output shard. Ranges of slots are dealt out, and counted where they are made."""
        slots = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(step).cast("long"))).alias("first")).repartition(self.tasks, "rank", "first")
        slots = slots.select("rank", "blocks", "salt", F.explode(F.sequence("first", F.least(F.col("first") + step, "n_slots") - 1)).alias("draw"))
        slots = slots.select("rank", "blocks", "salt", (mix(F.col("draw") + F.col("salt"), seed + 2) % shards).alias("shard"))
        return slots.groupBy("rank", "shard", "blocks", "salt").agg(F.count(F.lit(1)).alias("blocks_drawn"))

    def pieces(self) -> DataFrame:
        """Documents cut at block borders: (doc, rank, block, from, n), from in words of the document."""
        b = self.block
        docs = self.docs.where("size > 0")
        docs = docs.select("*", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
        first = F.greatest(F.col("block") * b, "start")
        n = F.least((F.col("block") + 1) * b, F.col("start") + F.col("size")) - first
        return docs.select("doc_id", "_k", "_t", "copy", "rank", "block", first.alias("at"), (first - F.col("start")).alias("from"), n.alias("n"))

    def taken(self) -> DataFrame:
        """For each document, how many of its words the mix takes."""
        drawn = self.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
        got = self.pieces().join(drawn, ["rank", "block"]).groupBy("_k", "_t", "copy").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
        out = self.docs.join(got, ["_k", "_t", "copy"], "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def render(self) -> DataFrame:
        """The mixed corpus: (shard, rank, slot, block, text), a row for each output slot."""
        k, t = row_key(self.table, self.key, self.text)
        texts = self.table.select(k, t, F.array_remove(F.split(F.coalesce(self.table[self.text], F.lit("")), SPACE), "").alias("w")).dropDuplicates(["_k", "_t"])
        pieces = self.pieces().join(texts, ["_k", "_t"])
        piece = F.array_join(F.slice("w", (F.col("from") + 1).cast("int"), F.col("n").cast("int")), " ")
        blocks = pieces.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("words")))).alias("parts"))
        blocks = blocks.select("rank", "block", F.array_join(F.col("parts.words"), " ").alias("text"))
        return self.slots.join(blocks, ["rank", "block"]).select("shard", "rank", "slot", "block", "text")


def mix_sources(
    table: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, shard_words: int = 1_000_000
) -> Mix:
    return Mix(table, key, text, source, weights, share, most, block, shard_words)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).taken()


def _sql() -> str:
    steps = [f"s0 as (select *, slot % blocks as i0, {mix_sql('rank', 7)} as salt from slots)"]
    for r in range(ROUNDS):
        key = f"((salt * {r * 7 + 3} % {PRIME}) * {PRIME} + (salt * {r * 11 + 5} + 97) % {PRIME})"
        mirror = f"(({key} % blocks - i{r}) % blocks + blocks) % blocks"
        steps.append(f"m{r} as (select *, {mirror} as mirror from s{r})")
        pair = f"((greatest(i{r}, mirror) + salt + {r * 15485863}) % {PRIME})"
        steps.append(f"s{r + 1} as (select rank, slot, blocks, salt, case when (({pair} * {pair} % {PRIME}) >> 11) % 2 = 1 then mirror else i{r} end as i{r + 1} from m{r})")
    bucket = f"{mix_sql(f'(doc_id % {PRIME} + {PRIME}) % {PRIME}', 7)} % (select greatest({BUCKETS}, ceil(count(*) / {BUCKET_DOCS}.0))::bigint from documents)"
    return f"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), placed as (
  select *, sum(size) over (partition by source order by bucket, doc_id) - size as start
  from (select *, {bucket} as bucket from sized)
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from sized group by source
), weighted as (
  select *, [5.0::double, 2.0, 1.0][(rank % 3 + 1)::int] as weight, source_size * 2.0::double as cap from sources
), filled as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from weighted
), free as (
  select level from filled where level * weight <= cap order by cap / weight, rank limit 1
), targeted as (
  select source, rank, source_size, least(cap, coalesce((select level from free) * weight, cap)) as target,
         ceil(source_size / 64.0)::bigint as blocks from filled
), slots as (
  select rank, blocks, unnest(range(least(blocks * 2, (floor(target / source_size) * blocks
    + floor((target - floor(target / source_size) * source_size) * blocks / source_size + 0.5))::bigint))) as slot from targeted where source_size > 0
), {", ".join(steps)}, drawn as (
  select rank, i{ROUNDS} as block, count(*) as times from s{ROUNDS} group by all
), joined as (
  select p.*, t.rank, t.source_size, t.target from placed p join targeted t on p.source is not distinct from t.source
), pieces as (
  select doc_id, size, start, rank, unnest(range((start // 64)::bigint, ((start + size - 1) // 64)::bigint + 1)) as block from joined where size > 0
), got as (
  select doc_id, sum((least((block + 1) * 64, start + size) - greatest(block * 64, start)) * times)::bigint as taken
  from pieces join drawn using (rank, block) group by doc_id
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from joined left join got using (doc_id)
"""


SQL = _sql()
