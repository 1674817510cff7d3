"""Near-duplicate documents by an LSH forest of MinHash signatures.

Copies of one shingle set are first collapsed to a representative. The forest has ``TREES`` sorted orders of the representatives: tree t sorts
them by their signatures, read from hash 4 t on. Documents with a common prefix of ``DEPTH`` values form a *region* of a tree; it holds all
that may be similar enough (two documents at the limit share no region of any tree once in 10^5 to 10^6 cases). Depth adapts to the region:

* In a region of at most ``LEAF`` documents all have the least common prefix that counts, so all are each other's candidates.
* In a larger one, a document's candidates are its neighbours in the sorted order: nobody else has a longer common prefix with it, however
  deep that is. (A region of more than ``RUN`` documents is dealt into sorted runs.)

Candidates whose sizes and signatures allow the asked similarity are confirmed on full shingle sets, best partners first, then those that still
lie between different components. Components come from contraction (``graph.py``), which goes on from those found before.

What neighbours leave open in *crowds* (the documents of large regions with a common centre) is settled exactly, without listing pairs. Every
member's Jaccard distance to the centre is computed on full sets. Distances obey the triangle inequality, so members outside the crowd's main
component visit only blocks of members whose distance to the centre differs by no more than the asked similarity allows. A block holds a bounded
number of members; a visit compares sizes and signatures, confirms on full sets, and stops at one link between two components, so
a task returns fewer links than it has members and visitors.

Cases: without words or text a document has an empty set, is linked with nothing and its own component; rows with one id are one document, linked
by any of its texts; null ids are kept, unlinked (component null, kept true); an empty table gives an empty result; other columns are kept, but
for ``n_shingles``, ``component_id`` and ``kept``, which are replaced.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small, documents, fresh, row_key
from .graph import smallest_reachable
from .shingles import alike, shingle_set

HASHES, TREES, DEPTH, LEAF, RUN = 64, 16, 3, 12, 4096
#: Bounds of one task's share in confirming: documents and shingles of a home or block (held in memory), and how many visit it.
HOME, HOME_SHINGLES, VISITS = 256, 500_000, 50_000
BLOCK, BLOCK_SHINGLES, GUESTS, BINS = 1024, 1_000_000, 8192, 20
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values by multiply-xor hashing of the shingles' upper and lower halves; chunks bound the memory of long texts."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = ((shingles >> np.uint64(32)) ^ (shingles & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    for at in range(0, len(x), 1024):
        y = (x[at : at + 1024, None] ^ _XOR) * _ODD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, y.min(axis=0))
    return low


def _describe(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, key, text in zip(pdf["doc_id"], pdf["t"], pdf["text"], strict=True):
            s = shingle_set(text, k)
            if len(s):
                with np.errstate(over="ignore"):
                    total, twisted = int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(17))))
                rows.append((doc, key, len(s), total - 2**63, twisted - 2**63, signature(s).tobytes()))
            else:
                rows.append((doc, key, 0, 0, 0, None))
        yield pd.DataFrame(rows, columns=["doc_id", "t", "n_shingles", "f1", "f2", "sig"])


class Likely:
    """Whether two sets may be as similar as asked, by their sizes and signatures."""

    def __init__(self, percent: int):
        self.percent, p = percent, percent / 100
        #: Signatures that agree less cannot belong to sets as similar as asked, but for one in 30,000 just at the limit.
        self.floor = p - 4 * (p * (1 - p) / HASHES) ** 0.5

    def __call__(self, n: np.ndarray, sig: np.ndarray, m: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, whether it and the sizes suffice)"""
        est = (sig == other).mean(axis=-1)
        return est, (est >= self.floor) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))


class Forest:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        spark: SparkSession = docs.sparkSession
        self.k, self.percent, self.tables = k, percent, Tables(spark, "forest")
        self.likely = Likely(percent)
        self.docs = docs.select("doc_id", "text")
        # Ids go through pandas as texts: a column of numbers with a null in it would become one of floats.
        sets = self.docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInPandas(functools.partial(_describe, k=k), "doc_id string, t long, n_shingles long, f1 long, f2 long, sig binary")
        self.sets = self.tables.write(sets.withColumn("doc_id", F.col("doc_id").cast("long")), "sets")
        real = self.sets.where("n_shingles > 0 and doc_id is not null")
        self.reps = self.tables.write(real.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")

    # ---- candidates

    def candidates(self) -> DataFrame:
        """(u, v, est) of neighbours in the sorted orders; u < v. Sets ``crowds``: (crowd, rep) of large regions, by their centres."""
        step = HASHES // TREES
        value = lambda t, j: F.substring("sig", 4 * ((t * step + j) % HASHES) + 1, 4)
        prefix = F.array(*[F.xxhash64(F.lit(t), *[value(t, j) for j in range(DEPTH)]) for t in range(TREES)])
        rows = self.reps.select("rep", F.posexplode(prefix).alias("tree", "region"))
        shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        regions = self.tables.write(rows.join(shared, "region"), "regions")
        run = F.when(F.col("size") > LEAF, F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / RUN))).otherwise(0).cast("int").alias("run")
        order = F.expr(f"substring(concat(sig, sig), {4 * step} * tree + 1, {4 * HASHES})").alias("order")
        rows = regions.join(self.reps.select("rep", "n_shingles", "sig"), "rep").select("region", run, order, "rep", "size", "n_shingles")
        rows = rows.repartition("region", "run").sortWithinPartitions("region", "run", "order", "rep")
        found = rows.mapInPandas(functools.partial(_neighbours, likely=self.likely), "u long, v long, est float")
        found = self.tables.write(found.distinct(), "candidates")
        wide = regions.where(F.col("size") > LEAF)
        crowding = wide.groupBy("rep").agg(F.sum("size").alias("weight"))
        centre = wide.join(crowding, "rep").groupBy("region").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("crowd"))
        centre = broadcast_if_small(self.tables.write(centre, "centres"))
        centred = wide.join(centre, "region").groupBy("crowd", "rep").agg(F.max("size").alias("size"))
        self.crowds = self.tables.write(centred, "crowds")
        self.home_of = broadcast_if_small(self.tables.write(self.crowds.groupBy("rep").agg(F.max_by("crowd", F.struct("size", "crowd")).alias("crowd")), "home-of"))
        return found

    # ---- crowds

    def crowd_links(self, labels: DataFrame) -> DataFrame | None:
        """(u, v) confirmed links that join the components of each crowd as far as its members are similar enough; None if nothing is open."""
        members = self.crowds.select("crowd", "rep").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        open_ = members.groupBy("crowd").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
        open_ = broadcast_if_small(self.tables.write(open_.select("crowd", F.ceil(F.col("n") / BLOCK).alias("parts")), "open-crowds"))
        members = self.tables.write(members.join(open_, "crowd"), "open-members")
        if members.isEmpty():
            return None
        wanted = broadcast_if_small(self.tables.write(members.select(F.col("rep").alias("doc_id")).distinct(), "open-reps"))
        sets = self.docs.join(wanted, "doc_id", "left_semi").mapInPandas(functools.partial(_whole_sets, k=self.k), "rep long, n long, whole binary")
        sets = self.tables.write(sets.where("n > 0"), "crowd-sets")
        # Distances to the centre. Its set is sent to each part of its crowd.
        guests = members.select("crowd", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(1).alias("kind"), "rep", "label")
        hosts = members.where("crowd = rep").select("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "rep", "label")
        rows = hosts.unionByName(guests).join(sets, "rep").repartition("crowd", "part").sortWithinPartitions("crowd", "part", "kind", "rep")
        star = rows.mapInPandas(functools.partial(_from_centre, percent=self.percent), "crowd long, rep long, label long, n long, distance double, linked boolean")
        star = self.tables.write(star, "star")
        near = star.where("linked").select("crowd", "label").distinct().withColumn("joined", F.lit(True))
        star = star.join(near, ["crowd", "label"], "left").withColumn("label", F.when(F.col("joined"), F.col("crowd")).otherwise(F.col("label"))).drop("joined")
        counts = star.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("c"))
        main = counts.groupBy("crowd").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("crowd", "main")
        main = broadcast_if_small(self.tables.write(main, "main-components"))
        bin_of = lambda d: F.floor(F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)) * BINS)
        rest = self.tables.write(star.join(main, "crowd").withColumn("bin", bin_of(F.col("distance"))), "ringed")
        links = star.where("linked and rep <> crowd").select(F.least("rep", "crowd").alias("u"), F.greatest("rep", "crowd").alias("v")).distinct()
        # Visits: only rings of the centre that are near enough, each cut into blocks.
        far = 1 - self.percent / 100 + 1e-9
        visits = rest.where("label <> main").select("crowd", "rep", "label", F.explode(F.sequence(bin_of(F.col("distance") - far), bin_of(F.col("distance") + far))).alias("bin"))
        rings = rest.groupBy("crowd", "bin").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("chunks"))
        rings = rings.join(visits.groupBy("crowd", "bin").agg(F.ceil(F.count(F.lit(1)) / GUESTS).alias("parts")), ["crowd", "bin"])
        rings = broadcast_if_small(self.tables.write(rings, "rings"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        block = F.xxhash64("crowd", "bin", "chunk", "part").alias("block")
        hosts = rest.join(rings, ["crowd", "bin"]).select("crowd", "bin", "rep", "label", F.pmod(F.xxhash64("rep"), "chunks").alias("chunk"), every("parts").alias("part"))
        guests = visits.join(rings, ["crowd", "bin"]).select("crowd", "bin", "rep", "label", F.pmod(F.xxhash64("rep", F.lit(1)), "parts").alias("part"), every("chunks").alias("chunk"))
        rows = hosts.select(block, F.lit(0).alias("kind"), "rep", "label").unionByName(guests.select(block, F.lit(1).alias("kind"), "rep", "label"))
        rows = rows.join(sets, "rep").join(self.reps.select("rep", "sig").join(wanted.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"), "rep")
        rows = rows.repartition("block").sortWithinPartitions("block", "kind", "rep")
        found = rows.mapInPandas(functools.partial(_links_within, likely=self.likely, percent=self.percent), "u long, v long")
        return self.tables.write(links.unionByName(found).distinct(), "links-crowds")

    # ---- confirmation

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full shingle sets are similar enough. Of each pair, the document with more pairs is at home, the other visits."""
        degrees = pairs.select(F.col("u").alias("rep")).unionAll(pairs.select("v")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        ends = degrees.join(self.home_of, "rep", "left").join(self.reps.select("rep", "n_shingles"), "rep").withColumn("crowd", F.coalesce("crowd", "rep"))
        homes = F.ceil(F.greatest(F.count(F.lit(1)) / HOME, F.sum("n_shingles") / HOME_SHINGLES))
        crowds = ends.groupBy("crowd").agg(homes.alias("homes"), F.sum("degree").alias("pairs")).withColumn("parts", F.ceil(F.col("pairs") / F.col("homes") / VISITS))
        ends = ends.join(crowds, "crowd").select("rep", "degree", "parts", F.xxhash64("crowd", F.pmod(F.xxhash64("rep"), "homes")).alias("home"))
        ends = self.tables.write(ends, f"ends-{name}")
        of = lambda c: ends.select(F.col("rep").alias(c), F.struct("degree", -F.col("rep"), "home", "parts").alias(f"e{c}"))
        meeting = lambda host, guest: F.struct(F.col(f"e{host}.home"), F.col(f"e{host}.parts"), F.col(host).alias("host"), F.col(guest).alias("guest"))
        met = pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v")
        met = met.select(F.when(F.col("eu") > F.col("ev"), meeting("u", "v")).otherwise(meeting("v", "u")).alias("m")).select("m.*")
        met = met.select(F.xxhash64("home", F.pmod(F.xxhash64("guest", F.lit(1)), "parts")).alias("block"), "host", "guest")
        met = self.tables.write(met, f"met-{name}")
        hosts = met.select("block", F.col("host").alias("doc_id")).distinct().withColumn("hosts", F.lit(None).cast("array<bigint>"))
        guests = met.groupBy("block", F.col("guest").alias("doc_id")).agg(F.collect_list("host").alias("hosts"))
        texts = self.docs.join(broadcast_if_small(ends.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInPandas(_pack, "doc_id long, packed binary")
        rows = hosts.unionByName(guests).join(texts, "doc_id").repartition("block").sortWithinPartitions("block", F.col("hosts").isNotNull())
        return self.tables.write(rows.mapInPandas(functools.partial(_verify, k=self.k, percent=self.percent), "u long, v long"), f"links-{name}")

    def labels(self, links: DataFrame, name: str, before: DataFrame | None = None) -> DataFrame:
        """(rep, label): the smallest id reachable over the links and those of the labels before, for reps that have any."""
        before = None if before is None else before.withColumnRenamed("rep", "node")
        return smallest_reachable(self.tables, links, name, before).withColumnRenamed("node", "rep")

    def components(self) -> DataFrame:
        """(rep, label) of all linked representatives."""
        found = self.candidates()
        # First the best partner of each document, which joins most groups; then what still lies between different components.
        ends = found.select(F.col("v").alias("x"), F.col("u").alias("y"), "est").unionByName(found.select(F.col("u").alias("x"), F.col("v").alias("y"), "est"))
        best = ends.groupBy("x").agg(F.max_by("y", F.struct("est", -F.col("y"))).alias("y"))
        best = self.tables.write(best.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "pairs-best")
        labels = self.labels(self.confirmed(best, "best"), "labels-best")
        of = lambda c: labels.withColumnsRenamed({"rep": c, "label": f"l{c}"})
        rest = found.join(best, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
        rest = self.tables.write(rest.where("coalesce(lu, u) <> coalesce(lv, v)").select("u", "v"), "pairs-rest")
        if not rest.isEmpty():
            labels = self.labels(self.confirmed(rest, "rest"), "labels-rest", labels)
        if (more := self.crowd_links(labels)) is not None:
            labels = self.labels(more, "labels-crowds", labels)
        return labels


def _pairs(u: np.ndarray, v: np.ndarray, est: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v), "est": est.astype(np.float32)})


def _matrix(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, signatures)), np.uint32).reshape(-1, HASHES)


def _neighbours(batches: Iterator[pd.DataFrame], likely: Likely) -> Iterator[pd.DataFrame]:
    """Candidates of sorted rows: next neighbours in large regions, all in those of at most LEAF rows. The last rows of a batch go on to the next."""
    tail = None
    for pdf in batches:
        rows = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        if rows.empty:
            continue
        region, run, size, n, ids = (rows[c].to_numpy() for c in ("region", "run", "size", "n_shingles", "rep"))
        sig, out = _matrix(rows["order"]), []
        for ahead in range(1, LEAF):
            j = np.arange(max(len(rows) - len(pdf), ahead), len(rows))
            i = j - ahead
            on = (region[i] == region[j]) & (run[i] == run[j]) & ((size[j] <= LEAF) | (ahead == 1))
            i, j = i[on], j[on]
            est, ok = likely(n[i], sig[i], n[j], sig[j])
            out.append(_pairs(ids[i[ok]], ids[j[ok]], est[ok]))
        tail = rows.tail(LEAF - 1)
        yield pd.concat(out)


def _whole_sets(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(text, k) for text in pdf["text"]]
        yield pd.DataFrame({"rep": pdf["doc_id"], "n": [len(s) for s in sets], "whole": [s.tobytes() for s in sets]})


def _from_centre(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Exact distances to the centre, whose row (of kind 0) comes first in each part."""
    centre = None
    for pdf in batches:
        rows = []
        for crowd, kind, rep, label, n, whole in zip(*(pdf[c] for c in ("crowd", "kind", "rep", "label", "n", "whole")), strict=True):
            s = np.frombuffer(whole, np.uint64)
            if not kind:
                centre = s
                continue
            common = len(np.intersect1d(centre, s, assume_unique=True))
            union = len(centre) + len(s) - common
            rows.append((crowd, rep, label, n, 1 - common / union if union else 1.0, 100 * common >= percent * union > 0))
        yield pd.DataFrame(rows, columns=["crowd", "rep", "label", "n", "distance", "linked"])


class _Block:
    """Members of a block, to be visited: joins components, one link for two of them."""

    def __init__(self, likely: Likely, percent: int):
        self.likely, self.percent, self.rows, self.up = likely, percent, [], {}

    def add(self, *row) -> None:
        self.rows.append(row)

    def close(self) -> None:
        self.ids, labels, n, sig, self.sets = zip(*self.rows, strict=True)
        self.component, self.n, self.sig = np.array(labels), np.array(n), _matrix(sig)

    def root(self, label: int) -> int:
        while label in self.up:
            label = self.up[label]
        return label

    def visit(self, rep: int, label: int, n: int, sig: bytes, s: np.ndarray) -> Iterator[tuple[int, int]]:
        mine = self.root(label)
        est, ok = self.likely(self.n, self.sig, n, np.frombuffer(sig, np.uint32))
        at = np.flatnonzero(ok & (self.component != mine))
        at, width = at[np.argsort(-est[at], kind="stable")], 16
        while len(at):
            first, at = at[:width], at[width:]
            for i in first[alike(s, [self.sets[i] for i in first], self.percent)]:
                if (other := self.component[i]) != mine:
                    self.component[self.component == other] = mine
                    self.up[other] = mine
                    yield min(rep, self.ids[i]), max(rep, self.ids[i])
            at, width = at[self.component[at] != mine], 2 * width


def _links_within(batches: Iterator[pd.DataFrame], likely: Likely, percent: int) -> Iterator[pd.DataFrame]:
    """Rows come by block, its members (kind 0) first, then its visitors."""
    at, block, open_ = None, None, False
    for pdf in batches:
        out = []
        for key, kind, rep, label, n, sig, whole in zip(*(pdf[c] for c in ("block", "kind", "rep", "label", "n", "sig", "whole")), strict=True):
            if key != at:
                at, block, open_ = key, _Block(likely, percent), True
            s = np.frombuffer(whole, np.uint64)
            if not kind:
                block.add(rep, label, n, sig, s)
            else:
                if open_:
                    block.close()
                    open_ = False
                out += block.visit(rep, label, n, sig, s)
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "packed": [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in pdf["text"]]})


def _verify(batches: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """Rows come by block, its hosts (without a list of hosts) first; only hosts of the current block are held."""
    block, sets = None, {}
    for pdf in batches:
        u, v = [], []
        for at, doc, hosts, packed in zip(pdf["block"], pdf["doc_id"], pdf["hosts"], pdf["packed"], strict=True):
            if at != block:
                block, sets = at, {}
            s = shingle_set(zlib.decompress(packed).decode("utf-8", "surrogatepass"), k)
            if not len(s):
                continue  # another row of that id, without words
            if hosts is None:
                sets.setdefault(doc, []).append(s)  # several texts of one id
            else:
                each = [(h, x) for h in hosts for x in sets[h]]
                found = {each[i][0] for i in np.flatnonzero(alike(s, [x for _, x in each], percent))}
                u += [min(doc, h) for h in found]
                v += [max(doc, h) for h in found]
        yield pd.DataFrame({"u": u, "v": v}, dtype="int64")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with n_shingles, component_id (smallest id reachable over links) and kept (one document of each component)."""
    docs = docs.drop("n_shingles", "component_id", "kept")
    forest = Forest(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), shingle, percent)
    labels = forest.components()
    reps = forest.reps.select("n_shingles", "f1", "f2", "rep").join(labels, "rep", "left")
    reps = reps.select("n_shingles", "f1", "f2", F.coalesce("label", "rep").alias("label"))
    found = forest.sets.select("doc_id", "t", "n_shingles", "f1", "f2").distinct().join(reps, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    found = found.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_k"), F.col("t").alias("_t"), "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    k, t = fresh(docs, "k", "t")
    out = docs.withColumns(dict(zip((k, t), row_key(docs, key, text), strict=True))).join(found.withColumnsRenamed({"_k": k, "_t": t}), [k, t])
    return out.select(*docs.columns, "n_shingles", "component_id", F.coalesce(docs[key] == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(documents(spark, sf_dir).select("doc_id", "text"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingled as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from worded
), rows as (
  select doc_id, len(s) as n, unnest(s) as g from shingled
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb
  from rows a join rows b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select u, v from pairs where 100 * common >= 85 * (na + nb - common)
), edges as (select u, v from links union all select v, u from links),
reach(x, y) as (select doc_id, doc_id from documents union select reach.x, e.v from reach join edges e on reach.y = e.u),
least_of as (select x as doc_id, min(y) as component_id from reach group by x)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from shingled join least_of using (doc_id)
"""
