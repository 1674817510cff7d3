"""Near-duplicate embeddings by tiled comparison in principal-component order.

Equal vectors of a group are collapsed to one *node* with its number of rows. The second moments of all nodes give an orthonormal basis for each
length of vector; in it, most of a vector's norm lies in its leading coordinates. Nodes of a group are cut into *tiles* by their first coordinate,
and each pair of tiles whose first coordinates allow the asked cosine meets in one task, the guests streaming past the hosts. There, blocks of
``SUB`` x ``SUB`` are compared by ``STEP`` coordinates at a time: the product of what is left of two vectors is at most the product of their suffix
norms, so a block is left as soon as no pair of it can reach the threshold, and only few pairs go on one by one. What remains is decided on the
vectors as given, in double precision.

A task returns no pairs: it counts links for each node and keeps a spanning forest of them, so a group of thousands of near copies gives no more
rows than it has nodes in each task. The work still grows with the square of a group's different vectors; rows of a group of any size are dealt
over its pairs of tiles, so no task holds more than one tile.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a group or key, link with nothing (n_links 0,
own component, null key: component null); vectors of different lengths link with nothing; each row is a vector, so repeated rows link with each
other; the component of a row is the smallest key among all rows it reaches; an empty table gives an empty result; other columns are kept, but for
``n_links``, ``component_id`` and ``kept``, which are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, fresh
from .graph import smallest_reachable

TILE, SUB, STEP = 2048, 512, 16
#: Longest vectors that get a basis of their own, and bytes of all bases together; others are compared in the order of their coordinates.
LONGEST, BASES = 1024, 64_000_000
#: Rounding in the rotated coordinates that bounds allow for.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors)"""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch.column("vec").take(pa.array(at)), dim)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second moments of a partition's unit vectors, one row of the matrix a row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in _by_length(batch):
            if dim <= LONGEST:
                x = unit(x)
                sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "i", "row"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for dim, i, row in zip(batch.column("dim").to_pylist(), batch.column("i").to_pylist(), batch.column("row"), strict=True):
            sums[dim, i] = sums.get((dim, i), 0) + row.values.to_numpy()
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], ["dim", "i", "row"])


def bases(nodes: DataFrame, tables: Tables) -> dict[int, np.ndarray]:
    """Orthonormal bases by length of vector, columns by falling eigenvalue of the second moments of all nodes. Their size is checked before they are read."""
    kind = "dim int, i int, row array<double>"
    rows = tables.write(nodes.select("dim", "vec").mapInArrow(_moments, kind).repartition("dim", "i").mapInArrow(_add_rows, kind), "moments")
    out, room = {}, BASES
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().limit(LONGEST).collect()):
        room -= 8 * dim * dim
        if room < 0:
            break
        m = np.zeros((dim, dim))
        for r in rows.where(F.col("dim") == dim).toLocalIterator():
            m[r["i"]] = r["row"]
        out[dim] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
    return out


def _lead(batches: Iterator[pa.RecordBatch], by: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The first coordinate of each node."""
    for batch in batches:
        lead = np.zeros(batch.num_rows)
        for dim, at, x in _by_length(batch):
            lead[at] = unit(x) @ (by[dim][:, 0] if dim in by else np.eye(dim, 1)[:, 0])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "grp", "dim")), pa.array(lead)], ["node", "grp", "dim", "lead"])


class Block:
    """Vectors that are compared together: as given, rotated, and their suffix norms after each STEP coordinates."""

    def __init__(self, nodes: np.ndarray, rows: np.ndarray, x: np.ndarray, basis: np.ndarray | None):
        self.nodes, self.rows = nodes, rows
        self.unit = unit(x)
        self.turned = self.unit if basis is None else self.unit @ basis
        rest = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.left = [np.sqrt(rest[:, k]) for k in range(STEP, x.shape[1], STEP)]

    def links(self, other: Block, least: float) -> np.ndarray | None:
        """Which of this block's vectors (rows) link with which of the other's; None if none do."""
        total = np.zeros((len(self.nodes), len(other.nodes)))
        for k in range(0, self.turned.shape[1], STEP):
            total += self.turned[:, k : k + STEP] @ other.turned[:, k : k + STEP].T
            if k + STEP >= self.turned.shape[1]:
                break
            open_ = total + np.outer(self.left[k // STEP], other.left[k // STEP]) >= least - SLACK
            count = np.count_nonzero(open_)
            if not count:
                return None
            if count * 50 < open_.size:
                i, j = np.nonzero(open_)
                return self._decided(other, i, j, least)
        return self._decided(other, *np.nonzero(total >= least - SLACK), least)

    def _decided(self, other: Block, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray | None:
        out = np.zeros((len(self.nodes), len(other.nodes)), bool)
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536], j[at : at + 65536]
            out[a, b] = np.einsum("ij,ij->i", self.unit[a], other.unit[b]) >= least
        return out if out.any() else None


class Meeting:
    """Links of one pair of tiles: how many each node has, and a forest that joins the same nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.degree: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] if y in self.up else y
            x = self.up[x]
        return x

    def add(self, a: Block, b: Block, found: np.ndarray | None, both: bool = True) -> None:
        """found: links of a's rows with b's. both: count for b's nodes, too (not if a and b are one block)."""
        if found is None:
            return
        for block, counts in ((a, found @ b.rows), *([(b, a.rows @ found)] if both else [])):
            for i in np.flatnonzero(counts):
                node = int(block.nodes[i])
                self.degree[node] = self.degree.get(node, 0) + int(counts[i])
        for i, j in spanning(found):
            x, y = self.root(u := int(a.nodes[i])), self.root(v := int(b.nodes[j]))
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.forest.append((u, v))


def spanning(found: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join all that ``found`` (rows x columns) joins: breadth first, each row and column reached once."""
    rows, cols = found.any(axis=1), found.any(axis=0)
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start], frontier = False, [start]
        while len(frontier):
            part = found[frontier] & cols
            new = np.flatnonzero(part.any(axis=0))
            if not len(new):
                break
            for i, j in zip(part[:, new].argmax(axis=0), new, strict=True):
                yield frontier[i], j
            cols[new] = False
            part = found[:, new] & rows[:, None]
            frontier = np.flatnonzero(part.any(axis=1))
            for i, j in zip(frontier, part[frontier].argmax(axis=1), strict=True):
                yield i, new[j]
            rows[frontier] = False


def _meet(batches: Iterator[pa.RecordBatch], by: dict[int, np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come by meeting, hosts (side 0) first. A tile that meets itself has hosts only. One tile is held; guests go by."""
    at, hosts, now = None, [], None

    def told(m: Meeting) -> pa.RecordBatch:
        u = [*m.degree, *(u for u, _ in m.forest)]
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array([*[None] * len(m.degree), *(v for _, v in m.forest)], pa.int64()), pa.array([*m.degree.values(), *[None] * len(m.forest)], pa.int64())], ["u", "v", "n"]
        )

    def compare(block: Block, guest: int, own: bool) -> None:
        if guest or own:
            for host in hosts:
                now.add(host, block, host.links(block, least))
        if own:
            within = block.links(block, least)
            if within is not None:
                np.fill_diagonal(within, False)
                now.add(block, block, within if within.any() else None, both=False)
        if not guest:
            hosts.append(block)

    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("meeting", "own", "side", "dim", "node", "rows")}
        edges = [0, *(np.flatnonzero((np.diff(cols["meeting"]) != 0) | (np.diff(cols["side"]) != 0) | (np.diff(cols["dim"]) != 0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            for s in range(lo, hi, SUB):
                e = min(s + SUB, hi)
                if cols["meeting"][s] != at:
                    if now:
                        yield told(now)
                    at, hosts, now = cols["meeting"][s], [], Meeting()
                dim = int(cols["dim"][s])
                block = Block(cols["node"][s:e], cols["rows"][s:e], _matrix(batch.column("vec").slice(s, e - s), dim), by.get(dim))
                compare(block, cols["side"][s], cols["own"][s])
    if now:
        yield told(now)


def _tiled(nodes: DataFrame, lead: DataFrame, least: float, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(node, grp, dim, tile) and (grp, dim, host, guest): tiles and the pairs of them whose first coordinates allow the cosine."""
    sizes = lead.groupBy("grp", "dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("lead", [i / 256 for i in range(1, 256)], 2048).alias("cuts"))
    sizes = tables.write(sizes, "sizes")
    # A group takes up to 256 strips by its first coordinate, and each strip as many tiles as its size needs.
    strips = F.least(F.lit(256), F.ceil(F.col("n") / TILE))
    strip = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("lead"))) * strips / 256).cast("int")
    cut = tables.write(lead.join(sizes, ["grp", "dim"]).select("node", "grp", "dim", "lead", strip.alias("strip")), "strips")
    counts = cut.groupBy("grp", "dim", "strip").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    tile = F.struct("strip", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    placed = tables.write(cut.join(counts, ["grp", "dim", "strip"]).select("node", "grp", "dim", "lead", tile.alias("tile")), "tiles")
    found = tables.write(placed.groupBy("grp", "dim", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high")), "found-tiles")
    # Unit vectors with first coordinates x and y have a cosine of at most x y + sqrt(1 - x^2) sqrt(1 - y^2): their angles differ too much beyond this reach.
    angle = lambda x: F.acos(F.least(F.greatest(F.col(x), F.lit(-1.0)), F.lit(1.0)))
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    tiles = found.select("grp", "dim", "tile", angle("high").alias("near"), angle("low").alias("far"))
    a, b = tiles.select("grp", "dim", *(F.col(c).alias(f"{c}_a") for c in ("tile", "near", "far"))), tiles.select("grp", "dim", *(F.col(c).alias(f"{c}_b") for c in ("tile", "near", "far")))
    pairs = a.join(b, ["grp", "dim"]).where(f"tile_a <= tile_b and near_a - far_b <= {reach} and near_b - far_a <= {reach}")
    return placed, tables.write(pairs.select("grp", "dim", F.col("tile_a").alias("host"), F.col("tile_b").alias("guest"), F.monotonically_increasing_id().alias("meeting")), "meetings")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = 0.93) -> DataFrame:
    """vectors with n_links, component_id and kept; only rows of one group are compared."""
    spark: SparkSession = vectors.sparkSession
    vectors = vectors.drop("n_links", "component_id", "kept")
    tables = Tables(spark, "vectors")
    of = T.FloatType() if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else T.DoubleType()
    values = F.col(f"`{vector}`").cast(T.ArrayType(of))
    fit = usable(values) & F.col(f"`{group}`").isNotNull() & F.col(f"`{key}`").isNotNull()
    real = vectors.where(fit).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{group}`").alias("grp"), values.alias("vec"))
    nodes = real.groupBy("grp", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    nodes = tables.write(nodes.select(F.monotonically_increasing_id().alias("node"), "grp", F.size("vec").alias("dim"), "vec", "first", "rows"), "nodes")
    by = bases(nodes, tables)
    lead = tables.write(nodes.select("node", "grp", "dim", "vec").mapInArrow(functools.partial(_lead, by=by), T.StructType([nodes.schema["node"], nodes.schema["grp"], nodes.schema["dim"], T.StructField("lead", T.DoubleType())])), "lead")
    placed, pairs = _tiled(nodes, lead, least, tables)
    whole = placed.join(nodes.select("node", "rows", "vec"), "node").select("grp", "dim", "tile", "lead", "node", "rows", "vec")
    sides = pairs.select("grp", "dim", F.col("host").alias("tile"), "meeting", F.lit(0).alias("side"), "host", "guest")
    sides = sides.unionByName(pairs.where("host <> guest").select("grp", "dim", F.col("guest").alias("tile"), "meeting", F.lit(1).alias("side"), "host", "guest"))
    rows = whole.join(sides, ["grp", "dim", "tile"]).select("meeting", (F.col("host") == F.col("guest")).alias("own"), "side", "dim", "lead", "node", "rows", "vec")
    rows = rows.repartition("meeting").sortWithinPartitions("meeting", "side", "lead")
    told = tables.write(rows.drop("lead").mapInArrow(functools.partial(_meet, by=by, least=least), "u long, v long, n long"), "told")
    tables.drop("moments", "lead", "strips", "tiles", "found-tiles", "meetings", "sizes")
    labels = smallest_reachable(tables, told.where("v is not null").select("u", "v"), "labels")
    degrees = told.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    found = nodes.join(degrees, "node", "left").join(labels, "node", "left").select("grp", "vec", "node", "first", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), "label")
    found = tables.write(found, "found")
    smallest = found.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    found = found.join(smallest, "label", "left").select(F.col("grp").alias("_g"), F.col("vec").alias("_v"), F.col("links").alias("_n"), F.coalesce("least", "first").alias("_c"))
    g, v, n, c, ok = fresh(vectors, "g", "v", "n", "c", "fit")
    found = found.toDF(g, v, n, c)
    named = vectors.withColumns({g: F.when(fit, F.col(f"`{group}`")), v: F.when(fit, values), ok: fit})
    out = named.where(F.col(ok)).join(found, [g, v]).select(*vectors.columns, F.col(n).alias("n_links"), F.col(c).alias("component_id"))
    alone = named.where(~F.col(ok)).select(*vectors.columns, F.lit(0).cast("long").alias("n_links"), F.col(f"`{key}`").cast("long").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col(f"`{key}`") == F.col("component_id"), F.lit(True)))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "n_links", "component_id", "kept")


SQL = r"""
with recursive vectors as (
  select vec_id, label, embedding::double[] as v from embeddings
), usable as (
  select row_number() over () as r, * from vectors where vec_id is not null and label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.r as u, b.r as w, a.vec_id as ui, b.vec_id as wi from usable a join usable b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93
), reach(x, y) as (select r, r from usable union select reach.x, l.w from reach join links l on reach.y = l.u),
least_of as (select x as r, min(vec_id) as component_id from reach join usable on reach.y = usable.r group by x),
counts as (select u as r, count(*) as n from links group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from usable join least_of using (r) left join counts using (r)
union all
select vec_id, 0::bigint, vec_id, true from vectors where not (vec_id is not null and label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0) is true
"""
