"""Components of a graph whose links are a table, by contraction.

Each round a node moves to the one of lowest rank among itself and its neighbours, and from there on (``HOPS`` moves in all); links are then told
between the places moved to, and those within one place are gone. So a round reads only what the rounds before left open, which is a fraction of it,
rather than all links again. Ranks are hashes: no order of ids makes chains that moves follow step by step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small

HOPS = 3


def _between(links: DataFrame, places: DataFrame) -> DataFrame:
    """Links (u, v) between the places (node, to) of their ends, but for those within one; a node without a place is its own."""
    for c in ("u", "v"):
        links = links.join(places.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")), c, "left")
    return links.select(F.coalesce("to_u", "u").alias("u"), F.coalesce("to_v", "v").alias("v")).where("u <> v")


def _moved(nodes: DataFrame, places: DataFrame, kind: str = "left") -> DataFrame:
    """(node, to), each moved on from ``to`` by places (node, to)."""
    places = places.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return nodes.join(places, "to", kind).select("node", F.coalesce("next", "to").alias("to"))


def smallest_reachable(tables: Tables, links: DataFrame, name: str, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of all nodes that links (u, v) join to others: the smallest node reachable. ``links`` and ``labels`` are written tables;
    ``labels``: what this returned for other links, which count too."""
    if labels is None:
        open_ = links.where("u <> v").select("u", "v")
    else:
        before = broadcast_if_small(labels.select("node", F.col("label").alias("to")))
        open_ = tables.write(_between(links, before), f"{name}-open-0")
    moves: list[DataFrame] = []
    while not open_.isEmpty():
        at = len(moves)
        both = open_.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(open_.select(F.col("v").alias("node"), F.col("u").alias("to")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("to"))
        first = both.groupBy("node").agg(F.min(rank("to")).alias("near")).select("node", F.least("near", rank("node"))["to"].alias("to"))
        first = broadcast_if_small(moved := tables.write(first, f"{name}-first-{at}"))
        for _ in range(HOPS - 1):
            moved = _moved(moved, first, "inner")
        moves.append(broadcast_if_small(tables.write(moved, f"{name}-moves-{at}")))
        open_ = tables.write(_between(open_, moves[at]), f"{name}-open-{at + 1}")
        tables.drop(f"{name}-first-{at}", f"{name}-open-{at}")
    if not moves:
        return links.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0) if labels is None else labels
    end = moves[0]
    for moved in moves[1:]:
        end = _moved(end, moved)
    found = end.join(end.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label")
    if labels is not None:
        # Nodes of these links are labels, or have none yet.
        found = tables.write(found, f"{name}-found")
        new = broadcast_if_small(found.withColumnRenamed("label", "to"))
        found = _moved(before, new).unionByName(new.join(before, "node", "left_anti")).withColumnRenamed("to", "label")
    found = tables.write(found, name)
    tables.drop(f"{name}-found", f"{name}-open-{len(moves)}", *(f"{name}-moves-{k}" for k in range(len(moves))))
    return found
