"""Components of links: what each round reads, and links that come later."""

import random

from wayfind.llm.common import Tables
from wayfind.llm.graph import smallest_reachable


def reached(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


class Counted(Tables):
    def __init__(self, spark, name):
        super().__init__(spark, name)
        self.rows = 0

    def write(self, df, name, *rest, **more):
        out = super().write(df, name, *rest, **more)
        self.rows += out.count()
        return out


def of(spark, links):
    return spark.createDataFrame(links, "u long, v long")


def found(labels):
    rows = labels.collect()
    out = {r["node"]: r["label"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_rounds_read_what_is_open_only(spark):
    """A chain in the order of ids: each round is told fewer links, so all rounds write a few times the chain."""
    links = [(i, i + 1) for i in range(2000)]
    tables = Counted(spark, "chain")
    assert found(smallest_reachable(tables, of(spark, links), "chain")) == reached(links)
    assert tables.rows < 6 * len(links)


def test_later_links_go_on_from_labels(spark):
    r = random.Random(5)
    first = [(u, v) for u, v in ((r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)) if u != v]
    later = [(u, v) for u, v in ((r.randrange(-500, 300), r.randrange(-500, 300)) for _ in range(120)) if u != v]
    tables = Tables(spark, "later")
    labels = smallest_reachable(tables, of(spark, first), "first")
    assert found(labels) == reached(first)
    assert found(smallest_reachable(tables, of(spark, later), "later", labels)) == reached(first + later)
    assert found(smallest_reachable(tables, of(spark, first[:9]), "same", labels)) == reached(first)
    assert found(smallest_reachable(tables, of(spark, []), "none", labels)) == reached(first)
    assert found(smallest_reachable(tables, of(spark, []), "empty")) == {}
