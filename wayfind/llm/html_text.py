"""HTML extraction with a site style tree.

What HTML and ARIA themselves define as not being the article goes (``nav``, ``aside``, ``form``, ``role=navigation``, ...), and where a page has an
``article`` (else a ``main``) element, its text is that element's. An article inside an article is a comment on it, as HTML has it. The rest is
decided by the tree, so by how the pages of a site differ:

* The pages of a host are merged into one tree, whose nodes are element paths (tag, class and id of an element below its parent's path). For
  each node and page there is a digest of its content (all text below) and of its presentation (the kinds of its children).
* A node's importance is mostly the entropy of its contents, partly that of its presentations. Entropies are taken in groups of about ``group``
  pages of the host and divided by the logarithm of the pages there, so the measure is one for a host of 50 pages or a million; text that stands on every
  page has an entropy near 0. Pages with the same main text count once, so copies do not make an article look like a template.
* A host with few pages leans on the same path's importance on all hosts, as if that were ``prior`` pages more. A path on which no host tells anything
  is kept.
* A node with a class or id is less important by the share of pages, on all hosts, where elements of that kind stand outside the article or
  main element; so adverts that differ from page to page go also on pages without such an element.

Branches of low importance go, inside an article or main element, too: an advert within articles goes if it says the same on many pages, or if elements of its kind stand outside
articles elsewhere. Only the article and main elements themselves are not judged. An article or main element within a form that spans the page is not part of the form.

Cases: a null or empty html, or one without text, gives an empty text; a ``br`` is white space; unclosed elements end with their parents; an unclosed
script, style, textarea or comment ends with the page, other unclosed elements do not hide what follows; of pages with the same main text, the
least digests count; equal rows get equal results; a null url is a host of its own; an empty table gives an empty
result; other columns are kept, but for ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, broadcast_if_small, fresh
from .url_filter import host_of

# HTML's elements by use, ARIA's roles, and the names of reader comments, which differ on every page as articles do.
RAW = "script|style|textarea|iframe|xmp"
HIDDEN = "title|noscript|button|template|svg|math|select|object|canvas|audio|video"
BLOCKS = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ASIDE = set("aside button dialog footer form head menu nav search".split())
ROLES = set("alert alertdialog banner comment complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = {"comment", "comments"}
ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<({HIDDEN})\b[^>]*>.*?</\2\s*>|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S | re.I
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)


class _Node:
    __slots__ = ("tag", "path", "kind", "gone", "article", "main", "form")

    def __init__(self, tag: str, path: int, kind: int, gone: bool, article: bool, main: bool, form: bool = False):
        """form: gone for no other reason than a form around it."""
        self.tag, self.path, self.kind, self.gone, self.article, self.main, self.form = tag, path, kind, gone, article, main, form


@functools.lru_cache(1 << 16)
def _named(attributes: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """An element's names as in its path, its classes and id, and its roles."""
    found = [(k.lower(), v.strip("\"'").lower()) for k, v in _NAME.findall(attributes)]
    own = [v for k, v in found if k != "role"]
    path = ".".join(re.sub(r"\d+", "#", v) for v in own)
    return path, frozenset(w for v in own for w in v.split()), frozenset(w for k, v in found if k == "role" for w in v.split())


@functools.lru_cache(1 << 16)
def _step(parent: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), parent & 0xFFFF) ^ (parent * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def blocks_of(page: str | None, low: frozenset[int] = frozenset()) -> tuple[list[tuple[str, list[_Node]]], dict[int, list[str]]]:
    """(text, open elements) of each block in page order, and the children's kinds by node. ``low``: nodes to be taken out."""
    page = page or ""
    root = _Node("", 1, 0, False, False, False)
    stack, blocks, kinds, parts = [root], [], {}, []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((text, stack[:]))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[4] or "").lower()
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if m[3]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(tag, {stack[i].tag}):
                break
            if stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
                break
        if tag == "hr":
            continue
        up = stack[-1]
        names, words, roles = _named(m[5])
        step = f"{tag}.{names}"
        kinds.setdefault(up.path, []).append(step)
        path = _step(up.path, step)
        framing = tag in ("article", "main") or "main" in roles
        inherited = up.gone and not (up.form and framing)
        other = path in low and not framing or tag in ASIDE - {"form"} or tag == "article" and up.article or tag == "header" and not up.article
        other = other or tag not in ("body", "html", "main") and bool(roles & ROLES or words & COMMENTS)
        gone = inherited or other or tag == "form"
        form = gone and not other and (up.form if inherited else not (up.article or up.main))
        stack.append(_Node(tag, path, _step(0, step) if names else 0, gone, tag == "article" or up.article, tag == "main" or "main" in roles or up.main, form))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return blocks, kinds


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    blocks = [(text, open_[-1]) for text, open_ in blocks_of(page, low)[0] if not open_[-1].gone]
    for wanted in ("article", "main"):
        inside = [text for text, node in blocks if getattr(node, wanted)]
        if inside:
            return "\n".join(inside)
    return "\n".join(text for text, _ in blocks)


def _signed(x: int) -> int:
    return x - (1 << 63)


def _digest(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A page's nodes with digests of their content and presentation, and the digest of its main text. kind: 0 without class and id;
    inside: whether the node is part of the page's article or main element; null on pages without."""
    for pdf in batches:
        rows = []
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            blocks, kinds = blocks_of(page)
            content: dict[int, xxhash.xxh64] = {}
            seen: dict[int, _Node] = {}
            for text, open_ in blocks:
                data = text.encode("utf-8", "surrogatepass") + b"\n"
                for path, node in {n.path: n for n in open_ if not n.gone and n.tag not in ("", "html", "body", "article", "main")}.items():
                    content.setdefault(path, xxhash.xxh64()).update(data)
                    seen[path] = node
            framed = any(open_[-1].article or open_[-1].main for _, open_ in blocks)
            nodes = [
                {"node": _signed(k), "content": _signed(h.intdigest()), "look": _digest(" ".join(kinds.get(k, ()))), "kind": seen[k].kind and _signed(seen[k].kind), "inside": (seen[k].article or seen[k].main) if framed else None}
                for k, h in content.items()
            ]
            rows.append((host, _digest(main_text(page)), nodes))
        yield pd.DataFrame(rows, columns=["host", "whole", "nodes"])


def style_tree(pages: DataFrame, presentation: float = 0.1, group: int = 64, prior: float = 4.0) -> DataFrame:
    """pages (host, html): (host, node, pages, importance), from counts of contents and presentations."""
    tables = Tables(pages.sparkSession, "style-tree")
    found = pages.mapInPandas(_nodes, "host string, whole long, nodes array<struct<node long, content long, look long, kind long, inside boolean>>")
    found = tables.write(found.groupBy("host", "whole").agg(F.min("nodes").alias("nodes")), "pages")
    groups = tables.write(found.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).alias("groups")), "hosts")
    nodes = found.join(broadcast_if_small(groups), "host").select("host", F.pmod("whole", "groups").alias("g"), F.explode("nodes").alias("x")).select("host", "g", "x.*")
    sides = F.array(F.struct(F.lit(0).alias("of"), F.col("content").alias("value")), F.struct(F.lit(1).alias("of"), F.col("look").alias("value")))
    counts = nodes.select("host", "g", "node", F.explode(sides).alias("v")).groupBy("host", "g", "node", "v.of", "v.value").agg(F.count(F.lit(1)).alias("c"))
    side = lambda k, x: F.sum(F.when(F.col("of") == k, x))
    sums = counts.groupBy("host", "g", "node").agg(side(0, F.col("c")).alias("pages"), *[side(k, F.col("c") * F.log("c")).alias(f"s{k}") for k in (0, 1)])
    entropy = lambda k: F.when(F.col("pages") > 1, 1 - F.col(f"s{k}") / F.col("pages") / F.log("pages")).otherwise(0.0)
    sums = sums.select("host", "node", "pages", (F.col("pages") - 1).alias("w"), ((1 - presentation) * entropy(0) + presentation * entropy(1)).alias("h"))
    own = tables.write(sums.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("h")).alias("wh")), "nodes")
    everywhere = own.groupBy("node").agg((F.sum("wh") / F.nullif(F.sum("w"), F.lit(0))).alias("all"))
    known = nodes.where("kind <> 0 and inside is not null").groupBy("kind").agg(F.sum(F.col("inside").cast("int")).alias("in"), F.count(F.lit(1)).alias("known"))
    kinds = nodes.where("kind <> 0").select("node", "kind").distinct().join(known, "kind").select("node", ((F.col("in") + 0.1) / (F.col("known") + 0.1)).alias("inside"))
    out = own.join(everywhere, "node").join(kinds, "node", "left")
    importance = (F.col("wh") + prior * F.coalesce("all", F.lit(1.0))) / (F.col("w") + prior) * F.coalesce("inside", F.lit(1.0))
    return out.select("host", "node", "pages", importance.alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first columns are the page and the nodes of low importance; the others go by as they are."""
    for batch in batches:
        low = [frozenset(n + (1 << 63) for n in x or ()) for x in batch.column(1).to_pylist()]
        texts = [main_text(page.as_py(), nodes) for page, nodes in zip(batch.column(0), low, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "text"])


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", least_importance: float = 0.2) -> DataFrame:
    """pages without their html, with the main ``text`` and its ``n_chars``."""
    spark: SparkSession = pages.sparkSession
    host: Column = host_of(pages[url])
    tree = style_tree(pages.select(host.alias("host"), pages[html].alias("html")))
    low = tree.where(F.col("importance") < least_importance).groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low"))
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    h, w, n = fresh(pages, "host", "html", "low")
    low = Tables(spark, "style-tree").write(low.toDF(h, n), "low")
    rows = pages.select(*kept, host.alias(h), pages[html].alias(w)).join(broadcast_if_small(low), h, "left").select(w, n, *kept)
    out = rows.mapInArrow(_extract, T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType())]))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
