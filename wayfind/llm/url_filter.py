"""URL filters: rules by host and path, and a path-template tree for the urls that no rule fits.

Each host has a tree of path templates. Numbers and long hexadecimal names become wildcards at once; any other segment becomes ``*``
unless at least 2 of the host's urls and ``common`` of those with a segment at this depth have it. Templates may have any depth.

A node's evidence are the labelled urls below it. Labelled are urls that a rule fits, and those of the ``labels`` table where one is given. Siblings,
at every depth, whose labelled share of bad urls does not differ from their parent's by more than ``z`` standard errors are merged; nodes without labelled
urls have nothing to be compared by and stay apart.

A template's purity is smoothed from the general to the special: it starts from the share of all urls; then come the host, the
template's nodes on all hosts together, from the root down, and its (merged) nodes on this host. Each step takes its own labelled urls and ``smooth``
urls of the share before it. A template is rejected if the last share is ``purity`` or more, and its nodes on any host have ``least`` labelled urls.

Everything after the parsing works on counts per host and shaped path.

Cases: a null url, or one without ``://``, has an empty host and an empty path, fits no rule and is one template, of the empty host;
equal rows get equal results; an empty table gives an empty result; other columns are kept, but for ``host``, ``path``, ``template``,
``rule`` and ``verdict``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ascii_lower, broadcast_if_small, fresh


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
RESULT = ("host", "path", "template", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def shape(path: Column) -> Column:
    """The path with long hexadecimal segments as {x} and other numbers as {n}; empty segments left out."""
    path = F.regexp_replace(path, "/(?=[a-f-]*[0-9])[0-9a-f-]{12,}(?=/|$)", "/{x}")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "[0-9]+", "{n}"), "/+", "/"), "/$", "")


def templates(shapes: DataFrame, common: float) -> DataFrame:
    """shapes (host, shape, urls, ...) with ``template``, its segments."""
    shapes = shapes.withColumn("s", F.filter(F.split("shape", "/"), lambda x: x != ""))
    parts = shapes.select("host", "shape", "urls", F.posexplode("s").alias("at", "value"))
    counts = parts.groupBy("host", "at", "value").agg(F.sum("urls").alias("n"))
    there = counts.groupBy("host", "at").agg(F.sum("n").alias("all"))
    known = counts.join(there, ["host", "at"]).where((F.col("n") >= 2) & (F.col("n") >= common * F.col("all"))).select("host", "at", "value", F.lit(True).alias("kept"))
    parts = parts.join(known, ["host", "at", "value"], "left").groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kept"), F.col("value")).otherwise("*").alias("to")))).alias("to"))
    return shapes.drop("s").join(parts.select("host", "shape", F.col("to.to").alias("template")), ["host", "shape"], "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))


def judge_templates(tables: Tables, shapes: DataFrame, z: float, smooth: float, purity: float, least: int) -> DataFrame:
    """(host, shape, rejected) for shapes (host, shape, bad, good, template)."""
    prefix = lambda n: F.array_join(F.slice("template", F.lit(1), n), "/")
    nodes = shapes.select("host", "shape", "bad", "good", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level"), "template")
    nodes = nodes.select("host", "shape", "bad", "good", "level", F.xxhash64("level", prefix(F.col("level"))).alias("node"), F.xxhash64(F.col("level") - 1, prefix(F.greatest(F.col("level") - 1, F.lit(0)))).alias("up"))
    nodes = tables.write(nodes, "nodes")
    own = nodes.groupBy("host", "level", "up", "node").agg(F.sum("bad").alias("b"), F.sum(F.col("bad") + F.col("good")).alias("n"))
    parents = own.groupBy("host", "level", "up").agg(((F.sum("b") + 1) / (F.sum("n") + 2)).alias("share"))
    share, n = F.col("share"), F.greatest(F.col("n"), F.lit(1))
    like = (F.col("n") > 0) & (F.abs(F.col("b") / n - share) <= z * F.sqrt(share * (1 - share) / n))
    own = tables.write(own.join(parents, ["host", "level", "up"]).withColumn("branch", F.when(~like, F.col("node").cast("string")).otherwise("alike")), "branches")
    merged = own.groupBy("host", "level", "up", "branch").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    host_side = own.select("host", "level", "up", "branch", "node").join(merged, ["host", "level", "up", "branch"]).select("host", "node", "b", "n")
    everywhere = own.where("level > 0").groupBy("node").agg(F.sum("b").alias("b_all"), F.sum("n").alias("n_all"))
    step = lambda kind, b, n: F.struct(F.lit(kind).alias("kind"), "level", F.col(b).cast("double").alias("b"), F.col(n).cast("double").alias("n"))
    met = nodes.select("host", "shape", "level", "node").join(host_side, ["host", "node"]).join(everywhere, "node", "left")
    steps = F.when(F.col("level") == 0, F.array(step(0, "b", "n"))).otherwise(F.array(step(1, "b_all", "n_all"), step(2, "b", "n")))
    met = met.groupBy("host", "shape").agg(F.array_sort(F.flatten(F.collect_list(steps))).alias("steps"))
    whole = shapes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum(F.col("bad") + F.col("good")), F.lit(0))).first()
    pure = F.aggregate("steps", F.lit((whole[0] + 1) / (whole[1] + 2)), lambda p, x: (x["b"] + smooth * p) / (x["n"] + smooth))
    seen = F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + F.when(x["kind"] > 0, x["n"]).otherwise(0.0))
    return met.select("host", "shape", ((pure >= purity) & (seen >= least)).alias("rejected"))


def filter_urls(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, common: float = 0.02, z: float = 2.0, smooth: float = 4.0, purity: float = 0.8, least: int = 5
) -> DataFrame:
    """pages with host, path, template, rule and verdict. labels: (url, bad boolean), in addition to the rules' verdicts."""
    spark: SparkSession = pages.sparkSession
    tables = Tables(spark, "urls")
    asked = pages.drop(*RESULT)
    s, r, h, m = fresh(asked, "shape", "rule", "host", "template")
    parse = lambda df, u, s="shape": df.withColumns({"host": host_of(df[u]), "path": path_of(df[u])}).withColumn(s, shape(F.col("path")))
    pages = parse(asked, url, s).withColumn(r, rule_of(F.col("host"), F.col("path"), rules))
    sides = lambda bad, good: (F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.sum(F.when(good, 1).otherwise(0)).alias("good"))
    seen = pages.groupBy("host", F.col(s).alias("shape")).agg(*sides(F.col(f"{r}.verdict") == "block", F.col(f"{r}.verdict") == "allow"), F.count(F.lit(1)).alias("urls"))
    if labels is not None:
        known = parse(labels.select("url", "bad"), "url")
        known = known.groupBy("host", "shape").agg(*sides(F.col("bad"), ~F.col("bad")), F.count(F.lit(1)).alias("urls"))
        seen = seen.unionByName(known).groupBy("host", "shape").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("urls").alias("urls"))
    shapes = tables.write(templates(tables.write(seen, "shapes"), common), "templates")
    judged = judge_templates(tables, shapes, z, smooth, purity, least)
    judged = tables.write(shapes.select("host", "shape", F.array_join("template", "/").alias("template")).join(judged, ["host", "shape"]), "judged")
    bad = f"{m}_rejected"
    judged = broadcast_if_small(judged).select(F.col("host").alias(h), F.col("shape").alias(f"{s}_of"), F.col("template").alias(m), F.col("rejected").alias(bad))
    out = pages.join(judged, (F.col("host") == F.col(h)) & (F.col(s) == F.col(f"{s}_of")), "left")
    verdict = F.coalesce(F.col(f"{r}.verdict"), F.when(F.col(bad), "block").otherwise("allow"))
    return out.select(*asked.columns, "host", "path", F.concat("host", F.lit("/"), m).alias("template"), F.col(f"{r}.rule").alias("rule"), verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = lambda r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"
    ordered = sorted(RULES, key=lambda r: (-len(str(r)), str(r)))
    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for r in ordered) + " end"
    given = "case " + " ".join(f"when {fits(r)} then '{r.verdict}'" for r in ordered) + " end"
    return rf"""
with parsed as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), split as (
  select *, list_filter(string_split(path, '/'), lambda x: x <> '') as raw, {rule} as rule, {given} as given from parsed
), shaped as (
  select *, list_transform(raw, lambda x: case when regexp_full_match(x, '[0-9a-f-]{{12,}}') and regexp_matches(x, '[0-9]')
    then '{{x}}' else regexp_replace(x, '[0-9]+', '{{n}}', 'g') end) as s from split
), seen as (
  select host, s, count(*) filter (given = 'block') as bad, count(*) filter (given = 'allow') as good, count(*) as urls from shaped group by host, s
), parts as (
  select host, s, urls, unnest(range(1, len(s) + 1)) as pos, unnest(s) as value from seen
), counts as (select host, pos, value, sum(urls) as n, sum(sum(urls)) over (partition by host, pos) as whole from parts group by host, pos, value
), general as (
  select host, s, list(case when n >= 2 and n >= 0.02 * whole then value else '*' end order by pos) as to from parts join counts using (host, pos, value) group by host, s
), shapes as (
  select host, s, bad, good, coalesce(g.to, []) as template from seen left join general g using (host, s)
), nodes as (
  select host, s, bad, good, level, array_to_string(template[1:level], '/') as node, array_to_string(template[1:greatest(level - 1, 0)], '/') as up
  from (select *, unnest(range(0, len(template) + 1)) as level from shapes)
), own as (select host, level, up, node, sum(bad) as b, sum(bad + good) as n from nodes group by all
), compared as (
  select *, (sum(b) over w + 1) / (sum(n) over w + 2) as share from own window w as (partition by host, level, up)
), branches as (
  select *, case when n > 0 and abs(b / greatest(n, 1) - share) <= 2.0 * sqrt(share * (1 - share) / greatest(n, 1)) then null else node end as branch from compared
), merged as (
  select host, level, node, sum(b) over w as b, sum(n) over w as n from branches window w as (partition by host, level, up, branch)
), everywhere as (select level, node, sum(b) as b, sum(n) as n from own where level > 0 group by level, node
), steps as (
  select nodes.host, s, level, node, case when level = 0 then 0 else 2 end as kind, m.b, m.n from nodes join merged m using (host, level, node)
  union all select nodes.host, s, level, node, 1, e.b, e.n from nodes join everywhere e using (level, node)
), chains as (
  select host, s, list(b::double order by kind, level) as bs, list(n::double order by kind, level) as ns, coalesce(sum(n) filter (kind > 0), 0) as seen from steps group by host, s
), whole as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(bad + good), 0) + 2) as base from shapes
), judged as (
  select host, s, seen >= 5 and list_reduce(list_prepend(base, range(1, len(bs) + 1)::double[]), lambda p, i: (bs[i::int] + 4.0 * p) / (ns[i::int] + 4.0)) >= 0.8 as rejected from chains, whole
)
select page_id, host, path, rule, coalesce(given, case when rejected then 'block' else 'allow' end) as verdict from shaped left join judged using (host, s)
"""


SQL = _sql()
