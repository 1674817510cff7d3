"""Line deduplication with levelled sorted runs of line digests.

A *run* is a table of (a, b, docs): two independent 64-bit hashes of a line's key and the number of documents that
held it, sorted by (a, b). Batches of documents arrive one after the other. Each batch is counted, merge-anti-joined with
the keys that a compacted run already holds as frequent (nothing more need be known of those), and its other keys
become a new run of level 0. When a level has ``fan`` runs, they are merged into one run of the next level. The last
compaction gives the frequent keys of the whole corpus, and every line with such a key goes.

Cases: a null or empty text is one empty line; an empty key is never dropped when ``min_chars`` is 1 or more; rows are
documents, so equal rows count twice and get equal results; an empty table gives an empty result; other columns are kept
(``kept``, ``n_lines`` and ``n_dropped`` are replaced if the input has them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ascii_lower, documents, fresh, let, row_key

KEY = ["a", "b"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.regexp_replace(line, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""))


class LineRuns:
    """The levels of runs. Pass the same ``tables`` to go on with runs of an earlier corpus."""

    def __init__(self, tables: Tables, min_docs: int, fan: int = 2):
        self.tables, self.min_docs, self.fan = tables, min_docs, fan
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.count = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.count += 1
        name = f"run-{level}-{self.count}"
        self.levels[level].append((name, self.tables.write(rows.sortWithinPartitions(*KEY), name)))

    def _merged(self, runs: list[tuple[str, DataFrame]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [r for _, r in runs]).groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def settled(self) -> list[DataFrame]:
        """Keys known to be frequent, from the compacted runs."""
        return [run.where(F.col("docs") >= self.min_docs).select(*KEY) for level in self.levels[1:] for _, run in level]

    def add(self, keys: DataFrame) -> None:
        """keys: (a, b), one row for each document and distinct key of a batch."""
        fresh = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"))
        for known in self.settled():
            fresh = fresh.join(known.hint("merge"), KEY, "left_anti")
        self._write(fresh, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self.compact(level)

    def compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        self._write(self._merged(runs), level + 1)
        self.tables.drop(*[name for name, _ in runs])

    def frequent(self) -> DataFrame:
        """Keys in at least min_docs documents, after a last compaction of all runs."""
        runs = [run for level in self.levels for run in level]
        self.levels = [[] for _ in self.levels]
        self._write(self._merged(runs), len(self.levels))
        self.tables.drop(*[name for name, _ in runs])
        return self.levels[-1][0][1].where(F.col("docs") >= self.min_docs).select(*KEY)


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 3
) -> DataFrame:
    """docs with ``n_lines``, ``n_dropped`` and ``kept``, the text without lines that min_docs documents or more hold."""
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "line-runs")
    docs = docs.drop("kept", "n_lines", "n_dropped")
    digest = lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))
    k, t, c, of_ = fresh(docs, "k", "t", "cut", "of")
    keyed = dict(zip((k, t), row_key(docs, key, text), strict=True))
    hashed = docs.select(keyed[k], keyed[t], F.transform(F.transform(lines_of(docs[text]), line_key), digest).alias("keys"))
    hashed = tables.write(hashed.withColumn("batch", F.pmod(F.xxhash64("_k", "_t"), F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineRuns(tables, min_docs)
    for batch in range(batches):
        of = hashed.where(F.col("batch") == batch).select(F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(of.where("key is not null").select("key.a", "key.b"))
    frequent = runs.frequent()
    hits = hashed.select("_k", "_t", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    hits = hits.select("_k", "_t", "pos", "key.a", "key.b").join(frequent, KEY, "left_semi")
    hits = hits.groupBy("_k", "_t").agg(F.array_sort(F.collect_set("pos")).alias("_cut")).toDF(k, t, c)
    lines = lines_of(docs[text])
    out = docs.withColumns(keyed).join(hits, [k, t], "left")
    cut = F.coalesce(c, F.array().cast("array<int>"))

    def kept(of: Column) -> Column:
        """The lines between two dropped ones, for all such stretches."""
        stretch = lambda i: F.slice(of["lines"], of["ends"][i - 1] + 2, of["ends"][i] - of["ends"][i - 1] - 1)
        return F.struct(
            F.size(of["lines"]).cast("long").alias("n_lines"),
            (F.size(of["ends"]) - 2).cast("long").alias("n_dropped"),
            F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(of["ends"]) - 1), stretch)), "\n").alias("kept"),
        )

    ends = let(lines, lambda x: F.struct(x.alias("lines"), F.concat(F.array(F.lit(-1)), cut, F.array(F.size(x))).alias("ends")))
    out = out.withColumn(of_, let(ends, kept))
    return out.select(*docs.columns, f"{of_}.n_lines", f"{of_}.n_dropped", f"{of_}.kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(case when f.key is null then line end, chr(10) order by pos), '')) as kept_sha256
from keyed left join frequent f using (key) group by doc_id
"""
