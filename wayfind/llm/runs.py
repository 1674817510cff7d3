"""Periodic runs of words: every maximal stretch that repeats a shortest piece often enough, and the text without the repeats.

Each run contains, at its period's length, a longest Lyndon word of one of two orders of words (any order and its reverse) that starts where that word does.
So a stack is scanned from the last word to the first under both orders: it holds where the longest Lyndon words of the following suffixes end, and comparing two suffixes tells
whether they merge. Each Lyndon word (start, length p) whose two sides agree with the words p further on, to the left and right, is extended to a run of period p.

Suffixes are compared by their *longest common extension*: a few words directly, then by doubling and binary search on rolling hashes, and what the hashes say is verified word by
word. The stretch that was verified last for a distance is remembered, and so is the last run of a period, so texts of one repeated word take no quadratic time.

Words that stand in a text less often than a run repeats its piece lie in no run: they cut the text into parts that are scanned one by one. This loses nothing, as each word of a run
occurs at least ``repeats`` times in it.

Cases: null and empty texts and texts of white space have no words, no runs and an empty collapsed text; equal rows get equal results; an empty table gives an empty result; other
columns are kept, but for ``runs`` and ``collapsed``, which are replaced. Whole texts are read, one at a time; memory is a small multiple of the longest.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, let, small_batches, words

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
MOD, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: Words compared directly before hashes are asked; agreeing stretches of this many words are remembered.
DIRECT, LONG = 12, 64


class Extensions:
    """Longest common extensions of places of a sequence of numbers, to the right and to the left."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.known: dict[int, list[int]] = {}

    @functools.cached_property
    def sums(self) -> list[int]:
        return list(accumulate(self.ids, lambda h, x: (h * BASE + x + 1) % MOD, initial=0))

    @functools.cached_property
    def powers(self) -> list[int]:
        return list(accumulate(range(self.n), lambda p, _: p * BASE % MOD, initial=1))

    def same(self, i: int, j: int, m: int) -> bool:
        s, p = self.sums, self.powers[m]
        return (s[i + m] - s[i] * p - s[j + m] + s[j] * p) % MOD == 0

    def right(self, i: int, j: int) -> int:
        """How many words agree from i and j on (i < j)."""
        ids, n = self.ids, self.n
        m, most = 0, min(DIRECT, n - j)
        while m < most and ids[i + m] == ids[j + m]:
            m += 1
        if m < DIRECT or m == n - j:
            return m
        stretch = self.known.get(j - i)
        if stretch and stretch[0] <= i + m <= stretch[1]:
            stretch[0] = min(stretch[0], i)
            return stretch[1] - i
        room, step = n - j, DIRECT
        while m + step <= room and self.same(i + m, j + m, step):
            m += step
            step *= 2
        low, high = 0, min(step, room - m + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.same(i + m, j + m, mid) else (low, mid)
        return self._verified(i, j - i, m + low)

    def left(self, i: int, j: int) -> int:
        """How many words agree up to, and without, i and j (i < j)."""
        ids = self.ids
        m, most = 0, min(DIRECT, i)
        while m < most and ids[i - 1 - m] == ids[j - 1 - m]:
            m += 1
        if m < DIRECT or m == i:
            return m
        step = DIRECT
        while m + step <= i and self.same(i - m - step, j - m - step, step):
            m += step
            step *= 2
        low, high = 0, min(step, i - m + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.same(i - m - mid, j - m - mid, mid) else (low, mid)
        m += low
        for k in range(0, m, LONG):  # the last words first, as a shorter extension ends there
            e = min(k + LONG, m)
            if ids[i - e : i - k] != ids[j - e : j - k]:
                return k + next(x for x in range(e - k) if ids[i - 1 - k - x] != ids[j - 1 - k - x])
        return m

    def _verified(self, i: int, d: int, m: int) -> int:
        """How many of the m words from i on are those d further on, compared word by word. A stretch that agrees up to its end is remembered for its distance."""
        ids, end = self.ids, i + m
        for at in range(i, end, LONG):
            e = min(at + LONG, end)
            if ids[at:e] != ids[at + d : e + d]:
                m = next(x for x in range(at, e) if ids[x] != ids[x + d]) - i
                break
        if m >= LONG:
            self.known[d] = [i, i + m]
        return m


def _scan(ext: Extensions, falling: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest Lyndon word at each place, the last first, under one order of words."""
    ids, n = ext.ids, ext.n
    ends = [0] * n
    for i in range(n - 1, -1, -1):
        j, a = i + 1, ids[i]
        while j < n:
            b = ids[j]
            if a == b:
                m = ext.right(i, j)
                if j + m == n:
                    break  # the later suffix is a beginning of this one, and so smaller under either order
                less = (ids[i + m] < ids[j + m]) != falling
            else:
                less = (a < b) != falling
            if not less:
                break
            j = ends[j]
        ends[i] = j
        yield i, j


def find_runs(ids: list[int], least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of runs of at least ``least`` words and ``repeats`` periods (2 or more), by start, then period."""
    ext, n, found = Extensions(ids), len(ids), set()
    last: dict[int, tuple[int, int]] = {}
    for falling in (False, True):
        for i, j in _scan(ext, falling):
            p = j - i
            need = max(least, repeats * p) - p
            if need > n - p or not ((j < n and ids[i] == ids[j]) or (i and ids[i - 1] == ids[j - 1])):
                continue
            if p in last and last[p][0] <= i and j <= last[p][1]:
                continue  # within the run of this period that was found last
            right = ext.right(i, j) if j < n else 0
            if right + i < need:
                continue
            left = ext.left(i, j)
            if left + right >= need:
                last[p] = i - left, j + right
                found.add((i - left, left + right + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(tokens: list, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """Runs of a whole text's words: of each part between words that are too rare to lie in a run."""
    if len(tokens) < least:
        return []
    counts = Counter(tokens)
    order: dict = {}
    ids = [order.setdefault(w, len(order)) if counts[w] >= repeats else -1 for w in tokens]
    out, start = [], 0
    ids.append(-1)
    while start < len(ids):
        end = ids.index(-1, start)
        if end - start >= least:
            out += [(start + s, length, p) for s, length, p in find_runs(ids[start:end], least, repeats)]
        start = end + 1
    return out


def without_repeats(tokens: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return tokens
    drop = [0] * (len(tokens) + 1)
    for start, length, p in runs:
        drop[start + p] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(tokens, accumulate(drop), strict=False) if not d]


def _runs(batches: Iterator[pa.RecordBatch], least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    """The first column is the text's bytes; the others go by. bytes.split() splits at just the white space of words."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        found, kept = [], []
        for text in batch.column(0):
            tokens = (text.as_py() or b"").split()
            runs = runs_of(tokens, least, repeats)
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            kept.append(b" ".join(without_repeats(tokens, runs)))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind), pa.array(kept, pa.binary())], names=[*batch.schema.names[1:], "runs", "collapsed"])


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 6, repeats: int = 4, drop_text: bool = False) -> DataFrame:
    """docs (without the text itself, if drop_text) with ``runs`` (start, length, period, in words, by start, then period) and ``collapsed`` (the words left, joined by one space)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")
    raw = fresh(docs, "raw")[0]
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    rows = docs.select(F.col(f"`{text}`").cast("binary").alias(raw), *[F.col(f"`{f.name}`") for f in kept])
    kind = T.StructType([*kept, T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.BinaryType())])
    out = rows.mapInArrow(functools.partial(_runs, least=least, repeats=repeats), kind)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(key: Column, text: Column) -> Column:
    """The query's texts: in one of ten, the words from some place on repeat a piece; the key alone tells which, where and how long."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def loop(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i < s.a, x).otherwise(F.get(w, (s.a + F.pmod(i - s.a, s.p)).cast("int"))))))

    return F.when((F.pmod(h, F.lit(10)) == 0) & F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), let(words(text), loop)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    out = collapse_runs(docs, drop_text=True)
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    told = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("b.length * 1000 div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
