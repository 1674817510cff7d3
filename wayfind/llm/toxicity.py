"""Toxicity by weak supervision.

1. *Lexicons.* Words and word stems whose presence goes with the toxic label are counted over all labelled training documents. Labelled documents
   with the same two least word hashes, which copies mostly share, share the weight of one document, so a text that was copied and labelled often does not make
   all its words look toxic. Each family (words, stems of 4, 5 and 6 letters) is hashed into ``BUCKETS`` entries, so the table of counts has a fixed
   bound and no word is left out. Entries with a log-odds ratio clearly above chance form the lexicons, cut into several voters for each
   family, from the surest to the least sure. A few writing patterns vote too.
2. *Label model.* The votes of every training document, labelled or not, are a bit mask; masks are counted (at most 2^voters rows), and a two-class
   generative model gives each voter's accuracies by EM. Training labels anchor the classes: where there is one, the class is known.
   Voters that err together within a class (residual correlation) share their weight, so copies of one signal do not count as several.
3. *Classifier.* A logistic regression on lexicon entries and votes is trained on the posterior labels of at most ``sample`` training documents, labelled
   or not (a documented bound; the rows with the least hash of their id), and scores every document. A label that a row has is one more
   vote for its posterior, of accuracy ``GOLD``.

Labels of held-out rows are never read; ids, languages and sources are never inputs of a score.

Cases: null and empty texts have no votes and get the score of such a text; repeated labels of one id count once, as the larger; null labels and
labels of null ids are none; without any toxic training row scores are the base rate; equal texts get equal scores; an empty table gives an
empty result; other columns are ignored, the result has doc_id, held_out and score.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small, documents, fold

STEMS = (4, 5, 6)
FAMILIES = ("word", *[f"stem{n}" for n in STEMS])
SLICES, BUCKETS, GOLD, ONE = 3, 1 << 18, 0.95, 1_000_000
#: Patterns within a word, and whether a text needs one such word or two.
PATTERNS = {
    "shouting": (re.compile(r"[A-Z]{4,}\W*"), 2),
    "bangs": (re.compile(r".*?[!?]{3,}.*"), 1),
    "masked": (re.compile(r"\W*\w+[*@#$]{2,}.*"), 1),
    "stretched": (re.compile(r".*?([A-Za-z])\1{3,}.*"), 1),
}
VOTERS = [f"{f}-{i}" for f in FAMILIES for i in range(SLICES)] + list(PATTERNS)
_EDGE = re.compile(r"^\W+|\W+$")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def described(word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A word's entries (number of the family times BUCKETS, plus a hash) and its patterns."""
    raw = word.decode("utf-8", "surrogatepass")
    bare = _EDGE.sub("", word.translate(_UPPER).decode("utf-8", "surrogatepass"))
    forms = [(0, bare)] + [(i + 1, bare[:n]) for i, n in enumerate(STEMS) if len(bare) >= n] if bare else []
    entries = tuple(i * BUCKETS + xxhash.xxh32_intdigest(form.encode("utf-8", "surrogatepass"), i) % BUCKETS for i, form in forms)
    return entries, tuple(i for i, (p, _) in enumerate(PATTERNS.values()) if p.fullmatch(raw))


def distinct_words(text: str | None) -> set[bytes]:
    """Words between white space, as they are written."""
    return set((text or "").encode("utf-8", "surrogatepass").split())


_hashed = functools.lru_cache(1 << 16)(xxhash.xxh32_intdigest)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two least hashes of a document's words, as one number; copies mostly share them, other documents hardly ever."""
    for pdf in batches:
        least = [heapq.nsmallest(2, map(_hashed, distinct_words(t))) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "sketch": [(x[0] << 31) + x[-1] if x else -1 for x in least]})


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial weights of documents by entry and label, and of all (entry -1): two arrays of a fixed size."""
    entries = functools.lru_cache(1 << 16)(lambda w: described(w)[0])
    counts, every = np.zeros((2, len(FAMILIES) * BUCKETS), np.int64), [0, 0]
    for pdf in batches:
        for text, toxic, weight in zip(pdf["text"], pdf["toxic"].tolist(), pdf["weight"].tolist(), strict=True):
            every[toxic] += weight
            seen = set().union(*map(entries, distinct_words(text)))
            counts[toxic, np.fromiter(seen, np.int64, len(seen))] += weight
    for y in (0, 1):
        at = np.flatnonzero(counts[y])
        yield pd.DataFrame({"entry": np.append(at, -1), "toxic": bool(y), "n": np.append(counts[y][at], every[y])})


def lexicon(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(entry, voter) of those whose log-odds ratio is surely high. Only these come to the driver: at most BUCKETS a family."""
    of = counts.groupBy("entry").agg((F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)) / ONE).alias("a"), (F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))) / ONE).alias("b"))
    totals = of.where("entry = -1").first()
    p, q = (totals["a"], totals["b"]) if totals else (0, 0)
    ratio = F.log((F.col("a") + 0.5) / (p + 1)) - F.log((F.col("b") + 0.5) / (q + 1))
    doubt = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = of.where("entry >= 0 and a >= 2").withColumn("sure", ratio - 2.5 * doubt).where("sure > 0.5").select("entry", "sure").toPandas()
    found = found.sort_values(["sure", "entry"], ascending=[False, True])
    family = found["entry"].to_numpy(np.int64) // BUCKETS
    voter = np.zeros(len(found), np.int64)
    for i in range(len(FAMILIES)):  # slices by how sure they are
        own = np.flatnonzero(family == i)
        voter[own] = i * SLICES + np.arange(len(own)) * SLICES // max(1, len(own))
    order = np.argsort(found["entry"].to_numpy(np.int64))
    return found["entry"].to_numpy(np.int64)[order], voter[order]


def _vote(batches: Iterator[pd.DataFrame], entries: np.ndarray, voter: np.ndarray) -> Iterator[pd.DataFrame]:
    number = {e: i for i, e in enumerate(entries.tolist())}
    least = [n for _, n in PATTERNS.values()]
    nothing = ((), ())

    @functools.lru_cache(1 << 17)
    def known(word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        of, patterns = described(word)
        of = tuple(number[e] for e in of if e in number)
        return (of, patterns) if of or patterns else nothing  # one object for most words

    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            found, shown = set(), [0] * len(least)
            for w in distinct_words(text):
                of, patterns = known(w)
                found.update(of)
                for i in patterns:
                    shown[i] += 1
            found = sorted(found)
            mask = 0
            for v in voter[found].tolist() if found else ():
                mask |= 1 << v
            for i, n in enumerate(shown):
                mask |= (n >= least[i]) << (len(VOTERS) - len(PATTERNS) + i)
            rows.append((doc, mask, found))
        yield pd.DataFrame(rows, columns=["doc_id", "mask", "found"])


class LabelModel:
    """Two classes; voter j fires with probability fire[y, j]. weight[j] shares the evidence of voters that err together."""

    def __init__(self, votes: np.ndarray, gold: np.ndarray, count: np.ndarray, rounds: int = 40):
        self.weight = np.ones(votes.shape[1])
        known, tiny = gold >= 0, 0.5
        q = np.where(known, gold, (votes[:, : len(FAMILIES) * SLICES].sum(1) >= 2) * 0.9)
        for step in range(rounds):
            w = np.stack([count * (1 - q), count * q])
            self.fire = (w @ votes + tiny * np.array([[0.02], [0.5]])) / (w.sum(1, keepdims=True) + tiny)
            self.fire = np.clip(self.fire, 1e-5, 1 - 1e-5)
            self.prior = float(np.clip((w[1].sum() + 0.5) / (count.sum() + 1), 1e-4, 1 - 1e-4))
            if step % 8 == 7:
                self.correlation = self._residuals(votes, w)
                self.weight = 1 / np.maximum(1, np.abs(self.correlation).sum(1))
            q = np.where(known, gold, self.posterior(votes))

    def _residuals(self, votes: np.ndarray, w: np.ndarray) -> np.ndarray:
        cov = sum((votes - self.fire[y]).T @ ((votes - self.fire[y]) * w[y][:, None]) for y in (0, 1))
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        c = cov / np.outer(d, d)
        c[np.abs(c) < 0.1] = 0
        np.fill_diagonal(c, 1)
        return c

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = votes * (np.log(self.fire[1]) - np.log(self.fire[0])) + (1 - votes) * (np.log1p(-self.fire[1]) - np.log1p(-self.fire[0]))
        x = log @ self.weight + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


def train(found: list[list[int]], votes: np.ndarray, target: np.ndarray, n: int, steps: int = 400, decay: float = 2e-4) -> np.ndarray:
    """Weights of n entries, all votes and a bias, by logistic regression on soft labels (full-batch Adam)."""
    width = n + votes.shape[1] + 1
    rows = np.concatenate([np.repeat(np.arange(len(found)), [len(f) for f in found]), *np.nonzero(votes)[:1], np.arange(len(found))])
    cols = np.concatenate([np.concatenate([np.asarray(f, int) for f in found]) if found else np.empty(0, int), n + np.nonzero(votes)[1], np.full(len(found), width - 1)]).astype(int)
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        x = np.bincount(rows, w[cols], len(found))
        error = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - target
        g = np.bincount(cols, error[rows], width) / max(1, len(found)) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _score(batches: Iterator[pd.DataFrame], weights: np.ndarray) -> Iterator[pd.DataFrame]:
    n = len(weights) - len(VOTERS) - 1
    for pdf in batches:
        x = bits(pdf["mask"].to_numpy()) @ weights[n:-1] + weights[-1] + np.array([weights[np.asarray(f, int)].sum() for f in pdf["found"]], float)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x, -40, 40)))})


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score) for every row."""
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "toxicity")
    held_out = lambda c: fold(c, 3) == 1
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = tables.write(known, "labels")
    texts = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    sketched = texts.join(broadcast_if_small(known), "doc_id").mapInPandas(_sketch, "doc_id long, toxic int, sketch long")
    sketched = tables.write(sketched, "sketches")
    share = sketched.groupBy("sketch", "toxic").agg(F.greatest(F.lit(1), F.round(ONE / F.count(F.lit(1)))).cast("long").alias("weight"))
    weighed = tables.write(sketched.join(share, ["sketch", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("weight").alias("weight")), "weights")
    counts = texts.join(broadcast_if_small(weighed), "doc_id").mapInPandas(_count_features, "entry long, toxic boolean, n long")
    counts = tables.write(counts.groupBy("entry", "toxic").agg(F.sum("n").alias("n")), "counts")
    entries, voter = lexicon(counts)
    tables.drop("counts", "sketches", "weights")
    # Ids go through pandas as texts: a column of numbers with a null in it would become one of floats.
    named = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    votes = tables.write(named.mapInPandas(functools.partial(_vote, entries=entries, voter=voter), "doc_id string, mask long, found array<int>"), "votes")
    ids = texts.schema["doc_id"].dataType
    marked = votes.withColumn("doc_id", F.col("doc_id").cast(ids)).where(~held_out(F.col("doc_id"))).join(broadcast_if_small(known), "doc_id", "left")
    seen = marked.groupBy("mask", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 3 * 2^voters rows
    model = LabelModel(bits(seen["mask"].to_numpy(np.int64)), seen["toxic"].fillna(-1).to_numpy(float), seen["n"].to_numpy(float))
    rows = marked.orderBy(F.xxhash64("doc_id")).limit(sample).select("mask", "found", "toxic").toPandas()
    weights = np.zeros(len(entries) + len(VOTERS) + 1)
    weights[-1] = np.log(model.prior / (1 - model.prior))
    if len(rows) and (seen["toxic"] == 1).any():
        v = bits(rows["mask"].to_numpy(np.int64))
        p = model.posterior(v)
        g = rows["toxic"].map({1: GOLD, 0: 1 - GOLD}).fillna(0.5).to_numpy(float)
        weights = train([list(f) for f in rows["found"]], v, p * g / (p * g + (1 - p) * (1 - g)), len(entries))
    scored = votes.mapInPandas(functools.partial(_score, weights=weights), "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(ids))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def rejected(score: Column, threshold: float = 0.7) -> Column:
    return (score >= threshold).cast("int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", rejected(F.col("score")).alias("predicted"))
