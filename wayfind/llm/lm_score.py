"""LM scoring by subword lattice likelihood, beside a smoothed word unigram.

*Vocabulary.* The pieces of an existing public tokenizer (a sentencepiece file, by path), with its byte pieces, so every text has some segmentation.
A piece that begins with the word mark only starts a word; so a text's lattice is the product of its words' lattices, and the probability
of a text is the product of its words' marginal probabilities over all segmentations, times that of the end piece.

*Scores.* The vocabulary's file has ranks in place of scores, so the first probabilities fall with the rank. They are fitted by EM to all
words of the training documents, each as often as it occurs: each task runs forward-backward over the words of its partition, and expected piece counts are summed by piece. Only
the vocabulary-sized table of scores (bounded by the tokenizer) reaches the driver and the tasks.

*Scoring.* Word scores are joined to documents. The most frequent words of ordinary length (a bounded number, by a threshold from a histogram of
counts) are sent to the tasks and cover most tokens; documents' other words are joined with the table of word scores by a shuffle. Nothing is dropped.

Cases: null and empty texts are the end token alone; texts of any length are scored whole, as their distinct words with counts; a very long word
is one lattice, linear in its length; equal rows get equal results; rows with a null id are training or held-out rows by the crc32 of an empty
text; without training documents base scores are those of V = N = 0 (log10 0.1 / 0.1) and pieces keep their first scores; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, fold
from .lattice import END, Lattice, load_vocabulary

#: Where the query finds its vocabulary, unless the session's ``spark.wayfind.vocabulary`` names another file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TINY, WORD_BYTES = 1e-9, 64


def first_scores(n: int) -> np.ndarray:
    """Natural logarithms of probabilities that fall with the rank of a piece."""
    p = 1 / (np.arange(n) + 10.0)
    return np.log(p / p.sum())


def words_of(text: str | None) -> list[bytes]:
    """Bytes are lower-cased and split as ASCII: A-Z only, and the white space from tab to carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    other: Counter = Counter()

    def flush() -> pd.DataFrame:
        keys = list(seen.keys() | other.keys())
        out = pd.DataFrame({"word": keys, "c": [seen.get(k, 0) for k in keys], "m": [other.get(k, 0) for k in keys]})
        seen.clear(), other.clear()
        return out

    for pdf in batches:
        for text, held in zip(pdf["text"], pdf["held_out"], strict=True):
            (other if held else seen).update(words_of(text))
            if len(seen) + len(other) > 400_000:
                yield flush()
    yield flush()


def _expect(batches: Iterator[pd.DataFrame], pieces: list[bytes], scores: np.ndarray) -> Iterator[pd.DataFrame]:
    lattice, counts = Lattice(pieces, scores), np.zeros(len(pieces))
    for pdf in batches:
        counts += lattice.expected(list(pdf["word"]), pdf["c"].to_numpy(float))
    yield pd.DataFrame({"piece": np.arange(len(pieces)), "n": counts})


def _word_scores(batches: Iterator[pd.DataFrame], pieces: list[bytes], scores: np.ndarray) -> Iterator[pd.DataFrame]:
    lattice = Lattice(pieces, scores)
    for pdf in batches:
        yield pdf.assign(lp=lattice.log_probabilities(list(pdf["word"])) / math.log(10))


def _score(batches: Iterator[pd.DataFrame], hot) -> Iterator[pd.DataFrame]:
    """Sums over a document's frequent words; its other words with their counts."""
    known = hot.value.get
    for pdf in batches:
        rows = []
        for at, text in zip(pdf["at"], pdf["text"], strict=True):
            counts = Counter(words_of(text))
            total, base, lattice, seen, cold = 0, 0.0, 0.0, 0, []
            for w, n in counts.items():
                total += n
                if (of := known(w)) is None:
                    cold.append((w, n))
                else:
                    base += n * of[0]
                    lattice += n * of[1]
                    seen += n * of[2]
            rows.append((at, total, seen, base, lattice, [w for w, _ in cold], [n for _, n in cold]))
        yield pd.DataFrame(rows, columns=["at", "n", "seen", "base", "lattice", "words", "times"])


def fit_scores(words: DataFrame, ends: int, pieces: list[bytes], rounds: int) -> np.ndarray:
    """The pieces' log scores after ``rounds`` of EM over the training words, each as often as it occurs. Each round sums a table as long as the vocabulary."""
    scores = first_scores(len(pieces))
    train = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        found = train.mapInPandas(functools.partial(_expect, pieces=pieces, scores=scores), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        found = found.where("n > 0").toPandas()
        n = np.zeros(len(pieces))
        n[found["piece"]] = found["n"]
        if not n.any():
            return scores
        n[pieces.index(END)] = max(ends, 1)
        n += TINY * n.sum()
        scores = np.log(n / n.sum())
    return scores


def frequent_words(words: DataFrame, most: int) -> dict[bytes, tuple[float, float, int]]:
    """(base, lattice, known) of at most ``most`` words of at most WORD_BYTES bytes, those with the highest counts: a histogram by steps of a
    quarter of an octave has a threshold that so many words reach."""
    short = words.where(F.length("word") <= WORD_BYTES).withColumn("step", F.floor(4 * F.log2(F.col("c") + F.col("m"))))
    least = None
    for row in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 4 * 63 rows
        most -= row["count"]
        if most < 0:
            break
        least = row["step"]
    if least is None:
        return {}
    top = short.where(F.col("step") >= least).select("word", "b", "p", (F.col("c") > 0).alias("known")).toArrow().to_pydict()
    return dict(zip(top["word"], zip(top["b"], top["p"], map(int, top["known"]), strict=True), strict=True))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, rounds: int = 2, frequent: int = 200_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row. Rows whose fold is 0 of 10 are held out."""
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "lm")
    held = fold(docs[key], 10) == 0
    rows = docs.select(docs[key].alias("doc_id"), held.alias("held_out"), docs[text].alias("text"))
    counted = rows.mapInPandas(_count, "word binary, c long, m long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    counted = tables.write(counted, "counts")
    ends = rows.where("not held_out").count()
    sums = counted.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    pieces = load_vocabulary(vocabulary or spark.conf.get("spark.wayfind.vocabulary", VOCABULARY))
    scores = fit_scores(counted, ends, pieces, rounds)
    words = counted.mapInPandas(functools.partial(_word_scores, pieces=pieces, scores=scores), "word binary, c long, m long, lp double")
    size = math.log10(train + 0.1 * (distinct + 1))
    words = words.select("word", "c", "m", (F.log10(F.col("c") + 0.1) - size).alias("b"), F.col("lp").alias("p"))
    words = tables.write(words, "words")
    hot = spark.sparkContext.broadcast(frequent_words(words, frequent))
    # A row's number: ids may be null or repeat.
    at = F.struct(F.coalesce(docs[key].cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(docs[text]).alias("t"))
    part = docs.select(at.alias("at"), docs[text].alias("text")).select(F.to_json("at").alias("at"), "text")
    part = part.mapInPandas(functools.partial(_score, hot=hot), "at string, n long, seen long, base double, lattice double, words array<binary>, times array<int>")
    part = tables.write(part.dropDuplicates(["at"]), "parts")
    cold = part.select("at", F.explode(F.arrays_zip("words", "times")).alias("w")).select("at", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    cold = cold.join(words.select("word", "c", "b", "p"), "word")
    cold = cold.groupBy("at").agg(F.sum(F.col("times") * F.col("b")).alias("b"), F.sum(F.col("times") * F.col("p")).alias("l"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    end_base = math.log10(ends + 0.1) - size
    end_score = scores[pieces.index(END)] / math.log(10)
    whole = part.drop("words", "times").join(cold, "at", "left").select(
        F.col("at").alias("_at"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("seen") + zero("s") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + end_base).alias("base_score"),
        (F.col("lattice") + zero("l") + end_score).alias("score"),
    )
    out = docs.select(docs[key].alias("doc_id"), held.alias("held_out"), F.to_json(at).alias("_at")).join(whole, "_at")
    return out.drop("_at")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text"))
