"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digit substitutions to Latin
letters and everything else between words to one blank. Terms are beginnings of
words; their weights are log ratios of how often they stand in toxic and in clean
labelled texts. Phrases in which a term is harmless are learned as exceptions:
they match longer and count nothing. Sums are normalised by the number of words
and turned into a probability by a logistic function fitted on labelled rows that
the lexicon has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut
from corpusloom.llm import common as C

#: Bound of the labelled rows a model is fitted on, half for the lexicon and half for the weights.
SAMPLE = 40_000
#: A term needs this many toxic texts and this log ratio.
SUPPORT, LEAST = 8, 1.2
STRONG = 4.0
PREFIX = range(4, 11)

# Look-alikes of Latin small letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Joiners and the soft hyphen vanish, so they cannot part a word.
INVISIBLE = "­​‌‍⁠﻿"


def _table(top: int = 0x600) -> list:
    table = [chr(i) if chr(i).isalpha() else " " for i in range(top)]
    for a, b in (HOMOGLYPHS | DIGITS).items():
        if ord(a) < top:
            table[ord(a)] = b
    for a in INVISIBLE:
        if ord(a) < top:
            table[ord(a)] = ""
    return table


TABLE = _table()
WIDE = re.compile(r"[！-～]")
JOINERS = re.compile("[​-‍⁠﻿]")


def fold(text: str) -> str:
    """Folded words, each after one blank, and a last blank."""
    if not text.isascii():
        text = JOINERS.sub("", WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text))
    return " " + " ".join(text.lower().translate(TABLE).split()) + " "


class Lexicon:
    """Terms and exceptions with weights, matched leftmost-longest; the automaton is built once per worker."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "_automaton": None}

    def features(self, text: str) -> list[float]:
        """Strong and weak sums, plain and per hundred words, and the length."""
        if self.weights and self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, weight)
            self._automaton.make_automaton()
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        found = [w for _, w in self._automaton.iter_long(folded)] if self.weights else []
        strong = sum(w for w in found if w >= STRONG)
        weak = sum(w for w in found if w < STRONG)
        n = max(words, 1)
        return [float(np.log1p(strong)), 100 * strong / n, float(np.log1p(weak)), 100 * weak / n, float(np.log1p(n)) / 5, 1.0]


def labelled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, half, text) of at most ``bound`` labelled rows outside the held-out fold.

    Rows are taken in the order of a hash of the id. Rows without label or id are
    left out; of several labels of one id the highest counts.
    """
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    chosen = labels.filter("toxic is not null and doc_id is not null").filter(fold_of != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).alias("half"))
    return docs.select("doc_id", C.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``bound`` small rows


def counts(rows: DataFrame) -> DataFrame:
    """(term, n1, n0, d1): occurrences in toxic and clean texts, each text counted up to three times, and toxic texts."""
    schema = pa.schema([("term", pa.string()), ("n1", pa.int64()), ("n0", pa.int64()), ("d1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            sums = (Counter(), Counter())
            texts = (Counter(), Counter())
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                own: Counter = Counter()
                for word, n in Counter(words).items():
                    for k in PREFIX:
                        if len(word) > k:
                            own[word[:k]] += n
                    own[word] += n
                for pair, n in Counter(zip(words, words[1:], strict=False)).items():
                    own[" ".join(pair)] += n
                side = int(toxic == 1)
                sums[side].update({t: min(n, 3) for t, n in own.items()})
                texts[side].update(own.keys())
            terms = list(sums[0].keys() | sums[1].keys())  # all of them: what is rare in a slice need not be rare in the sample
            yield pa.RecordBatch.from_arrays([
                pa.array(terms, pa.string()), pa.array([sums[1][t] for t in terms], pa.int64()), pa.array([sums[0][t] for t in terms], pa.int64()),
                pa.array([texts[1][t] for t in terms], pa.int64())], schema=schema)

    return rows.select("text", "toxic").mapInArrow(run, "term string, n1 long, n0 long, d1 long").groupBy("term").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("d1").alias("d1"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Weighted terms and exceptions from labelled rows (text, toxic)."""
    table = cut(counts(rows))
    totals = table.filter("term not like '% %' and length(term) between 1 and 400").agg(F.sum("n1"), F.sum("n0")).first()
    all1, all0 = (totals[0] or 0) + 1, (totals[1] or 0) + 1
    ratio = F.log((F.col("n1") + 0.5) / all1) - F.log((F.col("n0") + 0.5) / all0)
    terms = [(r["term"], r["w"]) for r in table.filter("term not like '% %'").filter(F.col("d1") >= SUPPORT).withColumn("w", ratio).filter(
        F.col("w") >= LEAST).select("term", "w").collect()]  # bounded by the words of the sample
    weights: dict[str, float] = {}
    for term, weight in sorted(terms, key=lambda t: (len(t[0]), t[0])):
        above = max((weights.get(" " + term[:k], 0.0) for k in range(1, len(term))), default=0.0)
        if weight > above + 0.7:
            weights[" " + term] = weight
    # A phrase around a term that clean texts use and toxic ones hardly do.
    heads = [w.strip() for w in weights]
    if heads:
        parts = F.split("term", " ")
        starts = F.array(*[F.lit(h) for h in sorted(set(heads))])
        with_term = F.exists(starts, lambda h: parts[0].startswith(h) | parts[1].startswith(h))
        for r in table.filter("term like '% %' and n0 >= 5 and n1 * 4 <= n0").filter(with_term).select("term").collect():
            weights[" " + r["term"] + " "] = 0.0
    return Lexicon(weights)


def fit(rows: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon from one half of the labelled rows, logistic weights from the other."""
    rows = cut(rows)
    lexicon = learn_lexicon(rows.filter("half = 0"))
    schema = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            x = [lexicon.features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, schema[0].type), part.column("toxic").cast(pa.int64())], schema=schema)

    found = rows.filter("half = 1").select("text", "toxic").mapInArrow(run, "x array<double>, toxic long").collect()  # a few numbers per sampled row
    if not found:
        return lexicon, np.array([1.0, 0, 1.0, 0, 0, -2.0])
    told = sorted((r["x"], float(r["toxic"] == 1)) for r in found)  # sums of floats depend on the order of rows
    x, y = np.array([t[0] for t in told]), np.array([t[1] for t in told])
    return lexicon, logistic(x, y)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id and score of every row. Null and empty texts have no hits; rows are scored one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            x = np.array([lexicon.features(t) for t in part.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Empty tables give an empty result; without labels fixed weights apply to an empty lexicon."""
    docs = C.documents(spark, folder)
    lexicon, weights = fit(labelled(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, lexicon, weights).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
