"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; the document
is toxic if at least one sentence is, so its score is the noisy-or of theirs, 1 - prod(1 - p). Sentences
with the same telling words are one, as are all those without any. Only the worst and those that are
toxic rather than not enter the noisy-or: many harmless ones don't add up, however long the text. Training
uses labels of documents only: the gradient of their log-likelihood passes through the noisy-or and falls
mostly on the sentences that explain the label. The trained model then scores all texts, and says which
sentence offends.

A word's weight is the sum of those of the word and of its first four and five letters, so that unseen
forms of a known stem count too. The model holds only what several training documents have, so its size
is bounded by theirs. Null and empty texts have no sentence that says anything; they get the score of an
empty sentence. Texts of any length are scored whole, and each row for itself; an empty table gives no rows. Without labels
of both kinds the model knows no words. Other columns of the documents aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.llm.storage import staged

#: The labelled documents that a model is fitted on at most; of each, all different telling sentences.
MAX_TRAIN = 6000
_SENTENCE = re.compile(r"[.!?;:\n\r  。！？]+")
_EDGES = " \t,\"'()[]{}<>|*_~`«»“”‘’¡¿…-#$%&"


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    """What a lower-case word is known by: itself and its beginnings; nothing if only marks are left."""
    word = word.strip(_EDGES)
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n)] if word else []


class _Known(dict):
    """The features that a model has, of the words that a worker has met, up to a bound."""

    def __init__(self, names: Container[str]):
        super().__init__()
        self.names = names

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = [f for f in features(word) if f in self.names]
        return found


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence that has a word."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def bag(text: str) -> list[list[str]]:
    """The distinct words of each sentence that has any, in lower case."""
    found = [sorted({*part.split()}) for part in _SENTENCE.split(text.lower())]
    return [words for words in found if words]


def _telling_sentences(text: str, known: _Known) -> list[tuple[str, ...]]:
    """The known features of each sentence that has any, equal ones once."""
    found = {tuple(sorted(f for w in {*part.split()} for f in known[w])) for part in _SENTENCE.split(text.lower())}
    return sorted(found - {()})


def _counts(odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which sentences enter the noisy-or of their document in training; ``starts``: the first one of each document."""
    worst = np.repeat(np.maximum.reduceat(odds, starts), np.diff(np.append(starts, len(odds))))
    return (odds >= 0) | (odds == worst)


def _fit(names: list[str], bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-5, lift: float = 2.0) -> Model:
    """Adam on the mean log-loss of documents, toxic ones counted ``lift`` times.

    ``bags``: for each document the ``names`` that its sentences have, one sentence's after another's, and how many each has, of
    those sentences that have any; the rest is one more, without.
    """
    toxic = labels.astype(bool)
    sizes = [np.append(0, size) for _, size in bags]
    column_of = np.concatenate([columns for columns, _ in bags]).astype(np.int64)
    docs = np.repeat(np.arange(len(bags)), [len(size) for size in sizes])
    sentence_of = np.repeat(np.arange(len(docs)), np.concatenate(sizes))
    starts = np.searchsorted(docs, np.arange(len(labels)))
    n, weights, bias = len(labels), np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(sentence_of, weights[column_of], minlength=len(docs)) + bias
        p = np.where(_counts(score, starts), 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0)
        clean = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)  # log of the chance that no sentence is toxic
        clean = np.minimum(clean, -1e-9)
        pull = np.where(toxic, lift * np.exp(clean) / np.expm1(clean), 1.0)  # of the loss, by a sentence's log-odds over p
        grad = pull[docs] * p / n
        full = np.append(np.bincount(column_of, grad[sentence_of], minlength=len(names)) + decay * weights, grad.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(dict(zip(names, weights.tolist())), float(bias))


def _telling(rows: DataFrame, n: int, n1: int, chi2: float) -> list[str]:
    """The features that more of the toxic documents have, by a chi-square of at least ``chi2``; counted on the executors.

    Only they get a weight: a clean word can't make up for a toxic one, and chance goes with the rest.
    """

    @F.pandas_udf("array<string>")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([list({f for words in bag(t) for w in words for f in features(w)}) for t in texts])

    counts = rows.select("toxic", F.explode(known("text")).alias("feature")).groupBy("feature").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("of"))
    gap = F.col("a") * n - F.col("of") * n1  # above 0 if more of the toxic documents have it
    spread = F.greatest(F.lit(1.0), F.col("of") * (n - F.col("of")) * float(n1 * (n - n1)))
    return sorted(r.feature for r in counts.where((gap > 0) & (n * gap * gap / spread >= chi2)).select("feature").collect())


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, chi2: float = 25.0, text: str = "text") -> Model:
    """Fits a model to ``labels`` (doc_id, toxic) of rows that aren't held out.

    At most ``max_train`` labelled documents are taken, by a hash of their ids, each whole. Words are counted on the executors;
    the driver gets the telling ones and of each document, as packed numbers, which of them each different sentence with any
    has. Null labels and ids are left out, an id with several labels is toxic if one is.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = staged(rows.repartition(16, "doc_id"), "training")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n1 in (0, n):
        return Model({}, -5.0)  # nothing to tell apart
    names = _telling(rows, n, n1, chi2)
    shared = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column, known = shared.value, _Known(shared.value)
        for part in batches:
            found = [[[column[f] for f in s] for s in _telling_sentences(t, known)] for t in part["text"]]
            columns = [np.array([c for s in bag for c in s], np.int32).tobytes() for bag in found]
            sizes = [np.array([len(s) for s in bag], np.int32).tobytes() for bag in found]
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "columns": columns, "sizes": sizes})

    got = sorted(rows.mapInPandas(numbered, "doc_id long, toxic int, columns binary, sizes binary").collect(), key=lambda r: (r.doc_id, bytes(r.columns)))
    return _fit(names, [(np.frombuffer(r.columns, np.int32), np.frombuffer(r.sizes, np.int32)) for r in got], np.array([r.toxic for r in got]))


def _log_odds(found: list[tuple[str, ...]], model: Model) -> np.ndarray:
    """Of sentences, by their known features."""
    return np.array([sum(model.weights[f] for f in s) for s in found]) + model.bias


def _score(text: str, known: _Known, model: Model) -> float:
    odds = _log_odds([(), *_telling_sentences(text, known)], model)
    odds = odds[odds >= 0] if odds.max() >= 0 else odds.max(keepdims=True)
    return float(-np.expm1(-np.logaddexp(0, np.clip(odds, -30, 30)).sum()))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The documents' score as a column of ``docs``; the model, whose size the training bounds, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        known = _Known(model.weights)
        for texts in batches:
            yield pd.Series([_score(t or "", known, model) for t in texts])

    return scored(F.col(text))


def locate(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """doc_id, start, end, score of every sentence whose own score is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, odds = shared.value, np.log(least / (1 - least))
        known = _Known(model.weights)
        for rows in batches:
            found = []
            for doc, text in zip(rows["doc_id"], rows["text"]):
                at = sentences(text)
                each = _log_odds([tuple(sorted(f for w in {*text[a:b].lower().split()} for f in known[w])) for a, b in at], model)
                found += [(doc, a, b, float(1 / (1 + np.exp(-s)))) for (a, b), s in zip(at, each) if s >= odds]
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "score"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(find, "doc_id long, start long, end long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row."""
    model = train(docs, labels, max_train)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
