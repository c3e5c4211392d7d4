"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words and runs of marks are tokens; each token and each pair of neighbours is hashed to one of 2**BITS
features, whose value is the logarithm of one more than its count, scaled to a vector of length one. Training
reads a bounded sample of labelled documents, example by example; scoring is a sparse dot product per document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
#: Labelled documents that training reads at most: those with the smallest hashes of their ids.
SAMPLE = 8000
#: Passes over a full sample; smaller ones get as many updates, in 40 passes at most.
EPOCHS, MOST_EPOCHS = 3, 40
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
THRESHOLD = 0.7
#: Entries of a worker's cache of token hashes.
CACHE = 500_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = h = zlib.crc32(token.encode())
        return h


_HASHES = _Hashes()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; none for one without tokens."""
    tokens = _TOKEN.findall(text.lower())
    one = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    two[one[:-1] == one[1:]] = 2  # a repeated token, whichever it is
    hashed = np.concatenate([one, two]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    index, count = np.unique(hashed.astype(np.int64), return_counts=True)
    value = np.log1p(count)
    return index, value / (np.sqrt(value @ value) or 1.0)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the examples in order. Returns the weights and the bias: the log-odds of the labels,
    so that a text without known n-grams scores as the sample at large does."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    good = sum(label for _, _, label in examples)
    bias = float(np.log((good + 0.5) / (len(examples) - good + 0.5)))
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(min(MOST_EPOCHS, -(-EPOCHS * SAMPLE // max(1, len(examples))))):
        for index, value, label in examples:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            grad = (1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35))) - label) * value
            more = ni + grad * grad
            z[index] = zi + grad - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[index] = more
    return weights(z, n).astype(np.float32), bias


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """docs: (doc_id, text), labels: (doc_id, quality). Learns from at most ``sample`` labelled documents that
    are not held out, in one task that holds their features. Returns the numbers and values of the weights
    that are not zero, 2**BITS at most, and the bias.

    Labels other than 0 and 1 are left out, and of several for one id the smallest counts; without any label
    all weights are zero.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [(*features(t), y) for batch in batches for t, y in zip(batch["text"], batch["label"])][:sample]
        weights, bias = train(examples)
        some = np.flatnonzero(weights)
        yield pd.DataFrame([(some.astype("<i4").tobytes(), weights[some].astype("<f4").tobytes(), bias)], columns=["index", "weight", "bias"])

    single = rows.repartition(1).sortWithinPartitions("order", "doc_id", "text").select("text", "label")
    found = single.mapInPandas(learn, "index binary, weight binary, bias double").first()
    if found is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(found["index"], "<i4"), np.frombuffer(found["weight"], "<f4"), found["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", to: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1. A text without tokens, a null one too, scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    loaded: dict[str, np.ndarray] = {}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, weight, bias = shared.value
        if "w" not in loaded:
            loaded["w"] = np.zeros(1 << BITS, np.float32)
            loaded["w"][index] = weight
        for batch in batches:
            found = (features(t) for t in batch)
            dots = np.fromiter((loaded["w"][i] @ v for i, v in found), np.float64, len(batch)) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    return docs.withColumn(to, F.pandas_udf(run, "double")(F.coalesce(text, F.lit(""))))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD) for each row of docs (doc_id, text). Repeated
    rows each give a row, a null doc_id stays null and is held out, an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, unchanged."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), to=name).filter(F.col(name) >= THRESHOLD).drop(name)
