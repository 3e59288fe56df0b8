"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise
interactions in time linear in the features. Features come from the text alone: its distinct words,
hashed; bucketed structure statistics; and, as metadata, its length and the scripts it is written in.

The model is fitted in numpy on the driver from a bounded sample of labelled rows (``SAMPLE``, whose
features, not texts, are gathered); every document is then scored where it lies.

Defined results: a null text counts as empty and gets a score like any other; without labels of both
classes every score is the share of the known labels (0.5 without any); repeated rows get repeated
scores; texts are read whole, however long, in bounded groups of rows; a score that ties with the cut counts as 1; an empty table
gives an empty table; other columns stay as they are, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learntrace.llm.learning import fold, labelled_sample

FOLDS, HELD_OUT = 4, 2
SAMPLE = 12_000  # labelled rows that the model is fitted on, in expectation
WORDS = 1 << 15  # hash buckets of words; statistics come after them
RANK = 8
EPOCHS = 12
BATCH = 128
CUT = 0.7

#: Name, upper ends of the buckets.
STATISTICS = (
    ("words", (5, 10, 20, 40, 80, 160, 320, 640, 1280, 5120)), ("mean_word", (2, 3, 4, 5, 6, 7, 8, 10, 14)), ("distinct_share", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    ("symbols_per_word", (0.001, 0.01, 0.05, 0.1, 0.3, 0.6, 1, 2, 3)), ("capitals_share", (0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6, 0.8)), ("exclamations_per_word", (0.001, 0.01, 0.1, 0.3, 0.6, 1)),
    ("same_neighbour_share", (0.001, 0.01, 0.05, 0.1, 0.2, 0.4, 0.6)), ("repeated_line_share", (0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)), ("digits_share", (0.001, 0.01, 0.03, 0.1, 0.3)),
    ("stops_per_word", (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3)), ("lines", (1, 2, 4, 8, 16, 32, 64)), ("non_ascii_share", (0.001, 0.01, 0.03, 0.06, 0.1, 0.3)), ("length_log2", tuple(range(2, 20))),
)
_FIRST = np.cumsum([WORDS, *[len(e) + 1 for _, e in STATISTICS]])
N_FEATURES = int(_FIRST[-1])
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: one statistic bucket each, and words that share one unit of weight."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    between = lambda a, b: int(np.count_nonzero(points - np.uint32(a) <= b - a))
    upper = between(0x41, 0x5A) + between(0xC0, 0xDE)
    other = between(0x80, 0x10FFFF)
    letters = max(1, between(0x41, 0x5A) + between(0x61, 0x7A) + other)
    stats = (
        len(words), sum(map(len, words)) / n, len(distinct) / n, (len(text) - len(text.translate(_SYMBOLS))) / n, upper / letters, text.count("!") / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / max(1, len(lines)), between(0x30, 0x39) / size,
        text.count(".") / n, len(lines), other / size, math.log2(size),
    )
    at = [int(f) + int(np.searchsorted(ends, s)) for f, (_, ends), s in zip(_FIRST, STATISTICS, stats, strict=False)]
    hashed = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (WORDS - 1) for w in distinct), dtype=np.int32, count=len(distinct)))
    values = np.r_[np.ones(len(at)), np.full(len(hashed), 1 / math.sqrt(max(1, len(hashed))))].astype(np.float32)
    return np.r_[np.array(at, dtype=np.int32), hashed], values


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of documents whose features lie one after another, and their factor sums."""
        vx = self.factors[at] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.weights[at] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 42) -> FactorisationMachine:
    """AdaGrad on the logistic loss; rows are taken in an order drawn from the seed."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    machine = FactorisationMachine(math.log(max(share, 1e-3) / max(1 - share, 1e-3)), np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK)))
    if not len(labels) or not 0 < share < 1:
        machine.factors[:] = 0
        return machine
    gw, gv = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            own = order[b : b + BATCH]
            sizes = np.array([len(rows[i][0]) for i in own])
            at, values = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]).astype(float)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            z, sums = machine.raw(at, values, starts)
            g = (_sigmoid(z) - labels[own]) / len(own)
            of = np.repeat(np.arange(len(own)), sizes)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, weights=g[of] * values, minlength=len(used)) + decay * machine.weights[used]
            slope = (g[of] * values)[:, None] * (sums[of] - machine.factors[at] * values[:, None])
            dv = np.column_stack([np.bincount(back, weights=slope[:, f], minlength=len(used)) for f in range(RANK)]) + decay * machine.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            machine.weights[used] -= rate * dw / np.sqrt(gw[used])
            machine.factors[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            machine.bias -= rate * 0.1 * float(g.sum())
    return machine


def _packed(texts: pd.Series) -> pd.DataFrame:
    found = [features(t) for t in texts]
    return pd.DataFrame({"at": [a.astype("<i4").tobytes() for a, _ in found], "values": [v.astype("<f4").tobytes() for _, v in found]})


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = SAMPLE) -> FactorisationMachine:
    kind = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("values", T.BinaryType())])
    sample = labelled_sample(docs.select(key, text), labels.select(key, label), label, FOLDS, HELD_OUT, rows, key)
    got = sample.select(key, "label", F.pandas_udf(_packed, kind)(F.col(text)).alias("f")).select(key, "label", "f.at", "f.values").toPandas().sort_values([key, "at"])
    return fit([(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4")) for a, v in zip(got["at"], got["values"], strict=True)], got["label"].to_numpy(float))


def scored(docs: DataFrame, machine: FactorisationMachine, text: str = "text", out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)))

    def score(texts: pd.Series) -> pd.Series:
        own = FactorisationMachine(*shared.value)
        result = []
        for first in range(0, len(texts), 256):  # bounded memory for long texts
            found = [features(t) for t in texts.iloc[first : first + 256]]
            starts = np.r_[0, np.cumsum([len(a) for a, _ in found])[:-1]]
            z, _ = own.raw(np.concatenate([a for a, _ in found]), np.concatenate([v for _, v in found]), starts)
            result.append(_sigmoid(z.astype(float)))
        return pd.Series(np.concatenate(result) if result else np.zeros(0))

    return docs.withColumn(out, F.pandas_udf(score, T.DoubleType())(F.col(text)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    held: Column = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    df = scored(docs.select("doc_id", "text"), train(docs, labels))
    return df.select("doc_id", held, "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
