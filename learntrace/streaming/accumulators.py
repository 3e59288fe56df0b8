"""Means, variances, votes and variances of gradients as streams of checkpoints.

Each checkpoint's rows arrive once, in any order. Scalars are plain streaming aggregates. Arrays by pixel and histograms of
votes are keyed states: an updating stream cannot aggregate twice, and a state does both steps at once. All of them merge, so the
order of checkpoints and their division among triggers do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from learntrace.operators import aggregates

VOTES = "example_id long, n long, ddd int, allacc double, consensuslabel int"
MOMENTS = "example_id long, n long, mean array<double>, variance array<double>"


class VoteProcessor(StatefulProcessor):
    """Votes for each label, and how many of them were right."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getMapState("votes", "pred int", "n long, right long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: tuple(v) for k, v in self.votes.iterator()}
        for frame in rows:
            for pred, acc in zip(frame["pred"].tolist(), frame["acc"].tolist(), strict=True):
                n, right = held.get(pred, (0, 0))
                held[pred] = n + 1, right + acc
            for pred in set(frame["pred"].tolist()):
                self.votes.updateValue((pred,), held[pred])
        n, right = (sum(v[i] for v in held.values()) for i in (0, 1))
        best = min(held, key=lambda pred: (-held[pred][0], pred))
        yield pd.DataFrame({"example_id": [key[0]], "n": [n], "ddd": [1 if right == n else -1 if not right else 0], "allacc": [right / n], "consensuslabel": [best]})

    def close(self) -> None:
        pass


def merged_moments(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and sum of squared deviations of two sets of rows, place by place."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


class MomentProcessor(StatefulProcessor):
    """Mean and squared deviations of each place of an array."""

    def __init__(self, value: str) -> None:
        self.value = value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean array<double>, m2 array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        now = None if held is None else (held[0], np.array(held[1]), np.array(held[2]))
        for frame in rows:
            x = np.stack(frame[self.value].tolist())
            new = len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)
            now = new if now is None else merged_moments(now, new)
        self.state.update((now[0], now[1].tolist(), now[2].tolist()))
        variance = (now[2] / (now[0] - 1)).tolist() if now[0] > 1 else None
        yield pd.DataFrame({"example_id": [key[0]], "n": [now[0]], "mean": [now[1].tolist()], "variance": [variance]})

    def close(self) -> None:
        pass


def pointwise_moments(stream: DataFrame, metrics: list[str]) -> DataFrame:
    """n, means and unbiased variances of scores by example."""
    return aggregates.online_pointwise(stream, ["example_id"], metrics)


def vote_scores(stream: DataFrame) -> DataFrame:
    """n, ddd, allacc and consensuslabel of (example_id, pred, acc) so far; equal votes go to the smaller label."""
    return stream.groupBy("example_id").transformWithStateInPandas(VoteProcessor(), VOTES, "Update", "None")


def array_moments(stream: DataFrame, value: str) -> DataFrame:
    """n, mean and variance of every place of an array column by example; a single row has no variance."""
    return stream.groupBy("example_id").transformWithStateInPandas(MomentProcessor(value), MOMENTS, "Update", "None")


def variance_of_gradients(moments: DataFrame) -> DataFrame:
    """``vog``: the mean over pixels of their variances over checkpoints."""
    return moments.select("example_id", (F.aggregate("variance", F.lit(0.0), lambda a, v: a + v) / F.size("variance")).alias("vog"))
