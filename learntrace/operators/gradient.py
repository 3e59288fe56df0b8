"""Gradient scores. Linear softmax models have closed forms; other models bring their own scorer.

Parameters of a linear model (a row a step and class) are a model, not data: they are gathered into
one array a step, whose size has the bound ``MAX_PARAMETERS``. Examples are scored in Arrow batches
where they lie, every checkpoint at once, so that variances over checkpoints need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learntrace.functions.matrices import lists, matrix
from learntrace.functions.vectors import doubles

MAX_PARAMETERS = 20_000_000
CHUNK = 512

#: A scorer takes parameters (steps x classes x dims, steps x classes), a batch of inputs and labels.
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def parameters(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights (step, class_idx, w, b) as arrays, in the order of steps and classes."""
    size = weights.agg(F.sum(F.size("w"))).first()[0] or 0
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} parameters; a linear model of at most {MAX_PARAMETERS} is gathered")
    rows = weights.select("step", "class_idx", doubles(F.col("w")).alias("w"), F.col("b").cast("double").alias("b")).toArrow().sort_by([("step", "ascending"), ("class_idx", "ascending")]).combine_chunks()
    steps = len(rows.column("step").unique())
    w = np.concatenate([matrix(c) for c in rows.column("w").chunks])
    return w.reshape(steps, rows.num_rows // steps, -1), rows.column("b").to_numpy().reshape(steps, -1)


def probabilities(w: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Softmax outputs, steps x rows x classes."""
    z = np.einsum("tcd,nd->tnc", w, x) + b[:, None, :]
    e = np.exp(z - z.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def _labels(p: np.ndarray, y: np.ndarray, predicted: bool) -> np.ndarray:
    return p.argmax(axis=2) if predicted else np.broadcast_to(y, p.shape[:2])


def class_gradient(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, predicted: bool = False) -> np.ndarray:
    """Input gradient of the label's confidence: p_y (W_y - sum_c p_c W_c), steps x rows x dims."""
    p = probabilities(w, b, x)
    own = _labels(p, y, predicted)
    py = np.take_along_axis(p, own[:, :, None], 2)
    return py * (np.take_along_axis(w, own[:, :, None], 1) - np.einsum("tnc,tcd->tnd", p, w))


def loss_gradient(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, predicted: bool = False) -> np.ndarray:
    """Input gradient of the cross-entropy: W'(p - onehot)."""
    p = probabilities(w, b, x)
    own = _labels(p, y, predicted)
    return np.einsum("tnc,tcd->tnd", p, w) - np.take_along_axis(w, own[:, :, None], 1)


def parameter_gradient_norm(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Norm of the loss gradient by all parameters: |p - onehot| sqrt(|x|^2 + 1), steps x rows."""
    p = probabilities(w, b, x)
    d = p - (np.arange(p.shape[2]) == np.asarray(y)[None, :, None])
    return np.sqrt((d * d).sum(axis=2) * ((x * x).sum(axis=1) + 1)[None])


def score_batches(examples: DataFrame, weights: DataFrame, fn: Callable[..., dict[str, np.ndarray]], schema: str, inputs: str = "x") -> DataFrame:
    """``fn(w, b, x, y)`` over Arrow batches of (example_id, label, inputs): named columns of the batch's rows."""
    w, b = parameters(weights)
    shared = examples.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = matrix(part.column(2))
                y = part.column(1).to_numpy(zero_copy_only=False)
                columns = fn(w, b, x, y)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(lists, columns.values())], names=["example_id", *columns])

    rows = examples.select(F.col("example_id").cast("long"), F.col("label").cast("int"), doubles(F.col(inputs)).alias("x"))
    return rows.mapInArrow(run, f"example_id long, {schema}")


def input_gradient(examples: DataFrame, weights: DataFrame, gradient: Scorer = class_gradient, predicted: bool = False) -> DataFrame:
    """example_id and ``grad``, the mean over checkpoints of the input gradient (one checkpoint: itself)."""
    return score_batches(examples, weights, lambda w, b, x, y: {"grad": gradient(w, b, x, y, predicted).mean(axis=0)}, "grad array<double>")


def input_gradients(examples: DataFrame, weights: DataFrame, gradient: Scorer = class_gradient, predicted: bool = False) -> DataFrame:
    """example_id, step and ``grad``, each checkpoint's input gradient."""
    steps = [r[0] for r in weights.select("step").distinct().orderBy("step").collect()]

    def each(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        return {f"g{t}": g for t, g in enumerate(gradient(w, b, x, y, predicted))}

    wide = score_batches(examples, weights, each, ", ".join(f"g{t} array<double>" for t in range(len(steps))))
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"g{t}").alias("grad")) for t, s in enumerate(steps)])
    return wide.select("example_id", F.explode(rows).alias("s")).select("example_id", "s.step", "s.grad")


def channel_means(gradients: DataFrame, channels: int) -> DataFrame:
    """``gradients`` with ``grad`` averaged over its channels, pixel by pixel."""
    pixels = F.size("grad") / channels
    of = lambda c, p: F.get("grad", (c * pixels + p).cast("int"))
    mean = F.transform(F.sequence(F.lit(0), (pixels - 1).cast("int")), lambda p: sum((of(c, p) for c in range(1, channels)), of(0, p)) / channels)
    return gradients.withColumn("grad", mean)


def variance_of_gradients(examples: DataFrame, weights: DataFrame, channels: int, gradient: Scorer = class_gradient, predicted: bool = False) -> DataFrame:
    """Mean over pixels of the unbiased variance over checkpoints of the channel-mean input gradient."""
    def vog(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        g = gradient(w, b, x, y, predicted)
        by_pixel = g.reshape(*g.shape[:2], channels, -1).mean(axis=2)
        return {"vog": by_pixel.var(axis=0, ddof=1).mean(axis=1)}

    return score_batches(examples, weights, vog, "vog double")


def pixel_states(examples: DataFrame, weights: DataFrame, channels: int, gradient: Scorer = class_gradient) -> DataFrame:
    """Mergeable states (n, mean, m2) of each example and pixel over the given checkpoints: the online form
    of :func:`variance_of_gradients`, merged with ``aggregates.merge_moments``."""
    def states(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        g = gradient(w, b, x, y, False)
        v = g.reshape(*g.shape[:2], channels, -1).mean(axis=2)
        return {"n": np.full(len(x), len(v)), "mean": v.mean(axis=0), "m2": v.var(axis=0) * len(v)}

    wide = score_batches(examples, weights, states, "n long, mean array<double>, m2 array<double>")
    return wide.select("example_id", "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("pixel", "s")).select("example_id", "pixel", "n", "s.mean", "s.m2")


def grand_score(examples: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean over checkpoints of the parameter gradient norm."""
    return score_batches(examples, weights, lambda w, b, x, y: {"grand": parameter_gradient_norm(w, b, x, y).mean(axis=0)}, "grand double")


def linear_logits(examples: DataFrame, weights: DataFrame) -> DataFrame:
    """Inference as a scan: example_id, step and logits ``z``."""
    steps = [r[0] for r in weights.select("step").distinct().orderBy("step").collect()]
    scored = score_batches(examples, weights, lambda w, b, x, y: {f"z{t}": np.einsum("cd,nd->nc", w[t], x) + b[t] for t in range(len(w))}, ", ".join(f"z{t} array<double>" for t in range(len(steps))))
    each = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"z{t}").alias("z")) for t, s in enumerate(steps)])
    return scored.select("example_id", F.explode(each).alias("s")).select("example_id", "s.step", "s.z")
