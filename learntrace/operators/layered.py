"""Models of several dense layers: evaluation with captured layers, and gradients by back-propagation.

A model is a table with a row a checkpoint and layer: ``step``, ``layer_idx``, ``name``, ``w`` (the weights row by row of outputs),
``b`` and ``activation`` (relu or none). It is gathered once through Arrow, within ``MAX_PARAMETERS`` numbers, and shared with the
tasks; examples (example_id, label, x) are scored in Arrow batches where they lie, so nothing is shuffled.

Modules are named as they run: a layer ``fc0`` with relu is ``fc0`` and ``fc0_relu``, and each module has an input and an
output, ``fc0.in`` and ``fc0.out``. The gradient of a layer's weights is the product of its error and its input, so its norm is the
product of theirs and no gradient is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrace.functions.matrices import lists, matrix
from learntrace.functions.vectors import doubles
from learntrace.operators import frames
from learntrace.operators.layers import distinct_layers, match_key

MAX_PARAMETERS = 20_000_000
CHUNK_VALUES = 1 << 22  # numbers of one layer's outputs over all checkpoints that are held at once
ACTIVATIONS = ("none", "relu")


@dataclass(frozen=True)
class Layer:
    """A dense layer of one checkpoint: outputs are activation(w x + b)."""

    name: str
    w: np.ndarray
    b: np.ndarray
    relu: bool


#: Layers of each checkpoint, in order, under the checkpoint's step.
Model = dict[int, list[Layer]]


def gathered(model: DataFrame) -> Model:
    """The model table as arrays. Layers that do not fit together or unknown activations are a ValueError."""
    size = model.agg(F.sum(F.size("w") + F.size("b"))).first()[0] or 0
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} parameters; at most {MAX_PARAMETERS} are shared with the tasks")
    table = model.select("step", "layer_idx", "name", "activation", doubles(F.col("w")).alias("w"), doubles(F.col("b")).alias("b")).toArrow().sort_by([("step", "ascending"), ("layer_idx", "ascending")]).combine_chunks()
    steps: Model = {}
    for i in range(table.num_rows):
        step, _, name, activation = (table.column(c)[i].as_py() for c in ("step", "layer_idx", "name", "activation"))
        w, b = (table.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("w", "b"))
        if activation not in ACTIVATIONS:
            raise ValueError(f"layer {name}: no activation {activation!r}")
        own = steps.setdefault(step, [])
        if not len(b) or len(w) % len(b) or own and len(w) // len(b) != len(own[-1].b):
            raise ValueError(f"layer {name} of step {step} takes no {len(own[-1].b) if own else len(w)} inputs")
        own.append(Layer(name, w.reshape(len(b), -1), b, activation == "relu"))
    return steps


def forward(layers: list[Layer], x: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Inputs and outputs of all modules, as they run; the last one holds the logits."""
    seen = []
    for layer in layers:
        seen.append((f"{layer.name}.in", x))
        x = x @ layer.w.T + layer.b
        seen.append((f"{layer.name}.out", x))
        if layer.relu:
            seen.append((f"{layer.name}_relu.in", x))
            x = np.maximum(x, 0)
            seen.append((f"{layer.name}_relu.out", x))
    return seen


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_error(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the cross-entropy by the logits."""
    return softmax(z) - (np.arange(z.shape[1]) == y[:, None])


def confidence_error(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the label's probability by the logits."""
    p = softmax(z)
    own = np.take_along_axis(p, y[:, None], 1)
    return own * ((np.arange(z.shape[1]) == y[:, None]) - p)


#: A loss as its gradient by the logits.
Error = Callable[[np.ndarray, np.ndarray], np.ndarray]


def backward(layers: list[Layer], x: np.ndarray, y: np.ndarray, error: Error, predicted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradient by the inputs, rows x dims, and the norm of the gradient by all parameters, a number a row."""
    seen = dict(forward(layers, x))
    z = seen[f"{layers[-1].name}{'_relu' if layers[-1].relu else ''}.out"]
    delta = error(z, z.argmax(axis=1) if predicted else y)
    squares = np.zeros(len(x))
    for layer in reversed(layers):
        if layer.relu:
            delta = delta * (seen[f"{layer.name}.out"] > 0)
        given = seen[f"{layer.name}.in"]
        squares += (delta * delta).sum(axis=1) * ((given * given).sum(axis=1) + 1)
        delta = delta @ layer.w
    return delta, np.sqrt(squares)


Scores = Callable[[Model, np.ndarray, np.ndarray], list[tuple[tuple, dict[str, np.ndarray]]]]


def scored(examples: DataFrame, model: DataFrame | Model, fn: Scores, keys: str, schema: str, inputs: str = "x") -> DataFrame:
    """``fn(model, x, y)`` over Arrow batches: it returns tables of the batch's rows, each with the values of its ``keys``."""
    layers = model if isinstance(model, dict) else gathered(model)
    shared = examples.sparkSession.sparkContext.broadcast(layers)
    widest = max((len(layer.b) for own in layers.values() for layer in own), default=1) * max(1, len(layers))
    names = [k.split()[0] for k in keys.split(", ")] if keys else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CHUNK_VALUES // max(widest, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, y = matrix(part.column(2)), part.column(1).to_numpy(zero_copy_only=False)
                for key, columns in fn(shared.value, x, y):
                    constant = [pa.array([k] * part.num_rows, pa.string() if isinstance(k, str) else pa.int32()) for k in key]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *constant, *map(lists, columns.values())], names=["example_id", "label", *names, *columns])

    rows = examples.select(F.col("example_id").cast("long"), F.col("label").cast("int"), doubles(F.col(inputs)).alias("x"))
    return rows.mapInArrow(run, ", ".join(s for s in ("example_id long, label int", keys, schema) if s))


def logits(examples: DataFrame, model: DataFrame | Model) -> DataFrame:
    """example_id, label, step and ``z``: inference over all checkpoints in one scan."""
    return scored(examples, model, lambda m, x, y: [((int(s),), {"z": forward(own, x)[-1][1]}) for s, own in m.items()], "step int", "z array<double>")


def module_names(layers: list[Layer]) -> list[str]:
    """Names of a checkpoint's inputs and outputs, in order."""
    return [n for layer in layers for n in (f"{layer.name}.in", f"{layer.name}.out", *((f"{layer.name}_relu.in", f"{layer.name}_relu.out") if layer.relu else ()))]


def activations(examples: DataFrame, model: DataFrame | Model, layers: list[str] | None = None) -> DataFrame:
    """example_id, label, step, layer_idx, layer and ``act``: the named inputs and outputs (None: all) of every checkpoint.

    Only what is named leaves the tasks. A name that no checkpoint has is a ValueError."""
    model = model if isinstance(model, dict) else gathered(model)
    known = {n for own in model.values() for n in module_names(own)}
    if layers is not None and set(layers) - known:
        raise ValueError(f"no layers {sorted(set(layers) - known)}; the model has {sorted(known)}")

    def named(m: Model, x: np.ndarray, y: np.ndarray) -> list[tuple[tuple, dict[str, np.ndarray]]]:
        return [((int(s), i, n), {"act": a}) for s, own in m.items() for i, (n, a) in enumerate(forward(own, x)) if layers is None or n in layers]

    return scored(examples, model, named, "step int, layer_idx int, layer string", "act array<double>")


def activations_by_run(examples: DataFrame, model: DataFrame | Model, layers: list[str], layers_per_run: int = 1) -> Iterator[DataFrame]:
    """Activations of a few of the layers at a time, each an inference of its own: what is held at once is bounded by
    ``layers_per_run`` and not by the number of layers."""
    model = model if isinstance(model, dict) else gathered(model)
    for at in range(0, len(layers), layers_per_run):
        yield activations(examples, model, layers[at : at + layers_per_run])


def discover_layers(spark: SparkSession, model: DataFrame | Model, include: list[str] | None = None, exclude: list[str] | None = None, inputs: DataFrame | None = None, n: int = 100, seed: int = 0) -> DataFrame:
    """layer_idx, layer and n of the first checkpoint's inputs and outputs that no earlier one equals, on ``inputs``
    (example_id, x) or on ``n`` normal ones."""
    model = model if isinstance(model, dict) else gathered(model)
    first = dict(list(model.items())[:1])
    rows = inputs if inputs is not None else frames.random_inputs(spark, n, first[next(iter(first))][0].w.shape[1], seed)
    names = activations(rows.withColumn("label", F.lit(0)), first).drop("label", "step")
    return distinct_layers(names.where(match_key(F.col("layer"), include, exclude)))


def input_gradient(examples: DataFrame, model: DataFrame | Model, error: Error = confidence_error, predicted: bool = False) -> DataFrame:
    """example_id, label, step and ``grad``, each checkpoint's gradient by the inputs."""
    return scored(examples, model, lambda m, x, y: [((int(s),), {"grad": backward(own, x, y, error, predicted)[0]}) for s, own in m.items()], "step int", "grad array<double>")


def grand_score(examples: DataFrame, model: DataFrame | Model, error: Error = loss_error) -> DataFrame:
    """example_id, label and ``grand``, the mean over checkpoints of the norm of the gradient by all parameters."""
    return scored(examples, model, lambda m, x, y: [((), {"grand": np.mean([backward(own, x, y, error)[1] for own in m.values()], axis=0)})], "", "grand double")


def variance_of_gradients(examples: DataFrame, model: DataFrame | Model, channels: int, error: Error = confidence_error, predicted: bool = False) -> DataFrame:
    """example_id, label and ``vog``: mean over pixels of the unbiased variance over checkpoints of the channel-mean gradient."""
    def vog(m: Model, x: np.ndarray, y: np.ndarray) -> list[tuple[tuple, dict[str, np.ndarray]]]:
        by_pixel = np.stack([backward(own, x, y, error, predicted)[0].reshape(len(x), channels, -1).mean(axis=1) for own in m.values()])
        return [((), {"vog": by_pixel.var(axis=0, ddof=1).mean(axis=1) if len(by_pixel) > 1 else np.full(len(x), np.nan)})]

    return scored(examples, model, vog, "", "vog double").withColumn("vog", F.when(~F.isnan("vog"), F.col("vog")))
