"""Outputs of all layers of a trained encoder for a whole table, in one pass.

The weights go to every task as a broadcast whose bytes are counted first; batches of rows are multiplied as blocks, and a row
answers with the output of each layer it was asked for. Nothing is gathered on the driver: the result is a table by id, and a
lost task is its own batches again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of weights that are sent to every executor, and rows that are multiplied at once.
MOST_BYTES, ROWS = 1 << 30, 2048
#: What may follow the weights of a layer.
ACTIVATIONS = {"none": lambda z: z, "relu": lambda z: np.maximum(z, 0.0), "tanh": np.tanh}


class Layer(NamedTuple):
    """Weights (in, out), offsets (out), and the name of what follows."""

    weights: np.ndarray
    offset: np.ndarray
    activation: str = "none"


def checked(layers: list[Layer], width: int | None = None) -> int:
    """The bytes of the layers; sizes that do not fit each other, numbers that are not finite and unknown names are errors."""
    for k, layer in enumerate(layers):
        w, b = np.asarray(layer.weights), np.asarray(layer.offset)
        if w.ndim != 2 or b.shape != (w.shape[1],) or width is not None and w.shape[0] != width:
            raise ValueError(f"layer {k}: weights {w.shape} and offset {b.shape} do not fit a width of {width}")
        if not (np.isfinite(w).all() and np.isfinite(b).all()):
            raise ValueError(f"layer {k} has numbers that are not finite")
        if layer.activation not in ACTIVATIONS:
            raise ValueError(f"layer {k}: unknown activation {layer.activation}")
        width = w.shape[1]
    return sum(np.asarray(x).nbytes for layer in layers for x in layer[:2])


def layer_outputs(rows: DataFrame, column: str, layers: list[Layer], wanted: list[int] | None = None) -> DataFrame:
    """(id, layer, v): the output of each wanted layer (by default the last) for each row, from an array column.

    Rows whose array is null, has a null, or is not as wide as the first layer have a null v; so nothing is dropped.
    """
    size = checked(layers)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of weights are more than {MOST_BYTES}")
    wanted = sorted(set([len(layers) - 1] if wanted is None else wanted))
    if wanted and not 0 <= wanted[0] <= wanted[-1] < len(layers):
        raise ValueError(f"no such layers: {wanted}")
    sent = rows.sparkSession.sparkContext.broadcast([Layer(np.asarray(w, float), np.asarray(b, float), a) for w, b, a in layers])
    width = np.asarray(layers[0].weights).shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                fits = part["v"].map(lambda v: v is not None and len(v) == width).to_numpy(bool)
                z = np.stack(part["v"].to_numpy()[fits]).astype(float) if fits.any() else np.zeros((0, width))
                for k, layer in enumerate(sent.value):
                    z = ACTIVATIONS[layer.activation](z @ layer.weights + layer.offset)
                    if k in wanted:
                        out = pd.Series([None] * len(part), dtype=object)
                        for place, v in zip(np.flatnonzero(fits), z):
                            out[place] = v
                        yield pd.DataFrame({"id": part["id"].to_numpy(), "layer": np.full(len(part), k, np.int32), "v": out})

    whole = F.when(F.forall(column, lambda x: x.isNotNull()), F.col(column).cast("array<double>"))
    return rows.select(F.col("id").cast("long").alias("id"), whole.alias("v")).mapInPandas(run, "id long, layer int, v array<double>")
