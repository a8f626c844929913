"""Layer outputs against NumPy, and what is refused."""

import numpy as np
import pytest

from nearfield.operators.inference import Layer, layer_outputs


def test_layers_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    layers = [Layer(rng.normal(size=(4, 6)), rng.normal(size=6), "relu"), Layer(rng.normal(size=(6, 3)), rng.normal(size=3), "tanh"), Layer(rng.normal(size=(3, 2)), np.zeros(2))]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["layer"], r["id"]): r["v"] for r in layer_outputs(df, "v", layers, [0, 2]).collect()}
    a = np.maximum(x @ layers[0].weights + layers[0].offset, 0)
    c = np.tanh(a @ layers[1].weights + layers[1].offset) @ layers[2].weights
    assert len(got) == 2 * len(rows) and all(got[layer, k] is None for layer in (0, 2) for k in (900, 901, 902))
    assert all(np.allclose(got[0, k], a[k]) and np.allclose(got[2, k], c[k]) for k in range(300))
    assert layer_outputs(df.limit(0), "v", layers).count() == 0


@pytest.mark.parametrize("layers", [[Layer(np.ones((2, 3)), np.ones(2))], [Layer(np.ones((2, 3)), np.ones(3)), Layer(np.ones((2, 1)), np.ones(1))], [Layer(np.full((1, 1), np.nan), np.ones(1))], [Layer(np.ones((1, 1)), np.ones(1), "what")]])
def test_layers_that_do_not_fit_are_errors(spark, layers):
    with pytest.raises(ValueError):
        layer_outputs(spark.createDataFrame([], "id long, v array<double>"), "v", layers)
