"""Scores of a stack of linear layers stored as safetensors."""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import EngineError

_erf = np.vectorize(math.erf, otypes=[np.float64])

#: Functions between layers; after the last there is none.
ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0),
    "gelu": lambda x: (0.5 * x * (1 + _erf(x / math.sqrt(2)))).astype(np.float32),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "tanh": np.tanh,
    "none": lambda x: x,
}
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}
#: Bytes of a model, at most: it goes to every executor.
MOST_BYTES = 256 << 20


@dataclass
class Model:
    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str

    def __call__(self, x: np.ndarray) -> np.ndarray:
        act = ACTIVATIONS[self.activation]
        for k, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if k + 1 < len(self.layers):
                x = act(x)
        return x


def _bad(path: str, what: str) -> EngineError:
    return EngineError("execution", f"predict: {path}: {what}")


def _activation(path: str, name: str) -> str:
    if name not in ACTIVATIONS:
        raise _bad(path, f"unknown activation {name!r}; one of {', '.join(ACTIVATIONS)}")
    return name


def parse_model(path: str, data: bytes, activation: str | None = None) -> Model:
    """A model from the bytes of its file.

    Layer N has the tensors ``N.weight`` (out, in) and ``N.bias``. The file's
    metadata names its activation under a key that is or ends in
    ``activation``; a query may name it too, and they must agree.
    """
    if len(data) < 8 or (size := struct.unpack("<Q", data[:8])[0]) > len(data) - 8:
        raise _bad(path, "not a safetensors file")
    try:
        header = json.loads(data[8 : 8 + size])
    except ValueError as e:
        raise _bad(path, f"not a safetensors file: {e}") from e
    meta = header.pop("__metadata__", None) or {}
    declared = next((v for k, v in meta.items() if k.rpartition(".")[2] == "activation"), None)
    if activation is not None:
        activation = _activation(path, activation)
    if declared is not None and activation not in (None, _activation(path, declared)):
        raise _bad(path, f"the file declares activation {declared!r} but the query asks for {activation!r}")
    activation = activation or declared
    if activation is None:
        raise _bad(path, f"the file declares no activation and the query names none; one of {', '.join(ACTIVATIONS)}")
    body, tensors = data[8 + size :], {}
    for name, t in header.items():
        if t["dtype"] not in _TYPES:
            raise _bad(path, f"{name} is {t['dtype']}; one of {', '.join(_TYPES)}")
        a, b = t["data_offsets"]
        flat = np.frombuffer(body[a:b], dtype=_TYPES[t["dtype"]])
        if flat.size != math.prod(t["shape"]):
            raise _bad(path, f"{name} does not fill its shape {t['shape']}")
        tensors[name] = flat.reshape(t["shape"]).astype(np.float32)
    found = {int(n[: -len(".weight")]): t for n, t in tensors.items() if n.endswith(".weight") and n[: -len(".weight")].isdigit()}
    if not found or sorted(found) != list(range(len(found))):
        raise _bad(path, "layers must be numbered from 0 without a gap")
    layers = []
    for k in range(len(found)):
        w, b = found[k], tensors.get(f"{k}.bias")
        if w.ndim != 2 or not w.size:
            raise _bad(path, f"{k}.weight must have two dimensions, none of them 0")
        if b is None or b.shape != (w.shape[0],):
            raise _bad(path, f"{k}.bias must have {w.shape[0]} values")
        if layers and layers[-1][0].shape[0] != w.shape[1]:
            raise _bad(path, f"layer {k - 1} gives {layers[-1][0].shape[0]} features and layer {k} takes {w.shape[1]}")
        layers.append((w, b))
    return Model(layers, activation)


def read_model(spark: SparkSession, path: str, activation: str | None = None) -> Model:
    """The model at a path that Spark's file systems can open, read once on the driver."""
    rows = spark.read.format("binaryFile").load(path).select("length", "path").limit(2).collect()
    if len(rows) != 1:
        raise _bad(path, "not one file")
    if rows[0]["length"] > MOST_BYTES:
        raise _bad(path, f"over {MOST_BYTES} bytes")
    return parse_model(path, bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), activation)


def scorer(spark: SparkSession, path: str, activation: str | None = None):
    """A vectorised function of a features column, for the model at a path."""
    return scorer_of(spark, read_model(spark, path, activation))


def scorer_of(spark: SparkSession, model: Model):
    """A vectorised function of a features column; null for a null vector or element."""
    shared = spark.sparkContext.broadcast(model)  # at most MOST_BYTES

    @F.arrow_udf("array<float>")
    def predict(features: pa.Array) -> pa.Array:
        model = shared.value
        width, out = model.layers[0][0].shape[1], model.layers[-1][0].shape[0]
        known = features.is_valid()
        vectors = features.filter(known)
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        if (sizes != width).any():
            raise ValueError(f"predict: the model takes {width} features")
        flat = vectors.flatten()
        x = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, width)
        gap = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        y = model(np.nan_to_num(x, nan=0.0) if gap.any() else x).astype(np.float32)
        # a row of the result for each row, null ones empty
        good = np.zeros(len(features), dtype=bool)
        good[np.flatnonzero(known.to_numpy(zero_copy_only=False))] = ~gap
        offsets = np.concatenate(([0], np.cumsum(good * out))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(y[~gap].ravel()), mask=pa.array(~good))

    return predict


def predict(spark: SparkSession, path: str, features: Column, activation: str | None = None) -> Column:
    """The model's outputs; null for a null vector or element."""
    return scorer(spark, path, activation)(features)
