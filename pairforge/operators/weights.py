"""Head weights in one container file: a length, a JSON header of names, types, shapes and places, then the tensors' bytes.

The layout is the public safetensors one.  A worker opens a file once and maps it, so heads share its pages and nothing is sent from the
driver; where the path is not a local one the file is read once a worker.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairforge.operators.encode import Head, Linear

KINDS = {"F64": np.dtype("<f8"), "F32": np.dtype("<f4"), "F16": np.dtype("<f2"), "BF16": np.dtype("<u2"), "I64": np.dtype("<i8")}
#: Heads of a retrieval model: whether each takes the mean away and normalises what it gives.
HEADS = {"text_proj": True, "protein_proj": True, "text_expand": False, "protein_expand": False}
SCALE, AT_ONCE = "logit_scale", 256


def save(path: str, tensors: Mapping[str, np.ndarray]) -> None:
    """Writes a container: floats and 64-bit integers of any shape."""
    names = {v: k for k, v in KINDS.items() if k != "BF16"}
    head, at, parts = {}, 0, []
    for name, x in tensors.items():
        raw = np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<"), copy=False)
        head[name] = {"dtype": names[raw.dtype], "shape": list(x.shape), "data_offsets": [at, at + raw.nbytes]}
        parts.append(raw.tobytes())
        at += raw.nbytes
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    fs, base = pafs.FileSystem.from_uri(path if ":" in path else f"file://{os.path.abspath(path)}")
    with fs.open_output_stream(base) as f:
        f.write(len(text).to_bytes(8, "little") + text + b"".join(parts))


@functools.lru_cache(8)
def load(path: str) -> dict[str, np.ndarray]:
    """The tensors by name, as views of the mapped file; bf16 becomes float32."""
    local = path.removeprefix("file://")
    if os.path.exists(local):
        raw = np.memmap(local, np.uint8, "r")
    else:
        fs, base = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(base) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    out = {}
    for name, t in head.items():
        if name == "__metadata__":
            continue
        lo, hi = t["data_offsets"]
        x = raw[8 + size + lo : 8 + size + hi].view(KINDS[t["dtype"]]).reshape(t["shape"])
        out[name] = (x.astype(np.uint32) << np.uint32(16)).view(np.float32) if t["dtype"] == "BF16" else x
    return out


def head(tensors: Mapping[str, np.ndarray], name: str, projects: bool) -> Head:
    """One head of a model: three linear layers with GELU and layer norms between."""
    wanted = [f"{name}.{part}.{x}" for part in ("fc1", "norm1", "fc2", "norm2", "fc3") for x in ("weight", "bias")] + [f"{name}.mean_in"] * projects
    if missing := [w for w in wanted if w not in tensors]:
        raise ValueError(f"the weights lack {missing}")
    of = lambda part, x: np.asarray(tensors[f"{name}.{part}.{x}"], np.float64)
    layers = [Linear(of(f"fc{k}", "weight"), of(f"fc{k}", "bias")) for k in (1, 2, 3)]
    for k, (a, b) in enumerate(zip(layers, layers[1:], strict=False), 1):
        widths = {len(a.bias), a.weight.shape[0], b.weight.shape[1], len(of(f"norm{k}", "weight")), len(of(f"norm{k}", "bias"))}
        if len(widths) != 1:
            raise ValueError(f"{name}: layer {k} and what follows have widths {sorted(widths)}")
    mean = np.asarray(tensors[f"{name}.mean_in"], np.float64) if projects else None
    if mean is not None and mean.shape != (layers[0].weight.shape[1],):
        raise ValueError(f"{name}: a mean of {mean.shape} for inputs of {layers[0].weight.shape[1]}")
    return Head(layers, [of(f"norm{k}", "weight") for k in (1, 2)], [of(f"norm{k}", "bias") for k in (1, 2)], mean, projects)


def model(path: str) -> dict[str, Head | float]:
    """All heads of a container, and the temperature's logarithm where it has one; tensors that belong to none raise, as missing ones do."""
    tensors = load(path)
    if strange := [k for k in tensors if k != SCALE and k.partition(".")[0] not in HEADS]:
        raise ValueError(f"the weights hold {strange} besides heads")
    there = {k.partition(".")[0] for k in tensors} - {SCALE}
    out: dict[str, Head | float] = {name: head(tensors, name, HEADS[name]) for name in HEADS if name in there}
    return out | ({SCALE: float(np.asarray(tensors[SCALE]))} if SCALE in tensors else {})


def project(df: DataFrame, tokens: str, path: str, name: str, out: str = "z") -> DataFrame:
    """df with a column `out`: the token vectors of each row through the head `name` of the container at `path`, which every worker maps for itself.

    Null and empty rows have no vectors; a batch goes through the head as one matrix.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])
    where = df.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = model(path).get(name)
        if chosen is None:
            raise ValueError(f"{path} holds no head {name}")
        for rows in batches:
            for lo in range(0, rows.num_rows, AT_ONCE):
                part = rows.slice(lo, AT_ONCE)
                lists = part.column(where)
                counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                vectors = lists.flatten()
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(counts.sum()), -1) if counts.sum() else np.zeros((0, len(chosen.layers[0].weight[0])))
                y = chosen(x)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([*part.columns, nested], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def state(heads: Mapping[str, Head]) -> dict[str, np.ndarray]:
    """Heads as tensors for `save`."""
    out = {}
    for name, h in heads.items():
        for k, layer in enumerate(h.layers, 1):
            out |= {f"{name}.fc{k}.weight": layer.weight, f"{name}.fc{k}.bias": layer.bias}
        for k, (scale, shift) in enumerate(zip(h.scales, h.shifts, strict=True), 1):
            out |= {f"{name}.norm{k}.weight": scale, f"{name}.norm{k}.bias": shift}
        if h.mean is not None or h.normalised:
            out[f"{name}.mean_in"] = h.mean if h.mean is not None else np.zeros(h.layers[0].weight.shape[1])
    return out
