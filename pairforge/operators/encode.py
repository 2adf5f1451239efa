"""Model inference as a stage: text to token vectors through a plain callable, in Arrow batches.

An encoder takes a list of strings and gives for each a float array of shape (tokens, width), valid tokens only.  It is made
once a worker by a factory, so weights are loaded there and never sent from the driver.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], list[np.ndarray]]
Scorer = Callable[[list[list[str]], list[list[str]]], list[np.ndarray]]
MOST_TOKENS, WINDOW = 1 << 14, 1024  # tokens of a batch with its padding; rows that are sorted by length together
ERF_STEP, ERF_END = 1 / 1024, 6.0


def hash_encoder(width: int = 16, most: int = 512) -> Encoder:
    """A stand-in without weights: each blank-separated token's vector follows from its digest."""

    def vector(token: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
        return np.random.default_rng(seed).standard_normal(width).astype(np.float32)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.stack([vector(t) for t in x.split()[:most]]) if x.split() else np.zeros((0, width), np.float32) for x in texts]

    return encode


def by_length(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Indices in batches of like sizes: the longest of a batch times its members is at most `most`; a longer one comes alone."""
    batch: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if batch and max(1, sizes[batch[0]]) * (len(batch) + 1) > most:
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def blank_separated(text: str) -> int:
    return len(text.split())


def nested_vectors(vectors: list[np.ndarray], width: int = 0) -> pa.Array:
    """Arrays of shape (tokens, width) as lists of lists of floats, from one buffer."""
    width = next((v.shape[1] for v in vectors if len(v)), width)
    flat = np.concatenate([np.zeros(0, np.float32), *(np.ascontiguousarray(v, np.float32).ravel() for v in vectors if len(v))])
    ends = np.cumsum([0, *(len(v) for v in vectors)])
    inner = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1, dtype=np.int32) * width), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner)


def encode(df: DataFrame, text: str, factory: Callable[[], Encoder], out: str = "tokens", most_tokens: int = MOST_TOKENS, window: int = WINDOW, size: Callable[[str], int] = blank_separated) -> DataFrame:
    """df with a column `out` of token vectors; null texts are empty.

    Texts of like length are encoded together: within `window` rows they are sorted by `size`, and a batch holds at most `most_tokens` tokens
    with its padding, or one text; rows keep their order.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.FloatType())))])
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for rows in batches:
            for lo in range(0, rows.num_rows, window):
                part = rows.slice(lo, window)
                texts = [x or "" for x in part.column(where).to_pylist()]
                vectors: list = [None] * len(texts)
                for batch in by_length([size(x) for x in texts], most_tokens):
                    for k, v in zip(batch, model([texts[k] for k in batch]), strict=True):
                        vectors[k] = v
                yield pa.RecordBatch.from_arrays([*part.columns, nested_vectors(vectors)], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def pseudo_perplexity(df: DataFrame, key: str, tokens: str, factory: Callable[[], Scorer], passes: int = 8, mask: str = "<mask>", specials: tuple[str, ...] = (), most_tokens: int = MOST_TOKENS, window: int = WINDOW) -> DataFrame:
    """(key, n, pppl): the exponent of the mean loss over the tokens that are no specials, each scored once while it is hidden.

    In pass j all such tokens at positions p with p mod passes = j are hidden together, so `passes` runs of the model score every position;
    passes in which nothing is hidden are left out.  pppl is not a number where there is nothing to score.  A scorer takes token lists with hidden tokens and the true lists,
    and gives the logarithm of each true token's probability, for every position.  Keys are distinct; passes stay in their row's task, and only sums leave it.
    """
    if passes < 2:
        raise ValueError("at least two passes: one alone would hide all that a token could be told from")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("t"))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for rows in batches:
            for lo in range(0, rows.num_rows, window):
                part = rows.slice(lo, window)
                lists = part.column(1).to_pylist()
                total, count = np.zeros(len(lists)), np.zeros(len(lists), np.int64)
                hidden = []
                for i, t in enumerate(lists):
                    open_to = [p for p, x in enumerate(t) if x not in specials]
                    count[i] = len(open_to)
                    hidden += [(i, j) for j in sorted({p % passes for p in open_to})]
                for batch in by_length([len(lists[i]) for i, _ in hidden], most_tokens):
                    truth = [lists[hidden[k][0]] for k in batch]
                    seen = [[mask if p % passes == hidden[k][1] and x not in specials else x for p, x in enumerate(t)] for k, t in zip(batch, truth, strict=True)]
                    for k, t, logp in zip(batch, truth, model(seen, truth), strict=True):
                        i, j = hidden[k]
                        total[i] += sum(float(logp[p]) for p in range(j, len(t), passes) if t[p] not in specials)
                with np.errstate(invalid="ignore"):
                    value = np.where(count > 0, np.exp(-total / np.maximum(count, 1)), np.nan)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(value)], names=["key", "n", "pppl"])

    found = rows.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType()), T.StructField("pppl", T.DoubleType())]))
    return found.withColumnRenamed("key", key)


def counting_scorer(vocabulary: int, mask: str = "<mask>") -> Scorer:
    """A stand-in for a masked model: a token's probability is its share of what the sequence shows, with one more of each."""

    def score(seen: list[list[str]], truth: list[list[str]]) -> list[np.ndarray]:
        out = []
        for shown, gold in zip(seen, truth, strict=True):
            there = Counter(x for x in shown if x != mask)
            out.append(np.log([(there[x] + 1) / (there.total() + vocabulary) for x in gold]))
        return out

    return score


@dataclass
class Linear:
    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias


@functools.lru_cache(1)
def _erf_grid() -> tuple[np.ndarray, np.ndarray]:
    """erf and its slope on a grid up to where it is 1."""
    x = np.arange(int(ERF_END / ERF_STEP) + 2) * ERF_STEP
    return np.array([math.erf(v) for v in x.tolist()]), 2 / math.sqrt(math.pi) * np.exp(-(x**2)) * ERF_STEP


def erf(x: np.ndarray) -> np.ndarray:
    """The error function within 1e-13 by cubic interpolation between grid points whose slopes are known."""
    value, slope = _erf_grid()
    a = np.minimum(np.abs(np.asarray(x, np.float64)), ERF_END) / ERF_STEP
    k = a.astype(np.int64)
    t = a - k
    p, q, m, n = value[k], value[k + 1], slope[k], slope[k + 1]
    return np.copysign(p + t * (m + t * (3 * (q - p) - 2 * m - n + t * (2 * (p - q) + m + n))), x)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * scale + shift


@dataclass
class Head:
    """Three linear layers with GELU and layer norms between; centred and normalised where it projects, plain where it expands."""

    layers: list[Linear]
    scales: list[np.ndarray]
    shifts: list[np.ndarray]
    mean: np.ndarray | None = None
    normalised: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.mean is not None:
            x = x - self.mean
        for layer, scale, shift in zip(self.layers, self.scales, self.shifts, strict=False):
            x = layer_norm(gelu(layer(x)), scale, shift)
        x = self.layers[-1](x)
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12) if self.normalised else x


def made_head(widths: list[int], seed: int = 0, mean: np.ndarray | None = None, normalised: bool = True) -> Head:
    """A head with seeded weights, for tests and dry runs."""
    rng = np.random.default_rng(seed)
    layers = [Linear(rng.standard_normal((b, a)) / math.sqrt(a), np.zeros(b)) for a, b in zip(widths, widths[1:], strict=False)]
    inner = widths[1:-1]
    return Head(layers, [np.ones(w) for w in inner], [np.zeros(w) for w in inner], mean, normalised)


def with_head(encoder: Encoder, head: Head) -> Encoder:
    """An encoder whose vectors went through the head, all tokens of a batch at once."""

    def encode(texts: list[str]) -> list[np.ndarray]:
        vectors = encoder(texts)
        sizes = [len(v) for v in vectors]
        width = len(head.layers[-1].bias)
        every = head(np.concatenate([v for v in vectors if len(v)])) if any(sizes) else np.zeros((0, width))
        return np.split(every, np.cumsum(sizes)[:-1]) if sizes else []

    return encode
