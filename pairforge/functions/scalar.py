"""Scalar functions that need Python, Arrow-batched."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_bf16(x: np.ndarray) -> np.ndarray:
    """The nearest value with the upper 16 bits of a float32 only, ties to even; NaN stays NaN."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    up = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(x), np.float32("nan"), up.view(np.float32)).astype(np.float32)


@F.pandas_udf(T.FloatType())
def bf16(x: pd.Series) -> pd.Series:
    return pd.Series(round_bf16(x.to_numpy(np.float32)))


def corrupt_spans(tokens: list[str], alphabet: list[str], share: float, key: str, mean: float = 5.0, longest: int = 10) -> list[str]:
    """About `share` of the tokens replaced in runs of geometric length by random substitutes; all of them for share >= 1."""
    if not tokens or share <= 0 or not alphabet:
        return list(tokens)
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big"))
    out, left = list(tokens), min(len(tokens), max(1, round(share * len(tokens))))
    if share >= 1:
        return [alphabet[i] for i in rng.integers(0, len(alphabet), len(tokens))]
    hit: set[int] = set()
    while left > 0:
        size = min(int(rng.geometric(1 / mean)), longest, left)
        start = int(rng.integers(0, len(tokens)))
        for k in range(start, min(start + size, len(tokens))):
            if k not in hit:
                hit.add(k)
                left -= 1
                out[k] = alphabet[int(rng.integers(0, len(alphabet)))]
    return out


def span_corruption(share: float, alphabet: list[str], seed: int = 7):
    """A pandas function of (tokens, key)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def corrupt(tokens: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([corrupt_spans(list(t), alphabet, share, f"{seed}|{k}") for t, k in zip(tokens, key, strict=True)])

    return corrupt
