"""Counter-based random numbers: each depends on its seed, stream and place alone, so retries and partitions change nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniforms(seed: int, streams: np.ndarray, step: np.ndarray, salt: int, n: int) -> np.ndarray:
    """(streams, n) numbers within (0, 1); streams (uint64) and step have one entry for each row."""
    base = _spread(streams + np.uint64((seed * 0x9E3779B97F4A7C15 + salt) % 2**64))
    base = _spread(base + np.asarray(step).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bits = _spread(base[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(seed: int, streams: np.ndarray, step: np.ndarray, salt: int, n: int, dims: int) -> np.ndarray:
    """(streams, n, dims) standard normal numbers."""
    m = n * dims
    a, b = uniforms(seed, streams, step, 2 * salt, m), uniforms(seed, streams, step, 2 * salt + 1, m)
    return (np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)).reshape(len(streams), n, dims)


def uniform_column(*parts: Column) -> Column:
    """A number within [0, 1) from the md5 of the parts as text, joined with bars."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(2**48)


def normal_column(*parts: Column) -> Column:
    """A standard normal number from two uniform ones."""
    a, b = uniform_column(*parts, F.lit("a")), uniform_column(*parts, F.lit("b"))
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(2.0 * np.pi * b)


def spawned(seed: int, n: int) -> list[int]:
    """n further seeds from one, the same each time, all different and none of them seed itself: for runs beside each other."""
    out: list[int] = []
    at = np.zeros(1, np.uint64)
    while len(out) < n:
        at = _spread(at + np.uint64((seed * 0x9E3779B97F4A7C15 + len(out) + 1) % 2**64))
        new = int(at[0] >> np.uint64(1))
        if new != seed and new not in out:
            out.append(new)
    return out
