"""Random fingerprints with the statistics of real ones, for tests and benchmarks."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def fake_fingerprints(num: int, n_features: int = 2048, seed: int | None = None, pack: bool = True) -> np.ndarray:
    """Rows of 0/1 (or packed bytes), popcounts from a normal (750, 400) cut to 1 .. n_features - 1."""
    if n_features < 1 or n_features % 8:
        raise ValueError("n_features must be a positive multiple of 8")
    rng = np.random.default_rng(seed)
    norm = NormalDist()
    lo, hi = norm.cdf((1 - 750) / 400), norm.cdf((n_features - 1 - 750) / 400)
    u = rng.uniform(size=num)
    ones = np.rint([750 + 400 * norm.inv_cdf(lo + x * (hi - lo)) for x in u]).astype(np.int64)
    rows = (np.arange(n_features) < ones[:, None]).astype(np.uint8)
    rows = rng.permuted(rows, axis=-1)
    return np.packbits(rows, axis=1) if pack else rows
