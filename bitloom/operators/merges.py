"""Merge criteria on whole-number summaries, for the tree kernel (``functions.isim.accepts`` is the Column form).

``radius``              mean similarity to the centroid of the union is at least the threshold
``diameter``            iSIM of the union is
``tolerance-diameter``  ... and not below that of the old entry by more than a tolerance, which
``tolerance-radius``    ... shrinks as the old entry grows; single old entries are exempt
``tolerance-legacy``    ... and a single newcomer is not too far from the others on average
``never-merge``         nothing merges
A custom criterion is any callable of (threshold, new_ls, new_n, old_ls, nom_ls, old_n, nom_n).

Criteria on iSIM need no more than (n, sum of the column sums, sum of their squares) of the union, the
old entry and the newcomer: ``sums_criterion``.  The others are given the column sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Accept = Callable[[float, np.ndarray, int, np.ndarray, np.ndarray, int, int], bool]
Sums = tuple[int, int, int]
NAMES = ("radius", "diameter", "tolerance-diameter", "tolerance-radius", "tolerance-legacy", "never-merge")
#: Size of the old entry at which an adaptive tolerance is used up, and its decay; fixed values.
LARGEST, DECAY = 1000, 1e-3


def isim_of(n: int, s: int, q: int) -> float:
    """Mean pairwise similarity from the sum of column sums and the sum of their squares."""
    if n < 2:
        return math.nan
    common = (q - s) / 2
    return common / (common + (n * s - q)) if s else 1.0


def isim(ls: np.ndarray, n: int) -> float:
    return isim_of(n, int(ls.sum()), int(np.dot(ls, ls)))


def radius_complement(ls: np.ndarray, n: int) -> float:
    centre = ls if n <= 1 else (2 * ls >= n)
    return ((n + 1) * isim(ls + centre, n + 1) - (n - 1) * isim(ls, n)) / 2


def allowance(tolerance: float, old_n: int, n_max: int = LARGEST, decay: float = DECAY) -> float:
    """How far the union may fall below the old entry: all of the tolerance at first, nothing at ``n_max``."""
    return max(tolerance * (math.exp(-decay * old_n) - math.exp(-decay * n_max)), 0.0)


def sums_criterion(name: str | Accept, tolerance: float = 0.05) -> Callable[[float, Sums, Sums, Sums], bool] | None:
    """The criterion as a function of (threshold, union, old, newcomer), each (n, s, q); None if that isn't enough."""
    if name == "never-merge":
        return lambda *_: False
    if name == "diameter":
        return lambda t, union, old, new: isim_of(*union) >= t
    if name == "tolerance-diameter":
        return lambda t, union, old, new: (d := isim_of(*union)) >= t and (old[0] == 1 or d >= isim_of(*old) - allowance(tolerance, old[0]))
    if name == "tolerance-legacy":
        # mean similarity of a single newcomer to the old members, against the old mean
        far = lambda d, n, before, m: (d * n - before * (m - 1)) / 2 < before - tolerance
        return lambda t, union, old, new: (d := isim_of(*union)) >= t and not (old[0] > 1 and new[0] == 1 and far(d, union[0], isim_of(*old), old[0]))
    return None


def criterion(name: str | Accept, tolerance: float = 0.05) -> Accept:
    """The criterion of a name on column sums; callables pass.  ``tolerance`` counts only where the name has one."""
    if callable(name):
        return name
    if name not in NAMES:
        raise ValueError(f"unknown merge criterion {name!r}; known: {', '.join(NAMES)}")
    if (by_sums := sums_criterion(name, tolerance)) is not None:
        sums = lambda ls, n: (n, int(ls.sum()), int(np.dot(ls, ls)))
        return lambda t, new, n, old, nom, old_n, nom_n: by_sums(t, sums(new, n), sums(old, old_n), sums(nom, nom_n))
    least = (lambda old, old_n: radius_complement(old, old_n) - allowance(tolerance, old_n)) if name == "tolerance-radius" else (lambda *_: -math.inf)
    return lambda t, new, n, old, nom, old_n, nom_n: (d := radius_complement(new, n)) >= t and (old_n == 1 or d >= least(old, old_n))
