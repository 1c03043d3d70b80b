"""iSIM: the mean pairwise Jaccard-Tanimoto similarity of a set, estimated from column sums alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def isim(n: Column, s: Column, q: Column) -> Column:
    """From n fingerprints, s the sum of their column sums and q the sum of the squares.

    NaN for fewer than two fingerprints, 1 where no bit is set.  Whole numbers up to one last
    division, so every engine gives the same double.  Sums are decimals: squares leave 64 bits at
    some tens of millions of fingerprints.
    """
    a = (q - s).cast("double") / 2
    return F.when(n < 2, F.lit(float("nan"))).when(s == 0, F.lit(1.0)).otherwise(a / F.greatest(a + (n * s - q).cast("double"), F.lit(1e-300)))


def sums(ls: Column) -> tuple[Column, Column]:
    """(s, q) of an array of column sums."""
    wide = lambda: F.lit(0).cast("decimal(38,0)")
    return F.aggregate(ls, wide(), lambda a, k: (a + k).cast("decimal(38,0)")), F.aggregate(ls, wide(), lambda a, k: (a + k.cast("decimal(19,0)") * k.cast("decimal(19,0)")).cast("decimal(38,0)"))


def isim_of(ls: Column, n: Column) -> Column:
    s, q = sums(ls)
    return isim(n, s, q)


def radius_complement(ls: Column, n: Column) -> Column:
    """Mean similarity to the centroid, by iSIM with and without it: ((n+1) iSIM(ls+c) - (n-1) iSIM(ls)) / 2."""
    with_c = F.transform(ls, lambda k: k + F.when(n <= 1, k).otherwise((2 * k >= n).cast("long")))
    return ((n + 1) * isim_of(with_c, n + 1) - (n - 1) * isim_of(ls, n)) / 2


def accepts(criterion: str, threshold: float, new: tuple[Column, Column], old: tuple[Column, Column], nom: tuple[Column, Column], tolerance: float = 0.05, n_max: int = 1000, decay: float = 1e-3, adaptive: bool = True) -> Column:
    """Whether a union (n, ls) may replace an old entry that a nominee joins; see ``operators.merges``."""
    import math

    new_n, new_ls = new
    old_n, old_ls = old
    nom_n, _ = nom
    size = (lambda ls, n: radius_complement(ls, n)) if "radius" in criterion else isim_of
    d = size(new_ls, new_n)
    ok = d >= threshold
    if criterion == "never-merge":
        return F.lit(False)
    if criterion in ("radius", "diameter"):
        return ok
    before = size(old_ls, old_n)
    if criterion in ("tolerance-diameter", "tolerance-radius"):
        if adaptive:
            tol = F.greatest(tolerance * (F.exp(-decay * old_n) - math.exp(-decay * n_max)), F.lit(0.0))
        else:
            tol = F.lit(float(tolerance))
        return ok & ((old_n == 1) | (d >= before - tol))
    if criterion == "tolerance-legacy":
        gain = (d * new_n - before * (old_n - 1)) / 2
        return ok & ((old_n == 1) | (nom_n != 1) | (gain >= before - tolerance))
    raise ValueError(f"unknown merge criterion {criterion!r}")
