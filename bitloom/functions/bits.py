"""Bit-vector scalars as Column expressions; all stay in the JVM.

A fingerprint of F bits is ``words``, an array of 64-bit numbers, most significant bit first, the
last word left-aligned and filled with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(bits: Column, n_features: int) -> Column:
    """Array of 0/1 -> words.  Shift and or, never multiply: 64 bits would overflow under ANSI."""

    def word(i: int) -> Column:
        part = F.slice(bits, 64 * i + 1, min(64, n_features - 64 * i))
        value = F.aggregate(part, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))
        return F.shiftleft(value, 64 - min(64, n_features - 64 * i))

    return F.array(*[word(i) for i in range((n_features + 63) // 64)])


def unpack(words: Column, n_features: int) -> Column:
    """Words -> array of 0/1 of length n_features."""
    # over words first, so that an expression standing for words is evaluated once
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.getbit(w, i).cast("int")))
    return F.slice(F.flatten(each), 1, n_features)


def sign_word(column: str, n: int = 64) -> Column:
    """Fingerprint of the signs of up to 64 numbers of an array column: bit i is set where its item i > 0, as one word."""
    return F.expr(" | ".join(f"IF(get({column}, {i}) > 0, shiftleft(1L, {63 - i}), 0L)" for i in range(n)))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))


def intersection(x: Column, y: Column) -> Column:
    """Common set bits of two fingerprints of the same width."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0).cast("long"), lambda a, c: a + c)


def jt(inter: Column, card_x: Column, card_y: Column) -> Column:
    """Jaccard-Tanimoto similarity; of two all-zero fingerprints it is 0."""
    return inter.cast("double") / F.greatest(card_x + card_y - inter, F.lit(1)).cast("double")


def jt_words(x: Column, y: Column) -> Column:
    return jt(intersection(x, y), popcount(x), popcount(y))


def majority(k: Column, n: Column) -> Column:
    """Centroid bit of a column sum k over n fingerprints: a tie sets the bit; one fingerprint stays itself."""
    return (2 * k >= n).cast("int")


def centroid_bits(ls: Column, n: Column) -> Column:
    return F.transform(ls, lambda k: majority(k, n))


def dtype_rank(n: Column) -> Column:
    """Bits of the smallest unsigned type that holds n: 8, 16, 32 or 64."""
    return F.when(n <= 255, 8).when(n <= 65535, 16).when(n <= 4294967295, 32).otherwise(64)


def min_safe_uint(n: Column) -> Column:
    """Bits of the smallest unsigned type that holds n (whole numbers of any width); negative or beyond 64 bits raises."""
    whole = n.cast("decimal(38,0)")
    fine = (whole >= 0) & (whole <= F.lit("18446744073709551615").cast("decimal(38,0)"))
    return F.when(fine, dtype_rank(whole)).when(whole.isNotNull(), F.raise_error(F.lit("no unsigned type holds this"))).cast("int")
