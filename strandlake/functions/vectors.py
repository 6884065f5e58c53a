"""Column functions on vectors (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Of unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def char_grams(token: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of characters of a marked token; a token shorter than a run has none of it."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    runs = [F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), _cut(padded, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*runs)


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def gram_bucket(gram: Column, dim: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(dim)).cast("int")


def gram_sign(gram: Column) -> Column:
    return F.when(F.shiftright(F.crc32(gram.cast("binary")), 16).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)
