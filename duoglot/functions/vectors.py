"""Vector columns (``array<float>``): length, unit length, similarity, feature hashing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duoglot.functions.text import as_column

SCORE_DIGITS = 6
HASH_DIM = 768


def round_score(c: Column) -> Column:
    """Scores are rounded before they are ranked, so that ties do not depend on the
    order in which floating point numbers were added. (+0.0 turns -0.0 into 0.0.)"""
    return F.round(c, SCORE_DIGITS) + F.lit(0.0)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b),
                          lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_column(v), F.lit(0.0),
                              lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a vector of length zero stays as it is.

    The length is paired with every component as an array. Named inside the lambda it
    would be computed again for each component.
    """
    v = as_column(v)
    length = norm(v)
    scale = F.when(length > 0, length).otherwise(1.0)
    return F.zip_with(v, F.array_repeat(scale, F.size(v)), lambda x, s: (x / s).cast("float"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two unit vectors, rounded for ranking."""
    return round_score(dot(a, b))


def hash_dimension(term: Column | str, dim: int = HASH_DIM) -> Column:
    """Bucket of a term: first 7 hex digits of its md5, modulo the vector width."""
    digest = F.md5(F.encode(as_column(term), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % dim).cast("int")


def hash_sign(term: Column | str) -> Column:
    """+1 or -1 by the 8th hex digit of the term's md5."""
    digest = F.md5(F.encode(as_column(term), "UTF-8"))
    return F.when(F.substring(digest, 8, 1) < "8", 1).otherwise(-1)


def dense_from_sorted(entries: Column | str, dim: int, scale: Column | float = 1.0) -> Column:
    """Dense ``array<float>`` from entries ``(dim, weight)`` sorted by ``dim``, each weight
    divided by ``scale``.

    Every entry is paired with the position before it and contributes the zeros in between
    and its weight; the pair without an entry fills up the end. The work is linear in the
    width. (The entries are not looked up inside the lambda: if the optimizer copies their
    expression into it, each look-up would build them again.)
    """
    entries = as_column(entries)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    zero = F.lit(0.0).cast("float")

    def piece(entry: Column, before: Column) -> Column:
        return F.when(entry.isNull(), F.array_repeat(zero, (F.lit(dim - 1) - before).cast("int"))
                      ).otherwise(F.concat(
                          F.array_repeat(zero, (entry["dim"] - before - 1).cast("int")),
                          F.array((entry["weight"] / scale).cast("float"))))

    before = F.concat(F.array(F.lit(-1)), entries["dim"])
    return F.flatten(F.zip_with(entries, before, piece))


def single_term_vector(term: str, dim: int = HASH_DIM) -> Column:
    """Hashed unit vector of a text that consists of one term."""
    entry = F.struct(hash_dimension(F.lit(term), dim).alias("dim"),
                     hash_sign(F.lit(term)).cast("double").alias("weight"))
    return dense_from_sorted(F.array(entry), dim)
