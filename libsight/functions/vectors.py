"""Vector arithmetic and the int8 storage form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from libsight.functions.text import col


def _round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def quantise(vector: Column | str) -> Column:
    """Struct (codes array<tinyint>, scale double): symmetric int8 quantisation."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    top = F.greatest(F.lit(1e-8), F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)))
    scale = top / 127
    codes = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(
        F.lit(127), _round_half_up(x / scale))).cast("tinyint"))
    return F.struct(codes.alias("codes"), scale.alias("scale"))


def dequantise(codes: Column | str, scale: Column | str) -> Column:
    s = col(scale)
    return F.transform(col(codes), lambda x: (x * s).cast("float"))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine over the shorter length; 0 where either norm is 0."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    x, y = F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n)
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norms > 0, _dot(x, y) / norms).otherwise(F.lit(0.0))


def semantic_score(cosine_value: Column | str) -> Column:
    return (col(cosine_value) + 1) / 2


def order_vectors(data: Column | str, texts: Column | str) -> Column:
    """Vectors of one embedding reply, in index order.

    ``data`` is array<struct<index, embedding>>; the count must equal that of
    the texts sent.
    """
    ordered = F.array_sort(col(data), lambda a, b: F.coalesce(a["index"], F.lit(0)).cast("int")
                           - F.coalesce(b["index"], F.lit(0)).cast("int"))
    vectors = F.transform(ordered, lambda d: d["embedding"])
    return F.when(F.size(vectors) == F.size(col(texts)), vectors).otherwise(
        F.raise_error(F.lit("embedding reply holds an unexpected number of vectors")))
