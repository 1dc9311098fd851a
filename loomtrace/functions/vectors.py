"""Vector columns (``ARRAY<FLOAT>``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def pair_feature(current: Column, history: Column) -> Column:
    """``[current, history, current - history, current * history]``."""
    return F.concat(current, history, difference(current, history), F.zip_with(current, history, lambda x, y: x * y))


def delta_feature(current: Column, previous: Column, usable: Column) -> Column:
    """``current - previous``; zeros when one of the texts is empty."""
    return F.when(usable, difference(current, previous)).otherwise(F.transform(current, lambda x: x * F.lit(0.0).cast("float")))
