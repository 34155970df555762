"""Vector columns over ``array<float>``.

Spark has no vector type or distance function, so the dot product is a fold over the zipped
arrays, in double precision. Vectors are stored with unit norm; ``cosine_distance`` does not rely on that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; NULL if either side is NULL or has no direction."""
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """The vector in double precision scaled to unit norm; NULL where it has no direction."""
    return let(v, lambda w: let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x.cast("double") / n))))


def normalize(v: Column, dimension: int) -> Column:
    """Unit vector, or NULL when the dimension is wrong, a value is missing or the norm is zero."""

    def checked(w: Column) -> Column:
        usable = (F.size(w) == dimension) & ~F.exists(w, lambda x: x.isNull() | F.isnan(x))
        return F.when(usable, unit(w).cast("array<float>"))

    return let(v, checked)


def parse_vector(payload: Column, dimension: int) -> Column:
    """Unit vector from an encoder's JSON answer.

    A flat list and a list holding exactly one list are accepted. Several inner lists would be one
    vector per token and are refused, as are booleans, strings and wrong dimensions.
    """
    number = r"\s*-?(?:\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)\s*"
    flat = rf"\A\s*\[{number}(?:,{number})*\]\s*\z"
    body = F.coalesce(F.nullif(F.regexp_extract(payload, r"\A\s*\[\s*(\[[^\[\]]*\])\s*\]\s*\z", 1), F.lit("")), payload)
    values = F.when(body.rlike(flat), F.from_json(body, "array<double>"))
    return normalize(values, dimension)
