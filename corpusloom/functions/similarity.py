"""Set and vector similarity on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of distinct sets; 0 if one is empty, ``both_empty`` if both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(asked: Column, content: Column) -> Column:
    """Share of the asked grams that the content has; 0 without any."""
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, content)) / F.size(asked))


def set_match(values: Column, text: Column) -> Column:
    """Share of values that occur in the text; null if none is asked."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: F.contains(text, v))) / F.size(values))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))
