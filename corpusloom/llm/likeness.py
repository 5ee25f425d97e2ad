"""Exact likeness of two texts, for verification after candidate search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from corpusloom.llm.forms import plain, plain_codes


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def jaccard(a: str, b: str) -> float:
    """Shared share of the distinct runs of three characters; 0 if neither text has one."""
    x, y = trigrams(a), trigrams(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def plain_texts(texts: list[str | None]) -> list[str]:
    """Plain forms of a batch, by one gather per character; a null gives ''."""
    codes, starts = plain_codes(texts)
    whole = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


@F.pandas_udf(StringType())
def plain_column(text: pd.Series) -> pd.Series:
    return pd.Series(plain_texts(text.tolist()))


@F.pandas_udf(DoubleType())
def likeness_of_plain(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x or "", y or "") for x, y in zip(a, b, strict=True)])


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two raw texts."""
    return likeness_of_plain(plain_column(a), plain_column(b))


__all__ = ["jaccard", "likeness", "likeness_of_plain", "plain", "plain_column", "plain_texts", "trigrams"]
