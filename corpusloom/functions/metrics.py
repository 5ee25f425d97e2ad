"""Text-generation metrics from their public definitions, as Arrow UDFs over characters.

BLEU: clipped n-gram precisions, smoothing 4, brevity penalty.  ROUGE-L: F1 of the longest common
subsequence, over characters or over the ASCII words that the public scorer keeps.  METEOR: exact
matching only.  Empty sides score 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def tokens(text: str | None, how: str = "char") -> list[str]:
    if not text:
        return []
    return [c for c in text if not c.isspace()] if how == "char" else re.findall(r"[a-z0-9]+", text.lower())


def bleu(reference: list[str], candidate: list[str], n: int) -> float:
    """Sentence BLEU of order n with smoothing 4 (always over four precisions, as the weights are padded)."""
    precisions = []
    for k in range(1, 5):
        c = Counter(tuple(candidate[i : i + k]) for i in range(len(candidate) - k + 1))
        r = Counter(tuple(reference[i : i + k]) for i in range(len(reference) - k + 1))
        precisions.append((sum((c & r).values()), max(1, sum(c.values()))))
    if precisions[0][0] == 0:
        return 0.0
    length, zeros, logs = len(candidate), 1, []
    for hits, total in precisions:
        if hits == 0 and length > 1:
            hits = 1 / (2**zeros * 5 / math.log(length))
            zeros += 1
        logs.append(math.log(hits / total) if hits else None)
    used = logs[:n]
    if any(x is None for x in used):
        return 0.0
    brevity = 1.0 if length > len(reference) else math.exp(1 - len(reference) / length)
    return brevity * math.exp(sum(used) / n)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: one vectorised row per token of a."""
    if not a or not b:
        return 0
    codes: dict[str, int] = {}
    y = np.array([codes.setdefault(t, len(codes)) for t in b])
    row = np.zeros(len(b) + 1, np.int32)
    for t in a:
        grown = row.copy()
        np.maximum(row[1:], row[:-1] + (y == codes.get(t, -1)), out=grown[1:])
        row = np.maximum.accumulate(grown)
    return int(row[-1])


def rouge_l(reference: list[str], candidate: list[str]) -> float:
    n = lcs(reference, candidate)
    return 2 * n / (len(reference) + len(candidate)) if n else 0.0


def meteor(reference: list[str], candidate: list[str]) -> float:
    """Exact matches, each reference token once (the latest candidate first), with the chunk penalty."""
    free: dict[str, list[int]] = {}
    for j, t in enumerate(reference):
        free.setdefault(t, []).append(j)
    pairs = []
    for i in range(len(candidate) - 1, -1, -1):
        if free.get(candidate[i]):
            pairs.append((i, free[candidate[i]].pop()))
    pairs.sort()
    if not pairs:
        return 0.0
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs[:-1], pairs[1:], strict=True))
    m = len(pairs)
    p, r = m / len(candidate), m / len(reference)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)


FIELDS = ("bleu1", "bleu2", "bleu3", "bleu4", "rouge_l", "rouge_l_char", "meteor")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in FIELDS]))
def text_metrics(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    rows = []
    for r, c in zip(reference, candidate, strict=True):
        x, y = tokens(r), tokens(c)
        rows.append((*[bleu(x, y, n) if x and y else 0.0 for n in (1, 2, 3, 4)], rouge_l(tokens(r, "ascii"), tokens(c, "ascii")), rouge_l(x, y), meteor(x, y)))
    return pd.DataFrame(rows, columns=list(FIELDS))


def accuracy_reward(completion: str | None, answer: str | None) -> float:
    """1.0 if the tagged or boxed answer equals the expected one as a number or as normalized text."""
    from corpusloom.functions.text import last_boxed

    def bare(t: str | None) -> str:
        t = t or ""
        m = re.search(r"<answer>(.*?)</answer>", t, re.S)
        t = m.group(1) if m else t
        return " ".join((last_boxed(t) or t).split()).lower()

    a, b = bare(completion), bare(answer)
    try:
        return float(abs(float(a.replace(",", "")) - float(b.replace(",", ""))) < 1e-9)
    except ValueError:
        return float(a == b and a != "")


@F.pandas_udf(DoubleType())
def accuracy_rewards(completion: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([accuracy_reward(c, a) for c, a in zip(completion, answer, strict=True)], dtype="float64")
