"""Minhash symbols of texts, and their comparison inside a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm.forms import mix, trigram_codes


def minhash_symbols(codes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """count x texts minhash values over runs of three; texts under three characters must not be given."""
    grams = mix(trigram_codes(codes))
    ends = starts[1:] - 2
    inside = np.zeros(len(grams) + 1, np.int64)
    inside[starts[:-1]] += 1
    inside[ends] -= 1
    keep = np.cumsum(inside[:-1]) > 0
    grams = grams[keep]
    at = np.concatenate([[0], np.cumsum(ends - starts[:-1])])[:-1]
    rng = np.random.default_rng(20240607)
    odd = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, count, dtype=np.uint64)
    out = np.empty((count, len(starts) - 1), np.uint64)
    work = np.empty_like(grams)
    with np.errstate(over="ignore"):
        for i in range(count):
            np.multiply(grams, odd[i], out=work)
            work += add[i]
            out[i] = np.minimum.reduceat(work, at)
    return mix(out)


def text_key(codes: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of every text: a polynomial sum of mixed (position, character) codes."""
    at = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts[:-1], np.diff(starts)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mix(codes.astype(np.uint64) + mix(at + np.uint64(seed)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
        return mix(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64)


def four_bit_marks(symbols: np.ndarray) -> np.ndarray:
    """The top four bits of sixteen symbols of every text, in one long."""
    nibbles = symbols >> np.uint64(60)
    return np.bitwise_or.reduce([nibbles[k] << np.uint64(4 * k) for k in range(16)]).view(np.int64)


def agreeing(a: Column, b: Column) -> Column:
    """How many of the sixteen four-bit symbols of two longs agree."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def block_anchors(symbols: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """texts x (blocks * width): the anchors within distance 1 of each block's word of ``width`` symbols.

    An anchor is a word with one free place.  Words of a block that differ in at most one symbol lie on
    a common anchor, so fingerprints that differ in fewer than 2 * blocks symbols share one for certain.
    """
    out = []
    with np.errstate(over="ignore"):
        for b in range(blocks):
            for free in range(width):
                h = np.full(symbols.shape[1], b * width + free, np.uint64)
                for k in range(width):
                    if k != free:
                        h = mix(symbols[b * width + k] + mix(h))
                out.append(h)
    return np.stack(out, 1).view(np.int64)
