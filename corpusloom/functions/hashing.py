"""Hashes, stable ids, hash order and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(prefix: str, category: Column, norm: Column) -> Column:
    """prefix, then the first 20 hex digits of the hash of category, line break, normalized text."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(category, F.lit("\n"), norm), 256), F.lit(20)))


def hash_bucket(text: Column, buckets: int) -> Column:
    """The first 8 hex digits of the hash, modulo ``buckets``."""
    return F.pmod(F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long"), F.lit(buckets))


def hash_order(seed: int, *keys: Column) -> Column:
    """A total pseudo-random order that any engine with SHA-256 repeats."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def stable_pick(values: Sequence[str], index: Column, multiplier: int = 1, offset: int = 0) -> Column:
    items = F.array(*map(F.lit, values))
    return F.element_at(items, (F.pmod(index * multiplier + offset, F.lit(len(values))) + 1).cast("int"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, as two nested hashes over binary."""
    if len(key) > 64:
        raise ValueError("a key of more than 64 bytes is hashed first")
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def head_digest(content: Column, head: int = 1 << 20) -> Column:
    """MD5 of the first MiB, the key of persisted vectors."""
    return F.md5(F.substring(content, 1, head))
