"""Comparable forms of a text: the visual skeleton and the plain form.

*Skeleton* -- decompose, replace every character by its prototype, decompose again.  Two texts
that print alike have one skeleton; letter case, marks and visible spaces stay distinct.

*Plain form* -- the skeleton composed again, in lower case, letters and digits only.

Both exist as functions on one string and as vectorised code-point tables over whole batches
(``plain_codes``): one gather per character, and only texts with combining marks, multi-character
compatibility forms or astral characters take the string path.

Nulls have no form (None); an empty text, or one of marks only, has the empty form.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# Letters of other scripts that print like a Latin letter, and what they print like.
LOOKALIKE_LETTERS = {
    "Cyrillic capitals": ("АВЕЅІЈКМНОРСТУХҮԌԚԜ", "ABESIJKMHOPCTYXYGQW"),
    "Cyrillic small": ("аеорсухѕіјһԁԛԝү", "aeopcyxsijhdqwy"),
    "Greek capitals": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    "Greek small": ("οναριϲϳγ", "ovapicjy"),
    "Latin variants": ("ɑɡıȷⅼ", "agijl"),
    "Armenian": ("ՕՏՍսոօցհզ", "OSUunoghq"),
}
# Radicals without a compatibility mapping, and the ideograph they print like.
LOOKALIKE_RADICALS = (
    "⺁⺂⺃⺄⺅⺆⺈⺊⺍⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺩⺪⺫⺬⺭⺮⺰⺱⺲⺴⺵⺶⺷⺸⺹⺺⺻⺼⺽⺾⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乛乚乙亻冂刀卜小兀尣尢巳幺彑彐忄心扌攵旡月歺民氵氺灬爫爫丬牛王疋目示礻竹纟罓罒网羊羊羊羋耂肀聿月臼艹艹虎衤覀西见角角讠贝车辶辶辶钅長镸长门阝雨青韦页风飞食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
)
#: Characters that do not print, besides category Cf: fillers, joiners, variation selectors.
INVISIBLE_RANGES = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))

_SLOW = np.uint32(0xFFFFFFFF)


@functools.cache
def prototypes() -> dict[int, str | None]:
    """Code point -> prototype for ``str.translate``; None drops an invisible character."""
    table: dict[int, str | None] = {}
    for same, as_ in LOOKALIKE_LETTERS.values():
        table.update({ord(a): b for a, b in zip(same, as_, strict=True)})
    table.update({ord(a): b for a, b in zip(*LOOKALIKE_RADICALS, strict=True)})
    for low, high in INVISIBLE_RANGES:
        table.update(dict.fromkeys(range(low, high + 1)))
    for cp in (*range(0x10000), *range(0xE0000, 0xE0080)):
        kind = unicodedata.category(chr(cp))
        if kind == "Cf":
            table[cp] = None
        elif kind == "Zs":
            table[cp] = " "
    return table


def skeleton(text: str | None) -> str | None:
    """The one form of all texts that print like ``text``."""
    if text is None:
        return None
    if text.isascii():
        return text
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).translate(prototypes()))


def plain(text: str | None) -> str | None:
    """Letters and digits of the composed skeleton, in lower case."""
    if text is None:
        return None
    composed = unicodedata.normalize("NFC", skeleton(text)).lower()
    return "".join(c for c in unicodedata.normalize("NFC", composed) if c.isalnum())


@functools.cache
def _plain_table() -> np.ndarray:
    """For each BMP code point its one plain code point, 0 if it has none, _SLOW if it depends on context."""
    table = np.zeros(0x10000, np.uint32)
    for cp in range(0x10000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        if unicodedata.combining(c) or len(unicodedata.normalize("NFKC", c)) > 1 or (0x1100 <= cp < 0x1200):
            table[cp] = _SLOW
            continue
        out = plain(c)
        table[cp] = 0 if not out else ord(out) if len(out) == 1 else _SLOW
    return table


def to_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the start of each (with the end of the last)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def plain_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Plain forms of all texts as code points, and the start of each; a null gives the empty form."""
    table = _plain_table()
    texts = [t or "" for t in texts]
    codes, starts = to_codes(texts)
    mapped = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], _SLOW)
    if (slow := np.flatnonzero(mapped == _SLOW)).size:
        for i in np.unique(np.searchsorted(starts, slow, "right") - 1):
            texts[i] = plain(texts[i])
        codes, starts = to_codes(texts)  # a plain form is its own plain form
        known = codes < 0x10000
        mapped = np.where(known, table[np.minimum(codes, 0xFFFF)], codes)
        mapped = np.where(mapped == _SLOW, codes, mapped)
    keep = mapped != 0
    kept = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return mapped[keep], kept[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where the array allows."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n code points (of the whole array; callers cut at text ends)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        while width < n:  # doubling: the hash of 2w from two of w, the last step overlaps
            step = min(width, n - width)
            h = mix(h[: len(h) - step] * np.uint64(3) + np.uint64(width) + (h[step:] << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            width += step
    return h


def trigram_codes(codes: np.ndarray) -> np.ndarray:
    """Every run of three code points, packed without collisions into 63 bits."""
    c = codes.astype(np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)
