"""Problem 9: splitting oversized texts at natural boundaries, by recursive bisection.

A text of more tokens than the capacity is cut at the strongest boundary near the middle of its
tokens -- paragraph, line, sentence, clause, list mark, space, word, in that order -- and its halves
are cut again while they exceed capacity - overlap.  "Near" is the middle half of the part.  Then
every piece but the first is extended to the left by up to ``overlap`` tokens of the text before it,
at word ends, and inside a word where the word alone has more.  Words of more than a quarter of the
limit are units of whole characters first, so text without any mark is cut too.

Pieces are spans [start, stop) of characters of the whole text, ``own`` is where the part of a piece
that is not overlap begins; ``tokens`` is the size of its text by the tokenizer.  Texts within the
capacity, null and empty ones have no pieces.  A capacity must exceed its overlap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.bpe import DEFAULT_RANKS, Encoder, encoder
from corpusloom.llm.tables import table

#: Boundary levels, strongest last.
WORD, SPACE, MARK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_SENTENCE, _CLAUSE, _MARK = set("。！？!?…‥"), set("；;：:"), set("，,、）)】」』”")


#: Bits of a word's code beside its level: it begins with white space, it is white space, it holds a line break, it ends with a full stop.
_BEGINS, _BLANK, _BREAK, _STOP, _SHIFT = 8, 16, 32, 64, 7


def _code(word: str) -> int:
    """Level of the end of a word, as far as the word tells, and its bits."""
    code = _BEGINS * word[0].isspace() | _BREAK * ("\n" in word) | _STOP * (word[-1] == ".")
    if word.isspace():
        return code | _BLANK | (PARAGRAPH if word.count("\n") > 1 else LINE if "\n" in word else SPACE)
    marks = set(word)
    for level, chars in ((SENTENCE, _SENTENCE), (CLAUSE, _CLAUSE), (MARK, _MARK)):
        if marks & chars:
            return code | level
    return code | WORD


class Cutter:
    """Pieces of one text for any number of (capacity, overlap) settings.

    ``known`` keeps size and code of words in one number each, for all texts of a worker.
    """

    def __init__(self, enc: Encoder, text: str, unit: int, known: dict[str, int]):
        self.enc, self.text, self.cut_inside = enc, text, False
        words = enc.split(text)
        try:
            facts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) > 1_000_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = enc.size(w) << _SHIFT | _code(w)
            facts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        sizes = facts >> _SHIFT
        if len(words) and sizes.max() > unit:
            parts = []
            for w, n in zip(words, sizes.tolist(), strict=True):
                if n > unit and len(w) > 1:
                    self.cut_inside = True
                    step = max(1, len(w) * unit // (2 * n))
                    parts += [w[i : i + step] for i in range(0, len(w), step)]
                else:
                    parts.append(w)
            words = parts
            facts = np.fromiter((enc.size(w) << _SHIFT | _code(w) for w in words), np.int64, len(words))
            sizes = facts >> _SHIFT
        self.words, self.codes = words, facts & ((1 << _SHIFT) - 1)
        self.sizes = sizes.tolist()
        self.tokens = list(accumulate(self.sizes, initial=0))
        self.chars = list(accumulate(map(len, words), initial=0))
        self.total = self.tokens[-1]
        self._by_level: list[list[int]] | None = None

    def levels(self) -> list[list[int]]:
        """Word numbers before which a cut lies, level by level, strongest first; empty levels are left out."""
        if self._by_level is None:
            codes = self.codes
            here, following = codes[:-1], codes[1:]
            level = here & 7
            spaced = (level == WORD) & ((following & _BEGINS) > 0)
            level = np.where(spaced, np.where((here & _STOP) > 0, SENTENCE, SPACE), level)
            breaks = (codes & (_BLANK | _BREAK)) == (_BLANK | _BREAK)
            after = np.concatenate([[False], breaks[:-2]]) if len(codes) > 1 else np.zeros(0, bool)
            line = level == LINE
            level = np.where(line & breaks[1:], -1, np.where(line & after, PARAGRAPH, level))  # only the end of a run of breaks counts
            by = [(np.flatnonzero(level == k) + 1).tolist() for k in range(PARAGRAPH, WORD, -1)]
            self._by_level = [*filter(None, by), range(1, len(self.words))]
        return self._by_level

    def middle(self, a: int, b: int) -> int:
        """Word number of the strongest boundary near the middle of words a..b."""
        tokens = self.tokens
        half, quarter = (tokens[a] + tokens[b]) / 2, (tokens[b] - tokens[a]) / 4
        centre = bisect_left(tokens, half, a, b + 1)
        for cuts in self.levels():
            at = bisect_left(cuts, centre)
            best, off = 0, quarter
            for c in cuts[max(0, at - 1) : at + 1]:
                if a < c < b and (d := abs(tokens[c] - half)) <= off and (d < off or not best):
                    best, off = c, d
            if best:
                return best
        return min(max(centre, a + 1), b - 1)

    def size(self, a: int, b: int) -> int:
        """Tokens of the text of words a..b; a run of white space at its end is one word there."""
        if not self.words[b - 1][-1].isspace():
            return self.tokens[b] - self.tokens[a]
        end = b
        while end > a and self.words[end - 1].isspace():
            end -= 1
        return self.tokens[end] - self.tokens[a] + (self.enc.count("".join(self.words[end:b])) if end < b else 0)

    def parts(self, limit: int) -> list[tuple[int, int]]:
        out, todo = [], [(0, len(self.words))]
        while todo:
            a, b = todo.pop()
            if b - a > 1 and self.size(a, b) > limit:
                m = self.middle(a, b)
                todo += [(m, b), (a, m)]
            else:
                out.append((a, b))
        return out

    def pieces(self, capacity: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, own, stop, tokens) of every piece."""
        out = []
        for a, b in self.parts(capacity - overlap):
            own, stop, room = self.chars[a], self.chars[b], overlap
            start, first = own, a
            while first and self.sizes[first - 1] <= room:
                first -= 1
                room -= self.sizes[first]
            start, extra = self.chars[first], 0
            if first and room and a:
                before = self.words[first - 1]
                for k in range(min(len(before) - 1, room), 0, -1):
                    if (n := self.enc.size(before[-k:])) <= room:
                        start, extra = start - k, n
                        break
            tokens = self.size(first, b) + extra
            if self.cut_inside or tokens > capacity:
                tokens = self.enc.count(self.text[start:stop])
                while tokens > capacity and start < own:  # a shorter overlap
                    start = next((c for c in self.chars[first : a + 1] if c > start), own)
                    tokens = self.enc.count(self.text[start:stop])
            out.append((start, own, stop, tokens))
        return out


#: Words of a worker process, by vocabulary.
_KNOWN: dict[str, dict[str, int]] = {}


def cut_batches(path: str, settings: list[tuple[int, int, int]]):
    smallest = min(c - o for _, c, o in settings)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        known = _KNOWN.setdefault(path, {})

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)
            for c in columns:
                c.clear()
            return out

        columns: list[list] = [[] for _ in NAMES]
        limits, docs, numbers, starts, owns, stops, sizes, texts = columns
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text or len(text.encode("utf-8", "replace")) <= smallest:
                    continue
                cutter = Cutter(enc, text, max(1, smallest // 4), known)
                for limit_id, capacity, overlap in settings:
                    if cutter.total > capacity:
                        cut = cutter.pieces(capacity, overlap)
                        n = len(cut)
                        limits += [limit_id] * n
                        docs += [doc_id] * n
                        numbers += range(n)
                        for start, own, stop, size in cut:
                            starts.append(start)
                            owns.append(own)
                            stops.append(stop)
                            sizes.append(size)
                            texts.append(text[start:stop])
                if len(texts) > 10_000:
                    yield flush()
        yield flush()

    return make


NAMES = ["limit_id", "doc_id", "piece", "start", "own", "stop", "tokens", "text"]
TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.string()]
SCHEMA = "limit_id long, doc_id long, piece int, start int, own int, stop int, tokens int, text string"


def split_documents(documents: DataFrame, settings: list[tuple[int, int, int]], path: str = DEFAULT_RANKS) -> DataFrame:
    """Pieces of documents (doc_id, text) under settings (limit_id, capacity, overlap)."""
    for _, capacity, overlap in settings:
        if not 0 <= overlap < capacity:
            raise ValueError(f"overlap {overlap} does not lie under capacity {capacity}")
    if not settings:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    return documents.select("doc_id", "text").mapInArrow(cut_batches(path, settings), SCHEMA)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, doc_id, piece, start, own, stop, tokens, text under every setting of token_limits."""
    settings = [(r["limit_id"], r["capacity"], r["overlap"]) for r in table(spark, sf_dir, "token_limits").orderBy("limit_id").collect()]  # a fixed table of settings
    return split_documents(table(spark, sf_dir, "documents"), settings)
