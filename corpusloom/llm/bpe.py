"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding
of their joined bytes.  Hence every prefix of a word has one token that can stand last in its
encoding: the token t ending there whose left neighbour -- the last token of the prefix before t --
makes a valid pair with it.  ``PrefixTable`` stores that token for every byte prefix.  Appending
bytes only adds entries; an edit keeps all entries before it.  Pair validity is found once per pair
by merging the joined bytes by rank, and remembered.

The vocabulary file is a parameter (a rank file: base64 token, space, rank); nothing is trained.
"""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np
import regex

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that splits text into words before any merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks, pair validity and a reversed trie of the tokens."""

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.size_of = {v: len(k) for k, v in self.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.trie: dict = {}
        for token, rank in self.ranks.items():
            if len(self.merged(token)) != 1:
                continue  # no merge leads there
            node = self.trie
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = rank

    def merged(self, word: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


@functools.cache
def vocabulary(path: str = DEFAULT_RANKS) -> Vocabulary:
    return Vocabulary(path)


class PrefixTable:
    """The unique last token of every byte prefix of one word; its size leads to the prefix before it."""

    def __init__(self, vocab: Vocabulary, word: bytes = b""):
        self.vocab, self.word = vocab, b""
        self.last: list[int] = [-1]
        self.append(word)

    def append(self, more: bytes) -> None:
        """Extend the word; entries of its prefixes stay."""
        word = self.word = self.word + more
        last, known, root = self.last, self.vocab.pairs.get, self.vocab.trie
        keep = last.append
        for end in range(len(last), len(word) + 1):
            node, at = root.get(word[end - 1]), end - 1
            while True:
                token = node.get(-1)
                if token is not None:
                    if not at:
                        break
                    ok = known((last[at], token))
                    if ok or (ok is None and self.vocab.valid(last[at], token)):
                        break
                at -= 1
                node = node[word[at]]
            keep(token)

    def edit(self, at: int, drop: int, put: bytes) -> None:
        """Replace ``drop`` bytes at ``at``; entries before the edit stay, later ones are made again."""
        word = self.word[:at] + put + self.word[at + drop :]
        del self.last[at + 1 :]
        self.word = word[:at]
        self.append(word[at:])

    def tokens(self) -> list[int]:
        out, end, size = [], len(self.word), self.vocab.size_of
        while end:
            out.append(self.last[end])
            end -= size[out[-1]]
        return out[::-1]


class Encoder:
    """Ids of texts; words repeat, so their encodings are kept (up to ``keep`` words, then all are forgotten)."""

    def __init__(self, path: str = DEFAULT_RANKS, keep: int = 400_000):
        self.vocab, self.keep = vocabulary(path), keep
        self.split = regex.compile(WORDS).findall
        self.known: dict[str, np.ndarray] = {}
        self.sizes: dict[str, int] = {}

    def word(self, word: str) -> np.ndarray:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            ids = self.known[word] = np.array(PrefixTable(self.vocab, word.encode("utf-8", "replace")).tokens(), np.int32)
        return ids

    def words(self, text: str) -> list[str]:
        return self.split(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, no special tokens; an empty text has none."""
        get, word = self.known.get, self.word
        parts = [x if (x := get(w)) is not None else word(w) for w in self.split(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def size(self, word: str) -> int:
        """Number of ids of one word; kept apart from the ids, as it takes little room."""
        n = self.sizes.get(word)
        if n is None:
            if len(self.sizes) >= 3 * self.keep:
                self.sizes.clear()
            n = self.sizes[word] = len(PrefixTable(self.vocab, word.encode("utf-8", "replace")).tokens())
        return n

    def count(self, text: str) -> int:
        return sum(map(self.size, self.split(text)))


@functools.cache
def encoder(path: str = DEFAULT_RANKS) -> Encoder:
    return Encoder(path)
