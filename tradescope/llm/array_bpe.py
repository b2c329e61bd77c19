"""Byte-pair merging of many words at once on ragged numpy arrays."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_NEVER = np.iinfo(np.int32).max
# Symbols merged together in one pass; bounds the arrays.
_SYMBOLS = 400_000


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter a byte-level vocabulary writes for each byte.

    Printable bytes stand for themselves, all others follow from U+0100 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class ArrayBPE:
    """Merges by rank from a tokenizers JSON file of the byte-level kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = len(vocab)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        product = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.product = key[order], order.astype(np.int32), product[order]
        # All occurrences of a pair may go in one step only if what they make never takes
        # part in an earlier merge.
        made = np.full(self.width, -1, np.int64)
        made[product] = np.arange(len(merges))
        if (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: a merge uses a symbol that a later merge makes")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(PATTERN).findall

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the merge table of each pair."""
        wanted = left.astype(np.int64) * self.width + right
        place = np.searchsorted(self.key, wanted)
        place[place == len(self.key)] = 0
        return np.where(self.key[place] == wanted, self.rank[place], _NEVER), place

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each (non-empty) pre-token."""
        encoded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        out = np.empty(len(words), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(words):
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + _SYMBOLS, "right")))
            symbols = self.first[np.frombuffer(b"".join(encoded[at:to]), np.uint8)]
            out[at:to] = self._merged(symbols, sizes[at:to])
            at = to
        return out

    def _merged(self, symbol: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each word when no pair can be merged any more.

        ``symbol`` holds the words one after the other; ``rank[i]`` belongs to the pair
        (i, i + 1) and is ``_NEVER`` across words.  In each round every word merges all
        occurrences of its own lowest-ranked pair.
        """
        result = sizes.copy()
        word = np.repeat(np.arange(len(sizes)), sizes)

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            inside = at[at + 1 < len(symbol)]
            inside = inside[word[inside] == word[inside + 1]]
            return inside, self._ranks(symbol[inside], symbol[inside + 1])

        rank = np.full(len(symbol), _NEVER, np.int32)
        made = np.zeros(len(symbol), np.int32)
        at, (found, place) = ranked(np.arange(len(symbol)))
        rank[at], made[at] = found, self.product[place]
        while len(symbol):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[begins, len(symbol)])
            lowest = np.minimum.reduceat(rank, begins)
            result[word[begins]] = lengths
            if (lowest == _NEVER).any():
                stay = np.repeat(lowest != _NEVER, lengths)
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                lengths, lowest = lengths[lowest != _NEVER], lowest[lowest != _NEVER]
                if not len(symbol):
                    break
            hit = rank == np.repeat(lowest, lengths)
            if (hit[1:] & hit[:-1]).any():
                # A run such as "aaaa": every other occurrence, from the left.
                places = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit, -1, places))
                hit &= (places - begun) % 2 == 1
            merged = np.flatnonzero(hit)
            symbol[merged] = made[merged]
            keep = np.ones(len(symbol), bool)
            keep[merged + 1] = False
            moved = merged - np.arange(len(merged))
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            touched = np.zeros(len(symbol), bool)
            touched[moved] = touched[moved[moved > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed] = _NEVER
            at, (found, place) = ranked(changed)
            rank[at], made[at] = found, self.product[place]
        return result
