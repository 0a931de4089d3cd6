"""Interpolated Kneser-Ney character models of several classes over one set of n-grams.

N-grams of one to `order` characters stay inside a word, which starts and ends with
a mark.  They are kept by 64-bit hash in sorted arrays, one for each order, with a
row of discounted shares and back-off weights for the classes; a text is scored by
binary search.  The highest order uses counts, lower ones the number of different
left neighbours, and the lowest backs off to a uniform share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .textnp import Words, mix

U = np.uint64
START, STOP = 2, 3
#: The share of every character before any is seen: one of all code points.
UNIFORM = 1 / 0x110000
_STEP = np.random.Generator(np.random.PCG64(104729)).integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words with their marks, and each one's place in its word."""
    text = "".join(f"\x02{w}\x03" for w in words)
    symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.flatnonzero(symbols == START)
    lengths = np.diff(np.append(starts, len(symbols)))
    return symbols, np.arange(len(symbols)) - np.repeat(starts, lengths)


def gram_keys(symbols: np.ndarray, place: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n from 1 to `order`, the key of the n characters that end at each place (0 where the word is shorter)."""
    total = np.zeros(len(symbols), dtype=np.uint64)
    for n in range(order):
        total[n:] += (symbols[: len(symbols) - n].astype(np.uint64) + U(1)) * _STEP[n]
        yield np.where(place >= n, mix(total + U(n)) | U(1), U(0))


@dataclass
class CharModel:
    classes: list[str]
    keys: list[np.ndarray]
    share: list[np.ndarray]
    weight: list[np.ndarray]

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray, classes: list[str], order: int = 5) -> CharModel:
        """From words and their counts (a row for each word, a column for each class)."""
        symbols, place = coded(words)
        place = place.astype(np.int32)
        owner = np.cumsum(place == 0, dtype=np.int32) - np.int32(1)
        counts = counts.astype(np.float32)
        keys, ids, first, raw = [], [], [], []
        for n, g in enumerate(gram_keys(symbols, place, order)):
            k, at, inverse = np.unique(g, return_index=True, return_inverse=True)
            short = int(k[0] == 0)  # places where the word is shorter
            keys.append(k[short:])
            ids.append((inverse - short).astype(np.int32))
            first.append(at[short:].astype(np.int32))
            del g, k, at
            raw.append(np.stack([np.bincount(inverse, weights=counts[owner, c], minlength=short + len(keys[n]))[short:] for c in range(len(classes))], axis=1).astype(np.float32))
            del inverse
        share, weight = [], []
        for n in range(order):
            uses = raw[n].copy()
            if n + 1 < order:
                uses[place[first[n]] > n] = 0  # only n-grams at a word's start keep their counts
                suffix = ids[n][first[n + 1]]
                for c in range(len(classes)):
                    uses[:, c] += np.bincount(suffix, weights=raw[n + 1][:, c] > 0, minlength=len(keys[n]))
            if n == 0:
                uses[keys[0] == next(gram_keys(np.array([START], "<u4"), np.zeros(1, int), 1))[0]] = 0
                context, contexts = np.zeros(len(uses), dtype=np.int64), 1
            else:
                context, contexts = ids[n - 1][first[n] - 1], len(keys[n - 1])
            one, two = (uses == 1).sum(axis=0), (uses == 2).sum(axis=0)
            discount = np.clip(one / np.maximum(1, one + 2 * two), 0.1, 0.9)
            total, kinds = np.zeros((contexts, len(classes))), np.zeros((contexts, len(classes)))
            np.add.at(total, context, uses)
            np.add.at(kinds, context, uses > 0)
            none = total == 0
            share.append((np.maximum(uses - discount, 0) / np.where(none, 1, total)[context]).astype(np.float32))
            weight.append(np.where(none, 1, discount * kinds / np.where(none, 1, total)).astype(np.float32))
        return cls(classes, keys, share, weight)

    def score(self, words: list[str], step: int = 20_000) -> np.ndarray:
        """log10 probability of each word under each class."""
        out = np.empty((len(words), len(self.classes)))
        for i in range(0, len(words), step):
            symbols, place = coded(words[i : i + step])
            p = np.full((len(symbols), len(self.classes)), UNIFORM)
            before = np.zeros(len(symbols), dtype=np.int64)  # the context's row: the empty one
            known = np.ones(len(symbols), dtype=bool)
            for n, g in enumerate(gram_keys(symbols, place, len(self.keys))):
                at = np.minimum(np.searchsorted(self.keys[n], g), len(self.keys[n]) - 1)
                hit = (self.keys[n][at] == g) & (g != 0)
                p[known] *= self.weight[n][before[known]]
                both = hit & known
                p[both] += self.share[n][at[both]]
                before = np.concatenate([[0], at[:-1]])
                known = np.concatenate([[False], hit[:-1]]) & (place > 0)
            logs = np.log10(p)
            logs[place == 0] = 0
            out[i : i + step] = np.add.reduceat(logs, np.flatnonzero(place == 0), axis=0)
        return out


class Memo:
    """Values of words by hash, kept sorted; over `limit` words it starts anew."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.keys, self.values = limit, np.zeros(0, dtype=np.uint64), None

    def __call__(self, words: Words, compute) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inverse): a row for each distinct word of `words`, and each word's row number."""
        unique, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self.keys, self.values = self.keys[:0], self.values[:0]
        place = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != unique[inside]
        if new.any():
            some = at[new]
            raw = b"\n".join([words.word(i) for i in some.tolist()])
            values = compute(raw.decode("utf-8", "replace").lower().split("\n"), unique[new])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.values = values[order] if self.values is None or not len(self.values) else np.concatenate([self.values, values])[order]
            self.keys = keys[order]
            place = np.searchsorted(self.keys, unique)
        return (self.values[place] if len(unique) else np.zeros((0, 1))), inverse
