"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model give each word a probability after the word before it.
Both are interpolated Kneser-Ney models of pairs of words, and both back off to counts
that the classes share:

* spelling: a character model of all words, and one of the words that tell toxic texts;
* words, both classes: discounted counts over the spelling;
* words, one class: what its counts keep, over the shared words (for the toxic class
  mixed with the spelling of telling words, by the share that these have);
* pairs, both classes: discounted counts over the shared words;
* pairs, one class: what its counts keep, over the shared pairs, each tilted by the
  class's ratio for its word and put back to one in sum.

As in Kneser-Ney smoothing, the level below is made of what discounts take away, and
gets as much as they do, so each level is a distribution and keeps the counts' sums.  A
class keeps of a count what chance does not explain, given the count in both classes:
its excess over its expected part, times the share of such excesses that are no chance
finds.  So a rare expression that one class has by chance is left to the shared counts,
and one that only that class uses is not: the other class then has next to nothing.
Counts are of different surroundings, so copies of a text count once; pairs that are
seen once are left to their words whole.

The log-likelihoods of the two models are compared, normalised by length: over the
whole text, and over each passage of PASSAGE words, so that one passage in a long text
counts.  Both are calibrated on labelled rows set aside, and the higher score decides.

The models learn from at most `DOCS` labelled documents of each class, and the spelling
from SPELT of their words and all telling ones; those bounds are for fitting alone, and
every text is scored whole.

Defined cases: a null text, or one without words, has the lowest score; rows without a
label are scored like others; repeated labels of one document count as the highest;
without labels of both classes every score is 0; null ids are never trained on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import CharModel, Memo
from .scratch import fold, rows_where
from .textnp import NON_LETTER, Words, batches, mix, sums
from .training import BEGIN, PairCounts, pair_counts, previous, sampled, spellings, weights

DOCS = 5000
ORDER = 5
#: Words, besides telling ones, that the spelling is learnt from.
SPELT = 100_000
PASSAGE = 48
#: The ratio of a text without words, which says nothing against it.
NOTHING = -10.0
TOXIC, ORDINARY = "1", "0"
#: Columns of words: shared and class probabilities; of contexts: their back-off weights.
SHARED, FIRST, SECOND = 0, 1, 2


@dataclass
class Toxicity:
    #: hashes of known words, sorted; probabilities of each (both classes, ordinary, toxic); as a context, back-off weights
    words: np.ndarray
    known: np.ndarray
    rest: np.ndarray
    #: weights of the level below words (both classes, ordinary, toxic), and the share of telling words
    free: np.ndarray
    telling: float
    #: keys of known pairs, sorted, with discounted shares after the first word (both classes, ordinary, toxic)
    pairs: np.ndarray
    after: np.ndarray
    #: spelling of all words and of telling ones
    chars: CharModel
    #: slope and middle of the scores of whole texts and of passages
    slope: np.ndarray = field(default_factory=lambda: np.zeros(2))
    middle: np.ndarray = field(default_factory=lambda: np.full(2, np.inf))
    #: words that this worker process has scored, in whatever task
    memo: Memo = field(default_factory=lambda: Memo(200_000))

    def levels(self, found: list[str], hashes: np.ndarray) -> np.ndarray:
        """Of each word: its probability in both classes, ordinary and toxic texts, whatever stands before; and its weights as a context."""
        at, there = find(self.words, hashes)
        out = np.ones((len(found), 6))
        out[:, :3], out[:, 3:] = self.known[at], self.rest[at]
        new = np.flatnonzero(~there)
        if len(new):
            out[new, :3] = self.level(np.zeros((len(new), 3)), 10.0 ** self.chars.score([found[i] for i in new.tolist()]))
            out[new, 3:] = 1
        return out.astype(np.float32)

    def level(self, own: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Probabilities of words (both classes, ordinary, toxic) from their discounted shares and spelling."""
        both = own[:, SHARED] + self.free[SHARED] * spelt[:, 0]
        one = own[:, FIRST] + self.free[FIRST] * both
        two = own[:, SECOND] + self.free[SECOND] * ((1 - self.telling) * both + self.telling * spelt[:, 1])
        return np.column_stack([both, one, two])

    def each(self, words: Words) -> np.ndarray:
        """log(toxic / ordinary) of each word after the one before it."""
        rows, inverse = self.memo(words, self.levels)
        if not len(inverse):
            return np.zeros(0)
        before = previous(words)
        first = before == BEGIN
        level = rows[inverse, :3].astype(np.float64)
        rest = np.empty((len(inverse), 3))
        rest[1:] = rows[inverse[:-1], 3:]
        rest[first] = self.rest[find(self.words, np.array([BEGIN]))[0][0]]
        at, known = find(self.pairs, pair_keys(before, words.hash))
        after = np.where(known[:, None], self.after[at], 0.0)
        both = after[:, SHARED] + rest[:, SHARED] * level[:, SHARED]
        tilted = both[:, None] * level[:, FIRST:] / level[:, :FIRST]
        p = after[:, FIRST:] + rest[:, FIRST:] * tilted
        return np.log(p[:, 1] / p[:, 0])

    def evidence(self, words: Words) -> np.ndarray:
        """The mean ratio of each text, and the highest mean of its passages; a shorter text is one passage."""
        each, n = self.each(words), words.count()
        whole = np.where(n > 0, sums(each, words.bounds) / np.maximum(n, 1), NOTHING)
        best = whole.copy()
        long = n > PASSAGE
        if long.any():
            total = np.zeros(len(each) + 1)
            np.cumsum(each, out=total[1:])
            means = (total[PASSAGE:] - total[:-PASSAGE]) / PASSAGE  # by first word
            last = words.bounds[1:][long] - PASSAGE + 1
            edges = np.column_stack([words.bounds[:-1][long], last]).ravel()
            best[long] = np.maximum.reduceat(np.append(means, -np.inf), edges)[::2]
        return np.column_stack([whole, best])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.middle), -50, 50)))).max(axis=1)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, whether it is there) of each key; `keys` are sorted and not empty."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + word)


def specific(own: np.ndarray, both: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of each count `own` out of `both`, what the class keeps when `share` is its expected part.

    The excess over that part is kept times the share of such excesses that are real:
    one less the number of chance finds as unlikely, over the number found, among
    counts of the same size (in powers of 2).  Chernoff's bound is the likelihood.
    """
    some = np.flatnonzero(own > both * share)
    r, n, e = own[some], both[some], share[some]
    at = np.clip(r / n, 1e-12, 1)
    rest = 1 - at
    log_p = -n * (at * np.log(at / e) + rest * np.log(np.maximum(rest, 1e-300) / np.maximum(1 - e, 1e-300)) * (rest > 0))
    size = np.log2(np.maximum(both, 1)).astype(np.int64)
    sizes = np.bincount(size)
    false = np.ones(len(some))
    for k in np.unique(size[some]).tolist():
        mine = np.flatnonzero(size[some] == k)
        order = mine[np.argsort(log_p[mine], kind="stable")]
        rate = np.exp(log_p[order]) * sizes[k] / np.arange(1, len(order) + 1)
        false[order] = np.minimum(1, np.minimum.accumulate(rate[::-1])[::-1])
    kept = np.zeros(len(own))
    kept[some] = (1 - false) * (r - n * e)
    return kept


def less_discount(counts: np.ndarray) -> np.ndarray:
    """Counts less a Kneser-Ney discount."""
    one, two = ((counts > k - 0.5) & (counts <= k + 0.5) for k in (1, 2))
    return np.maximum(counts - min(0.95, max(0.3, one.sum() / max(1, one.sum() + 2 * two.sum()))), 0)


def estimate(seen: PairCounts, spell: Callable[[np.ndarray], tuple[CharModel, np.ndarray]]) -> Toxicity:
    """Models from (ordinary, toxic) counts; pairs that are seen once are left to their words.

    `spell(columns)` learns the spelling of the words, in order of their hashes, from
    their counts, all and telling; and gives each one's probability in the two.
    """
    hashes = np.union1d(seen.words, np.array([BEGIN]))
    size = len(hashes)
    each, follow = np.zeros((size, 2)), np.zeros((size, 2))
    each[np.searchsorted(hashes, seen.words)] = seen.of_word
    follow[np.searchsorted(hashes, seen.contexts)] = seen.of_context
    total = each.sum(axis=0)
    n = each.sum(axis=1)
    kept = np.column_stack([specific(each[:, k], n, np.full(size, total[k] / total.sum())) for k in (0, 1)])
    tells = np.where(2 * kept[:, 1] > each[:, 1], kept[:, 1], 0)
    telling = float(tells.sum() / total[1])
    chars, spelt = spell(np.column_stack([n, np.rint(tells)]))
    left = n - kept.sum(axis=1)
    own = np.column_stack([less_discount(left) / left.sum(), kept / total])
    free = 1 - own.sum(axis=0)
    model = Toxicity(hashes, own, own, free, telling, hashes[:0], own[:0], chars)
    level = model.level(own, spelt)

    starts, w = np.searchsorted(hashes, seen.before), np.searchsorted(hashes, seen.word)

    def of(values: np.ndarray) -> np.ndarray:
        """Sums by context."""
        return np.bincount(starts, values, size)

    counts = seen.of_pair.astype(np.float64)
    both = counts.sum(axis=1)
    expected = follow[starts] * level[w, FIRST:]
    expected /= expected.sum(axis=1, keepdims=True)
    kept = np.column_stack([specific(counts[:, k], both, expected[:, k]) for k in (0, 1)])
    left = both - kept.sum(axis=1)
    all_left = follow.sum(axis=1) - of(kept.sum(axis=1))
    after = np.column_stack([less_discount(left) / all_left[starts], kept / np.maximum(follow[starts], 1)])
    rest = np.column_stack([1 - of(after[:, k]) for k in range(3)])
    for k in (FIRST, SECOND):  # tilted pairs of a context add up to one
        tilt = level[w, k] / level[w, SHARED]
        rest[:, k] /= of(after[:, SHARED] * tilt) + rest[:, SHARED]
    keys = pair_keys(seen.before, seen.word)
    order = np.argsort(keys)
    model.known, model.rest = level.astype(np.float32), rest.astype(np.float32)
    model.pairs, model.after = keys[order], after[order].astype(np.float32)
    return model


def calibrate(model: Toxicity, evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> None:
    """Logistic curves over the evidence of whole texts and of passages: their middles at the cuts with the fewest errors together.

    `weight` says how many texts each one stands for, as classes are not drawn alike.
    Without both classes, a text is toxic where its ratio is above 1.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        model.slope, model.middle = np.array([8.0, 8.0]), np.array([0.5, 0.5])
        return
    weight = np.ones(len(toxic)) if weight is None else weight
    whole, passage = evidence.T
    best, errors = None, np.inf
    for at in [np.inf, cut_at(whole, toxic, weight)[0], *np.quantile(whole, np.linspace(0, 1, 201))]:
        left = whole < at
        second, missed = cut_at(passage[left], toxic[left], weight[left])
        found = missed + (weight * (toxic == 0))[~left].sum()
        if found < errors:
            best, errors = (at, second), found
    model.middle = np.array(best)
    model.slope = np.array([slope_at(x, m, toxic, weight) for x, m in zip(evidence.T, best, strict=True)])


def cut_at(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The cut with the fewest errors, and their weight."""
    if len(evidence) < 2:
        return np.inf, float((weight * (toxic == 1)).sum())
    order = np.argsort(evidence, kind="stable")
    x, y, w = evidence[order], toxic[order], weight[order]
    missed = np.cumsum(w * (y == 1))[:-1]  # toxic texts below the cut
    wrong = np.cumsum((w * (y == 0))[::-1])[::-1][1:]  # ordinary ones above
    errors = missed + wrong
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    return float((x[k] + x[k + 1]) / 2), float(errors[k])


def slope_at(evidence: np.ndarray, middle: float, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logistic curve's slope by Newton steps; its middle is given."""
    if np.isinf(middle):  # this evidence says nothing
        return 1.0
    away = evidence - middle
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * away, -50, 50)))
        step = ((weight * (toxic - p)) @ away - 0.01 * slope) / ((weight * p * (1 - p)) @ (away * away) + 0.01)
        slope = float(np.clip(slope + np.clip(step, -5, 5), 0.1, 40))
    return slope


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = DOCS) -> Toxicity | None:
    """Learn from docs(doc_id, text) with labels(doc_id, toxic) outside fold 0; None without both classes."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id", folds) > 0)
    rows = marks.select("doc_id", F.when(F.col("toxic") == 1, TOXIC).otherwise(ORDINARY).alias("class"))
    sample = sampled(rows, per_class, "toxicity", docs.where(F.col("text").isNotNull()).select("doc_id", "text"))
    seen = pair_counts(sample, NON_LETTER, [ORDINARY, TOXIC])
    if not len(seen.words) or not seen.of_word.any(axis=0).all():
        return None

    def spell(columns: np.ndarray) -> tuple[CharModel, np.ndarray]:
        hashes, words = spellings(sample, NON_LETTER)
        every = np.union1d(hashes, np.array([BEGIN]))
        at = np.searchsorted(every, hashes)
        columns = columns[at]
        some = np.flatnonzero((np.arange(len(words)) < SPELT) | (columns[:, 1] > 0))  # hashes are in no order of words
        chars = CharModel.fit([words[i] for i in some.tolist()], columns[some], ["all", "telling"], ORDER)
        spelt = np.full((len(every), 2), 1e-300)  # what stands before a text is no word
        spelt[at] = 10.0 ** chars.score(words)
        return chars, spelt

    model = estimate(seen, spell)
    del seen
    pa.default_memory_pool().release_unused()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            whole, passage = shared.value.evidence(Words(texts, NON_LETTER)).T
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(whole), pa.array(passage)], ["class", "whole", "passage"])

    held = sample.where("held").select("class", "text").mapInArrow(run, "class string, whole double, passage double").toPandas()  # bounded by the sample
    stands_for = held["class"].map(weights(rows, per_class)).to_numpy(dtype=float)
    calibrate(model, held[["whole", "passage"]].to_numpy(), (held["class"] == TOXIC).to_numpy().astype(float), stands_for)
    return model


def score(docs: DataFrame, model: Toxicity | None) -> DataFrame:
    """doc_id, tie, score, predicted of docs(doc_id, tie, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in batches(it):
            s = known.score(known.evidence(Words(texts, NON_LETTER))) if known else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "tie", "score", "predicted"])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Learn and score: doc_id, tie, held_out, score, predicted for each row."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    found = score(slim, fit(slim, labels, folds))
    return found.select("doc_id", "tie", (fold("doc_id", folds) == 0).alias("held_out"), "score", "predicted")


def ordinary(docs: DataFrame, labels: DataFrame, folds: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, with all their columns."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(slim, labels, folds)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows_where(docs, lambda texts: shared.value.score(shared.value.evidence(Words(texts, NON_LETTER))) < 0.5, text)
