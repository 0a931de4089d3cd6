"""Language identification by Kneser-Ney character models.

Each language has an interpolated Kneser-Ney model of the characters of its words.
A text gets the language with the lowest cross-entropy per character over all its
words, and a share of belief from the differences.  It is rejected where even the
best model finds it less likely than texts of that language are: its cross-entropy is
compared with those of texts set aside, in deviations that allow for its length, and
the limit lies between two points: where FALSE of known texts would be rejected (beyond
what the texts set aside show, so their tail, from the 90th to the 99th percentile, is
drawn out), and where three quarters of the same texts would be if their own language
were not known, so that the next best model had to do.

The models learn from at most `DOCS` documents of each language; that bound is for
fitting alone, and every text is scored whole.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is
rejected; without any training row all texts are `und`; null languages teach nothing;
ties go to the first language by name; null ids are never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import CharModel, Memo
from .scratch import fold, rows_where
from .textnp import NON_LETTER, Words, batches, sums
from .training import sampled, word_counts

DOCS = 1500
ORDER = 5
NONE = "und"
#: Belief grows with evidence, but neighbouring characters are not independent.
TEMPER = 0.3
#: The share of texts in known languages that may be rejected.
FALSE = 1e-5


@dataclass
class Languages:
    model: CharModel | None
    #: by language: mean cross-entropy, deviation of documents, deviation of one character
    mean: np.ndarray
    spread: np.ndarray
    #: deviations above the mean at which a text is rejected
    bar: float = np.inf
    #: words that this worker process has scored, in whatever task
    memo: Memo = field(default_factory=Memo)

    def deviations(self, h: np.ndarray, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return (h - self.mean[best]) / np.sqrt(self.spread[best] ** 2 + 2 / np.maximum(chars, 1))


def entropies(words: Words, known: Languages) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per character by text and language, characters by text)."""

    model = known.model

    def compute(found: list[str], _: np.ndarray) -> np.ndarray:
        return np.column_stack([-model.score(found), [len(w) + 1 for w in found]]).astype(np.float32)

    rows, inverse = known.memo(words, compute)
    total = sums(rows[inverse], words.bounds) if len(inverse) else np.zeros((len(words.bounds) - 1, len(model.classes) + 1))
    return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]


def fit(docs: DataFrame, folds: int = 5, per_language: int = DOCS) -> Languages:
    """Learn from docs(doc_id, text, lang) outside fold 0."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) > 0)).select("doc_id", "text", F.col("lang").alias("class"))
    sample = sampled(rows, per_language, "languages")
    words, counts, classes = word_counts(sample, NON_LETTER)
    if not classes:
        return Languages(None, np.zeros(0), np.zeros(0))
    model = CharModel.fit(words, counts, classes, ORDER)
    shared = docs.sparkSession.sparkContext.broadcast(Languages(model, np.zeros(0), np.zeros(0)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.model.classes
        for batch, texts in batches(it):
            h, chars = entropies(Words(texts, NON_LETTER), shared.value)
            own = [names.index(c) if c in names else -1 for c in batch.column("class").to_pylist()]
            keep = [i for i, c in enumerate(own) if c >= 0 and chars[i] > 0]
            mine, own = h[keep].copy(), np.array([own[i] for i in keep], dtype=np.int64)
            rows = np.arange(len(keep))
            first = mine[rows, own]
            mine[rows, own] = np.inf
            second = mine.argmin(axis=1) if len(keep) else own
            columns = [own.astype(np.int32), first, second.astype(np.int32), mine[rows, second], chars[keep].astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["language", "h", "other", "other_h", "chars"])

    seen = sample.where("held").select("class", "text").mapInArrow(run, "language int, h double, other int, other_h double, chars double").toPandas()  # bounded by the sample
    mean, spread = np.full(len(classes), 1.0), np.full(len(classes), 0.2)
    for c in range(len(classes)):
        h = seen.h[(seen.language == c) & (seen.chars >= 100)].to_numpy()
        if len(h) >= 5:
            mean[c] = np.median(h)
            spread[c] = max(0.01, 1.4826 * np.median(np.abs(h - mean[c])))
    known = Languages(model, mean, spread)
    if len(seen) >= 20:
        z = known.deviations(seen.h.to_numpy(), seen.language.to_numpy(), seen.chars.to_numpy())
        some, few = np.quantile(z, [0.9, 0.99])
        known.bar = float(few + max(few - some, 0.5) * np.log10(0.01 / FALSE))
        if len(classes) > 1:
            foreign = known.deviations(seen.other_h.to_numpy(), seen.other.to_numpy(), seen.chars.to_numpy())
            known.bar = max(known.bar, float(known.bar + np.quantile(foreign, 0.25)) / 2)
    return known


def decisions(texts: list[str | None], known: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, rejected, entropy) of each text; the number after the last language is none."""
    n = len(known.model.classes) if known.model else 0
    words = Words(texts, NON_LETTER)
    letters = np.array([bool(c) and (t.isascii() or any(map(str.isalpha, t))) for t, c in zip(texts, words.count().tolist(), strict=True)], dtype=bool)
    best, score, entropy, out = np.full(len(texts), n), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
    if n and letters.any():
        h, chars = entropies(words, known)
        lowest = h.min(axis=1)
        belief = np.exp(-(h - lowest[:, None]) * np.log(10) * TEMPER * chars[:, None])
        best = np.where(letters, h.argmin(axis=1), n)
        score = np.where(letters, 1 / belief.sum(axis=1), 0)
        entropy = np.where(letters, lowest, np.nan)
        out = ~letters | (known.deviations(lowest, np.minimum(best, n - 1), chars) > known.bar)
    return best, score, out, entropy


def predict(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, tie, lang_pred, score, rejected, entropy of docs(doc_id, tie, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(shared.value.model.classes if shared.value.model else []), NONE]
        for batch, texts in batches(it):
            best, score, out, entropy = decisions(texts, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array([names[b] for b in best]), pa.array(score), pa.array(out), pa.array(entropy, from_pandas=True)], ["doc_id", "tie", "lang_pred", "score", "rejected", "entropy"])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, lang_pred string, score double, rejected boolean, entropy double")


def identify(docs: DataFrame, folds: int = 5, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Learn and predict: doc_id, tie, held_out, lang_pred, score, rejected, entropy for each row."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    found = predict(slim, fit(slim, folds))
    return found.select("doc_id", "tie", (fold("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def recognised(docs: DataFrame, folds: int = 5, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns; all of them where nothing can be learnt."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = fit(slim, folds)
    if known.model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(known)
    return rows_where(docs, lambda texts: ~decisions(texts, shared.value)[2], text)
