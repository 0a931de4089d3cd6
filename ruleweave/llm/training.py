"""Bounded samples of labelled rows and their word counts, for the classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .textnp import Words, batches, mix

U = np.uint64
#: What stands before a text's first word.
BEGIN = U(0x9E3779B97F4A7C15)


def sampled(rows: DataFrame, limit: int, tag: str, texts: DataFrame | None = None) -> DataFrame:
    """About `limit` rows of each `class`, or all, by a hash of the id; written.

    With `texts` (doc_id, text), `rows` are labels (doc_id, class), and those drawn,
    about `limit` for each class, are broadcast to find their texts.  Of each class a third serves to calibrate (`held`), the rest to count.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("class").agg(F.count(F.lit(1))).collect()}  # one row for each class
    if not sizes:
        return cut((rows if texts is None else texts.join(rows, "doc_id")).withColumn("held", F.lit(False)), tag)
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, limit / n))))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / (1 << 20)).cast("double")
    held = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)) == 0
    drawn = rows.where(draw < share[F.col("class")])
    if texts is not None:
        drawn = texts.join(F.broadcast(drawn), "doc_id")
    return cut(drawn.withColumn("held", held), tag)


def weights(rows: DataFrame, limit: int) -> dict[str, float]:
    """How many rows of a class stand behind one that `sampled` draws."""
    return {r[0]: max(1.0, r[1] / limit) for r in rows.groupBy("class").agg(F.count(F.lit(1))).collect()}


def word_counts(sample: DataFrame, separators: np.ndarray) -> tuple[list[str], np.ndarray, list[str]]:
    """(words, counts by class, classes) of the rows that are not held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            words, found = Words(texts, separators), Counter()
            for label, i, j in zip(batch.column("class").to_pylist(), words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                each = b"\n".join([words.word(k) for k in range(i, j)]).decode("utf-8", "replace").lower().split("\n")
                found.update((label, w) for w in each if w)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["class", "word", "n"])

    counted = sample.where("not held").select("class", "text").mapInArrow(run, "class string, word string, n long")
    classes = sorted(r[0] for r in sample.where("not held").select("class").distinct().collect())
    if not classes:
        return [], np.zeros((0, 0)), []
    columns = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(classes)]
    rows = counted.groupBy("word").agg(*columns).orderBy("word").toArrow()  # bounded by the sample
    counts = np.column_stack([rows[f"n{i}"].to_numpy() for i in range(len(classes))]).astype(np.float64)
    return rows["word"].to_pylist(), counts, classes


def previous(words: Words) -> np.ndarray:
    """The hash of the word before each word; `BEGIN` at a text's first."""
    out = np.empty(len(words.hash), dtype=np.uint64)
    out[1:] = words.hash[:-1]
    out[words.bounds[:-1][words.count() > 0]] = BEGIN
    return out


def spellings(sample: DataFrame, separators: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(hashes, words) of all words of the rows that are not held, by hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(it):
            words = Words(texts, separators)
            keys, at = np.unique(words.hash, return_index=True)
            each = b"\n".join([words.word(k) for k in at.tolist()]).decode("utf-8", "replace").lower().split("\n") if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(each, pa.string())], ["h", "word"])

    rows = sample.where("not held").select("text").mapInArrow(run, "h long, word string").groupBy("h").agg(F.min("word").alias("word")).toArrow()  # bounded by the sample
    keys = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["word"].take(pa.array(order)).to_pylist()


@dataclass
class PairCounts:
    """Counts by class of words, of contexts and of pairs that are seen more than once; hashes are sorted for words and contexts."""

    words: np.ndarray
    of_word: np.ndarray
    contexts: np.ndarray
    of_context: np.ndarray
    before: np.ndarray
    word: np.ndarray
    of_pair: np.ndarray


def pair_counts(sample: DataFrame, separators: np.ndarray, classes: list[str]) -> PairCounts:
    """Counts of words after the word before, in the rows that are not held.

    A count is of different surroundings, the word before the pair with the one after
    it, so that copies of a text count once and a fixed phrase as often as it is used.
    Pairs that are seen once stay on the cluster, but for their part in other counts.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            words = Words(texts, separators)
            before = previous(words)
            kind = np.array([classes.index(c) for c in batch.column("class").to_pylist()], dtype=np.int8)[words.owner()]
            first = before == BEGIN
            wide, after = np.full(len(before), BEGIN), np.full(len(before), BEGIN)
            wide[1:] = np.where(first[1:], BEGIN, before[:-1])
            after[:-1] = np.where(first[1:], BEGIN, words.hash[1:])
            around = mix(wide * U(3) + after)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(before.view(np.int64)), pa.array(words.hash.view(np.int64)), pa.array(around.view(np.int64))], ["kind", "before", "word", "around"])

    seen = sample.where("not held").select("class", "text").mapInArrow(run, "kind byte, before long, word long, around long").distinct()
    names = [f"n{i}" for i in range(len(classes))]
    pairs = cut(seen.groupBy("before", "word").agg(*(F.count_if(F.col("kind") == i).cast("int").alias(n) for i, n in enumerate(names))), "pairs")

    def taken(df: DataFrame, *keys: str) -> list[np.ndarray]:
        rows = df.toArrow()  # bounded by the sample
        counts = np.column_stack([rows[n].to_numpy() for n in names]).astype(np.float32)
        out = [rows[k].to_numpy().view(np.uint64) for k in keys]
        order = np.argsort(out[0], kind="stable")
        return [*(x[order] for x in out), counts[order]]

    totals = [F.sum(n).alias(n) for n in names]
    often = pairs.where(" + ".join(names) + " > 1")
    return PairCounts(*taken(pairs.groupBy("word").agg(*totals), "word"), *taken(pairs.groupBy("before").agg(*totals), "before"), *taken(often, "before", "word"))
