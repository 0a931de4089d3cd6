"""Language-model scores of whole documents.

Word counts are of the whole training part of the corpus, added up by a shuffle on
the word's 64-bit hash.  Words above a count that at most TOP words reach go to all
tasks; the counts of the others come by a join, so every count is exact and nothing
that grows with the corpus is broadcast.  The base score is the add-0.1 unigram; the
model is a gated recurrent network over the VOCABULARY most frequent words, trained
on every word of all training documents, in the tasks that read them; its probability
of a word outside its vocabulary is shared out as the unigram does.

Defined cases: a null or empty text is one end token; rows that repeat an id are
scored as rows; null ids are scored and never trained on; without training rows N
and V are 0, the base score follows its formula and the model is untrained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gru import SLOTS, Gru, Moments
from .scratch import cut, fold
from .textnp import SPACE, Words, batches, sums

FOLDS = 10
TOP = 1 << 19
VOCABULARY = 2048
HIDDEN = 16
#: Adam's rates, one for each round of training.
RATES = (4e-3, 2e-3, 1e-3)
#: Words that a task holds at a time in training.
CHUNK = 1 << 20
END = np.uint64(0x9E3779B97F4A7C15)
ADDED = 0.1


@dataclass
class Frequent:
    """Words whose counts all tasks have: sorted hashes, counts, and ids in the network (0: outside it)."""

    keys: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.total + ADDED * (self.distinct + 1)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is there) of each hash."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def network_ids(self, hashes: np.ndarray) -> np.ndarray:
        at, there = self.find(hashes)
        return np.where(there, self.ids[at], 0).astype(np.int64) if len(self.ids) else np.zeros(len(hashes), dtype=np.int64)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and their bounds."""
    words = Words(texts, SPACE)
    n = words.count() + 1
    bounds = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=bounds[1:])
    out = np.empty(bounds[-1], dtype=np.uint64)
    last = np.zeros(len(out), dtype=bool)
    last[bounds[1:] - 1] = True
    out[last] = END
    out[~last] = words.hash
    return out, bounds


def counts(docs: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """h, c of all tokens of docs(text); a task adds up its own first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "c"])

        for _, texts in batches(it):
            held.append(tokens(texts)[0])
            size += len(held[-1])
            if size >= limit:
                yield added()
                held, size = [], 0
        if held:
            yield added()

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counted: DataFrame, top: int, vocabulary: int) -> tuple[Frequent, int]:
    """The most frequent words, at most `top`, and the least count that they have."""
    total, distinct = counted.agg(F.sum("c"), F.count(F.lit(1))).first()
    steps = dict(counted.groupBy(F.floor(F.log2("c")).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 63 rows
    bar, n = 64, 0
    while bar > 0 and n + steps.get(bar - 1, 0) <= top:
        bar -= 1
        n += steps.get(bar, 0)
    rows = counted.where(F.col("c") >= (1 << bar if bar < 63 else 1 << 62)).toArrow()  # at most `top` rows
    keys, c = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    rank = np.lexsort((keys, -c))[: vocabulary - 1]
    ids = np.zeros(len(keys), dtype=np.int32)
    ids[rank] = np.arange(1, len(rank) + 1)
    return Frequent(keys, c, ids, int(total or 0), int(distinct or 0)), bar


def shares(known: Frequent, vocabulary: int) -> np.ndarray:
    """Of each network id; id 0 has what is outside the vocabulary."""
    out = np.full(vocabulary, 1e-9)
    inside = known.ids > 0
    out[known.ids[inside]] = (known.counts[inside] + ADDED) / (known.total + ADDED * (known.distinct + 1))
    out[0] = max(1e-6, 1 - out[1:].sum())
    return out / out.sum()


def learn(docs: DataFrame, known: Frequent, vocabulary: int = VOCABULARY, hidden: int = HIDDEN, rates: tuple[float, ...] = RATES) -> Gru:
    """The network, trained once on every word of every row of docs(doc_id, text).

    There is a round for each of `rates`, over the documents whose ids' hash falls to it.
    In a round each task starts from the same weights, trains on the documents of
    its partition, some `CHUNK` words at a time, and returns its weights; their mean,
    weighted by words, starts the next round.  Weights are added up in about as many
    tasks as the root of the number of partitions, so few come to the driver.
    """
    model = Gru.start(shares(known, vocabulary), hidden)
    spark = docs.sparkSession
    groups = max(1, round(docs.rdd.getNumPartitions() ** 0.5))
    for turn, rate in enumerate(rates):
        shared = spark.sparkContext.broadcast((known, model))

        def run(it: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            seen, start = shared.value
            net = Gru({k: v.copy() for k, v in start.p.items()})
            moments, held, size, total = Moments(net.p), [], 0, 0
            for _, texts in batches(it):
                h, bounds = tokens(texts)
                ids = seen.network_ids(h)
                held += [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                size += len(ids)
                if size >= CHUNK:
                    net.train(held, rate, moments=moments)
                    held, total, size = [], total + size, 0
            net.train(held, rate, moments=moments)
            total += size
            if total:
                yield weighed(total, {k: v * np.float64(total) for k, v in net.p.items()})

        def add(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, sums_of = 0, {}
            for b in it:
                for n, data in zip(b.column("n").to_pylist(), b.column("weights").to_pylist(), strict=True):
                    total += n
                    for k, v in unweighed(data, shared.value[1]).items():
                        sums_of[k] = sums_of.get(k, 0) + v
            if total:
                yield weighed(total, sums_of)

        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(len(rates))) == turn).select("text")
        trained = part.mapInArrow(run, "n long, weights binary").repartition(groups).mapInArrow(add, "n long, weights binary").collect()  # a row for each group
        total = sum(r.n for r in trained)
        if total:
            parts = [unweighed(r.weights, model) for r in trained]
            model = Gru({k: (sum(x[k] for x in parts) / total).astype(np.float32) for k in model.p})
    return model


def weighed(n: int, weights: dict[str, np.ndarray]) -> pa.RecordBatch:
    data = b"".join(weights[k].astype("<f4").tobytes() for k in sorted(weights))
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["n", "weights"])


def unweighed(data: bytes, like: Gru) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4").astype(np.float64), {}, 0
    for k in sorted(like.p):
        out[k] = flat[at : at + like.p[k].size].reshape(like.p[k].shape)
        at += like.p[k].size
    return out


def score(docs: DataFrame, folds: int = FOLDS, top: int = TOP, vocabulary: int = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`."""
    assert vocabulary % SLOTS == 0
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    training = slim.where(fold("doc_id", folds) > 0)
    counted = cut(counts(training), "word-counts")
    known, bar = frequent(counted, top, vocabulary)
    model = learn(training, known, vocabulary=vocabulary)
    rest_share = np.log10(shares(known, vocabulary)[0])
    shared = docs.sparkSession.sparkContext.broadcast((known, model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, net = shared.value
        row = TaskContext.get().partitionId() << 40
        logs = seen.base(seen.counts.astype(float)) if len(seen.counts) else np.zeros(1)
        ids_of = seen.ids if len(seen.ids) else np.zeros(1, dtype=np.int32)
        for batch, texts in batches(it, 16 << 20, 5000):
            h, bounds = tokens(texts)
            at, there = seen.find(h)
            base = np.where(there, logs[at], 0.0)
            ids = np.where(there, ids_of[at], 0)
            inside = ids > 0
            found = net.score(ids, bounds) / np.log(10)
            # what the unigram gives words outside the network is added after the join
            outside = sums(~inside, bounds)
            in_base = sums(np.where(inside, base, 0.0), bounds)
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[~there]
            rare = np.empty(len(owner), dtype=[("o", np.int64), ("h", np.uint64)])
            rare["o"], rare["h"] = owner, h[~there]
            order = np.lexsort((rare["h"], rare["o"]))
            rare = rare[order]
            new = np.ones(len(rare), dtype=bool)
            new[1:] = rare[1:] != rare[:-1]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare)))
            offsets = np.searchsorted(rare["o"][first], np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(row + np.arange(len(texts))), pa.array(np.diff(bounds)), pa.array(sums(there, bounds).astype(np.int64)), pa.array(sums(base, bounds)), pa.array(found - outside * rest_share - in_base), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rare["h"][first]).view(np.int64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))],
                ["doc_id", "row", "n_tokens", "known", "base", "extra", "h", "n"],
            )
            row += len(texts)

    rows = cut(slim.mapInArrow(run, "doc_id long, row long, n_tokens long, known long, base double, extra double, h array<bigint>, n array<int>"), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("h", "n")).alias("w")).select("row", "w.h", "w.n")
    less = counted.where(F.col("c") < (1 << bar if bar < 63 else 1 << 62))
    c = F.coalesce("c", F.lit(0))
    log = F.log10((c + F.lit(ADDED)) / F.lit(known.total + ADDED * (known.distinct + 1)))
    added = rare.join(less, "h", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * log).alias("less"))
    out = rows.select("doc_id", "row", "n_tokens", "known", "base", "extra").join(added, "row", "left")
    base = F.col("base") + F.coalesce("less", F.lit(0.0))
    return out.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("extra")).alias("score"))
