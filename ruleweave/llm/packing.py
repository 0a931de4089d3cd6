"""Documents packed into as few fixed-length sequences as can be.

Texts become token ids; only longer ones are cut, into pieces of the capacity.  What
the packing needs is how many pieces there are of each length, at most `capacity`
counts, so the plan is made once for all pieces on all machines: pieces above a
third of the capacity are matched, at most two in a sequence, the longest with the
longest partner that fits; the shorter ones then go, longest first, into the
tightest gap left.  The plan is a list of runs (length, ranks, sequences, offset)
whose number depends on the capacity alone.  A piece finds its place by its rank
among the pieces of its length, which is a count over partitions plus its rank in
its own partition; no piece moves, and no group is collected.

Defined cases: a null text is an empty one (one id); null and repeated ids are rows
like others; an empty table gives no sequence.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, small
from .textnp import batches
from .tokens import AT_ONCE, Vocabulary, bits_for, pack, unpack

CAPACITY = 2048


@dataclass
class Plan:
    """Runs of pieces of one length: ranks from `lo`, `per` of them in each sequence from `sequence` on, at `offset`."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = sorted(self.runs)
        columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
        return (columns[0] << 44) + columns[1], columns[1], columns[2], columns[3], columns[4]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where pieces go, from the number of pieces of each length."""
    out = Plan(capacity)
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    widths: list[int] = []

    def room(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(widths, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        out.runs.append((length, used[length], first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        fits = [b for b in large[: bisect_right(large, capacity - a)] if left[b] > (b == a)]
        b = fits[-1] if fits else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        first = out.sequences
        out.sequences += n
        place(a, n, first, 1, 0)
        if b is not None:
            place(b, n, first, 1, a)
        room(capacity - a - (b or 0), first, n)

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(widths, s)
            if at == len(widths):
                per = capacity // s
                n = -(-left[s] // per)
                room(capacity, out.sequences, n)
                out.sequences += n
                continue
            gap = widths[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                widths.pop(at)
            per = gap // s
            full = min(n, left[s] // per)
            if full:
                place(s, full * per, first, per, capacity - gap)
                room(gap - full * per * s // full, first, full)
            rest = n - full
            if rest and 0 < left[s] < per:
                some = left[s]
                place(s, some, first + full, some, capacity - gap)
                room(gap - some * s, first + full, 1)
                full, rest = full + 1, rest - 1
            room(gap, first + full, rest)
    return out


def pieces(docs: DataFrame, tokenizer: str, lower: bool, capacity: int, end: int, text: str, key: str) -> DataFrame:
    """doc_id, piece, start, length, ids (packed), bits, part, rank: `rank` counts pieces of a length inside a part."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer, lower))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, seen = TaskContext.get().partitionId(), None, defaultdict(int)
        last = np.array([end], dtype="<u4")
        for batch, texts in batches(it, AT_ONCE):
            coder = coder or shared.value.coder()
            bits, rows = bits_for(coder.vocabulary), []
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                ids = np.concatenate([np.frombuffer(coded, dtype="<u4"), last])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cutted = ids[start : start + capacity]
                    n = len(cutted)
                    rows.append((doc_id, piece, start, n, pack(cutted, bits), bits, part, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids", "bits", "part", "rank"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, bits int, part int, rank long")


def pack_documents(docs: DataFrame, tokenizer: str, lower: bool = True, capacity: int = CAPACITY, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids (bytes of little-endian unsigned 32-bit ids), sequence_id, offset."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, lower, capacity, end, text, key), "pieces")
    counts = cut(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-bases")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    made = spark.sparkContext.broadcast(plan(totals, capacity).arrays())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lo, first, per, offset = made.value
        for b in it:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            step = rank - lo[at]
            ids = [unpack(x, k, 0, n).astype("<u4").tobytes() for x, k, n in zip(b.column("ids").to_pylist(), b.column("bits").to_pylist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(ids, pa.binary()), pa.array(first[at] + step // per[at]), pa.array(offset[at] + step % per[at] * length)], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    placed = rows.join(small(bases), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", "bits", "rank", "base")
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digests(placed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sums = pa.array([crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length")), sums, b.column("sequence_id"), b.column("offset")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids: whole sequences, each a group of at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
