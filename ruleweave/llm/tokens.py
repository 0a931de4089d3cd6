"""Token ids in fixed-width bit-packed blocks.

`TokenCoder` encodes texts with a public tokenizer file.  `write` lays the id
streams of all documents, in ascending id order, into blocks: every id takes the
least number of bits that the vocabulary needs, and a block holds its documents'
offsets, so numpy unpacks a block at once and any document or token can be read
from its block alone.  Blocks are rows of a Parquet folder, written by Spark's own
committer: a task that runs again leaves one copy.

Defined cases: a null text is an empty one (only the end id); null ids sort first;
repeated rows are kept; an empty table writes no block and reads back as no row; a
block closes after `BLOCK` ids and never splits a document, so it holds at most
that many ids or one document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import partitions
from .textnp import batches as texts_of

BLOCK = 1 << 16
END = 0
#: How the two vocabularies cut a text before they merge, for texts of `PLAIN` characters.
LETTER = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"
BYTE_PIECES = rf" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"
WORD_PIECES = rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{LETTER}0-9]+"
#: Only on these characters do Python's classes surely agree with the tokenizers'.
PLAIN = re.compile(f"[\t\n\r\x20-\x7e¡-©«-¬®-±´¶-¸»¿×÷‐-‧€{LETTER[6:]}]*")
#: Pieces that are remembered, in sorted arrays; and those in front of them, until there are enough to sort in.
CACHE, YOUNG = 600_000, 40_000
#: Characters that are encoded at a time.
AT_ONCE = 1 << 20


class Pieces:
    """Ids of pieces of text by the pieces' 64-bit hashes: a few bytes a piece, so that many are remembered.

    Over CACHE pieces, the half that was not used for longest goes.
    """

    def __init__(self) -> None:
        self.keys, self.start, self.size, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.data, self.turn = b"", 0
        self.young: dict[int, bytes] = {}

    def take(self, keys: np.ndarray) -> list[bytes | None]:
        """The ids of each piece, None where they are not known."""
        self.turn += 1
        out: list[bytes | None] = [None] * len(keys)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            at = at[hit]
            self.last[at] = self.turn
            data = self.data
            for i, a, n in zip(hit.tolist(), self.start[at].tolist(), self.size[at].tolist(), strict=True):
                out[i] = data[a : a + n]
        if self.young:
            known = self.young.get
            out = [known(k) if c is None else c for k, c in zip(keys.tolist(), out, strict=True)]
        return out

    def add(self, keys: list[int], coded: list[bytes]) -> None:
        self.young.update(zip(keys, coded, strict=True))
        if len(self.young) < YOUNG:
            return
        if len(self.keys) > CACHE:
            kept = self.last > np.median(self.last)
            some = [self.data[a : a + n] for a, n in zip(self.start[kept].tolist(), self.size[kept].tolist(), strict=True)]
            self.data, self.keys, self.size, self.last = b"".join(some), self.keys[kept], self.size[kept], self.last[kept]
            self.start = np.cumsum(self.size) - self.size
        new = np.fromiter(self.young, np.int64, len(self.young))
        size = np.fromiter(map(len, self.young.values()), np.int64, len(new))
        start = len(self.data) + np.cumsum(size) - size
        self.data += b"".join(self.young.values())
        order = np.argsort(new)
        at = np.searchsorted(self.keys, new[order])
        columns = ((self.keys, new), (self.start, start), (self.size, size), (self.last, np.full(len(new), self.turn, np.int32)))
        self.keys, self.start, self.size, self.last = (np.insert(a, at, b[order]) for a, b in columns)
        self.young = {}


class TokenCoder:
    """Ids of texts as the tokenizers library gives them.

    Merges never cross the vocabulary's pre-split, so each distinct piece goes
    through the library once and is remembered.  Texts with characters outside `PLAIN`
    go through the library whole.
    """

    def __init__(self, file: str, lower: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.lower = lower
        self.split = re.compile(WORD_PIECES if lower else BYTE_PIECES).findall
        self.known = Pieces()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, from texts in which a mark that is always a piece of its own parts them."""
        mark = " \x7f " if self.lower else "\n"
        sign = self.tokenizer.encode(mark, add_special_tokens=False).ids
        odd = [p for p in pieces if not p.strip() or "\n" in p]
        known = dict(zip(odd, self.whole(odd), strict=True))
        rest = [p for p in pieces if p not in known]
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at, raw = np.flatnonzero(ids == sign[0]), ids.tobytes()
            if len(sign) == 1 and len(at) == len(some) - 1:
                coded = [raw[4 * i : 4 * j] for i, j in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)]
            else:
                coded = self.whole(some)
            known.update(zip(some, coded, strict=True))
        return [known[p] for p in pieces]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without an end id; null is empty."""
        cut = []
        for t in texts:
            t = t or ""
            cut.append(self.split(t.lower() if self.lower else t) if PLAIN.fullmatch(t) else None)
        unique = list(set().union(*(c for c in cut if c)))
        keys = np.fromiter(map(hash, unique), np.int64, len(unique))
        coded = self.known.take(keys)
        if new := [i for i, c in enumerate(coded) if c is None]:
            learnt = self._learn([unique[i] for i in new])
            for i, c in zip(new, learnt, strict=True):
                coded[i] = c
            self.known.add(keys[new].tolist(), learnt)
        known = dict(zip(unique, coded, strict=True))
        return [self.whole([t])[0] if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


@dataclass
class Vocabulary:
    """A vocabulary's coder in a worker process, made when it is first asked for.

    It is sent as a broadcast: a worker keeps it, and what it remembers, for later
    tasks of the same query, and lets it go when it works for another.
    """

    file: str
    lower: bool
    _coder: TokenCoder | None = None

    def coder(self) -> TokenCoder:
        self._coder = self._coder or TokenCoder(self.file, self.lower)
        return self._coder


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at `bits` each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    plane = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(plane.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids `start` to `start + n` of a packed block, without touching the rest."""
    if bits == 16:
        return np.frombuffer(data, dtype="<u2", count=n, offset=2 * start).astype(np.uint32)
    first, last = start * bits, (start + n) * bits
    raw = np.frombuffer(data, dtype=np.uint8)[first // 8 : (last + 7) // 8]
    plane = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + n * bits].reshape(n, bits)
    return plane.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


BLOCKS = "part int, block int, first long, n_ids long, bits int, doc_ids array<bigint>, offsets array<bigint>, ids binary"


def write(docs: DataFrame, out: str, tokenizer: str, lower: bool = False, end: int = END, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> None:
    """Encode every text of `docs` and write the blocks to `out`, documents in ascending order."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer, lower))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, first, number = TaskContext.get().partitionId(), None, 0, 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("ids", pa.binary())])
        ends, keys, offsets, held, n = np.array([end], dtype="<u4").tobytes(), [], [0], [], 0

        def closed() -> pa.RecordBatch:
            bits = bits_for(coder.vocabulary)
            ids = pack(np.frombuffer(b"".join(held), dtype="<u4"), bits)
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "first": first, "n_ids": n, "bits": bits, "doc_ids": keys, "offsets": offsets, "ids": ids}], schema)

        for b, texts in texts_of(batches, AT_ONCE):
            coder = coder or shared.value.coder()
            for doc_id, coded in zip(b.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                held += (coded, ends)
                n += len(coded) // 4 + 1
                keys.append(doc_id)
                offsets.append(n)
                if n >= block:
                    yield closed()
                    first, number, keys, offsets, held, n = first + n, number + 1, [], [0], [], 0
        if keys:
            yield closed()

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a checksum orders rows of one id, so that a task that runs again writes the same
    tied = slim.withColumn("tie", F.xxhash64("text"))
    dealt = tied.repartitionByRange(partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(out)


def documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks of `out`."""
    blocks = spark.read.schema(BLOCKS).parquet(out)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each range partition
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["ids"], row["bits"], 0, row["n_ids"]).astype("<u4")
                at = np.array(row["offsets"], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "local": pa.array(row["first"] + at[:-1]),
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_crc32": pa.array([crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                })

    rows = blocks.select("part", "first", "n_ids", "bits", "doc_ids", "offsets", "ids").mapInArrow(read, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def ids_at(spark: SparkSession, out: str, part: int, start: int, n: int) -> np.ndarray:
    """`n` ids from place `start` of a part, reading only the blocks that hold them."""
    hold = spark.read.schema(BLOCKS).parquet(out).where((F.col("part") == part) & (F.col("first") < start + n) & (F.col("first") + F.col("n_ids") > start))
    found = []
    for row in hold.orderBy("first").toLocalIterator():  # one block at a time
        i, j = max(0, start - row.first), min(row.n_ids, start + n - row.first)
        found.append(unpack(row.ids, row.bits, i, j - i))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
