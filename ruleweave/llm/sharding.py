"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are ordered by id (nulls first; rows of one id by the text's checksum).  Each
range partition adds up its own sizes; only those totals, one row for a partition,
are summed in order, and give each partition its base.  A row's shard follows from
the bytes before it, so shards are contiguous and cut at equal targets.

Defined cases: a null text counts as empty (size 1); null ids come first; rows that
repeat are rows like any others; an empty table gives an empty result; columns that
are not needed are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, partitions

SHARDS = 16


def ordered_totals(df: DataFrame, keys: list[str], sizes: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bases): rows in `keys` order with `part` and `<size>_before` inside their part, and each part's `<size>_base`.

    `rows` is a written table.  The bases are a window over one row for each partition.
    """
    n = partitions(df)
    spec = ", ".join(f"{s}_before long" for s in sizes)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, part int, {spec}"

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), dict.fromkeys(sizes, 0)
        for b in batches:
            columns, names = list(b.columns), list(b.schema.names)
            columns.append(pa.array(np.full(b.num_rows, part, dtype=np.int32)))
            for s in sizes:
                values = b.column(s).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(values)
                columns.append(pa.array(total - values + base[s]))
                base[s] += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays(columns, [*names, "part", *(f"{s}_before" for s in sizes)])

    rows = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(running, schema), tag)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(*(F.sum(s).alias(s) for s in sizes))
    bases = totals.select("part", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_base") for s in sizes))
    return rows, bases


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, shard, slot: one row for each row of `docs`."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("one"))
    rows, bases = ordered_totals(slim, ["doc_id", "text_crc32", "size"], ["size", "one"], "shards")
    total = rows.agg(F.sum("size").alias("total"))
    placed = rows.join(bases, "part").select("doc_id", "size", "text_crc32", (F.col("size_before") + F.col("size_base")).alias("start"), (F.col("one_before") + F.col("one_base")).alias("at"))
    total = total.first()[0] or 1  # one number
    # a row belongs where its middle falls, compared exactly in integers
    target = F.least(F.lit(shards - 1), F.expr(f"cast(cast(2 * start + size as decimal(38, 0)) * {shards} div {2 * total} as int)"))
    cutted = placed.withColumn("shard", target)
    first = cutted.groupBy("shard").agg(F.min("at").alias("first"))
    return cutted.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))  # one row for each shard


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> None:
    """The rows of `docs` under `out/shard=<n>/`; a join on the id and the text's checksum brings the placement."""
    placed = shard(docs, shards, text, key).groupBy("doc_id", "text_crc32", "size").agg(F.min("shard").alias("shard"))
    body = F.coalesce(F.col(text), F.lit(""))
    match = placed.doc_id.eqNullSafe(docs[key]) & (placed.text_crc32 == F.crc32(body.cast("binary"))) & (placed["size"] == F.octet_length(body) + 1)
    docs.join(placed, match).select(*(docs[c] for c in docs.columns if c != "shard"), placed.shard).write.partitionBy("shard").parquet(out)
