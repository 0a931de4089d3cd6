"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import new_path, write

_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 2048


def path(spark: SparkSession, tag: str) -> str:
    """A path in the folder that all executors share, for a table that goes with this process."""
    return new_path(spark, tag)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """`df`, written as Parquet and read back: its plan starts at the files."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, tag))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most `ARROW_ROWS` rows, where the session does not set a number itself.

    The JVM and the worker each hold a batch of every running task; by default it has
    10,000 rows.  This is for programs that own their session, the queries and the
    pipeline; operators leave the session as it is.
    """
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def partitions(df: DataFrame) -> int:
    """As many partitions as a shuffle has, and no fewer than the input's splits."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo `n`; a null id is outside every fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


#: Broadcast a side only when a count shows that it stays under so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def _width(df: DataFrame) -> F.Column:
    """About how many bytes a row takes."""
    parts = [F.lit(16 * len(df.columns))]
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(c), F.lit(0)) * 24)
    return sum(parts[1:], parts[0]).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it has at most `rows` rows and BROADCAST_BYTES (it should be a written table); else as it is."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def without(docs: DataFrame, dropped: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id and text's hash are not among `dropped` (doc_id, tie), a written table."""
    out = small(dropped.select(F.col("doc_id").alias("dropped_id"), F.col("tie").alias("dropped_tie")))
    tie = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(out, docs[key].cast("long").eqNullSafe(out["dropped_id"]) & (tie == out["dropped_tie"]), "left_anti")


def rows_where(docs: DataFrame, decide: Callable[[list], np.ndarray], text: str = "text") -> DataFrame:
    """Rows of `docs` for which `decide(texts)` is true, with all their columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textnp import batches

        for b, texts in batches(it, column=text):
            yield b.filter(pa.array(decide(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
