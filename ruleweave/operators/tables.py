"""Written tables: each round of a fixpoint starts from files, so plans stay small and lost executors cost a re-read."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []
#: tables written in buckets, and in how many
_bucketed: dict[str, int] = {}
#: A side is broadcast if a written table shows that it has at most so many bytes in memory.
BROADCAST_BYTES = 16 << 20
#: The round in which a row was found, a column of the files that relations do not show.
ROUND = "_round"
#: A relation of more blocks than this is written anew as one.
BLOCKS = 16


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all tasks run on this machine."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ruleweave-")
        spark.conf.set(_SETTING, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for a table that goes with this process."""
    out = f"{folder(spark)}/ruleweave/{re.sub(r'[^A-Za-z0-9_.-]', '_', tag)}-{uuid.uuid4().hex}"
    _made.append((spark, out))
    return out


def write(df: DataFrame, tag: str) -> str:
    out = new_path(df.sparkSession, tag)
    df.write.parquet(out)
    return out


def counted(df: DataFrame, tag: str, by: list[str] | None = None) -> tuple[str, int, int]:
    """Write `df`, in buckets by columns if there are any; (path, rows, bytes in memory), counted on the way."""
    seen, out = Observation(), new_path(df.sparkSession, tag)
    long = [F.octet_length(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    fixed = 16 * len(df.schema)
    size = F.sum(sum(long, F.lit(0)).cast("long") + fixed)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(parts, *by) if by else df
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).write
    if by:
        writer.bucketBy(parts, *by).format("parquet").option("path", out).saveAsTable(_table(out))
        _bucketed[out] = parts
    else:
        writer.parquet(out)
    return out, seen.get["rows"], seen.get["bytes"]


def _table(out: str) -> str:
    return "ruleweave_" + out.rsplit("-", 1)[1]


def in_buckets(spark: SparkSession, out: str) -> bool:
    """Whether a table lies in as many buckets as shuffles have partitions, so that joins on all columns need none."""
    return _bucketed.get(out) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_buckets(spark: SparkSession, out: str) -> DataFrame:
    return spark.table(_table(out))


def delete(spark: SparkSession, out: str) -> None:
    if _bucketed.pop(out, None):
        spark.sql(f"DROP TABLE IF EXISTS {_table(out)}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clear() -> None:
    """Delete what this process wrote."""
    for spark, out in _made:
        try:
            delete(spark, out)
        except Exception:  # the session may be gone; the folder belongs to the cluster then
            break
    _made.clear()


@dataclass
class Relation:
    """A set of rows as written blocks, one for each round that found any; or rows that are not written yet."""

    spark: SparkSession
    schema: T.StructType
    paths: list[str] = field(default_factory=list)
    rows: int = 0
    bytes: int = 0
    #: rows that are read once at most and so are left where they come from
    unwritten: DataFrame | None = None
    #: blocks of another relation, which are not this one's to delete; and own ones that newer ones have replaced
    adopted: set[str] = field(default_factory=set)
    stale: list[str] = field(default_factory=list)
    #: whether the next block is large, and goes into buckets by all columns
    large: bool = False

    def frame(self) -> DataFrame:
        if self.unwritten is not None:
            return self.unwritten
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def staged(self) -> DataFrame:
        """The rows, each with the number of its round."""
        if self.unwritten is not None or not self.paths:
            return self.frame().withColumn(ROUND, F.lit(0))
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField(ROUND, T.IntegerType())])).parquet(*self.paths)

    def copy(self) -> Relation:
        """The same blocks, to which others may be added."""
        return Relation(self.spark, self.schema, list(self.paths), self.rows, self.bytes, self.unwritten, set(self.paths))

    def add(self, df: DataFrame, tag: str, number: int = 0) -> Relation:
        """Write `df` as a new block of a round; returns that block as a relation, empty blocks included."""
        by = self.schema.names if self.large else None
        path, rows, size = counted(df.withColumn(ROUND, F.lit(number)), tag, by)
        block = Relation(self.spark, self.schema, [path], rows, size)
        if block.rows:
            self.paths.append(path)
            self.rows += rows
            self.bytes += size
            if len(self.paths) > BLOCKS:
                self.stale += [x for x in self.paths if x not in self.adopted]
                self.paths = [counted(self.staged(), tag, by)[0]]
        return block

    def bucketed(self, tag: str) -> list[DataFrame]:
        """The rows as tables in buckets by all columns; blocks that are in none are first written anew, as one."""
        loose = [x for x in self.paths if not in_buckets(self.spark, x)]
        if loose:
            rows = Relation(self.spark, self.schema, loose).staged()
            self.paths = [x for x in self.paths if x not in loose] + [counted(rows, tag, self.schema.names)[0]]
            self.stale += [x for x in loose if x not in self.adopted]
        return [read_buckets(self.spark, x).select(*self.schema.names) for x in self.paths]

    def tidy(self, used: set[str]) -> None:
        """Delete replaced blocks, but for those still in use."""
        for path in [x for x in self.stale if x not in used]:
            delete(self.spark, path)
            self.stale.remove(path)

    def small(self) -> bool:
        return self.unwritten is None and self.bytes <= BROADCAST_BYTES


def columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def unify(kinds: list[T.DataType]) -> T.DataType:
    """One type for a position: the wider integer, else double for numbers, else string."""
    kinds = list(dict.fromkeys(kinds))
    if len(kinds) == 1:
        return kinds[0]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(k, whole) for k in kinds):
        return max(kinds, key=lambda k: whole.index(type(k)))
    if all(isinstance(k, (*whole, T.FloatType, T.DoubleType)) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def as_facts(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ...; rows with a null are no facts.  Rows may repeat: what is derived from them will not."""
    return df.toDF(*columns(len(df.columns))).dropna()


def as_relation(df: DataFrame) -> DataFrame:
    """`df` as a set of facts."""
    return as_facts(df).distinct()
