"""Sources of facts, and the configuration file that names them.

A source is a DataFrame; its rows are facts once nulls and repeats are gone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import plain_literal, triple_part
from ..operators.tables import as_relation, columns
from ..plans.rules import RuleError


def parquet(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Columns `names` of Parquet files, or all of them."""
    df = spark.read.parquet(path)
    return df.select(*names) if names else df


def csv(spark: SparkSession, path: str, sep: str = ",", arity: int | None = None) -> DataFrame:
    """Quoted text without a header; an empty field is the empty constant, and every row has the same number of fields."""
    read = spark.read.option("quote", '"').option("escape", '"').option("sep", "\t" if sep == "t" else sep)
    arity = arity or len(read.csv(path).columns)
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in [*columns(arity), "_ragged"]])
    df = read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_ragged").csv(path)
    wrong = F.raise_error(F.concat(F.lit(f"not {arity} fields: "), "_ragged"))
    first = F.when(F.col("_ragged").isNotNull(), wrong).otherwise(F.coalesce("c0", F.lit("")))
    return df.select(first.alias("c0"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns(arity)[1:]))


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Subject, predicate and object of every valid line; other lines are skipped."""
    line = spark.read.text(path)
    parts = line.select(*(triple_part(F.col("value"), i + 1).alias(f"c{i}") for i in range(3)))
    return parts.where("c0 <> ''").withColumn("c2", plain_literal(F.col("c2")))


def rows(spark: SparkSession, facts: Iterable[tuple], schema: str | None = None) -> DataFrame:
    """Literal rows, all of one length."""
    facts = list(facts)
    if len({len(f) for f in facts}) > 1:
        raise RuleError("rows of different lengths")
    if any(v is None for f in facts for v in f):
        raise RuleError("a fact has no nulls")
    return spark.createDataFrame(facts, schema or [f"c{i}" for i in range(len(facts[0]) if facts else 1)])


def view(spark: SparkSession, sql: str) -> DataFrame:
    """Any query as a source: arithmetic, windows and aggregates go here, since rules have none."""
    return spark.sql(sql)


def jdbc(spark: SparkSession, url: str, table: str, *names: str, **options: str) -> DataFrame:
    """A table of a database; constants in atoms reach it as a WHERE clause."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.select(*names) if names else df


def triples(spark: SparkSession, path: str) -> DataFrame:
    """A triple store: Parquet partitioned by predicate, read as (subject, predicate, object)."""
    return spark.read.parquet(path).select("s", "p", "o")


def load_triples(df: DataFrame, path: str) -> None:
    """Write (subject, predicate, object) so that a constant predicate reads its own files only."""
    df.toDF("s", "p", "o").distinct().repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).write.partitionBy("p").parquet(path)


def without(df: DataFrame, removed: DataFrame) -> DataFrame:
    """A source with some rows hidden."""
    names = columns(len(df.columns))
    gone = removed.toDF(*(f"k{i}" for i in range(len(names))))
    left = df.toDF(*names)
    return left.join(gone, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, gone.columns, strict=True)], "left_anti")


def removal_list(spark: SparkSession, path: str, arity: int) -> DataFrame:
    """Rows of a text file of terms parted by white space; a full stop at a line's end closes a row, which may take several lines."""
    words = spark.read.option("lineSep", ".\n").text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    words = words.select(F.filter("w", lambda x: ~x.isin("", ".")).alias("w")).where(F.size("w") > 0)
    wrong = F.raise_error(F.concat(F.lit(f"not {arity} terms: "), F.array_join("w", " "))).cast("string")
    return words.select(*(F.when(F.size("w") == arity, F.col("w")[i]).otherwise(wrong).alias(f"c{i}") for i in range(arity)))


def changes(spark: SparkSession, folder: str, source: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(removed, added) rows of sources, from the files `<pred>_remove.csv` and `<pred>_add.csv` of a folder, in the sources' types."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: tuple[dict[str, DataFrame], dict[str, DataFrame]] = ({}, {})
    for pred, df in source.items():
        for found, end in zip(out, ("remove", "add"), strict=True):
            file = f"{folder.rstrip('/')}/{pred}_{end}.csv"
            at = jvm.org.apache.hadoop.fs.Path(file)
            if at.getFileSystem(conf).exists(at):
                rows = csv(spark, file, arity=len(df.columns))
                found[pred] = rows.select(*(F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, df.schema, strict=True)))
    return out


def _in_memory(spark: SparkSession, p: list[str]) -> DataFrame:
    """CSV if there is one, else N-Triples, compressed or not."""
    folder, name, sep = p[0].rstrip("/"), p[1], p[2] if len(p) > 2 else ","
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for end in (".csv.gz", ".csv", ".nt.gz", ".nt"):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{end}")
        if at.getFileSystem(conf).exists(at):
            return csv(spark, f"{folder}/{name}{end}", sep) if ".csv" in end else ntriples(spark, f"{folder}/{name}{end}")
    raise RuleError(f"no {name}.csv or {name}.nt in {folder}")


def _database(spark: SparkSession, p: list[str]) -> DataFrame:
    url, user, password, table, *names = p
    return jdbc(spark, url, table, *(n for x in names for n in x.split(",")), user=user, password=password)


KINDS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "INMEMORY": _in_memory,
    "PARQUET": lambda spark, p: parquet(spark, p[0], *p[1:]),
    "TRIPLES": lambda spark, p: triples(spark, p[0]),
    "SQL": lambda spark, p: view(spark, p[0]),
    "JDBC": _database,
}


def configured(spark: SparkSession, text: str, folder: str = "") -> dict[str, DataFrame]:
    """Sources by predicate, from lines `EDB<i>_predname=`, `EDB<i>_type=` and `EDB<i>_param<j>=`.

    A relative folder of an INMEMORY source is taken below `folder`, the configuration's own.
    """
    found: dict[int, dict[str, str]] = {}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.fullmatch(r"\s*EDB(\d+)_(predname|type|param\d+)\s*=\s*(.*?)\s*", line)
        if not m:
            raise RuleError(f"cannot read {line!r}")
        found.setdefault(int(m[1]), {})[m[2]] = m[3]
    out = {}
    for i, given in sorted(found.items()):
        if given.get("type") not in KINDS:
            raise RuleError(f"EDB{i}: unknown type {given.get('type')!r}")
        if not given.get("predname"):
            raise RuleError(f"EDB{i} has no predname")
        params = [given[f"param{j}"] for j in range(len([k for k in given if k.startswith("param")]))]
        if given["type"] == "INMEMORY" and folder and not re.match(r"/|\w+:", params[0]):
            params[0] = f"{folder.rstrip('/')}/{params[0]}"
        out[given["predname"]] = KINDS[given["type"]](spark, params)
    return out


def statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """rows and distinct values of each column, in one row."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(F.count(F.lit(1)).alias("rows"), *(count(c).alias(f"distinct_{c}") for c in df.columns))


__all__ = [n for n in dir() if not n.startswith("_")] + ["as_relation"]
