"""Writing models and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_null
from ..plans.rules import Program, RuleError, Var


def file_name(pred: str) -> str:
    """A predicate's name as a folder's: path separators as octal escapes."""
    return pred.replace("\\", "\\134").replace("/", "\\057")


def without_nulls(df: DataFrame) -> DataFrame:
    """Rows without labelled nulls."""
    out = df
    for c in df.columns:
        out = out.where(~is_null(F.col(c)))
    return out


def csv(df: DataFrame, path: str, nulls: bool = True) -> None:
    """Comma-separated text; a value is quoted where it has to be."""
    (df if nulls else without_nulls(df)).write.option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def json(df: DataFrame, path: str) -> None:
    """Answers as JSON, an object of variables and values on each line."""
    df.write.json(path)


def tsv(df: DataFrame, path: str, number: str | None = None) -> None:
    """Tab-separated text with the round in which each row was found, column `number` or else 0, in front."""
    rest = [F.col(c).cast("string").alias(c) for c in df.columns if c != number]
    df.select((F.col(number) if number else F.lit(0)).alias("round"), *rest).write.option("sep", "\t").csv(path)


def ntriples(model: dict[str, DataFrame], program: Program, triples: str, path: str, per_file: int = 10_000_000) -> None:
    """Derived facts as triples, for predicates that copy a pattern of the triple source `triples`.

    `P(..) :- triples(..)` tells how a fact of P is a triple; facts that the source
    has already are left out by the caller's anti join or kept, as the model has them.
    """
    written: set[str] = set()
    for r in program.rules:
        if len(r.body) != 1 or r.body[0].pred != triples or len(r.heads) != 1 or r.heads[0].pred not in model:
            continue
        head, body = r.heads[0], r.body[0]
        at = {a.name: i for i, a in enumerate(head.args) if isinstance(a, Var)}
        if any(isinstance(a, Var) and a.name not in at for a in body.args):
            continue
        if head.pred in written:
            raise RuleError(f"{head.pred} is defined by two patterns of {triples}: which triple a fact is cannot be told")
        df = model[head.pred]
        parts = [F.col(df.columns[at[a.name]]) if isinstance(a, Var) else F.lit(str(a)) for a in body.args]
        line = df.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value")).distinct()
        line.write.mode("append" if written else "overwrite").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        written.add(head.pred)
    if not written:
        raise RuleError(f"no predicate is defined by a pattern of {triples}")


def write(frames: dict[str, DataFrame], path: str, form: str) -> None:
    """Each predicate below `path`, as files of one form."""
    if form not in ("csv", "json", "parquet", "tsv"):
        raise RuleError(f"unknown form {form!r}")
    for pred, df in frames.items():
        to = f"{path.rstrip('/')}/{file_name(pred)}"
        if form == "parquet":
            df.write.parquet(to)
        elif form == "csv":
            csv(df, to)
        elif form == "json":
            json(df, to)
        else:
            tsv(df, to)
