"""Rule bodies as joins of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rules import Atom, Rule, RuleError, Var
from .tables import unify
from .tiles import pairs

#: Joined rows that a tile of a projected join should have, and blocks of a side that it may take whatever they cost.
TILE_ROWS = 4 << 20
TILE_BLOCKS = 16
#: Blocks of runs of numbers that a side may have.
RUN_BLOCKS = 256


def literal(value: object, kind: T.DataType) -> Column:
    """A constant in the type of the position that it is compared with."""
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    return F.lit(value).try_cast(kind.simpleString()) if not isinstance(value, str) else F.lit(value.strip("\"'")).try_cast(kind.simpleString())


def matches(atom: Atom, df: DataFrame, tag: str) -> DataFrame:
    """Rows of a relation that fit an atom, one column for each of its variables.

    Columns get fresh names first: the same relation may stand in a body twice.
    """
    if len(df.columns) != len(atom.args):
        raise RuleError(f"{atom.pred} has {len(df.columns)} columns and {len(atom.args)} arguments")
    named = df.toDF(*(f"{tag}_{i}" for i in range(len(atom.args))))
    first: dict[str, str] = {}
    for i, a in enumerate(atom.args):
        column = named[f"{tag}_{i}"]
        if not isinstance(a, Var):
            named = named.where(column == literal(a, named.schema[i].dataType))
        elif a.name in first:
            named = named.where(column == named[first[a.name]])
        else:
            first[a.name] = f"{tag}_{i}"
    return named.select(*(F.col(c).alias(f"v_{v}") for v, c in first.items())) if first else named.select(F.lit(1).alias("v_")).limit(1)


def _alike(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with one type for each common column, and those columns."""
    on = [c for c in right.columns if c in left.columns]
    for c in on:
        a, b = left.schema[c].dataType, right.schema[c].dataType
        if a != b:
            kind = unify([a, b])
            left, right = left.withColumn(c, F.col(c).cast(kind)), right.withColumn(c, F.col(c).cast(kind))
    return left, right, on


def joined(left: DataFrame | None, right: DataFrame, needed: set[str], negated: bool = False) -> DataFrame:
    """`left` with an atom's rows; a check only where the atom adds no variable that is needed."""
    if left is None:
        return right
    left, right, on = _alike(left, right)
    if negated:
        return left.join(right, on, "left_anti") if on and on != ["v_"] else left.join(right.limit(1), F.lit(True), "left_anti")
    new = [c for c in right.columns if c not in on and c in needed]
    if not new:
        return left.join(right, on, "left_semi") if on else left.join(right.limit(1), F.lit(True), "left_semi")
    if not on:
        return left.crossJoin(right.select(*new))  # the rule itself asks for a product
    return left.join(right.select(*on, *new), on)


def order(body: tuple[Atom, ...], first: int | None, sizes: dict[int, int]) -> list[int]:
    """Positive atoms, `first` in front, then the smallest that shares a variable; negated ones last."""
    rest = [i for i, a in enumerate(body) if not a.negated]
    start = first if first is not None else min(rest, key=lambda i: (sizes[i], i))
    out, seen = [start], set(body[start].vars())
    rest.remove(start)
    while rest:
        at = min(rest, key=lambda i: (not seen & set(body[i].vars()), sizes[i], i))
        out.append(at)
        seen |= set(body[at].vars())
        rest.remove(at)
    return out + [i for i, a in enumerate(body) if a.negated]


def body_rows(rule: Rule, frames: list[DataFrame], sizes: list[int], first: int | None = None, few: int = 0) -> DataFrame:
    """The matches of a rule's body: one column `v_X` for each variable that the head needs.

    `frames[i]` is what the body's atom i reads; a frame of at most `few` bytes is broadcast.
    """
    at = order(rule.body, first, dict(enumerate(sizes)))
    out: DataFrame | None = None
    for k, i in enumerate(at):
        a = rule.body[i]
        later = {v for j in at[k + 1 :] for v in rule.body[j].vars()}
        needed = {f"v_{v}" for v in later | {v for h in rule.heads for v in h.vars()}}
        right = matches(a, frames[i], f"a{i}")
        if sizes[i] <= few:
            right = F.broadcast(right)
        out = joined(out, right, needed, a.negated)
        keep = [c for c in out.columns if c in needed]
        if keep and keep != out.columns:
            out = out.select(*keep)
    return out


def projects(rule: Rule) -> bool:
    """Whether a body is a join of two atoms whose head takes variables of both and leaves one that they share out."""
    if len(rule.body) != 2 or any(b.negated for b in rule.body) or rule.existential():
        return False
    a, b = (set(x.vars()) for x in rule.body)
    head = {v for h in rule.heads for v in h.vars()}
    return bool((a & b) - head and (a - b) & head and (b - a) & head)


def _quantiles(df: DataFrame, kept: list[str]) -> tuple[int, int] | None:
    """What a tenth and nine tenths of the values lie under, if they are whole numbers."""
    if len(kept) > 1 or not isinstance(df.schema[kept[0]].dataType, T.IntegralType):
        return None
    q = df.select(F.percentile_approx(kept[0], [0.1, 0.9]).alias("q")).first().q
    return (q[0], q[1]) if q else None


def _block(kept: list[str], blocks: int, width: int | None = None) -> Column:
    """The block of a row's values: by runs of `width` numbers that follow each other, else by hash."""
    at = F.xxhash64(*kept) if width is None else F.floor(F.col(kept[0]) / F.lit(float(width)))
    return F.pmod(at, F.lit(blocks)).cast("int")


def _runs(left: DataFrame, right: DataFrame, on: list[str], mine: list[str], other: list[str], rows: float, most: float) -> tuple[int, list[int | None], list[tuple[int, int]]] | None:
    """Blocks of a side, the widths of their runs and the tiles that have rows; None if hashed blocks are not much worse.

    Keys that are near each other often join the same ones.  Blocks of runs then meet few
    of the others, and rows are copied to few tiles: at most to half of `most`.
    """
    ends = [_quantiles(left, mine), _quantiles(right, other)]
    if None in ends:
        return None
    side = max(1, min(RUN_BLOCKS, round(sqrt(rows / TILE_ROWS))))
    widths = [max(1, ceil((hi - lo) / 0.8 / side)) for lo, hi in ends]
    l = left.groupBy(*on, _block(mine, side, widths[0]).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    r = right.groupBy(*on, _block(other, side, widths[1]).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    tiles = l.join(r, on).groupBy("a", "b").agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("rows"), F.sum(F.col("n") + F.col("m")).alias("copies")).collect()
    if 2 * sum(t.copies for t in tiles) > most or max(t.rows for t in tiles) > 4 * rows / side:
        return None
    return side, widths, [(t.a, t.b) for t in tiles]


def projected(rule: Rule, frames: list[DataFrame]) -> Callable[[DataFrame | None], DataFrame] | None:
    """The matches of a body that `projects`, as a set, but for given ones; None if the join does not multiply its rows.

    A side's rows are dealt into blocks by what the head takes from them, and each pair
    of blocks is a tile, which one task joins and de-duplicates, and from which it takes
    the given matches.  What is shuffled are both sides, once for each block of the other
    one that has the key, and never the joined rows; the blocks are few enough for that.
    A key that many rows share has rows in all tiles.
    """
    left, right, on = _alike(*(matches(b, f, f"a{i}") for i, (b, f) in enumerate(zip(rule.body, frames, strict=True))))
    head = {f"v_{v}" for h in rule.heads for v in h.vars()}
    mine, other = [c for c in left.columns if c in head], [c for c in right.columns if c in head and c not in on]
    kinds = T.StructType([*(left.schema[c] for c in mine), *(right.schema[c] for c in other)])
    if any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in kinds):
        return None  # these have equal values that are written differently
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("n")).join(right.groupBy(on).agg(F.count(F.lit(1)).alias("m")), on)
    rows, n, m = counts.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.sum("n"), F.sum("m")).first()
    if not rows or rows < max(TILE_ROWS, 8 * (n + m)):
        return None
    side = min(sqrt(rows / TILE_ROWS), max(TILE_BLOCKS, rows / 32 / (n + m)))
    a, b, widths = max(1, round(side * sqrt(n / m))), max(1, round(side * sqrt(m / n))), [None, None]
    runs = _runs(left, right, on, mine, other, rows, float(n) * b + float(m) * a)
    if runs:
        a, widths, used = runs
        b = a
    else:
        used = [(i, j) for i in range(a) for j in range(b)]
    # numbers for the tiles that hash partitioning deals one to each partition
    ids = left.sparkSession.range(24 * len(used) + 24).groupBy(F.pmod(F.hash("id"), F.lit(len(used))).alias("at")).agg(F.min("id").alias("id")).collect()
    number = [-1] * (a * b)
    for (i, j), x in zip(used, ids, strict=True):
        number[i * b + j] = x.id
    tile = F.element_at(F.lit(number).cast("array<long>"), (F.col("a") * b + F.col("b") + 1).cast("int")).alias("tile")

    def value(kept: list[str]) -> Column:
        return F.col(kept[0]) if len(kept) == 1 else F.struct(*kept)

    def lists(df: DataFrame, by: list[str], kept: list[str], block: Column, name: str) -> DataFrame:
        return df.groupBy(*by, block.alias(name)).agg(F.collect_set(value(kept)).alias(f"{name}s"))

    in_a, in_b = _block(mine, a, widths[0]), _block(other, b, widths[1])

    def found(less: DataFrame | None = None) -> DataFrame:
        rows = lists(left, on, mine, in_a, "a").join(lists(right, on, other, in_b, "b"), on).select(tile, "as", "bs", F.lit(False).alias("less"))
        if less is not None:
            gone = lists(less, mine, other, in_b, "b").withColumn("a", in_a)
            rows = rows.union(gone.select(tile, F.array(value(mine)).alias("as"), "bs", F.lit(True).alias("less")).where("tile >= 0"))
        return rows.repartition(len(used), "tile").select("as", "bs", "less").mapInArrow(pairs(kinds.names, (len(mine) > 1, len(other) > 1)), kinds)

    return found
