"""Semi-naive evaluation of rule programs, one written round at a time.

Strata follow each other; within one, all rules are evaluated against the same
snapshot, so the number of rounds is the depth of the recursion and not its number
of rules.  In a round every rule has one plan for each recursive body atom, which
reads the last round's new rows there, rows known before that for the recursive
atoms in front of it and all rows for those behind.  New rows are de-duplicated,
compared with the known ones by an anti join, and written; only their count and size
come to the driver.  A predicate without recursion that other rules read once at most is
not written: it is a part of the plan that reads it.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import is_null, labelled_null
from ..plans.rules import SAME_AS, Atom, Program, Rule, RuleError, Var
from .bodies import body_rows, literal, matches, projected, projects
from .components import components
from .tables import BROADCAST_BYTES, Relation, as_relation, columns, counted, delete, read_buckets, unify

SKOLEM, RESTRICTED = "skolem", "restricted"


class TimedOut(RuntimeError):
    """Evaluation took longer than allowed; `model` has what was found."""


@dataclass
class Stats:
    rounds: int = 0
    derived: int = 0
    seconds: float = 0.0
    #: rows by predicate and round
    new: list[tuple[int, str, int]] = field(default_factory=list)


class Evaluation:
    """One run of a program over source relations."""

    def __init__(self, spark: SparkSession, program: Program, sources: dict[str, DataFrame], chase: str = RESTRICTED, max_rounds: int | None = None, timeout: float | None = None, una: bool = False, spelled: bool = False, start: dict[str, Relation | DataFrame] | None = None, watch: Callable[[DataFrame], None] | None = None, prune: Callable[[DataFrame], DataFrame] | None = None, inline: bool = True):
        if chase not in (SKOLEM, RESTRICTED):
            raise RuleError(f"unknown chase {chase!r}")
        program.check({p: len(d.columns) for p, d in sources.items()})
        self.spark, self.program, self.sources = spark, program, sources
        self.chase, self.max_rounds, self.una, self.spelled = chase, max_rounds, una, spelled
        self.until = time.monotonic() + timeout if timeout else None
        self.watch, self.prune, self.inline = watch, prune, inline and not watch and not prune and not any(r.is_egd() for r in program.rules)
        self.number = {id(r): i for i, r in enumerate(program.rules)}
        start = start or {}
        self.kinds = self._kinds({p: d.frame() if isinstance(d, Relation) else d for p, d in start.items()})
        self.full: dict[str, Relation] = {}
        self.stats = Stats()
        self._sizes: dict[str, int] = {}
        #: tables of a round that the next one does not need
        self._given: list[str] = []
        #: rules whose projected join is a predicate, with what makes its rows
        self._tiled: dict[str, tuple[Rule, Callable[[DataFrame | None], DataFrame]]] = {}
        #: blocks that the caller of a saturation still reads
        self._held: set[str] = set()
        for p in sorted(program.idb()):
            self.full[p] = Relation(spark, T.StructType([T.StructField(c, k) for c, k in zip(columns(len(self.kinds[p])), self.kinds[p], strict=True)]))
            if p in start and isinstance(start[p], Relation) and start[p].unwritten is None and start[p].schema == self.full[p].schema:
                self.full[p] = start[p].copy()
            elif p in start:
                known = start[p].frame() if isinstance(start[p], Relation) else start[p]
                self.full[p].add(self._typed(p, known), p)
        unknown = {b.pred for r in program.rules for b in r.body} - set(self.full) - set(sources)
        if unknown:
            raise RuleError(f"no source and no rule for {', '.join(sorted(unknown))}")

    # types

    def _kinds(self, start: dict[str, DataFrame]) -> dict[str, list[T.DataType]]:
        """The type of every position: those of sources, carried through rules until nothing changes."""
        source = {p: [f.dataType for f in d.schema] for p, d in self.sources.items()}
        found: dict[str, list[list[T.DataType]]] = {p: [[] for _ in range(n)] for p, n in self.program.arities().items()}
        for p, d in start.items():
            if p in found:
                for i, f in enumerate(d.schema):
                    found[p][i].append(f.dataType)
        constants = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        while True:
            before = {p: [unify(k) if k else None for k in ks] for p, ks in found.items()}
            for r in self.program.rules:
                of: dict[str, list[T.DataType]] = defaultdict(list)
                for b in r.body:
                    if not b.negated:
                        for i, a in enumerate(b.args):
                            kind = source[b.pred][i] if b.pred in source else before[b.pred][i]
                            if isinstance(a, Var) and kind is not None:
                                of[a.name].append(kind)
                loose = set(r.existential())
                for h in r.heads:
                    for i, a in enumerate(h.args):
                        if not isinstance(a, Var):
                            found[h.pred][i].append(constants[type(a)])
                        elif a.name in loose:
                            found[h.pred][i].append(T.StringType())
                        elif of[a.name]:
                            found[h.pred][i].append(unify(of[a.name]))
            for ks in found.values():
                for k in ks:
                    k[:] = list(dict.fromkeys(k))
            after = {p: [unify(k) if k else None for k in ks] for p, ks in found.items()}
            if after == before:
                return {p: source.get(p) or [k or T.StringType() for k in ks] for p, ks in after.items()}

    def _typed(self, pred: str, df: DataFrame) -> DataFrame:
        named = df.toDF(*columns(len(df.columns)))
        return named.select(*(F.col(c).cast(k).alias(c) for c, k in zip(named.columns, self.kinds[pred], strict=True)))

    # reading

    def frame(self, pred: str) -> DataFrame:
        return self.full[pred].frame() if pred in self.full else self.sources[pred]

    def size(self, pred: str) -> int:
        """Bytes, where they are counted; other relations count as large."""
        if pred in self.full:
            return self.full[pred].bytes if self.full[pred].unwritten is None else 1 << 40
        return self._sizes.get(pred, 1 << 40)

    # one rule

    def _heads(self, r: Rule, rows: DataFrame) -> dict[str, list[DataFrame]]:
        """The head facts of body matches."""
        frontier = [F.col(f"v_{v}") for v in r.frontier()]
        loose = {v: labelled_null(self.number.get(id(r), 0), v, frontier, self.spelled) for v in r.existential()}
        out: dict[str, list[DataFrame]] = defaultdict(list)
        for h in r.heads:
            kinds = self.kinds[h.pred]
            args = []
            for i, a in enumerate(h.args):
                c = literal(a, kinds[i]) if not isinstance(a, Var) else loose.get(a.name, F.col(f"v_{a.name}") if a.name not in loose else None)
                args.append(c.cast(kinds[i]).alias(f"c{i}"))
            out[h.pred].append(rows.select(*args))
        return out

    def _unsatisfied(self, r: Rule, rows: DataFrame) -> DataFrame:
        """Matches whose head is not yet there for some values of its existential variables."""
        found: DataFrame | None = None
        for i, h in enumerate(r.heads):
            right = matches(h, self.frame(h.pred), f"h{i}")
            on = [c for c in right.columns if found is not None and c in found.columns]
            found = right if found is None else (found.join(right, on) if on else found.crossJoin(right))
        keys = [f"v_{v}" for v in r.frontier()]
        if not keys:
            return rows.join(found.limit(1), F.lit(True), "left_anti")
        typed = found.select(*(F.col(k).cast(rows.schema[k].dataType) for k in keys))
        return rows.join(typed.distinct(), keys, "left_anti")

    def _plans(self, r: Rule, recursive: set[str], delta: dict[str, Relation], old: dict[str, DataFrame]) -> list[DataFrame]:
        """Body matches of a rule that use at least one new row."""
        out = []
        for i, b in enumerate(r.body):
            if b.negated or b.pred not in recursive or not delta[b.pred].rows:
                continue
            frames, sizes = [], []
            for j, a in enumerate(r.body):
                fresh = not a.negated and a.pred in recursive
                frames.append(delta[a.pred].frame() if j == i else old[a.pred] if fresh and j < i else self.frame(a.pred))
                sizes.append(delta[a.pred].bytes if j == i else self.size(a.pred))
            out.append(body_rows(r, frames, sizes, i, BROADCAST_BYTES))
        return out

    def _whole(self, r: Rule) -> DataFrame:
        return body_rows(r, [self.frame(b.pred) for b in r.body], [self.size(b.pred) for b in r.body], None, BROADCAST_BYTES)

    def _set(self, r: Rule) -> tuple[DataFrame, bool]:
        """The matches of a body, and whether no two of them are equal where they differ in no variable of the head."""
        rows = self._remaining(r)
        if rows is not None:
            return rows, {a.name for a in r.body[0].args} <= {v for h in r.heads for v in h.vars()}
        if projects(r):
            self._write([p for p in {b.pred for b in r.body} if sum(b.pred == p for q in self.program.rules for b in q.body) > 1])
            found = projected(r, [self.frame(b.pred) for b in r.body])
            if found is not None:
                if len(r.heads) == 1:
                    self._tiled[r.heads[0].pred] = (r, found)
                return found(None), True
        return self._whole(r), False

    def _remaining(self, r: Rule) -> DataFrame | None:
        """The matches of a body that takes rows from an unwritten projected join, if its tiles can take them: joined rows are not shuffled for it."""
        (first, *rest) = r.body
        if first.negated or not rest or not all(b.negated for b in rest) or first.pred not in self._tiled or self.full[first.pred].unwritten is None:
            return None
        made, found = self._tiled[first.pred]
        head, names = made.heads[0].args, [a.name for a in first.args if isinstance(a, Var)]
        rows = found(None)
        if not all(isinstance(a, Var) for a in (*head, *first.args)) or len(set(names)) < len(head) or {f"v_{a.name}" for a in head} != set(rows.columns) or len(head) != len(rows.columns):
            return None
        less: DataFrame | None = None
        for b in rest:
            if set(b.vars()) != set(names):
                return None
            part = matches(b, self.frame(b.pred), "n").select(*(F.col(f"v_{v}").alias(f"v_{h.name}") for v, h in zip(names, head, strict=True)))
            if any(part.schema[c].dataType != rows.schema[c].dataType for c in rows.columns):
                return None
            less = part if less is None else less.unionByName(part)
        return found(less).select(*(F.col(f"v_{h.name}").alias(f"v_{v}") for v, h in zip(names, head, strict=True)))

    # rounds

    def _store(self, found: dict[str, list[DataFrame]]) -> dict[str, Relation]:
        """Write what is new of each predicate."""
        delta = {}
        for p in sorted(found):
            rows = reduce(DataFrame.unionByName, found[p]).distinct()
            if self.full[p].rows:
                rows = self._unknown(rows, p)
            delta[p] = self.full[p].add(self.prune(rows) if self.prune else rows, p, self.stats.rounds)
            self.stats.derived += delta[p].rows
            if delta[p].rows:
                self.stats.new.append((self.stats.rounds, p, delta[p].rows))
                if self.watch:
                    self.watch(delta[p].frame())
        return delta

    def _unknown(self, rows: DataFrame, pred: str) -> DataFrame:
        """Rows that the relation does not have.

        A relation that is no longer small is scanned where it lies, for the rows in
        question that it has, if those are few; else both lie in buckets by the whole
        row, and are compared bucket by bucket: known rows are not shuffled again.
        """
        full = self.full[pred]
        keys = [f"k{i}" for i in range(len(rows.columns))]
        on = [F.col(c) == F.col(k) for c, k in zip(rows.columns, keys, strict=True)]
        full.large = False
        if full.small():
            return rows.join(F.broadcast(full.frame().toDF(*keys)), on, "left_anti")
        path, _, size = counted(rows, pred, rows.columns)
        self._given.append(path)
        if size > BROADCAST_BYTES:
            full.large = True
            rows = read_buckets(self.spark, path)
            for known in full.bucketed(pred):
                rows = rows.join(known.toDF(*keys), on, "left_anti")
            return rows
        rows = self.spark.read.schema(full.schema).parquet(path)
        again = full.frame().toDF(*keys).join(F.broadcast(rows), on, "left_semi")
        return rows.join(F.broadcast(again), on, "left_anti")

    def _tick(self) -> None:
        self.stats.rounds += 1
        if self.until and time.monotonic() > self.until:
            raise TimedOut
        if self.max_rounds and self.stats.rounds > self.max_rounds:
            raise RuleError(f"no fixpoint after {self.max_rounds} rounds")

    def _saturate(self, rules: list[Rule], delta: dict[str, Relation] | None) -> bool:
        """Evaluate rules to their fixpoint; from `delta` if given, else from all rows."""
        recursive = {h.pred for r in rules for h in r.heads}
        changed = False
        before: dict[str, list[str]] = {p: [] for p in recursive}
        if delta is None:
            self._tick()
            known = {p: list(self.full[p].paths) for p in recursive}
            found: dict[str, list[DataFrame]] = defaultdict(list)
            for r in rules:
                if any(not b.negated and b.pred in self.full and not self.full[b.pred].rows and self.full[b.pred].unwritten is None for b in r.body):
                    continue
                for p, dfs in self._heads(r, self._set(r)[0]).items():
                    found[p] += dfs
            delta = self._store(found)
            before = known
        while any(d.rows for d in delta.values()):
            changed = True
            self._tick()
            delta = {p: delta.get(p, Relation(self.spark, self.full[p].schema)) for p in recursive | set(delta)}
            old = {p: Relation(self.spark, self.full[p].schema, before.get(p, [])).frame() for p in recursive}
            now = {p: list(self.full[p].paths) for p in recursive}
            found = defaultdict(list)
            for r in rules:
                for rows in self._plans(r, set(delta), delta, {**{p: self.frame(p) for p in delta if p in self.full}, **old}):
                    for p, dfs in self._heads(r, rows).items():
                        found[p] += dfs
            delta = self._store(found)
            before = now
            used = self._held | {x for d in (*delta.values(), *(self.full[p] for p in recursive)) for x in d.paths} | {x for xs in before.values() for x in xs}
            for p in recursive:
                self.full[p].tidy(used)
            for path in self._given:
                delete(self.spark, path)
            self._given.clear()
        return changed

    def carry(self, rules: list[Rule], delta: dict[str, Relation]) -> dict[str, Relation]:
        """Saturate rules from new rows; returns all rows that this added, by predicate."""
        heads = {h.pred for r in rules for h in r.heads}
        known = {p: set(self.full[p].paths) for p in heads}
        self._held |= {x for d in delta.values() for x in d.paths}
        self._saturate(rules, delta)
        out = {}
        for p in heads:
            fresh = [x for x in self.full[p].paths if x not in known[p]]
            out[p] = Relation(self.spark, self.full[p].schema, fresh + (delta[p].paths if p in delta and delta[p].rows else []))
            path, out[p].rows, out[p].bytes = counted(out[p].frame(), p)
            out[p].paths = [path]
        return out

    def run(self) -> Evaluation:
        began = time.monotonic()
        try:
            for rules in self.program.strata():
                if self.inline and self._inline(rules):
                    continue
                plain = [r for r in rules if not r.existential() and not r.is_egd()]
                loose = [r for r in rules if r.existential()]
                self._stratum(plain, loose)
            if any(r.is_egd() for r in self.program.rules):
                self._with_equality()
        finally:
            self.stats.seconds = time.monotonic() - began
        return self

    def _inline(self, rules: list[Rule]) -> bool:
        """Leave a predicate unwritten, if that is as good: it is not recursive, and read at most once."""
        heads = {h.pred for r in rules for h in r.heads}
        simple = len(heads) == 1 and not any(r.existential() or len(r.heads) > 1 for r in rules) and not any(b.pred in heads for r in rules for b in r.body)
        pred = next(iter(heads))
        reads = sum(b.pred == pred for r in self.program.rules for b in r.body)
        again = {h.pred for g in self.program.strata() for r in g if any(b.pred in {h.pred for q in g for h in q.heads} for b in r.body) for h in r.heads}
        looped = any(b.pred == pred and (r.existential() or any(h.pred in again for h in r.heads)) for r in self.program.rules for b in r.body)
        if not simple or reads > 1 or looped or self.full[pred].rows:
            return False
        self._tick()
        found = [(r, *self._set(r)) for r in rules]
        rows = [df for r, df, _ in found for df in self._heads(r, df)[pred]]
        if len(found) == 1 and found[0][2] and self._faithful(*found[0][:2]):
            self.full[pred].unwritten = rows[0]
        else:
            self._tiled.pop(pred, None)
            self.full[pred].unwritten = reduce(DataFrame.unionByName, rows).distinct()
        return True

    def _faithful(self, r: Rule, rows: DataFrame) -> bool:
        """Whether a rule's only head tells different matches apart: it keeps their types."""
        h = r.heads[0]
        return all(not isinstance(a, Var) or rows.schema[f"v_{a.name}"].dataType == k for a, k in zip(h.args, self.kinds[h.pred], strict=True))

    def _settle(self, rules: list[Rule]) -> None:
        """Write the sources that are read in every round, once; their sizes are known from then on."""
        heads = {h.pred for r in rules for h in r.heads}
        again = [r for r in rules if r.existential() or any(b.pred in heads for b in r.body)]
        self._write({b.pred for r in again for b in r.body})

    def _write(self, preds: Iterable[str]) -> None:
        """Write those of the predicates that are sources and are not written yet."""
        for p in sorted(set(preds) & set(self.sources) - set(self._sizes)):
            path, _, self._sizes[p] = counted(self.sources[p], p)
            self.sources = {**self.sources, p: self.spark.read.schema(self.sources[p].schema).parquet(path)}

    def _stratum(self, plain: list[Rule], loose: list[Rule]) -> None:
        self._settle(plain + loose)
        if self.chase == SKOLEM or not loose:
            self._saturate(plain + loose, None)
            return
        self._saturate(plain, None)
        again = True
        while again:  # one existential rule at a time, plain rules to their fixpoint after each
            again = False
            for r in loose:
                self._tick()
                delta = self._store(self._heads(r, self._unsatisfied(r, self._whole(r))))
                if any(d.rows for d in delta.values()):
                    again = True
                    self._saturate(plain, delta)

    # equality

    def _with_equality(self) -> None:
        """Merge equal terms and go on, until no rule finds two different terms that are equal."""
        equal = [r for r in self.program.rules if r.is_egd()]
        rest = [r for r in self.program.rules if not r.is_egd()]
        while True:
            self._tick()
            pairs = [self._whole(r) for r in equal]
            links = reduce(DataFrame.union, [rows.select(*(F.col(f"v_{a.name}").cast("string") if isinstance(a, Var) else F.lit(str(a)) for a in r.heads[0].args)).toDF("x", "y") for r, rows in zip(equal, pairs, strict=True)]).where("x <> y").distinct()
            merged = components(links, lambda c: F.struct(is_null(c).alias("null"), F.length(c).alias("depth"), c.alias("term")))
            if merged is None:
                return
            if self.una and not merged.where(~is_null(F.col("node")) & ~is_null(F.col("root")) & (F.col("node") != F.col("root"))).isEmpty():
                raise RuleError("two different constants are equal")
            self._replace(merged)
            for rules in Program(rest, self.program.hidden).strata():
                self._stratum([r for r in rules if not r.existential()], [r for r in rules if r.existential()])

    def _replace(self, merged: DataFrame) -> None:
        """Put each term's representative in its place in every relation, sources included."""
        for p in [*self.full, *{b.pred for r in self.program.rules for b in r.body} - set(self.full)]:
            df = self.frame(p)
            for i, f in enumerate(df.schema):
                new = merged.select(F.col("node").cast(f.dataType).alias(f"n{i}"), F.col("root").cast(f.dataType).alias(f"r{i}"))
                df = df.join(new, df[f.name] == new[f"n{i}"], "left").withColumn(f.name, F.coalesce(f"r{i}", f.name)).drop(f"n{i}", f"r{i}")
            block = Relation(self.spark, df.schema)
            block.add(df.distinct(), p, self.stats.rounds)
            if p in self.full:
                self.full[p] = block
            else:
                self._sizes[p] = block.bytes
                self.sources = {**self.sources, p: block.frame()}


def select(df: DataFrame, query: Atom, constants: bool = False) -> DataFrame:
    """Answers to an atom: its variables, or all its arguments, as columns; `df` is a set of rows."""
    rows = matches(query, df, "q")
    names = [a.name for a in query.args if isinstance(a, Var)]
    if constants:
        rows = rows.select(*(F.col(f"v_{a.name}").alias(f"c{i}") if isinstance(a, Var) else literal(a, df.schema[i].dataType).alias(f"c{i}") for i, a in enumerate(query.args)))
    else:
        rows = rows.toDF(*(c[2:] for c in rows.columns))
    return rows if names else rows.distinct()  # every variable is kept, so nothing can repeat


__all__ = ["RESTRICTED", "SAME_AS", "SKOLEM", "Evaluation", "Stats", "TimedOut", "as_relation", "select"]
