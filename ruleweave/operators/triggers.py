"""Linear programs without a loop: every derivation is a selection of a source.

In a linear rule the body is one atom, so a chain of rules carries a source row to a
fact by moving and repeating its columns.  The distinct shapes of such chains are
finite; they are found on atoms alone, those that give what another shape of the
same source gives are left out, and each predicate is then one union of selections.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..plans.rules import Atom, Program, RuleError, Var
from .bodies import literal, matches


@dataclass(frozen=True)
class Shape:
    """Facts head(args) for the rows that match `source`; arguments are the source's variables or constants."""

    head: Atom
    source: Atom
    #: rules applied, the first one on the source
    path: tuple[int, ...] = ()

    def key(self) -> tuple:
        names: dict[str, int] = {}

        def of(t: object) -> object:
            return ("v", names.setdefault(t.name, len(names))) if isinstance(t, Var) else ("c", t)

        return (self.source.pred, tuple(map(of, self.source.args)), self.head.pred, tuple(map(of, self.head.args)))


def _applied(fact: Atom, body: Atom, head: Atom) -> tuple[dict[str, object], Atom] | None:
    """Unify a derived atom with a rule's body atom; (bindings of the fact's variables, head)."""
    given: dict[str, object] = {}
    same: dict[str, object] = {}

    def now(t: object) -> object:
        while isinstance(t, Var) and t.name in same:
            t = same[t.name]
        return t

    for f, b in zip(fact.args, body.args, strict=True):
        if isinstance(b, Var) and b.name not in given:
            given[b.name] = f
            continue
        f, b = now(f), now(given[b.name]) if isinstance(b, Var) else b
        if f == b:
            continue
        if isinstance(f, Var):
            same[f.name] = b
        elif isinstance(b, Var):
            same[b.name] = f
        else:
            return None
    return same, Atom(head.pred, tuple(now(given[a.name]) if isinstance(a, Var) else a for a in head.args))


def shapes(program: Program, arities: dict[str, int]) -> list[Shape]:
    """Every shape of every derived predicate, from sources of `arities`."""
    for r in program.rules:
        if len(r.body) != 1 or len(r.heads) != 1 or r.body[0].negated or r.existential():
            raise RuleError(f"not a linear rule: {r}")
    work: list[Shape] = []
    seen: dict[tuple, Shape] = {}
    for p, n in arities.items():
        source = Atom(p, tuple(Var(f"S{i}") for i in range(n)))
        work.append(Shape(source, source))
    while work:
        s = work.pop(0)
        for i, r in enumerate(program.rules):
            if r.body[0].pred != s.head.pred:
                continue
            found = _applied(s.head, r.body[0], r.heads[0])
            if found is None:
                continue
            same, head = found

            def now(t: object, same: dict = same) -> object:
                while isinstance(t, Var) and t.name in same:
                    t = same[t.name]
                return t

            new = Shape(head, Atom(s.source.pred, tuple(map(now, s.source.args))), (*s.path, i))
            if new.key() not in seen:
                seen[new.key()] = new
                work.append(new)
    general = list(seen.values())
    return [s for s in general if not any(o is not s and _covers(o, s) and not (_covers(s, o) and o.path > s.path) for o in general)]


def _covers(wide: Shape, narrow: Shape) -> bool:
    """Whether every fact of `narrow` is one of `wide`, on any source."""
    if wide.source.pred != narrow.source.pred or wide.head.pred != narrow.head.pred:
        return False
    to: dict[str, object] = {}
    for a, b in zip(wide.source.args, narrow.source.args, strict=True):
        if isinstance(a, Var):
            if to.setdefault(a.name, b) != b:
                return False
        elif a != b:
            return False
    return tuple(to.get(a.name) if isinstance(a, Var) else a for a in wide.head.args) == narrow.head.args


def materialise(program: Program, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The model of a linear program as one union of selections for each predicate."""
    used = {p: len(d.columns) for p, d in sources.items()}
    program.check(used)
    found: dict[str, list[DataFrame]] = defaultdict(list)
    for s in shapes(program, used):
        rows = matches(s.source, sources[s.source.pred], "s")
        kinds = {a.name: rows.schema[f"v_{a.name}"].dataType for a in s.source.args if isinstance(a, Var)}
        columns = [rows[f"v_{a.name}"].alias(f"c{i}") if isinstance(a, Var) else literal(a, next(iter(kinds.values()))).alias(f"c{i}") for i, a in enumerate(s.head.args)]
        found[s.head.pred].append(rows.select(*columns))
    return {p: reduce(DataFrame.union, dfs).distinct() for p, dfs in found.items()}


def depends(program: Program, pred: str) -> list[list[str]]:
    """The sets of source predicates from which a fact of `pred` may be derived, by unfolding without repeats."""
    idb = program.idb()

    def of(p: str, above: frozenset[str]) -> set[frozenset[str]]:
        if p not in idb:
            return {frozenset([p])}
        if p in above:
            return set()
        out: set[frozenset[str]] = set()
        for r in program.rules:
            if any(h.pred == p for h in r.heads):
                sets = {frozenset()}
                for b in r.body:
                    sets = {x | y for x in sets for y in of(b.pred, above | {p})}
                out |= sets
        return out

    return sorted(sorted(s) for s in of(pred, frozenset()))
