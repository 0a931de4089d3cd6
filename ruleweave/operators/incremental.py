"""Models kept up to date under additions and deletions of source rows.

Deletion marks every fact that some derivation through a deleted row gave, keeps the
others, and derives again from those what still holds; additions start the fixpoint
from the new rows.  Negation is not monotone, so programs with it are evaluated anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Program, Rule, RuleError
from .fixpoint import Evaluation
from .tables import Relation, as_relation, columns


def _minus(df: DataFrame, other: DataFrame) -> DataFrame:
    names = columns(len(df.columns))
    left, right = df.toDF(*names), other.toDF(*(f"k{i}" for i in range(len(names))))
    return left.join(right, [F.col(a) == F.col(b) for a, b in zip(names, right.columns, strict=True)], "left_anti")


def _changed(source: DataFrame, blocks: Relation | None, removed: DataFrame | None, added: DataFrame | None, tag: str) -> Relation:
    """A source's rows after the changes, as blocks: additions are a new one, removals write the rest anew."""
    out = blocks.copy() if blocks else Relation(source.sparkSession, source.schema)
    if not blocks:
        out.add((_minus(source, removed) if removed is not None else source).distinct(), tag)
    elif removed is not None:
        out = Relation(source.sparkSession, source.schema)
        out.add(_minus(blocks.frame(), removed), tag)
    if added is not None:
        named = added.toDF(*columns(len(added.columns)))
        typed = named.select(*(F.col(c).cast(f.dataType).alias(c) for c, f in zip(named.columns, source.schema, strict=True)))
        out.add(_minus(as_relation(typed), out.frame()).toDF(*source.columns), tag)
    return out


def updated(spark: SparkSession, program: Program, sources: dict[str, DataFrame], model: dict[str, Relation], removed: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, blocks: dict[str, Relation] | None = None) -> tuple[dict[str, Relation], dict[str, Relation]]:
    """(changed sources, model) after the changes; `model` is that of `sources` before them.

    Blocks of predicates that lose nothing are taken over as they are, with new ones
    beside them; so are `blocks` of sources that were changed before.  Plans do not grow with
    the number of updates.
    """
    removed, added = removed or {}, added or {}
    unknown = (set(removed) | set(added)) - set(sources)
    if unknown:
        raise RuleError(f"not a source: {', '.join(sorted(unknown))}")
    if any(r.existential() or r.is_egd() for r in program.rules):
        raise RuleError("updates need rules without existential variables or equality")
    removed = {p: as_relation(d) for p, d in removed.items()}
    added = {p: as_relation(d) for p, d in added.items()}
    changed = {p: _changed(sources[p], (blocks or {}).get(p), removed.get(p), added.get(p), p) for p in {*removed, *added}}
    after = {**sources, **{p: r.frame() for p, r in changed.items()}}
    if any(b.negated for r in program.rules for b in r.body):
        run = Evaluation(spark, program, after).run()
        return changed, run.full
    idb = program.idb()

    # what was derived through a removed row; only its removed rows, never all old facts, drive the joins
    gone: dict[str, DataFrame] = {}
    if removed:
        rules, read = [], {}
        for r in program.rules:
            for i, b in enumerate(r.body):
                if b.pred in removed or b.pred in idb:
                    body = tuple(a.with_pred(f"{a.pred}@gone" if j == i else f"{a.pred}@old") for j, a in enumerate(r.body))
                    rules.append(Rule(tuple(h.with_pred(f"{h.pred}@gone") for h in r.heads), body))
        for p in {b.pred for r in program.rules for b in r.body}:
            read[f"{p}@old"] = model[p].frame() if p in idb else sources[p]
            if p in removed:
                read[f"{p}@gone"] = removed[p]
        made = {h.pred for r in rules for h in r.heads}
        rules = [r for r in rules if all(b.pred in made or b.pred in read for b in r.body)]
        read = {p: d for p, d in read.items() if any(b.pred == p for r in rules for b in r.body)}
        run = Evaluation(spark, Program(rules), read, inline=False).run()
        gone = {h: run.frame(f"{h}@gone") for h in idb if f"{h}@gone" in run.full and run.full[f"{h}@gone"].rows}
    kept = {p: _minus(model[p].frame(), gone[p]) if p in gone else model[p] for p in idb}

    # from what is left: facts marked as gone that still hold, and facts that need a new row
    seeds = []
    for r in program.rules:
        seeds += [Rule((h,), (h.with_pred(f"{h.pred}@gone"), *r.body)) for h in r.heads if h.pred in gone]
        for i, b in enumerate(r.body):
            if b.pred in added:
                seeds.append(Rule(r.heads, tuple(a.with_pred(f"{a.pred}@new") if j == i else a for j, a in enumerate(r.body))))
    read = {**after, **{f"{p}@gone": d for p, d in gone.items()}, **{f"{p}@new": d for p, d in added.items()}}
    run = Evaluation(spark, Program(program.rules + seeds), read, start=kept)
    first: dict[str, list[DataFrame]] = {}
    for s in seeds:
        for p, dfs in run._heads(s, run._whole(s)).items():
            first.setdefault(p, []).extend(dfs)
    delta = run._store(first)
    for rules in program.strata():
        made = {h.pred for r in rules for h in r.heads}
        used = {b.pred for r in rules for b in r.body} | made
        delta |= run.carry(rules, {p: d for p, d in delta.items() if p in used})
    return changed, {p: run.full[p] for p in idb}

