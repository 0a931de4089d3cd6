"""The engine's front: sources, rules, a model, queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import triggers
from .operators.bodies import literal
from .operators.fixpoint import RESTRICTED, SKOLEM, Evaluation, TimedOut, select
from .operators.incremental import updated
from .operators.tables import ROUND, Relation, as_facts, as_relation, delete, write
from .operators.termination import Ends, termination
from .plans import equality, magic
from .plans.rules import Atom, Program, RuleError, Var, atom
from .sources import sinks
from .sources import tables as sources

TRIPLES_OUT, TRIPLES_IN = "TI", "TE"


class Reasoner:
    """Facts in, rules over them, answers out.

    Sources cannot change once rules are set (`update` changes them with the model);
    setting rules drops the model; a derived predicate is empty before `materialize`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, DataFrame] = {}
        self.program = Program()
        self.model: dict[str, DataFrame] | None = None
        #: the model's blocks, while they are known
        self.blocks: dict[str, Relation] | None = None
        self.source_blocks: dict[str, Relation] = {}
        self.retired: set[str] = set()
        #: sources as the model has them: equality may have put other terms in their place
        self.merged: dict[str, DataFrame] = {}
        self.last: Evaluation | None = None
        self.prepared: dict[Atom, DataFrame] = {}

    # facts

    def add_source(self, pred: str, df: DataFrame) -> Reasoner:
        """A DataFrame as a predicate; it takes the place of an earlier one of that name."""
        if self.program.rules:
            raise RuleError("sources are fixed once rules are set")
        self.sources[pred] = as_facts(df)
        return self

    def add_facts(self, pred: str, facts: Iterable[tuple]) -> Reasoner:
        return self.add_source(pred, sources.rows(self.spark, facts))

    def configure(self, text: str, folder: str = "") -> Reasoner:
        for pred, df in sources.configured(self.spark, text, folder).items():
            self.add_source(pred, df)
        return self

    def hide(self, pred: str, removed: DataFrame) -> Reasoner:
        """Leave rows of a source out."""
        return self.add_source(pred, sources.without(self.sources[pred], removed))

    # rules

    def set_rules(self, rules: str | Iterable[str] | Program, multihead: bool = False, same_as: str = "NATIVE") -> Reasoner:
        """Rules as text or as a program; equality by replacement (NATIVE), AXIOM or SING."""
        program = rules if isinstance(rules, Program) else Program.parse(rules)
        if not program.rules and TRIPLES_IN in self.sources:
            program = Program.parse(f"{TRIPLES_OUT}(A,B,C) :- {TRIPLES_IN}(A,B,C)")
        if multihead:
            program = program.split_heads()
        if same_as == "AXIOM":
            program = equality.axioms(program)
        elif same_as == "SING":
            program = equality.singular(program)
        elif same_as != "NATIVE":
            raise RuleError(f"unknown treatment of equality {same_as!r}")
        program.check({p: len(d.columns) for p, d in self.sources.items()})
        self.program, self.model, self.last, self.prepared = program, None, None, {}
        self.blocks, self.merged = None, {}
        return self

    # model

    def materialize(self, skolem: bool = False, timeout: float | None = None, max_rounds: int | None = None, una: bool = False) -> bool:
        """Compute the least model; False if time ran out, with the part that was found kept."""
        run = Evaluation(self.spark, self.program, self.sources, SKOLEM if skolem else RESTRICTED, max_rounds, timeout, una)
        self.last = run
        try:
            run.run()
        except TimedOut:
            return False
        finally:
            self._take(run.full)
            self.merged = {p: d for p, d in run.sources.items() if any(r.is_egd() for r in self.program.rules)}
        return True

    def _take(self, blocks: dict[str, Relation]) -> None:
        self.blocks = {p: blocks[p] for p in self.program.idb()}
        self.model = {p: r.frame() for p, r in self.blocks.items()}

    def materialize_linear(self) -> Reasoner:
        """The model of a linear program, without rounds."""
        self.model, self.blocks, self.last = triggers.materialise(self.program, self.sources), None, None
        return self

    def update(self, removed: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None) -> Reasoner:
        """Change source rows and bring the model up to date.

        Blocks that an update replaces are deleted by the next one: frames taken from
        the model are good until then.
        """
        if self.model is None:
            raise RuleError("there is no model to update")
        self.prepared, self.last = {}, None
        known = self.blocks or {p: Relation(self.spark, d.schema, unwritten=d) for p, d in self.model.items()}
        changed, blocks = updated(self.spark, self.program, self.sources, known, removed, added, self.source_blocks)
        before = {x for r in (*known.values(), *self.source_blocks.values()) for x in r.paths}
        self.sources |= {p: r.frame() for p, r in changed.items()}
        self.source_blocks |= changed
        self._take(blocks)
        for path in self.retired:
            delete(self.spark, path)
        self.retired = before - {x for r in (*self.blocks.values(), *self.source_blocks.values()) for x in r.paths}
        return self

    def update_from(self, folder: str) -> Reasoner:
        """Changes from the files `<source>_remove.csv` and `<source>_add.csv` of a folder."""
        return self.update(*sources.changes(self.spark, folder, self.sources))

    def derived(self, pred: str, source: str) -> DataFrame:
        """Facts of a predicate that a source of the same arity does not have."""
        return sources.without(self.facts(pred), self.facts(source))

    def facts(self, pred: str) -> DataFrame:
        if pred in self.sources:
            return self.merged[pred] if pred in self.merged else self.sources[pred].distinct()
        if pred not in self.program.idb():
            raise RuleError(f"unknown predicate {pred}")
        if self.model is None:
            run = Evaluation(self.spark, self.program, self.sources)
            return run.frame(pred)
        return self.model[pred]

    # queries

    def query(self, query: str | Atom, mode: str | None = None, constants: bool = False, nulls: bool = True) -> DataFrame:
        """Answers to an atom.

        Modes: `edb` reads a source, `mat` the model, `magic` (or `qsqr`) evaluates
        only what the query's constants ask for.  Without a mode, a model is used if
        there is one, and magic sets if the query has a constant.
        """
        q = atom(query) if isinstance(query, str) else query
        if mode is None and q in self.prepared:
            out = select(self.prepared[q], q, constants)
            return out if nulls else sinks.without_nulls(out)
        if mode is None:
            bound = any(not isinstance(a, Var) for a in q.args)
            plain = not any(r.existential() or r.is_egd() for r in self.program.rules)
            mode = "edb" if q.pred in self.sources else "mat" if self.model is not None or not (bound and plain) else "magic"
        if mode == "edb" or q.pred in self.sources:
            out = select(self.facts(q.pred), q, constants)
        elif mode == "mat":
            if self.model is None:
                self.materialize()
            out = select(self.facts(q.pred), q, constants)
        elif mode in ("magic", "qsqr"):
            out = self._goal(q, constants)
        else:
            raise RuleError(f"unknown mode {mode!r}")
        return out if nulls else sinks.without_nulls(out)

    def _goal(self, q: Atom, constants: bool) -> DataFrame:
        program, goal, seed = magic.rewrite(self.program, q)
        used = {b.pred for r in program.rules for b in r.body}
        read = {p: d for p, d in self.sources.items() if p in used}
        if seed:
            kinds = Evaluation(self.spark, self.program, self.sources).kinds[q.pred]
            given = [literal(a, k) for a, k in zip(q.args, kinds, strict=True) if not isinstance(a, Var)] or [F.lit(0)]
            read[seed] = self.spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(given))).dropna()
        run = Evaluation(self.spark, program, read).run()
        self.last = run
        return select(run.frame(goal.pred), goal, constants)

    def ask(self, query: str | Atom, mode: str | None = None) -> bool:
        """Whether an atom has an answer."""
        q = atom(query) if isinstance(query, str) else query
        return not self.query(q, mode, constants=True).isEmpty()

    def patterns(self, triples: list[tuple], names: list[str] | None = None, pred: str = TRIPLES_OUT, distinct: bool = True) -> DataFrame:
        """Basic graph pattern: triples of constants and `?variables`, joined; `names` are the variables to keep."""
        out: DataFrame | None = None
        for t in triples:
            rows = self.query(Atom(pred, tuple(Var(x[1:]) if isinstance(x, str) and x.startswith("?") else x for x in t)), mode="mat" if pred not in self.sources else "edb")
            on = [c for c in rows.columns if out is not None and c in out.columns]
            out = rows if out is None else out.join(rows, on) if on else out.crossJoin(rows)
        out = out.select(*(n.removeprefix("?") for n in names)) if names else out
        return out.distinct() if distinct else out

    def connected(self, query: str | Atom, keys: DataFrame, constants: bool = False) -> DataFrame:
        """Answers whose variables match rows of `keys`, whose columns are named like them."""
        return self.query(query, constants=constants).join(keys.distinct(), keys.columns, "left_semi")

    def prepare(self, queries: Iterable[str | Atom]) -> Reasoner:
        """Answer some atoms beforehand; the same atoms, asked later without a mode, read the answers."""
        for q in queries:
            a = atom(q) if isinstance(q, str) else q
            rows = as_relation(self._goal(a, constants=True))
            self.prepared[a] = self.spark.read.schema(rows.schema).parquet(write(rows, a.pred))
        return self

    # about programs

    def explain(self) -> str:
        """Strata, and rounds and rows of the last evaluation."""
        lines = []
        for i, group in enumerate(self.program.strata()):
            lines += [f"stratum {i}", *(f"  {r}" for r in group)]
        if self.last:
            lines += [f"{self.last.stats.rounds} rounds, {self.last.stats.derived} rows", *(f"  round {n}: {p} +{k}" for n, p, k in self.last.stats.new)]
        return "\n".join(lines)

    def check_termination(self, check: str = "MFA") -> Ends:
        return termination(self.spark, self.program, check)

    def counts(self) -> DataFrame:
        """pred, rows of the model."""
        return self.spark.createDataFrame([(p, d.count()) for p, d in sorted((self.model or {}).items()) if p not in self.program.hidden] or [], "pred string, rows long")

    def metrics(self, query: str | Atom) -> dict[str, int]:
        """Rules that the query may use, how many of them are recursive, and rows of the sources under them."""
        q = atom(query) if isinstance(query, str) else query
        reach = magic.below(self.program, {q.pred})
        rules = [r for r in self.program.rules if any(h.pred in reach for h in r.heads)]
        again = [r for r in rules if any(h.pred in magic.below(self.program, {b.pred for b in r.body}) for h in r.heads)]
        rows = sum(self.sources[p].count() for p in reach if p in self.sources)
        return {"rules": len(rules), "recursive": len(again), "source_rows": rows}

    # results

    def write(self, path: str, form: str = "csv", nulls: bool = True) -> None:
        """The model as `csv`, `tsv` (with rounds), `parquet` or `nt`."""
        model = {p: d if nulls else sinks.without_nulls(d) for p, d in (self.model or {}).items() if p not in self.program.hidden}
        if form == "nt":
            first = next((b.pred for r in self.program.rules for b in r.body if b.pred in self.sources and len(b.args) == 3), TRIPLES_IN)
            sinks.ntriples(model, self.program, first, path)
        elif form == "tsv" and self.last:
            for p in model:
                rows = self.last.full[p].staged()
                sinks.tsv(rows if nulls else sinks.without_nulls(rows), f"{path.rstrip('/')}/{sinks.file_name(p)}", ROUND)
        else:
            sinks.write(model, path, form)


__all__ = ["Ends", "Reasoner"]
