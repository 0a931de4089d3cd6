import os

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import naive
from ruleweave.operators import bodies, fixpoint, tables, tiles
from ruleweave.operators.termination import Ends
from ruleweave.plans.rules import Program, RuleError, atom
from ruleweave.reasoner import Reasoner

CLOSURE = "t(X,Y) :- e(X,Y)\nt(X,Z) :- t(X,Y), e(Y,Z)"


def rows(df):
    return sorted(map(tuple, df.collect()))


def reasoner(spark, facts, rules="", **how):
    r = Reasoner(spark)
    for p, f in facts.items():
        r.add_facts(p, f)
    return r.set_rules(rules, **how)


def model(spark, facts, rules, pred, **how):
    r = reasoner(spark, facts, rules)
    r.materialize(**how)
    return rows(r.facts(pred))


def test_micro_programs(spark):
    e = [(1, 2), (2, 3), (3, 1)]
    assert model(spark, {"A": [("a",), ("b",), ("a",)]}, "B(X) :- A(X)", "B") == [("a",), ("b",)]
    assert len(model(spark, {"e": e}, CLOSURE, "t")) == 9
    even = "ev(X) :- zero(X)\nod(Y) :- ev(X), succ(X,Y)\nev(Y) :- od(X), succ(X,Y)"
    assert model(spark, {"zero": [(0,)], "succ": [(0, 1), (1, 2), (2, 3)]}, even, "ev") == [(0,), (2,)]
    assert model(spark, {"n": [(1,), (2,), (3,)], "r": [(2,)]}, "q(X) :- n(X), ~r(X)", "q") == [(1,), (3,)]
    assert model(spark, {"A": [("a",)]}, "B(X), C(X) :- A(X)", "C") == [("a",)]
    assert len(model(spark, {"A": [("a",), ("b",)], "D": [(1,), (2,)]}, "P(X,Y) :- A(X), D(Y)", "P")) == 4
    quoted = [('"a),b"',), ("'a),b'",)]
    assert model(spark, {"A": quoted}, "B(X) :- A(X)", "B") == sorted(quoted)


def test_queries(spark):
    r = reasoner(spark, {"p2": [("c", "d", "e"), ("f", "g", "h")], "X": [("d", "e"), ("c", "c")], "A": [("a",), ("b",)]}, "B(X) :- A(X)")
    assert rows(r.query("p2(V,d,W)", constants=True)) == [("c", "d", "e")]
    assert rows(r.query("p2(V,d,W)")) == [("c", "e")]
    assert rows(r.query("X(V,V)")) == [("c",)]
    assert r.ask("A(a)") and not r.ask("A(z)")
    assert rows(r.query("B(X)", "mat")) == [("a",), ("b",)]
    with pytest.raises(RuleError):
        r.query("nothing(X)")
    with pytest.raises(RuleError):
        r.add_facts("C", [(1,)])


def test_lifecycle(spark):
    r = Reasoner(spark).add_facts("A", [("a",)]).add_facts("A", [("a",), ("b",)])
    assert rows(r.facts("A")) == [("a",), ("b",)]
    r.set_rules("B(X) :- A(X)")
    assert rows(r.facts("B")) == []  # before the model
    for bad in ([(1,), (1, 2)], [(None,)]):
        with pytest.raises(RuleError):
            Reasoner(spark).add_facts("A", bad)
    with pytest.raises(RuleError):
        r.set_rules("B(X) :- missing(X)").materialize()


def test_empty_and_null_sources(spark):
    empty = spark.createDataFrame([], "x int, y int")
    r = Reasoner(spark).add_source("e", empty).set_rules(CLOSURE + "\nn(X) :- e(X,Y), ~t(Y,X)")
    assert r.materialize() and rows(r.facts("t")) == [] and rows(r.facts("n")) == []
    some = spark.createDataFrame([(1, None), (1, 2), (1, 2)], "x int, y int")
    assert rows(Reasoner(spark).add_source("e", some).facts("e")) == [(1, 2)]


def test_types_widen(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,), (2,)], "x bigint")
    r = Reasoner(spark).add_source("a", a).add_source("b", b).set_rules("u(X) :- a(X)\nu(X) :- b(X)\nj(X) :- a(X), b(X)")
    r.materialize()
    assert rows(r.facts("u")) == [(1,), (2,)] and r.facts("u").schema[0].dataType.simpleString() == "bigint"
    assert rows(r.facts("j")) == [(1,)]


def test_chase(spark):
    w = model(spark, {"per": [("p",), ("q",)]}, "w(X,Z) :- per(X)", "w", skolem=True)
    assert len({z for _, z in w}) == 2
    kept = model(spark, {"per": [("p",), ("q",)], "w0": [("p", "d")]}, "w(X,Y) :- w0(X,Y)\nw(X,Z) :- per(X)", "w")
    assert kept[0] == ("p", "d") and kept[1][0] == "q" and kept[1][1].startswith("_:") and len(kept) == 2
    assert len(model(spark, {"per": [("p",), ("q",)]}, "k(Z) :- per(X)", "k", skolem=True)) == 1
    r = reasoner(spark, {"per": [("p",)]}, "par(X,Z) :- per(X)\nmore(Y) :- par(X,Y)\npar(X,Z) :- more(X)")
    with pytest.raises(RuleError, match="rounds"):
        r.materialize(skolem=True, max_rounds=5)
    assert rows(reasoner(spark, {"per": [("p",)]}, "w(X,Z) :- per(X)").query("w(X,Z)", "mat", nulls=False)) == []


def test_termination(spark):
    loop = reasoner(spark, {"per": [("p",)]}, "par(X,Z) :- per(X)\nmore(Y) :- par(X,Y)\npar(X,Z) :- more(X)")
    assert [loop.check_termination(c) for c in ("JA", "MSA", "MFA", "MFC")] == [Ends.UNKNOWN] * 3 + [Ends.NO]
    fine = reasoner(spark, {"per": [("p",)]}, "par(X,Z) :- per(X)\nmore(Y) :- par(X,Y)")
    assert [fine.check_termination(c) for c in ("JA", "MSA", "MFA", "MFC")] == [Ends.YES] * 3 + [Ends.UNKNOWN]
    assert reasoner(spark, {"A": [("a",)]}, "B(X) :- A(X)").check_termination("JA") == Ends.YES


def test_equality(spark):
    facts = {"s": [("a", "b"), ("b", "c")], "t": [("a",), ("c",)]}
    rules = "owl:sameAs(X,Y) :- s(X,Y)\nu(X) :- t(X)"
    assert model(spark, facts, rules, "u") == [("a",)]
    with pytest.raises(RuleError, match="different constants"):
        model(spark, facts, rules, "u", una=True)
    r = reasoner(spark, facts, rules, same_as="AXIOM")
    r.materialize()
    assert rows(r.facts("u")) == [("a",), ("b",), ("c",)]
    r = reasoner(spark, {**facts, "p": [("b",)]}, rules + "\nw(X) :- t(X), p(X)", same_as="SING")
    r.materialize()
    assert rows(r.facts("w")) == [("a",), ("c",)]
    with pytest.raises(RuleError):
        reasoner(spark, facts, "owl:sameAs(X,Y) :- s(X,Y)\nu(X) :- t(X), ~s(X,X)", same_as="SING")


def test_delete(spark):
    r = reasoner(spark, {"e": [(1, 2), (2, 3), (3, 1)]}, CLOSURE)
    r.materialize()
    r.update(removed={"e": spark.createDataFrame([(3, 1)])})
    assert rows(r.facts("t")) == [(1, 2), (1, 3), (2, 3)]


def test_prepared(spark):
    r = reasoner(spark, {"e": [(1, 2), (2, 3)]}, CLOSURE).prepare(["t(1,Y)"])
    assert rows(r.query("t(1,Y)")) == [(2,), (3,)] and rows(r.query("t(1,Y)", constants=True)) == [(1, 2), (1, 3)]
    assert rows(r.query("t(2,Y)")) == [(3,)]


def test_linear_programs(spark):
    facts = {"e": [(1, 2), (2, 2), (3, 1)]}
    rules = "p(X,Y) :- e(X,Y)\nq(Y,X) :- p(X,Y)\np(X,Y) :- q(X,Y)\nr(X) :- p(X,X)\ns(X,X) :- p(X,Y)\nr(Y) :- s(X,Y)"
    fast = reasoner(spark, facts, rules).materialize_linear()
    slow = reasoner(spark, facts, rules)
    slow.materialize()
    for p in ("p", "q", "r", "s"):
        assert rows(fast.facts(p)) == rows(slow.facts(p))
    with pytest.raises(RuleError):
        reasoner(spark, facts, CLOSURE).materialize_linear()


EDGES = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=8)
PROGRAMS = [
    CLOSURE,
    "t(X,Y) :- e(X,Y)\nt(X,Z) :- t(X,Y), t(Y,Z)",
    "t(X,Y) :- e(X,Y)\nt(X,Y) :- e(Y,X)\nt(X,Z) :- e(X,Y), t(Y,Z)\nn(X,Y) :- f(X,Y), ~t(X,Y)",
    "t(X,Y) :- e(X,Y), f(Y,Y)\nt(X,Y) :- u(X,Y)\nu(X,Z) :- t(X,Y), f(Y,Z)",
]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(PROGRAMS), EDGES, EDGES, EDGES)
def test_against_plain_evaluation(spark, rules, e, f, more):
    """The model, the same by magic sets, and the same after changes, against sets of tuples."""
    program = Program.parse(rules)
    r = reasoner(spark, {"e": e, "f": f}, rules)
    r.materialize()
    want = naive.model(program, {"e": set(e), "f": set(f)})
    for p in program.idb():
        assert rows(r.facts(p)) == sorted(want[p])
    goal = atom(f"t({e[0][0]},Y)")
    asked = reasoner(spark, {"e": e, "f": f}, rules).query(goal, "magic")
    assert rows(asked) == sorted((y,) for x, y in want["t"] if x == e[0][0])
    gone = e[: len(e) // 2 + 1]
    r.update(removed={"e": spark.createDataFrame(gone)}, added={"e": spark.createDataFrame(more)})
    want = naive.model(program, {"e": (set(e) - set(gone)) | set(more), "f": set(f)})
    for p in program.idb():
        assert rows(r.facts(p)) == sorted(want[p])


def test_magic_keeps_types(spark):
    r = reasoner(spark, {"e": [(i, i + 1) for i in range(5)]}, CLOSURE)
    got = r.query("t(1,Y)", "magic", constants=True)
    assert [f.dataType.typeName() for f in got.schema] == ["long", "long"] and rows(got) == [(1, y) for y in (2, 3, 4, 5)]
    assert rows(r.query("t(x,Y)", "magic")) == []  # no number


def test_rounds_are_kept_when_blocks_are_merged(spark, tmp_path):
    r = reasoner(spark, {"e": [(i, i + 1) for i in range(21)]}, CLOSURE)
    r.materialize()
    r.write(str(tmp_path / "out"), "tsv")
    found = [x.value.split("\t") for x in spark.read.text(str(tmp_path / "out" / "t")).collect()]
    assert sorted((int(n), int(a), int(b)) for n, a, b in found) == sorted((d, i, i + d) for d in range(1, 22) for i in range(22 - d))


def test_superseded_blocks_go(spark):
    from ruleweave.operators import tables

    r = reasoner(spark, {"e": [(i, i + 1) for i in range(40)]}, CLOSURE)
    before = set(os.listdir(f"{tables.folder(spark).removeprefix('file:')}/ruleweave"))
    r.materialize()
    left = set(os.listdir(f"{tables.folder(spark).removeprefix('file:')}/ruleweave")) - before
    assert len(left) <= 2 * tables.BLOCKS + 4 and r.facts("t").count() == 820


def test_many_updates_keep_plans_small(spark):
    """A source and a model that grow by one row at a time: reads and blocks do not grow with the updates."""
    r = reasoner(spark, {"e": [(0, 1)]}, "t(X,Y) :- e(X,Y)\ns(Y,X) :- t(X,Y)")
    r.materialize()
    for i in range(1, 20):
        r.update(added={"e": spark.createDataFrame([(i, i + 1)], "c0 long, c1 long")})
    assert rows(r.query("s(Y,X)")) == [(i + 1, i) for i in range(20)] and len(r.blocks["s"].paths) <= 17
    assert r.facts("t")._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
    r.update(removed={"e": spark.createDataFrame([(3, 4), (7, 8)], "c0 long, c1 long")})
    assert rows(r.query("t(X,Y)")) == [(i, i + 1) for i in range(20) if i not in (3, 7)]


def test_sources_come_back_when_rules_are_set_again(spark):
    r = reasoner(spark, {"s": [("a", "b"), ("b", "c")]}, "owl:sameAs(X,Y) :- s(X,Y)")
    r.materialize()
    r.set_rules("p(X,Y) :- s(X,Y)").materialize()
    assert rows(r.facts("p")) == [("a", "b"), ("b", "c")]


def test_derived_facts(spark):
    r = reasoner(spark, {"e": [(1, 2), (2, 3)]}, CLOSURE)
    r.materialize()
    assert rows(r.derived("t", "e")) == [(1, 3)]


@pytest.mark.parametrize("kind", [int, str])
def test_tiles_join_and_compare_without_shuffling_joined_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(bodies, "TILE_ROWS", 20)
    monkeypatch.setattr(tiles, "AT_ONCE", 50)
    e = {(x, y) for x in range(200) for y in (x % 3, 300 + x % 2, x)} | {(y, z) for y in (0, 1, 2, 300, 301) for z in range(60, 160)}
    e = {(kind(x), kind(y)) for x, y in e}
    both = {(x, z) for x, y in e for u, z in e if y == u}
    assert model(spark, {"e": sorted(e)}, "two(X,Z) :- e(X,Y), e(Y,Z)", "two") == sorted(both)
    assert model(spark, {"e": sorted(e)}, "two(X,Z) :- e(X,Y), e(Y,Z)\nonly(X,Z) :- two(X,Z), ~e(X,Z)", "only") == sorted(both - e)
    wide = {(x, y, kind(int(x) % 2)) for x, y in e}
    found = model(spark, {"w": sorted(wide)}, "p(X,K,Z,L) :- w(X,Y,K), w(Z,Y,L)", "p")
    assert found == sorted({(x, k, z, m) for x, y, k in wide for z, u, m in wide if y == u})
    r = reasoner(spark, {"e": sorted(e)}, "two(X,Z) :- e(X,Y), e(Y,Z)")
    r.materialize()
    plan = r.facts("two")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan.split("MapInArrow")[0]


def test_one_key_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bodies, "TILE_ROWS", 5000)
    r = reasoner(spark, {"s": [(i, 7) for i in range(200)]}, "sn(X,Y) :- s(X,N), s(Y,N)")
    r.materialize()
    parts = r.facts("sn").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(parts) == 40_000 and max(parts) < 10_000
    assert r.facts("sn").distinct().count() == 40_000


def test_pairs_that_repeat_in_a_sparse_tile():
    lists = [([i, i + 500], [7 * i, 7 * i + 1]) for i in range(300)] * 2  # 1200 of 1.8 million cells, all of them twice
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in lists], pa.list_(pa.int64())) for k in (0, 1)], ["as", "bs"])
    found = [(x, y) for b in tiles.pairs(["x", "y"], (False, False))(iter([batch])) for x, y in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(found) == sorted({(x, y) for xs, ys in lists for x in xs for y in ys})


@pytest.mark.parametrize("bits", [0, 64 << 20])
def test_pairs_but_for_given_ones(monkeypatch, bits):
    monkeypatch.setattr(tiles, "BITS", bits)
    monkeypatch.setattr(tiles, "BITS_AT_ONCE", 20)
    monkeypatch.setattr(tiles, "AT_ONCE", 500)
    lists = [([i % 7, i % 3, 50 + i % 2], [*range(i, i + 200)], False) for i in range(0, 300, 5)]
    less = [([1], [4, 5, 900], True), ([51], [*range(0, 600, 2)], True), ([77], [3], True), ([2], [499], True)]
    columns = zip(*(less[:2] + lists + less[2:]), strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()), strict=True)], ["as", "bs", "less"])
    found = [(x, y) for b in tiles.pairs(["x", "y"], (False, False))(iter([batch])) for x, y in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(found) == sorted({(x, y) for xs, ys, _ in lists for x in xs for y in ys} - {(x, y) for xs, ys, _ in less for x in xs for y in ys})


@pytest.mark.parametrize("near", [True, False])
def test_tiles_stay_whole_where_joins_are_merged(spark, monkeypatch, near):
    monkeypatch.setattr(bodies, "TILE_ROWS", 2000)
    e = {(c * 40 + x, c * 40 + (x * 7 + k * 3) % 40) for c in range(4) for x in range(40) for k in range(25)}
    if not near:  # nodes that join the same ones are far from each other
        e = {(x * 67 % 160, y * 67 % 160) for x, y in e}
    both = {(x, z) for x, y in e for u, z in e if y == u}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        two = reasoner(spark, {"e": sorted(e)}, "two(X,Z) :- e(X,Y), e(Y,Z)")
        two.materialize()
        assert sorted(map(tuple, two.facts("two").collect())) == sorted(both)  # none twice
        only = reasoner(spark, {"e": sorted(e)}, "two(X,Z) :- e(X,Y), e(Y,Z)\nonly(Z,X) :- two(X,Z), ~e(X,Z), ~e(Z,X)")
        only.materialize()
        assert sorted(map(tuple, only.facts("only").collect())) == sorted((z, x) for x, z in both if (x, z) not in e and (z, x) not in e)
        plan = only.facts("only")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
        assert len(plan) > 1 and "Exchange" not in plan[0] and "Join" not in plan[0]  # the pairs stay where they are found
        ends = reasoner(spark, {"e": sorted(e)}, "two(X,Z) :- e(X,Y), e(Y,Z)\nends(X) :- two(X,Z), ~e(X,Z)")
        ends.materialize()
        assert sorted(map(tuple, ends.facts("ends").collect())) == sorted({(x,) for x, z in both - e})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    frame = spark.createDataFrame(sorted(e), "x long, y long")
    left, right = frame.toDF("v_X", "v_Y"), frame.toDF("v_Y", "v_Z")
    runs = bodies._runs(left, right, ["v_Y"], ["v_X"], ["v_Z"], 25.0 * len(e), 2.0 * 7 * len(e))
    assert (runs is not None) == near


def test_known_rows_lie_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 100)
    seen = []
    unknown = fixpoint.Evaluation._unknown
    monkeypatch.setattr(fixpoint.Evaluation, "_unknown", lambda *a: seen.append(unknown(*a)) or seen[-1])
    e = [(i, i + 1) for i in range(7)] + [(7, 3)]
    r = reasoner(spark, {"e": e}, CLOSURE)
    r.materialize()
    want = {(x, y) for x in range(8) for y in range(min(x, 2) + 1, 8) if y > x or y >= 3 <= x} | {(x, y) for x in range(3) for y in range(3, 8)}
    assert rows(r.facts("t")) == sorted(want)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    r.update(removed={"e": spark.createDataFrame([(7, 3)], "a long, b long")})
    assert rows(r.facts("t")) == [(x, y) for x in range(8) for y in range(x + 1, 8)]
