import gzip

import pyarrow.parquet as pq
import pytest

from ruleweave.operators.topk import HEAD, top_k
from ruleweave.plans.rules import RuleError
from ruleweave.reasoner import Reasoner
from ruleweave.sources import tables as S
from ruleweave.streaming.additions import maintained


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_csv_and_config(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,"x ""y"", z"\n,c\n')
    with gzip.open(tmp_path / "q.nt.gz", "wt") as f:
        f.write('<s> <p> "v"^^<http://www.w3.org/2001/XMLSchema#string> .\nnot a triple\n_:b <p> <o> .\n')
    conf = "EDB0_predname=P\nEDB0_type=INMEMORY\nEDB0_param0=.\nEDB0_param1=p\n# note\nEDB1_predname=Q\nEDB1_type=INMEMORY\nEDB1_param0=.\nEDB1_param1=q\n"
    r = Reasoner(spark).configure(conf, str(tmp_path))
    assert rows(r.facts("P")) == [("", "c"), ("a", 'x "y", z')]
    assert rows(r.facts("Q")) == [("<s>", "<p>", '"v"'), ("_:b", "<p>", "<o>")]
    for bad in ("nonsense", "EDB0_predname=P\nEDB0_type=NONE", "EDB0_type=SQL\nEDB0_param0=select 1"):
        with pytest.raises(RuleError):
            S.configured(spark, bad)


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\nc\n")
    with pytest.raises(Exception, match="fields"):
        S.csv(spark, str(tmp_path / "r.csv"), arity=2).collect()


def test_triples_and_removal(spark, tmp_path):
    df = spark.createDataFrame([("a", "p", "b"), ("a", "q", "c"), ("a", "p", "b")], "s string, p string, o string")
    S.load_triples(df, str(tmp_path / "t"))
    t = S.triples(spark, str(tmp_path / "t"))
    assert rows(t) == [("a", "p", "b"), ("a", "q", "c")]
    (tmp_path / "gone").write_text("a p b .\n")
    left = S.without(t, S.removal_list(spark, str(tmp_path / "gone"), 3))
    assert rows(left) == [("a", "q", "c")]
    assert S.statistics(t, exact=True).first()[:2] == (2, 1)


def test_sinks(spark, tmp_path):
    r = Reasoner(spark).add_facts("TE", [("a", "<p>", "b c"), ("b", "<p>", 'd"e')]).set_rules("P(X,Y) :- TE(X,<p>,Y)\nP(Y,X) :- P(X,Y)\nn/x(X,Z) :- P(X,Y)")
    r.materialize()
    r.write(str(tmp_path / "csv"))
    assert len(rows(S.csv(spark, str(tmp_path / "csv" / "P")))) == 4
    r.write(str(tmp_path / "tsv"), "tsv")
    assert {x[0] for x in rows(S.csv(spark, str(tmp_path / "tsv" / "P"), sep="t"))} >= {"1"}
    assert (tmp_path / "tsv" / "n\\057x").exists()
    r.write(str(tmp_path / "nt"), "nt")
    assert "a <p> b c ." in {x[0] for x in rows(spark.read.text(str(tmp_path / "nt")))}
    r.write(str(tmp_path / "pq"), "parquet", nulls=False)
    assert pq.ParquetDataset(str(tmp_path / "pq" / "n\\057x")).read().num_rows == 0  # nulls are left out
    with pytest.raises(RuleError):
        r.write(str(tmp_path / "other"), "db?")


def test_top_k(spark):
    e = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id int, embedding array<float>")
    rel = spark.createDataFrame([(1, [2.0, 0.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(1, 1)], "e int, r int")
    assert [x[2] for x in top_k(q, e, rel, 3).orderBy("rank").collect()] == [3, 2, 4]
    assert [x[2] for x in top_k(q, e, rel, 2, HEAD).orderBy("rank").collect()] == [0, 1]


def test_patterns_and_default_rules(spark):
    r = Reasoner(spark).add_facts("TE", [("a", "k", "b"), ("b", "k", "c")]).set_rules("")
    r.materialize()
    assert rows(r.patterns([("?x", "k", "?y"), ("?y", "k", "?z")], ["?x", "?z"])) == [("a", "c")]
    assert "stratum 0" in r.explain() and r.metrics("TI(X,Y,Z)")["rules"] == 1 and rows(r.counts()) == [("TI", 2)]


def test_stream(spark, tmp_path):
    schema = "a int, b int"
    spark.createDataFrame([(1, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    r = Reasoner(spark).add_source("e", spark.createDataFrame([(2, 3)], schema)).set_rules("t(X,Y) :- e(X,Y)\nt(X,Z) :- t(X,Y), e(Y,Z)")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = maintained(stream, r, "e").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(r.facts("t")) == [(1, 2), (1, 3), (2, 3)]


def test_entry_without_llm():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for p in root.glob("ruleweave/**/*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), p


def test_removal_list_rows_cross_lines(spark, tmp_path):
    (tmp_path / "gone.txt").write_text("<a.b>\n <c> .\nd e\t.\n\n f g .")
    assert sorted(map(tuple, S.removal_list(spark, str(tmp_path / "gone.txt"), 2).collect())) == [("<a.b>", "<c>"), ("d", "e"), ("f", "g")]
    with pytest.raises(Exception, match="not 3 terms"):
        S.removal_list(spark, str(tmp_path / "gone.txt"), 3).collect()


def test_json_and_update_folder(spark, tmp_path):
    r = Reasoner(spark).add_facts("e", [(1, 2), (2, 3)]).set_rules("t(X,Y) :- e(X,Y)")
    r.materialize()
    (tmp_path / "e_add.csv").write_text("5,6\n")
    (tmp_path / "e_remove.csv").write_text("1,2\n")
    r.update_from(str(tmp_path))
    assert sorted(map(tuple, r.query("t(X,Y)").collect())) == [(2, 3), (5, 6)]
    r.write(str(tmp_path / "out"), "json")
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "out" / "t")).collect()) == ['{"c0":2,"c1":3}', '{"c0":5,"c1":6}']
