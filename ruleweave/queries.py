"""Rule programs over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import triggers
from .operators.tables import new_path
from .operators.topk import top_k
from .plans.rules import Program
from .reasoner import Reasoner
from .sources import sinks
from .sources import tables as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# source views: rules have no arithmetic, so edges come from windows over the tables


def order_succ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): b is the next order of a's customer."""
    o = table(spark, sf_dir, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("a"), nxt.alias("b"))


def conv_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): b is the turn after a."""
    node = F.col("conv_id") * 1000 + F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", node.alias("a")).distinct()
    return c.select("a", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))


def supplier_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): suppliers of lines that follow each other in an order."""
    l = table(spark, sf_dir, "lineitem")
    # the part decides between lines of one supplier only, so it is not shuffled
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    return l.select(F.col("l_suppkey").alias("a"), nxt.alias("b")).distinct()


ORDER_SUCC = "order_succ AS (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)"
CONV_NEXT = "conv_next AS (SELECT a, b FROM (SELECT a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT DISTINCT conv_id, turn, conv_id * 1000 + turn AS a FROM conversations)) WHERE b IS NOT NULL)"
CLOSURE = "t(x, y) AS (SELECT a, b FROM {0} UNION SELECT t.x, e.b FROM t JOIN {0} e ON t.y = e.a)"
LINEAR = "t(X,Y) :- e(X,Y)\nt(X,Z) :- t(X,Y), e(Y,Z)"


def small_tables(spark: SparkSession, sf_dir: str) -> Reasoner:
    r = Reasoner(spark)
    r.add_source("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    r.add_source("supplier", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    r.add_source("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r.add_source("region", table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("<"), "r_name", F.lit(">"))))  # names as constants
    r.add_source("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return r


def answer(spark: SparkSession, sf_dir: str, rules: str, goal: str, names: str, **how: object) -> DataFrame:
    """The answers to a goal over the small tables, columns renamed."""
    r = small_tables(spark, sf_dir).set_rules(rules)
    r.materialize()
    return r.query(goal, "mat", **how).toDF(*names.split())


@query("join_chain", "SELECT DISTINCT c_custkey AS c, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: a join and a projection, as one rule."""
    return answer(spark, sf_dir, "cr(C,R) :- customer(C,N), nation(N,M,R)", "cr(C,R)", "c r")


def closure(spark: SparkSession, edges: DataFrame, rules: str, goal: str = "t(X,Y)") -> DataFrame:
    r = Reasoner(spark).add_source("e", edges).set_rules(rules)
    r.materialize()
    return r.query(goal, "mat").toDF("x", "y")


@query("tc_order_succ", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT x, y FROM t")
def tc_order_succ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear recursion."""
    return closure(spark, order_succ(spark, sf_dir), LINEAR)


@query("tc_nonlinear", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT x, y FROM t")
def tc_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion with two recursive atoms: as many rounds as the logarithm of the depth."""
    return closure(spark, order_succ(spark, sf_dir), "t(X,Y) :- e(X,Y)\nt(X,Z) :- t(X,Y), t(Y,Z)")


@query("tc_conversation", f"WITH RECURSIVE {CONV_NEXT}, {CLOSURE.format('conv_next')} SELECT x, y FROM t")
def tc_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(spark, conv_next(spark, sf_dir), LINEAR)


@query("mutual_recursion", f"WITH RECURSIVE {ORDER_SUCC}, walk(x, n) AS (SELECT min(o_orderkey), 0 FROM orders GROUP BY o_custkey UNION SELECT e.b, (n + 1) % 2 FROM walk JOIN order_succ e ON e.a = x) SELECT x FROM walk WHERE n = 0")
def mutual_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other order of each customer, from the first, by two predicates that need each other."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a")).select("a")
    r = Reasoner(spark).add_source("first", first).add_source("e", order_succ(spark, sf_dir))
    r.set_rules("even(X) :- first(X)\nodd(Y) :- even(X), e(X,Y)\neven(Y) :- odd(X), e(X,Y)").materialize()
    return r.query("even(X)", "mat").toDF("x")


@query("same_nation", "SELECT DISTINCT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def same_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self join."""
    return answer(spark, sf_dir, "sn(X,Y) :- supplier(X,N), supplier(Y,N)", "sn(X,Y)", "x y")


@query("supplier_two_steps", "WITH e AS (SELECT DISTINCT a, b FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL) SELECT DISTINCT x.a AS x, y.b AS y FROM e x JOIN e y ON x.b = y.a WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.a = x.a AND z.b = y.b)")
def supplier_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs two steps apart and not one, on a dense graph: join, then anti join."""
    r = Reasoner(spark).add_source("e", supplier_next(spark, sf_dir)).set_rules("two(X,Z) :- e(X,Y), e(Y,Z)\nonly(X,Z) :- two(X,Z), ~e(X,Z)")
    r.materialize()
    return r.query("only(X,Y)", "mat").toDF("x", "y")


@query("neg_no_large_orders", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def neg_no_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of a high price."""
    r = small_tables(spark, sf_dir)
    r.add_source("large", table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey"))
    r.set_rules("has(C) :- large(O,C)\nnone(C) :- customer(C,N), ~has(C)").materialize()
    return r.query("none(C)", "mat").toDF("c")


@query("neg_suppliers", "SELECT DISTINCT s_suppkey AS s FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def neg_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers outside one region: negation of a derived predicate."""
    return answer(spark, sf_dir, "in(N) :- nation(N,M,R), region(R,<ASIA>)\nout(S) :- supplier(S,N), ~in(N)", "out(S)", "s")


@query("neg_unreachable", f"WITH RECURSIVE {CONV_NEXT}, {CLOSURE.format('conv_next')}, n AS (SELECT a AS x FROM conv_next UNION SELECT b FROM conv_next) SELECT p.x AS x, q.x AS y FROM n p JOIN n q ON p.x // 1000 = q.x // 1000 WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.x = p.x AND t.y = q.x)")
def neg_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation of a recursive predicate, in the stratum above it."""
    e = conv_next(spark, sf_dir).dropna()
    conv = e.select(F.col("a").alias("n"), (F.col("a") / 1000).cast("long").alias("c")).union(e.select("b", (F.col("b") / 1000).cast("long"))).distinct()
    r = Reasoner(spark).add_source("e", e).add_source("of", conv).set_rules(LINEAR + "\nnot(X,Y) :- of(X,C), of(Y,C), ~t(X,Y)")
    r.materialize()
    return r.query("not(X,Y)", "mat").toDF("x", "y")


@query("const_select", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_nationkey = 7")
def const_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_tables(spark, sf_dir).query("customer(C,7)").toDF("c")


@query("const_answer", "SELECT DISTINCT n_nationkey AS c0, 2 AS c2, n_name AS c1 FROM nation WHERE n_regionkey = 2")
def const_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that show the query's constants."""
    return small_tables(spark, sf_dir).query("nation(N,M,2)", constants=True).withColumn("c2", F.col("c2").cast("int"))


@query("repeated_var", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS x FROM lineitem WHERE l_linenumber = CAST(l_quantity AS INTEGER)")
def repeated_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number is their quantity: one variable at two places."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int"))
    return Reasoner(spark).add_source("line", lines).query("line(O,X,X)").toDF("o", "x")


@query("semi_join", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, "b(C) :- customer(C,N), orders(O,C)", "b(C)", "c")


@query("cross", "SELECT DISTINCT r_regionkey AS x, n_nationkey AS y FROM region, nation")
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms without a common variable: the rule itself asks for the product."""
    return answer(spark, sf_dir, "p(X,Y) :- region(X,A), nation(Y,B,C)", "p(X,Y)", "x y")


@query("multi_head", "SELECT DISTINCT k, kind FROM (SELECT c_custkey AS k, 'in' AS kind FROM customer UNION ALL SELECT c_nationkey, 'used' FROM customer)")
def multi_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = small_tables(spark, sf_dir).set_rules("in(C), used(N) :- customer(C,N)")
    r.materialize()
    return r.query("in(X)", "mat").select(F.col("X").alias("k"), F.lit("in").alias("kind")).union(r.query("used(X)", "mat").select(F.col("X").cast("long"), F.lit("used")))


@query("union_rules", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def union_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, "n(N) :- customer(C,N)\nn(N) :- supplier(S,N)", "n(N)", "n")


@query("head_constant", "SELECT DISTINCT s_suppkey AS s, 'supplier' AS kind FROM supplier")
def head_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, "k(S,supplier) :- supplier(S,N)", "k(S,K)", "s kind")


@query("boolean", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 4) AS yes, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1) AS other")
def boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = small_tables(spark, sf_dir).set_rules("nr(N,R) :- nation(N,M,R)")
    r.materialize()
    return spark.createDataFrame([(r.ask("nr(3,4)"), r.ask("nr(3,1)"))], "yes boolean, other boolean")


FIRST = "(SELECT min(o_orderkey) FROM orders)"


def _first_order(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]


@query("magic_reach", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT y FROM t WHERE x = {FIRST}")
def magic_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order's successors by magic sets: only that order's part of the closure is derived."""
    r = Reasoner(spark).add_source("e", order_succ(spark, sf_dir)).set_rules(LINEAR)
    return r.query(f"t({_first_order(spark, sf_dir)},Y)", "magic").toDF("y")


@query("magic_sources", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT x FROM t WHERE y = (SELECT max(o_orderkey) FROM orders)")
def magic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other binding pattern, with the recursive atom last."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    r = Reasoner(spark).add_source("e", order_succ(spark, sf_dir)).set_rules("t(X,Y) :- e(X,Y)\nt(X,Z) :- e(X,Y), t(Y,Z)")
    return r.query(f"t(X,{last})", "qsqr").toDF("x")


@query("connected_keys", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT x, y FROM t WHERE x IN (SELECT o_orderkey FROM orders WHERE o_custkey = 1)")
def connected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for a set of bound values."""
    r = Reasoner(spark).add_source("e", order_succ(spark, sf_dir)).set_rules(LINEAR)
    r.materialize()
    keys = table(spark, sf_dir, "orders").where("o_custkey = 1").select(F.col("o_orderkey").alias("X"))
    return r.connected("t(X,Y)", keys).toDF("x", "y")


@query("egd_components", f"WITH RECURSIVE {CONV_NEXT}, l AS (SELECT a, b FROM conv_next UNION SELECT b, a FROM conv_next), r(x, y) AS (SELECT a, a FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a) SELECT DISTINCT min(CAST(y AS VARCHAR) || '') AS root FROM (SELECT x, y, length(CAST(y AS VARCHAR)) AS n, min(length(CAST(y AS VARCHAR))) OVER (PARTITION BY x) AS m FROM r) WHERE n = m GROUP BY x")
def egd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one conversation are equal: each class keeps one representative."""
    e = conv_next(spark, sf_dir).dropna()
    r = Reasoner(spark).add_source("s", e.select(F.col("a").cast("string"), F.col("b").cast("string")))
    r.set_rules("owl:sameAs(X,Y) :- s(X,Y)\nu(X) :- s(X,Y)\nu(Y) :- s(X,Y)").materialize()
    return r.query("u(X)", "mat").toDF("root")


@query("equality_axioms", f"WITH RECURSIVE {CONV_NEXT}, l AS (SELECT a, b FROM conv_next UNION SELECT b, a FROM conv_next), r(x, y) AS (SELECT a, a FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a) SELECT x, y FROM r")
def equality_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality as plain rules: the whole relation of equal turns."""
    r = Reasoner(spark).add_source("s", conv_next(spark, sf_dir)).set_rules("owl:sameAs(X,Y) :- s(X,Y)", same_as="AXIOM")
    r.materialize()
    return r.query("equal@(X,Y)", "mat").toDF("x", "y")


@query("skolem_groups", "SELECT DISTINCT a.c_custkey AS x, b.n AS same FROM customer a JOIN (SELECT c_nationkey, count(DISTINCT c_custkey) AS n FROM customer GROUP BY c_nationkey) b USING (c_nationkey)")
def skolem_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many customers each one shares its unknown manager."""
    r = small_tables(spark, sf_dir).set_rules("managed(N,Z) :- customer(C,N)\nby(C,Z) :- customer(C,N), managed(N,Z)")
    r.materialize(skolem=True)
    by = r.query("by(C,Z)", "mat")
    return by.join(by.groupBy("Z").agg(F.count(F.lit(1)).alias("same")), "Z").select(F.col("C").alias("x"), "same")


@query("skolem_nulls", "SELECT count(*) AS n_rows, count(DISTINCT c_nationkey) AS n_nulls FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer)")
def skolem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unknown manager for each nation: nulls depend on the frontier alone."""
    r = small_tables(spark, sf_dir).set_rules("managed(N,Z) :- customer(C,N)\nby(C,Z) :- customer(C,N), managed(N,Z)")
    r.materialize(skolem=True)
    return r.query("by(C,Z)", "mat").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Z").alias("n_nulls"))


@query("restricted_known", "SELECT count(*) AS n_rows, count(*) FILTER (known IS NULL) AS n_nulls FROM (SELECT DISTINCT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 3000) AS known FROM customer)")
def restricted_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers have a supplier of their nation if one is known, else an unknown one."""
    near = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("s"))
    r = small_tables(spark, sf_dir)
    r.add_source("near", near).set_rules("has(C,S) :- customer(C,N), near(N,S)\nhas(C,Z) :- customer(C,N)").materialize()
    out = r.query("has(C,S)", "mat")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("S").startswith("_:")).alias("n_nulls"))


@query("restricted_rows", "SELECT DISTINCT c_custkey AS c, (SELECT CAST(min(s_suppkey) AS VARCHAR) FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 3000) AS s FROM customer")
def restricted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's supplier, the known one or else an unknown one, shown as a null."""
    near = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("s"))
    r = small_tables(spark, sf_dir)
    r.add_source("near", near).set_rules("has(C,S) :- customer(C,N), near(N,S)\nhas(C,Z) :- customer(C,N)").materialize()
    return r.query("has(C,S)", "mat").select(F.col("C").alias("c"), F.when(~F.col("S").startswith("_:"), F.col("S")).alias("s"))


@query("without_nulls", "SELECT DISTINCT c_custkey AS c, (SELECT CAST(min(s_suppkey) AS VARCHAR) FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 3000) AS s FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)")
def without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without unknown ones."""
    near = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("s"))
    r = small_tables(spark, sf_dir)
    r.add_source("near", near).set_rules("has(C,S) :- customer(C,N), near(N,S)\nhas(C,Z) :- customer(C,N)").materialize()
    return r.query("has(C,S)", "mat", nulls=False).toDF("c", "s")


@query("magic_types", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT x, y FROM t WHERE x = {FIRST}")
def magic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magic sets with the query's constant shown, in its column's own type."""
    r = Reasoner(spark).add_source("e", order_succ(spark, sf_dir)).set_rules(LINEAR)
    return r.query(f"t({_first_order(spark, sf_dir)},Y)", "magic", constants=True).toDF("x", "y")


@query("prepared", f"WITH RECURSIVE {ORDER_SUCC}, {CLOSURE.format('order_succ')} SELECT x, y FROM t WHERE x = {FIRST}")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers worked out beforehand."""
    goal = f"t({_first_order(spark, sf_dir)},Y)"
    r = Reasoner(spark).add_source("e", order_succ(spark, sf_dir)).set_rules(LINEAR).prepare([goal])
    return r.query(goal, constants=True).toDF("x", "y")


@query("split_heads", "SELECT DISTINCT k, kind FROM (SELECT c_custkey AS k, 'in' AS kind FROM customer UNION ALL SELECT c_nationkey, 'used' FROM customer)")
def split_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads by way of one predicate over the variables of both."""
    r = small_tables(spark, sf_dir).set_rules("in(C), used(N) :- customer(C,N)", multihead=True)
    r.materialize()
    return r.query("in(X)", "mat").select(F.col("X").alias("k"), F.lit("in").alias("kind")).union(r.query("used(X)", "mat").select(F.col("X").cast("long"), F.lit("used")))


@query("singular_equality", f"WITH RECURSIVE {CONV_NEXT}, l AS (SELECT a, b FROM conv_next UNION SELECT b, a FROM conv_next), r(x, y) AS (SELECT a, a FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a) SELECT DISTINCT r.x AS x FROM r JOIN (SELECT min(a) AS a FROM conv_next) f ON r.y = f.a")
def singular_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What equals the first turn, by bodies that join through the equality predicate."""
    edges = conv_next(spark, sf_dir).dropna()
    r = Reasoner(spark).add_source("s", edges).add_source("first", edges.agg(F.min("a").alias("a")))
    r.set_rules("owl:sameAs(X,Y) :- s(X,Y)\nend(X) :- s(X,Y)\nend(Y) :- s(X,Y)\nu(X) :- end(X), first(X)\nv(Y) :- end(Y), owl:sameAs(X,Y), first(X)", same_as="SING")
    r.materialize()
    return r.query("v(X)", "mat").toDF("x")


@query("csv_round", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k, c_name AS n, c_mktsegment AS s FROM customer")
def csv_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV, and read through a configuration file's text."""
    folder = new_path(spark, "csv")
    sinks.csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), f"{folder}/customers.csv")
    r = Reasoner(spark).configure(f"EDB0_predname=c\nEDB0_type=INMEMORY\nEDB0_param0={folder}\nEDB0_param1=customers\n")
    r.set_rules("k(K,N,S) :- c(K,N,S)").materialize()
    return r.query("k(K,N,S)", "mat").toDF("k", "n", "s")


TRIPLES_SQL = "SELECT DISTINCT '<c' || c_custkey || '>' AS s, '<livesIn>' AS p, '<n' || c_nationkey || '>' AS o FROM customer"


def lives_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.format_string("<c%d>", "c_custkey").alias("s"), F.lit("<livesIn>").alias("p"), F.format_string("<n%d>", "c_nationkey").alias("o"))


@query("ntriples_round", TRIPLES_SQL)
def ntriples_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written as N-Triples and read back."""
    path = new_path(spark, "triples")
    r = Reasoner(spark).add_source("TE", lives_in(spark, sf_dir)).set_rules("livesIn(A,B) :- TE(A,<livesIn>,B)")
    r.materialize()
    r.write(path, "nt")
    return Reasoner(spark).add_source("TE", sources.ntriples(spark, path)).query("TE(S,P,O)").toDF("s", "p", "o")


@query("triple_store", TRIPLES_SQL)
def triple_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is partitioned by predicate: a constant predicate reads its own files."""
    path = new_path(spark, "store")
    names = table(spark, sf_dir, "nation").select(F.format_string("<n%d>", "n_nationkey"), F.lit("<name>"), "n_name")
    sources.load_triples(lives_in(spark, sf_dir).union(names), path)
    return Reasoner(spark).add_source("TE", sources.triples(spark, path)).query("TE(S,<livesIn>,O)", constants=True).toDF("s", "p", "o")


@query("literal_rows", "SELECT DISTINCT n_name AS n, side FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('ASIA', 'east'), ('EUROPE', 'west')) v(r, side) ON r = r_name")
def literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that are given in the program's own text."""
    r = Reasoner(spark).add_facts("side", [("ASIA", "east"), ("EUROPE", "west")])
    r.add_source("nation", table(spark, sf_dir, "nation").select("n_name", "n_regionkey")).add_source("region", table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    r.set_rules("of(N,S) :- nation(N,K), region(K,R), side(R,S)").materialize()
    return r.query("of(N,S)", "mat").toDF("n", "side")


@query("sql_source", "SELECT n_name AS n, total FROM nation JOIN (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY c_nationkey) ON c_nationkey = n_nationkey")
def sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate as a source: rules have none."""
    r = Reasoner(spark).add_source("count", sources.view(spark, f"SELECT c_nationkey, count(*) AS total FROM parquet.`{sf_dir}/customer.parquet` GROUP BY c_nationkey"))
    r.add_source("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).set_rules("of(N,T) :- nation(K,N), count(K,T)").materialize()
    return r.query("of(N,T)", "mat").toDF("n", "total")


@query("removal_list", "SELECT DISTINCT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE s_acctbal > 0")
def removal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a source hidden by a list in a text file."""
    path = new_path(spark, "removed")
    s = table(spark, sf_dir, "supplier")
    s.where("s_acctbal <= 0").select(F.format_string("%d\n%d .", "s_suppkey", "s_nationkey")).write.text(path)
    r = Reasoner(spark).add_source("supplier", s.select("s_suppkey", "s_nationkey"))
    gone = sources.removal_list(spark, path, 2).select(F.col("c0").cast("long"), F.col("c1").cast("int"))
    return r.hide("supplier", gone).query("supplier(S,N)").toDF("s", "n")


@query("termination_verdicts", "SELECT * FROM (VALUES ('ends', 'JA', 1), ('ends', 'MSA', 1), ('ends', 'MFA', 1), ('ends', 'MFC', 0), ('goes on', 'JA', 0), ('goes on', 'MSA', 0), ('goes on', 'MFA', 0), ('goes on', 'MFC', 2)) v(program, \"check\", verdict)")
def termination_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check says of a chase that ends and of one that does not."""
    programs = {"ends": "w(X,Z) :- per(X)\nv(Z) :- w(X,Z)", "goes on": "par(X,Z) :- per(X)\nper(Z) :- par(X,Z)\nper(X) :- base(X)"}
    found = [(n, c, int(Reasoner(spark).set_rules(t).check_termination(c))) for n, t in programs.items() for c in ("JA", "MSA", "MFA", "MFC")]
    return spark.createDataFrame(found, "program string, check string, verdict int")


@query("source_sets", "SELECT * FROM (VALUES ('a,b'), ('c')) v(sources)")
def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of sources from which a predicate may be derived."""
    found = triggers.depends(Program.parse("p(X) :- a(X), q(X)\nq(X) :- b(X)\np(X) :- c(X)\nq(X) :- q(X), a(X)"), "p")
    return spark.createDataFrame([(",".join(x),) for x in found], "sources string")


@query("update_folder", f"WITH RECURSIVE {ORDER_SUCC}, e AS (SELECT a, b FROM order_succ WHERE a % 10 <> 4), {CLOSURE.format('e')} SELECT x, y FROM t")
def update_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model brought up to date by the files of a folder."""
    e = order_succ(spark, sf_dir).dropna()
    folder = new_path(spark, "changes")
    sinks.csv(e.where("a % 10 = 4"), f"{folder}/e_remove.csv")
    sinks.csv(e.where("a % 10 = 7"), f"{folder}/e_add.csv")
    r = Reasoner(spark).add_source("e", e.where("a % 10 <> 7")).set_rules(LINEAR)
    r.materialize()
    return r.update_from(folder).query("t(X,Y)", "mat").toDF("x", "y")


@query("dred_delete", f"WITH RECURSIVE {ORDER_SUCC}, e AS (SELECT a, b FROM order_succ WHERE a % 10 <> 3), {CLOSURE.format('e')} SELECT x, y FROM t")
def dred_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model after a tenth of its edges is gone, by overdeletion and rederivation."""
    e = order_succ(spark, sf_dir).dropna()
    r = Reasoner(spark).add_source("e", e).set_rules(LINEAR)
    r.materialize()
    r.update(removed={"e": e.where("a % 10 = 3")})
    return r.query("t(X,Y)", "mat").toDF("x", "y")


@query("dred_both", f"WITH RECURSIVE {ORDER_SUCC}, e AS (SELECT a, b FROM order_succ WHERE a % 10 <> 4), {CLOSURE.format('e')} SELECT x, y FROM t")
def dred_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and deletions at once."""
    e = order_succ(spark, sf_dir).dropna()
    r = Reasoner(spark).add_source("e", e.where("a % 10 <> 7")).set_rules(LINEAR)
    r.materialize()
    r.update(removed={"e": e.where("a % 10 = 4")}, added={"e": e.where("a % 10 = 7")})
    return r.query("t(X,Y)", "mat").toDF("x", "y")


@query("hidden_rows", "SELECT DISTINCT s_suppkey AS s FROM supplier WHERE s_nationkey <> 5")
def hidden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source with rows left out."""
    r = small_tables(spark, sf_dir)
    r.hide("supplier", table(spark, sf_dir, "supplier").where("s_nationkey = 5").select("s_suppkey", "s_nationkey"))
    r.set_rules("s(S) :- supplier(S,N)").materialize()
    return r.query("s(S)", "mat").toDF("s")


@query("linear_graph", "SELECT DISTINCT s_nationkey AS x, s_suppkey AS y FROM supplier UNION SELECT s_suppkey, s_nationkey FROM supplier UNION SELECT c_custkey, c_nationkey FROM customer UNION SELECT c_nationkey, c_custkey FROM customer")
def linear_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear rules with a cycle, as one union of selections and no loop."""
    r = Reasoner(spark)
    r.add_source("s", table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long")))
    r.add_source("c", table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long")))
    r.set_rules("p(X,Y) :- s(X,Y)\np(X,Y) :- c(X,Y)\nq(Y,X) :- p(X,Y)\np(X,Y) :- q(X,Y)").materialize_linear()
    return r.query("p(X,Y)", "mat").toDF("x", "y")


@query("patterns", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basic graph pattern over triples made from the tables."""

    def part(name: str, s: str, p: str, o: str, mark: str, to: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(mark), F.col(s)).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(to), F.col(o)).alias("o"))

    triples = part("customer", "c_custkey", "livesIn", "c_nationkey", "c", "n").union(part("nation", "n_nationkey", "partOf", "n_regionkey", "n", "r")).union(part("region", "r_regionkey", "name", "r_name", "r", ""))
    r = Reasoner(spark).add_source("TE", triples).set_rules([])
    r.materialize()
    found = r.patterns([("?c", "livesIn", "?n"), ("?n", "partOf", "?r"), ("?r", "name", "?m")], ["?c", "?m"])
    return found.select(F.substring("c", 2, 99).alias("c"), F.col("m").alias("r"))


TOPK_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS FLOAT)) AS e FROM embeddings),
q AS (SELECT a.id AS e, b.id AS r, list_transform(range(1, 65), lambda i: CAST(a.e[i] + b.e[i] AS FLOAT)) AS w FROM v a JOIN v b ON b.id = 1 WHERE a.id % 100 = 0),
s AS (SELECT q.e, q.r, v.id AS answer, list_sum(list_transform(range(1, 65), lambda i: CAST(abs(CAST(q.w[i] - v.e[i] AS FLOAT)) AS DOUBLE))) AS score FROM q, v)
SELECT e, r, answer, CAST(rank AS INTEGER) AS rank FROM (SELECT e, r, answer, row_number() OVER (PARTITION BY e, r ORDER BY round(score, 6), answer) AS rank FROM s) WHERE rank <= 5
"""


@query("topk_tail", TOPK_SQL)
def topk_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest tails for a stated set of heads (ids divisible by 100) and one relation, against all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    heads = v.where("id % 100 = 0").select(F.col("id").alias("e"), F.lit(1).cast("long").alias("r"))
    return top_k(heads, v, v.where("id = 1"), 5).select("e", "r", "answer", "rank")
