"""The relational surface over the test tables, as DataFrame queries; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.plans.catalog import register
from lamina.sources.tables import table

c = F.col


def _simple(name: str, sql: str, source: str, build) -> None:
    """Register a query over one table; ``build`` maps its DataFrame to the result."""

    def query(spark, d) -> DataFrame:
        return build(table(spark, d, source))

    query.__name__ = name
    register(name, sql)(query)


# selection and projection
_simple("select_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'", "orders", lambda o: o.filter((c("o_totalprice") > 300000) & (c("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice"))
_simple("select_logical", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT p_type = 'ECONOMY'", "part", lambda p: p.filter(((c("p_size") < 10) | (c("p_size") > 40)) & ~(c("p_type") == "ECONOMY")).select("p_partkey"))
_simple("select_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", "part", lambda p: p.filter(c("p_size").between(10, 20)).select("p_partkey", "p_size"))
_simple("select_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20", "part", lambda p: p.filter(~c("p_size").between(10, 20)).select("p_partkey", "p_size"))
_simple("select_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_brand LIKE 'Brand#_'", "part", lambda p: p.filter(c("p_name").like("%ring") & c("p_brand").like("Brand#_")).select("p_partkey", "p_name"))
_simple("select_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE 's%'", "part", lambda p: p.filter(~c("p_name").like("s%")).select("p_partkey", "p_name"))
_simple("select_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')", "customer", lambda x: x.filter(c("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select("c_custkey", "c_mktsegment"))
_simple("select_not_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')", "customer", lambda x: x.filter(~c("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select("c_custkey", "c_mktsegment"))
_simple("null_coalesce", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END, 0.0) AS price FROM orders", "orders", lambda o: o.select("o_orderkey", F.coalesce(F.when(c("o_orderstatus") != "F", c("o_totalprice")), F.lit(0.0)).alias("price")))
_simple("is_null", "SELECT count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (x IS NOT NULL) AS others FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders)", "orders", lambda o: o.select(F.when(c("o_orderstatus") != "F", c("o_totalprice")).alias("x")).agg(F.count_if(c("x").isNull()).alias("nulls"), F.count_if(c("x").isNotNull()).alias("others")))
_simple("project", "SELECT c_custkey AS id, c_name AS name FROM customer", "customer", lambda x: x.select(c("c_custkey").alias("id"), c("c_name").alias("name")))
_simple("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) / 2 AS half_charge FROM lineitem", "lineitem", lambda x: x.select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")) / 2).alias("half_charge")))
_simple("distinct_one", "SELECT DISTINCT p_brand FROM part", "part", lambda p: p.select("p_brand").distinct())
_simple("distinct_multi", "SELECT DISTINCT p_brand, p_type FROM part", "part", lambda p: p.select("p_brand", "p_type").distinct())

# order and limits
_simple("order_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC", "customer", lambda x: x.select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", c("c_acctbal").desc()))
_simple("order_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS cut FROM lineitem ORDER BY l_extendedprice * l_discount DESC", "lineitem", lambda x: x.orderBy((c("l_extendedprice") * c("l_discount")).desc()).select("l_orderkey", "l_linenumber", (c("l_extendedprice") * c("l_discount")).alias("cut")))
_simple("order_nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders ORDER BY x NULLS FIRST, o_orderkey", "orders", lambda o: o.select("o_orderkey", F.when(c("o_orderstatus") != "F", c("o_totalprice")).alias("x")).orderBy(c("x").asc_nulls_first(), "o_orderkey"))
_simple("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20", "orders", lambda o: o.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").offset(20).limit(10))
_simple("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders", lambda o: o.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(25))


@register("topn_ties", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, rank() OVER (ORDER BY o_orderpriority) AS r FROM orders) WHERE r <= 10")
def topn_ties(spark, d):
    """The first 10 and all that tie with the last of them: the tenth value (a top-k), then a filter; no global window."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    last = o.select("o_orderpriority").orderBy("o_orderpriority").limit(10).agg(F.max("o_orderpriority").alias("last"))
    return o.join(F.broadcast(last), c("o_orderpriority") <= c("last")).drop("last")  # one row


# aggregation
_simple("agg_counts", "SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, count(DISTINCT o_custkey) AS customers FROM orders", "orders", lambda o: o.agg(F.count("*").alias("n"), F.count(F.when(c("o_orderstatus") == "F", 1)).alias("n_f"), F.countDistinct("o_custkey").alias("customers")))
_simple("agg_basic", "SELECT round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem", "lineitem", lambda x: x.agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest")))
_simple("agg_stats", "SELECT o_orderpriority, round(variance(o_totalprice) / 1e6, 3) AS var_m, round(stddev(o_totalprice), 3) AS dev, round(median(o_totalprice), 3) AS mid FROM orders GROUP BY o_orderpriority", "orders", lambda o: o.groupBy("o_orderpriority").agg(F.round(F.variance("o_totalprice") / 1e6, 3).alias("var_m"), F.round(F.stddev("o_totalprice"), 3).alias("dev"), F.round(F.median("o_totalprice"), 3).alias("mid")))
_simple("group_by_one", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag", "lineitem", lambda x: x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")))
_simple("group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 3) AS price FROM lineitem GROUP BY ALL", "lineitem", lambda x: x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 3).alias("price")))
_simple("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", "orders", lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12"))
_simple("where_having", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000", "orders", lambda o: o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).filter("t > 1000000").select("o_custkey", F.round("t", 2).alias("total")))
_simple("hash_agg", "SELECT l_suppkey, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_suppkey", "lineitem", lambda x: x.groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("lines")))
_simple("sort_agg", "SELECT l_suppkey, max(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey", "lineitem", lambda x: x.groupBy("l_suppkey").agg(F.max("l_returnflag").alias("flag")))


# joins
def _two(spark, d):
    return table(spark, d, "orders"), table(spark, d, "customer")


_EQUI = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


@register("equi_join", _EQUI)
def equi_join(spark, d):
    o, cu = _two(spark, d)
    return o.join(cu, o.o_custkey == cu.c_custkey).select("o_orderkey", "c_name")


@register("sort_merge_join", _EQUI)
def sort_merge_join(spark, d):
    o, cu = _two(spark, d)
    return o.join(cu.hint("merge"), o.o_custkey == cu.c_custkey).select("o_orderkey", "c_name")


@register("hash_join", _EQUI)
def hash_join(spark, d):
    o, cu = _two(spark, d)
    return o.join(cu.hint("shuffle_hash"), o.o_custkey == cu.c_custkey).select("o_orderkey", "c_name")


@register("natural_join", "SELECT k, o_orderkey, c_name FROM (SELECT o_custkey AS k, o_orderkey FROM orders) NATURAL JOIN (SELECT c_custkey AS k, c_name FROM customer)")
def natural_join(spark, d):
    o, cu = _two(spark, d)
    a, b = o.select(c("o_custkey").alias("k"), "o_orderkey"), cu.select(c("c_custkey").alias("k"), "c_name")
    return a.join(b, [x for x in a.columns if x in b.columns])


@register("cross_product", "SELECT r_name, n_name FROM region, nation")
def cross_product(spark, d):
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@register("theta_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def theta_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = s.toDF("a", "a_nation", "a_bal"), s.toDF("b", "b_nation", "b_bal")
    return a.join(b, (c("a_nation") == c("b_nation")) & (c("a_bal") < c("b_bal"))).select("a", "b")


@register("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    o, cu = _two(spark, d)
    return cu.join(o.filter("o_totalprice > 400000"), cu.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    o, cu = _two(spark, d)
    return cu.join(o.filter("o_totalprice > 400000"), cu.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@register("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def in_subquery(spark, d):
    o, cu = _two(spark, d)
    return o.join(cu.filter("c_acctbal < 0"), o.o_custkey == cu.c_custkey, "left_semi").select("o_orderkey")


@register("exists_corr", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity * 10000 > o.o_totalprice)")
def exists_corr(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(line, (o.o_orderkey == line.l_orderkey) & (line.l_quantity * 10000 > o.o_totalprice), "left_semi").select("o_orderkey")


@register("late_materialize", "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def late_materialize(spark, d):
    """The winners' keys first, from two columns; then the wide columns by key."""
    o = table(spark, d, "orders")
    keys = o.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey")
    return o.join(F.broadcast(keys), "o_orderkey", "left_semi").select("o_orderkey", "o_orderdate", "o_orderpriority")  # 50 rows


@register("multi_index_intersect", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def multi_index_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_orderkey").intersect(o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey"))


# set operations
def _keys(spark, d):
    o, cu = _two(spark, d)
    return cu.select(c("c_custkey").alias("k")), o.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("k"))


_A, _B = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"


@register("set_union", f"{_A} UNION {_B}")
def set_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@register("set_intersect", f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@register("set_except", f"{_A} EXCEPT {_B}")
def set_except(spark, d):
    a, b = _keys(spark, d)
    return a.subtract(b)


# changes and constraints, as functions from table to table
_simple("update_expr", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 1.1::DOUBLE ELSE p_retailprice END AS p_retailprice FROM part", "part", lambda p: p.select("p_partkey", F.when(c("p_size") > 25, c("p_retailprice") * 1.1).otherwise(c("p_retailprice")).alias("p_retailprice")))
_simple("delete_where", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'", "orders", lambda o: o.filter(~(c("o_orderstatus") == "F")).select("o_orderkey"))
_simple("check_pk", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", "lineitem", lambda x: x.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1"))
_simple("check_constraint", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal >= 0", "customer", lambda x: x.filter(~(c("c_acctbal") >= 0)).select("c_custkey", "c_acctbal"))


@register("check_fk", "SELECT count(*) AS broken FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 48)")
def check_fk(spark, d):
    """Rows of lineitem whose part isn't among the parts below size 48."""
    line, p = table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size < 48")
    return line.join(p, line.l_partkey == p.p_partkey, "left_anti").agg(F.count("*").alias("broken"))


@register("update_in_subquery", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_in_subquery(spark, d):
    o, cu = _two(spark, d)
    hit = cu.filter("c_mktsegment = 'MACHINERY'").select(c("c_custkey").alias("hit")).distinct()
    joined = o.join(hit, o.o_custkey == c("hit"), "left")
    return joined.select("o_orderkey", F.when(c("hit").isNotNull(), "1-URGENT").otherwise(c("o_orderpriority")).alias("o_orderpriority"))


@register("update_join", "SELECT s_suppkey, s_acctbal + n_regionkey AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def update_join(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", (c("s_acctbal") + c("n_regionkey")).alias("s_acctbal"))


@register("delete_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def delete_in_subquery(spark, d):
    o, cu = _two(spark, d)
    return o.join(cu.filter("c_mktsegment = 'MACHINERY'"), o.o_custkey == cu.c_custkey, "left_anti").select("o_orderkey")


@register("insert_select", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
def insert_select(spark, d):
    s, cu = table(spark, d, "supplier"), table(spark, d, "customer").filter("c_acctbal > 9000")
    return s.select(c("s_suppkey").alias("k"), c("s_name").alias("name")).union(cu.select("c_custkey", "c_name"))


# partitioning
@register("exchange_repartition", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders")
def exchange_repartition(spark, d):
    """Distribute, repartition by key, gather: nothing lost."""
    o = table(spark, d, "orders").select("o_custkey")
    return o.repartition(4).repartition(8, "o_custkey").coalesce(1).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


_simple("hash_partition", "SELECT o_custkey * 7919 % 1009 % 8 AS part, count(*) AS n FROM orders GROUP BY 1", "orders", lambda o: o.groupBy(F.pmod(F.pmod(c("o_custkey") * 7919, F.lit(1009)), F.lit(8)).alias("part")).agg(F.count("*").alias("n")))
_simple("range_partition", "SELECT floor(o_totalprice / 100000)::BIGINT AS part, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1", "orders", lambda o: o.groupBy(F.floor(c("o_totalprice") / 100000).alias("part")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")))


@register("rendezvous_hash", "SELECT c_custkey, max_by(node, (c_custkey * 31 + node * 17) * 7919 % 100003 * 8 + node) AS node FROM customer, (SELECT unnest(range(8))::BIGINT AS node) GROUP BY c_custkey")
def rendezvous_hash(spark, d):
    """Every key goes to the node with the highest score for it; scores of all nodes stand in one array, no join."""
    score = lambda n: F.pmod((c("c_custkey") * 31 + n * 17) * 7919, F.lit(100003)) * 8 + n
    scored = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda n: F.struct(score(n).alias("s"), n.alias("n")))
    return table(spark, d, "customer").select("c_custkey", F.array_max(scored)["n"].alias("node"))
