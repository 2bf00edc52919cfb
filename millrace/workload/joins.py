"""Left joins: one key, two keys, chains, mixed types, null keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.operators.joins import left_join
from millrace.workload.registry import query, table


@query(
    """
    SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def join_left_single(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = left_join(documents, table(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})


@query(
    """
    SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, s.pair_quantity
    FROM lineitem l LEFT JOIN (
      SELECT l_orderkey AS ok, l_partkey AS pk, sum(l_quantity) AS pair_quantity
      FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) s
    ON l.l_orderkey = s.ok AND l.l_partkey = s.pk
    """
)
def join_left_multi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    returned = lines.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"))
    sums = returned.agg(F.sum("l_quantity").alias("pair_quantity"))
    left = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return left_join(left, sums, ["l_orderkey", "l_partkey"], ["ok", "pk"], spread=True)


@query(
    """
    SELECT o_orderkey, o_custkey, c_nationkey, n_name, n_regionkey, r_name
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    """
)
def join_chain(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    chain = [
        (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"),
        (table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey"),
        (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey"),
    ]
    return reduce(lambda left, step: left_join(left, step[0], [step[1]], [step[2]]), chain, first)


@query(
    """
    SELECT CAST(o_custkey AS VARCHAR) AS cust_text, o_orderkey, c_name
    FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)
    """
)
def join_type_align(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cust_text"), "o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return left_join(orders, customers, ["cust_text"], ["c_custkey"])


@query(
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k FROM orders),
         c AS (SELECT nullif(c_custkey, 7) AS k, c_name FROM customer)
    SELECT o.o_orderkey, CAST(o.k AS DOUBLE) AS k, plain.c_name AS plain_name, safe.c_name AS safe_name
    FROM o LEFT JOIN c AS plain ON o.k = plain.k LEFT JOIN c AS safe ON o.k IS NOT DISTINCT FROM safe.k
    """
)
def join_null_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k"
    )
    customers = table(spark, sf_dir, "customer").selectExpr("nullif(c_custkey, 7) AS k", "c_name")
    plain = left_join(orders, customers.withColumnRenamed("c_name", "plain_name"), ["k"], ["k"])
    out = left_join(plain, customers.withColumnRenamed("c_name", "safe_name"), ["k"], ["k"], null_safe=True)
    return out.withColumn("k", F.col("k").cast("double"))
