"""Queries of referential integrity and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity
from ..sources.readers import star
from .base import query

BAD = "CASE WHEN o_orderkey % 37 = 0 THEN o_custkey + 1000000 WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey END"


def _orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return star(spark, sf_dir, "orders").withColumn("fk", F.when(k % 37 == 0, F.col("o_custkey") + 1_000_000).when(k % 41 == 0, None).otherwise(F.col("o_custkey")))


@query("ref001_foreign_key", f"WITH o AS (SELECT *, {BAD} AS fk FROM orders) SELECT o_orderkey, fk FROM o WHERE fk IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = fk)")
def ref001_table(spark, sf_dir):
    return integrity.orphans(_orders(spark, sf_dir), star(spark, sf_dir, "customer"), "fk", "c_custkey").select("o_orderkey", "fk")


@query("ref002_cardinality", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) NOT BETWEEN 2 AND 5")
def ref002(spark, sf_dir):
    return integrity.cardinality(star(spark, sf_dir, "lineitem"), "l_orderkey", 2, 5)


@query("ref003_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0)")
def ref003(spark, sf_dir):
    parents = star(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0")
    return integrity.orphans(star(spark, sf_dir, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("set_operations", """WITH m AS (SELECT DISTINCT user_id FROM events WHERE value > 400), o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value < 60)
  SELECT 'both' AS which, count(*) AS n FROM (SELECT * FROM m INTERSECT SELECT * FROM o) UNION ALL SELECT 'mine', count(*) FROM (SELECT * FROM m EXCEPT SELECT * FROM o)
  UNION ALL SELECT 'other', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM m) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM m UNION SELECT * FROM o)""")
def set_operations(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    m, o = e.where("value > 400").select("user_id").distinct(), e.where("event_type = 'error' AND value < 60").select("user_id").distinct()
    parts = {"both": m.intersect(o), "mine": m.join(o, "user_id", "left_anti"), "other": o.join(m, "user_id", "left_anti"), "any": m.union(o).distinct()}
    out = None
    for name, d in parts.items():
        row = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("which"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("union_missing_columns", "SELECT kind, count(*) AS n, count(reason) AS n_reason, count(score) AS n_score FROM (SELECT 'a' AS kind, CASE WHEN value > 200 THEN 'high' END AS reason, NULL AS score FROM events UNION ALL SELECT 'b', NULL, value FROM events WHERE value > 100) GROUP BY kind")
def union_missing(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    a = e.select(F.lit("a").alias("kind"), F.when(F.col("value") > 200, "high").alias("reason"))
    b = e.where("value > 100").select(F.lit("b").alias("kind"), F.col("value").alias("score"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("n_reason"), F.count("score").alias("n_score"))
