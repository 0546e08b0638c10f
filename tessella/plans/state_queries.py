"""State queries: orders as tasks, lineitem as their files, two slices of orders as two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import retrieval, state
from tessella.registry import query, table


@query("board_diff", """WITH b AS (SELECT DISTINCT o_orderkey AS path FROM orders WHERE o_orderstatus IN ('O', 'P')), l AS (SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT DISTINCT l_orderkey AS path FROM lineitem)
SELECT path, 'board_file_missing' AS code FROM b WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT path, 'live_task_missing' FROM l WHERE path NOT IN (SELECT path FROM b)
UNION ALL SELECT path, 'board_task_not_live' FROM b WHERE path IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM l)""")
def board_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    board = o.filter("o_orderstatus in ('O', 'P')").select(F.col("o_orderkey").alias("path")).distinct()
    lines = lambda f: f.select(F.col("l_orderkey").alias("path")).distinct()
    return state.board_difference(board, lines(x.filter("l_linestatus = 'O'")), lines(x))


_SNAP = "SELECT o_custkey, min(o_orderkey) AS o_orderkey, max(o_totalprice) AS fingerprint FROM orders WHERE o_orderstatus = '{}' GROUP BY o_custkey"


@query("change_delta", f"SELECT n.o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'new' WHEN floor(n.fingerprint / 100000) = floor(b.fingerprint / 100000) THEN 'same' ELSE 'conflict' END AS state FROM ({_SNAP.format('O')}) AS n LEFT JOIN ({_SNAP.format('F')}) AS b ON n.o_custkey = b.o_custkey")
def change_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    slice_ = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.floor(F.max("o_totalprice") / 100000).alias("fingerprint"))
    return state.change_delta(slice_("O"), slice_("F"), ["o_custkey"]).select("o_custkey", "state")


@query("upgrade_plan_diff", """WITH w AS (SELECT p_partkey AS path, p_size // 10 AS digest FROM part WHERE p_retailprice > 950), p AS (SELECT p_partkey AS path, p_size // 10 + CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END AS digest FROM part WHERE p_size > 5),
i AS (SELECT p_partkey AS path, p_size // 10 + CASE WHEN p_type LIKE 'S%' THEN 1 ELSE 0 END AS digest FROM part WHERE p_size < 40)
SELECT coalesce(w.path, p.path, i.path) AS path, CASE WHEN w.digest IS NOT NULL AND p.digest IS NULL THEN 'create' WHEN w.digest = p.digest THEN 'skip' WHEN w.digest IS NOT NULL AND p.digest IS NOT DISTINCT FROM i.digest THEN 'replace'
WHEN w.digest IS NOT NULL THEN 'conflict' WHEN p.digest IS NOT NULL AND p.digest IS NOT DISTINCT FROM i.digest THEN 'remove' WHEN p.digest IS NOT NULL AND i.digest IS NOT NULL THEN 'conflict' ELSE 'keep' END AS action
FROM w FULL JOIN p ON w.path = p.path FULL JOIN i ON coalesce(w.path, p.path) = i.path""")
def upgrade_plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("d", F.expr("p_size div 10"))
    side = lambda where, digest: part.filter(where).select(F.col("p_partkey").alias("path"), F.expr(digest).alias("digest"))
    return state.plan_difference(side("p_retailprice > 950", "d"), side("p_size > 5", "d + case when p_brand = 'Brand#11' then 1 else 0 end"), side("p_size < 40", "d + case when p_type like 'S%' then 1 else 0 end"))


@query("duplicate_ids", "SELECT md5(text) AS id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.repeated(table(spark, sf_dir, "documents").select(F.md5("text").alias("id")), "id")


@query("missing_refs", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dangling(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")))


@query("problems_union", """SELECT DISTINCT severity, code, message, path FROM (
SELECT 'error' AS severity, 'task_without_file' AS code, o_orderpriority AS message, 'o/' || o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'warning', 'cheap', o_orderstatus, 'o/' || o_orderkey FROM orders WHERE o_totalprice < 5000
UNION ALL SELECT 'error', 'discount', l_returnflag, 'l/' || l_orderkey FROM lineitem WHERE l_discount > 0.09) AS x""")
def problems_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("o/"), "o_orderkey")
    bare = o.join(x.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return state.all_problems(
        state.problems(bare, [("error", "task_without_file", F.lit(True), F.col("o_orderpriority"))], path),
        state.problems(o, [("warning", "cheap", F.col("o_totalprice") < 5000, F.col("o_orderstatus"))], path),
        state.problems(x, [("error", "discount", F.col("l_discount") > 0.09, F.col("l_returnflag"))], F.concat(F.lit("l/"), "l_orderkey")),
    )


@query("surface_profile", "SELECT p_brand, CASE WHEN bool_or(p_size = 50 AND p_retailprice > 1500) THEN 'critical' WHEN bool_or(p_size > 48) THEN 'standard' WHEN bool_and(p_size < 48) THEN 'prose' ELSE 'mixed' END AS profile FROM part GROUP BY p_brand")
def surface_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.profile(table(spark, sf_dir, "part"), "p_brand", F.expr("p_size = 50 and p_retailprice > 1500"), F.col("p_size") > 48, F.col("p_size") < 48)


_YEAR = "SELECT o_orderpriority AS id, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = '{}' GROUP BY o_orderpriority"


@query("baseline_candidate_delta", f"SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(b.n, 0) - coalesce(a.n, 0) < -5 AS dropped FROM ({_YEAR.format('F')}) AS a FULL JOIN ({_YEAR.format('O')}) AS b ON a.id = b.id")
def baseline_candidate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return retrieval.deltas(side("F"), side("O"), "id", "n", 5)


@query("parents_idle", """SELECT t.user_id AS id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') AS t
JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY user_id) AS c ON t.user_id = c.user_id WHERE n = 0""")
def parents_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    live = e.filter("event_type = 'signup'").select(F.col("user_id").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("live")).distinct()
    children = e.select(F.lit(None).cast("long").alias("id"), F.col("user_id").alias("parent"), (F.col("event_type") == "purchase").alias("live"))
    return state.parents_without_live_children(live.union(children))
