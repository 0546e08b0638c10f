"""Graph queries over the driver's tables, read as a property graph.

customer = file, orders = symbol, part = topic, nation = repository; an order's customer DEFINES it, a line of an
order HAS_TOPIC its part, and orders of one customer CALL the next order of the customer; suppliers IMPORT parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.registry import query, table

DEFINES_SQL = "SELECT 'DEFINES' AS kind, 'file:' || o_custkey AS src, 'symbol:' || o_orderkey AS dst FROM orders"
CALLS_SQL = """SELECT 'CALLS' AS kind, 'symbol:' || o_orderkey AS src, 'symbol:' || nxt AS dst FROM (
  SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) AS x WHERE nxt IS NOT NULL"""
TOPIC_SQL = "SELECT DISTINCT 'HAS_TOPIC' AS kind, 'symbol:' || l_orderkey AS src, 'topic:' || l_partkey AS dst FROM lineitem"
IMPORTS_SQL = "SELECT DISTINCT 'IMPORTS_FILE' AS kind, 'file:' || c_custkey AS src, 'file:' || (c_custkey * 7 % 1000) AS dst FROM customer WHERE c_custkey * 7 % 1000 <> c_custkey"
EDGES_SQL = f"{DEFINES_SQL} UNION ALL {CALLS_SQL} UNION ALL {IMPORTS_SQL}"


def defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("DEFINES").alias("kind"), F.concat(F.lit("file:"), "o_custkey").alias("src"), F.concat(F.lit("symbol:"), "o_orderkey").alias("dst"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", later.alias("later")).filter("later is not null")
    return o.select(F.lit("CALLS").alias("kind"), F.concat(F.lit("symbol:"), "o_orderkey").alias("src"), F.concat(F.lit("symbol:"), "later").alias("dst"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return x.select(F.lit("HAS_TOPIC").alias("kind"), F.concat(F.lit("symbol:"), "l_orderkey").alias("src"), F.concat(F.lit("topic:"), "l_partkey").alias("dst"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 1000).alias("to")).filter("c_custkey <> to").distinct()
    return c.select(F.lit("IMPORTS_FILE").alias("kind"), F.concat(F.lit("file:"), "c_custkey").alias("src"), F.concat(F.lit("file:"), "to").alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defines(spark, sf_dir).unionByName(calls(spark, sf_dir)).unionByName(imports(spark, sf_dir))


def ids(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "id string")


@query("graph_callers", f"SELECT e.src, e.dst, o.o_custkey AS caller_file FROM ({CALLS_SQL}) AS e JOIN orders AS o ON e.src = 'symbol:' || o.o_orderkey JOIN orders AS p ON e.dst = 'symbol:' || p.o_orderkey WHERE p.o_orderpriority = '1-URGENT'")
def graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    symbol = F.concat(F.lit("symbol:"), "o_orderkey")
    found = graph.callers_of(calls(spark, sf_dir), o.filter("o_orderpriority = '1-URGENT'").select(symbol.alias("id")))
    return found.join(o.select(symbol.alias("src"), F.col("o_custkey").alias("caller_file")), "src").select("src", "dst", "caller_file")


@query("graph_callees", f"SELECT e.src, e.dst FROM ({CALLS_SQL}) AS e JOIN orders AS o ON e.src = 'symbol:' || o.o_orderkey WHERE o.o_orderstatus = 'P'")
def graph_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("symbol:"), "o_orderkey").alias("id"))
    return graph.callees_of(calls(spark, sf_dir), some).select("src", "dst")


@query("graph_file_incident", f"SELECT kind, src, dst FROM ({EDGES_SQL}) AS e WHERE src IN ('file:7', 'file:21') OR dst IN ('file:7', 'file:21')")
def graph_file_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident(edges(spark, sf_dir), ids(spark, "file:7", "file:21")).select("kind", "src", "dst")


@query("graph_topic", f"SELECT e.src, e.dst, p.p_name AS topic FROM ({TOPIC_SQL}) AS e JOIN part AS p ON e.dst = 'topic:' || p.p_partkey WHERE p.p_size = 10")
def graph_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size = 10").select(F.concat(F.lit("topic:"), "p_partkey").alias("id"), F.col("p_name").alias("topic"))
    return graph.into(topics(spark, sf_dir), graph.HAS_TOPIC, p).join(p.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "topic")


@query("graph_import", f"SELECT dst, CAST(count(*) AS BIGINT) AS importers FROM ({IMPORTS_SQL}) AS e GROUP BY dst")
def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(spark, sf_dir).groupBy("dst").agg(F.count(F.lit(1)).alias("importers"))


@query("graph_symbol_ambiguous", "SELECT p_name AS name, p_partkey AS id, count(*) OVER () AS n_matches, count(*) OVER () > 1 AS ambiguous FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def graph_symbol_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"))
    return graph.select_symbol(p, p.agg(F.min("name")).head()[0]).select("name", "id", "n_matches", "ambiguous")


STEPS_SQL = f"""e AS ({EDGES_SQL}),
steps AS (SELECT dst AS here, src AS nxt, FALSE AS back FROM e WHERE kind IN ('CALLS', 'IMPORTS_FILE') UNION ALL SELECT src, dst, FALSE FROM e WHERE kind = 'DEFINES' UNION ALL SELECT dst, src, TRUE FROM e WHERE kind = 'DEFINES')"""


def _levels(depth: int, seeds: str) -> str:
    levels = [f"l0 AS (SELECT DISTINCT {seeds})"]
    for k in range(1, depth + 1):
        met = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        levels.append(f"l{k} AS (SELECT DISTINCT nxt AS id FROM steps JOIN l{k - 1} ON here = id WHERE nxt NOT IN ({met}))")
    return ", ".join(levels)


def _all_levels(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT id, {k} AS depth FROM l{k}" for k in range(depth + 1))


URGENT = "'symbol:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.concat(F.lit("symbol:"), "o_orderkey").alias("id"))


@query("graph_impact_d2", f"WITH {STEPS_SQL}, {_levels(2, URGENT)} {_all_levels(2)}")
def graph_impact_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(edges(spark, sf_dir), _urgent(spark, sf_dir), 2)


@query("graph_impact_d3", f"WITH {STEPS_SQL}, {_levels(3, URGENT)} {_all_levels(3)}")
def graph_impact_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(edges(spark, sf_dir), _urgent(spark, sf_dir), 3)


@query("graph_impact_paths", f"WITH {STEPS_SQL}, {_levels(2, URGENT)}, r AS ({_all_levels(2)}) SELECT here AS src, nxt AS dst, depth + 1 AS depth FROM steps JOIN r ON here = id WHERE depth < 2 AND NOT (back AND EXISTS (SELECT 1 FROM r AS o WHERE o.id = nxt AND o.depth = r.depth))")
def graph_impact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.impact_paths(e, graph.impact(e, _urgent(spark, sf_dir), 2), 2).select("src", "dst", "depth")


BOTH_SQL = "e AS (SELECT 'n' || n_nationkey AS src, 'c' || c_custkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), steps AS (SELECT src AS here, dst AS nxt FROM e UNION ALL SELECT dst, src FROM e)"


@query("graph_neighborhood", f"WITH {BOTH_SQL}, {_levels(2, chr(39) + 'n3' + chr(39) + ' AS id')} {_all_levels(2)}")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    pair = lambda a, x, b, y: (F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    e = c.join(n, c.c_nationkey == n.n_nationkey).select(*pair("n", "n_nationkey", "c", "c_custkey")).union(o.select(*pair("c", "o_custkey", "o", "o_orderkey")))
    return graph.neighborhood(e, ids(spark, "n3"), 2)


@query("graph_kind_counts", f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM ({EDGES_SQL} UNION ALL {TOPIC_SQL}) AS e GROUP BY kind")
def graph_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kind_counts(edges(spark, sf_dir).unionByName(topics(spark, sf_dir)))


_FULL = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


@query("edge_last_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(x + ' DESC' for x in _FULL.split(', '))}) AS p FROM lineitem) AS x WHERE p = 1")
def edge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.last_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(x) for x in _FULL.split(", ")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("node_first_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_FULL}) AS p FROM lineitem) AS x WHERE p = 1")
def node_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(x) for x in _FULL.split(", ")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("graph_path_rows", f"SELECT e.kind, e.src, e.dst, c.c_name || ' defines ' || o.o_orderpriority AS reason FROM ({DEFINES_SQL}) AS e JOIN customer AS c ON e.src = 'file:' || c.c_custkey JOIN orders AS o ON e.dst = 'symbol:' || o.o_orderkey")
def graph_path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("file:"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    symbols = table(spark, sf_dir, "orders").select(F.concat(F.lit("symbol:"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    return graph.path_rows(defines(spark, sf_dir), files.union(symbols)).select("kind", "src", "dst", "reason")


@query("graph_definition_closure", f"""WITH d AS (SELECT 'file:' || o_custkey AS src, 'symbol:' || o_orderkey AS dst, o_orderkey AS ord, o_orderstatus AS s FROM orders),
f AS (SELECT src, min(ord) AS first FROM d WHERE s = 'P' GROUP BY src) SELECT d.src, d.dst, d.ord FROM d JOIN f ON d.src = f.src WHERE d.ord >= f.first""")
def graph_definition_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    e = o.select(F.lit("DEFINES").alias("kind"), F.concat(F.lit("file:"), "o_custkey").alias("src"), F.concat(F.lit("symbol:"), "o_orderkey").alias("dst"), F.col("o_orderkey").alias("ord"))
    wanted = o.filter("o_orderstatus = 'P'").select(F.concat(F.lit("symbol:"), "o_orderkey").alias("id"))
    return graph.definition_closure(e, wanted).select("src", "dst", "ord")




@query("node_ids", """SELECT page_id, 'file:' || replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F') AS id FROM pages WHERE regexp_matches(url, '^[A-Za-z0-9_.~:/?-]*$')""")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.text import percent_encoded

    p = table(spark, sf_dir, "pages").filter(F.col("url").rlike(r"^[A-Za-z0-9_.~:/?-]*\z"))
    return p.select("page_id", F.concat(F.lit("file:"), percent_encoded(F.col("url"))).alias("id"))


@query("node_ids_all", """SELECT page_id, 'file:' || url_encode(url) AS id FROM pages""")
def node_ids_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As node_ids, for every page."""
    from tessella.functions.text import percent_encoded

    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("file:"), percent_encoded(F.col("url"))).alias("id"))
