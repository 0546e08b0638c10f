"""Queries of the code index and of reports: parts as indexed files, orders as symbols and candidates, events as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import index, reports
from tessella.plans.graph_queries import CALLS_SQL, calls
from tessella.registry import query, table

_FILES_SQL = """f AS (SELECT 'p/' || p_partkey AS path, CASE WHEN p_size < 10 THEN 'skipped' WHEN p_size > 45 THEN 'parse_error' ELSE 'ok' END AS parse_status,
CASE WHEN p_brand = 'Brand#2' THEN 'excluded' WHEN p_brand = 'Brand#3' THEN 'orphan_annotation' ELSE 'indexed' END AS classification, p_partkey FROM part)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") < 10, "skipped").when(F.col("p_size") > 45, "parse_error").otherwise("ok")
    kind = F.when(F.col("p_brand") == "Brand#2", "excluded").when(F.col("p_brand") == "Brand#3", "orphan_annotation").otherwise("indexed")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), "p_partkey").alias("path"), status.alias("parse_status"), kind.alias("classification"), "p_partkey")


@query("index_summary", f"""WITH {_FILES_SQL}, s AS (SELECT * FROM f ORDER BY path LIMIT 150), t AS (SELECT CAST(count(*) AS BIGINT) AS total FROM f)
SELECT total, CAST(count(*) AS BIGINT) AS returned, count(*) < total AS truncated, total - count(*) AS dropped_count, CAST(count(*) FILTER (WHERE parse_status = 'ok') AS BIGINT) AS ok,
CAST(count(*) FILTER (WHERE parse_status = 'skipped') AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE parse_status = 'parse_error') AS BIGINT) AS parse_error FROM t, s GROUP BY total""")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_summary(files(spark, sf_dir), 150)


@query("visible_files", f"WITH {_FILES_SQL} SELECT path FROM f WHERE classification NOT IN ('excluded', 'excluded_override', 'orphan_annotation', 'orphan_exclusion')")
def visible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.visible(files(spark, sf_dir)).select("path")


@query("index_metadata", f"""WITH {_FILES_SQL}, m AS (SELECT 'p/' || l_partkey AS path, max(l_quantity) AS facts FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT f.path, parse_status, facts FROM f LEFT JOIN m ON f.path = m.path""")
def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max("l_quantity").alias("facts"))
    noted = noted.select(F.concat(F.lit("p/"), "l_partkey").alias("path"), "facts")
    return index.with_metadata(files(spark, sf_dir), noted).select("path", "parse_status", "facts")


@query("annotation_payload", """SELECT 'o/' || o_orderkey AS path, o_orderstatus AS role, array_to_string(list_sort(list_distinct(list_filter([o_orderpriority, ' ', o_orderstatus, o_orderpriority], lambda x: trim(x) <> ''))), '|') AS topics FROM orders""")
def annotation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    noted = o.select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.col("o_orderstatus").alias("role"), F.array("o_orderpriority", F.lit(" "), "o_orderstatus", "o_orderpriority").alias("topics"), "o_totalprice")
    return index.annotation_payload(noted, ["role", "topics"]).withColumn("topics", F.array_join("topics", "|"))


@query("symbol_target_id", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'id' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 'ast:' || o_custkey WHEN o_orderkey % 4 = 2 THEN o_orderpriority || ':f' || o_orderkey ELSE '' END AS target FROM orders""")
def symbol_target_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = F.col("o_orderkey") % 4, F.lit(None).cast("string")
    name = F.concat(F.lit("f"), "o_orderkey")
    values = {
        "id": F.when(r == 0, F.concat(F.lit(" id"), "o_orderkey", F.lit("\t"))).otherwise("  "), "provider": F.when(r == 3, "ast").otherwise(F.when(r < 2, "ast")),
        "provider_symbol_id": F.when(r < 2, F.col("o_custkey").cast("string")), "path": F.when(r < 3, F.col("o_orderpriority")), "qualified_name": F.lit(""), "name": F.coalesce(name, s),
    }
    target = F.struct(*[v.alias(k) for k, v in values.items()]).alias("s")
    return table(spark, sf_dir, "orders").select("o_orderkey", target).select("o_orderkey", index.symbol_target(F.col("s")).alias("target"))


@query("call_symbol_edges", f"SELECT e.kind, e.src, e.dst, 'resolved' AS assertion, 'ast' AS source FROM ({CALLS_SQL}) AS e JOIN orders AS a ON e.src = 'symbol:' || a.o_orderkey JOIN orders AS b ON e.dst = 'symbol:' || b.o_orderkey WHERE a.o_orderstatus <> 'P' AND b.o_orderstatus <> 'P'")
def call_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("symbol:"), "o_orderkey")
    known = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(name.alias("symbol"), name.alias("id"))
    return index.call_edges(calls(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit("ast").alias("source")), known)


@query("resolution_edges", """WITH r AS (SELECT DISTINCT 'o' || l_orderkey AS importer, 'i' || l_suppkey AS import_ref, 'p' || l_partkey AS target FROM lineitem),
k AS (SELECT * FROM r WHERE importer IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P') AND target IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10) AND import_ref IN (SELECT 'i' || s_suppkey FROM supplier))
SELECT DISTINCT 'RESOLVES_TO' AS kind, import_ref AS src, target AS dst, 'resolved' AS assertion, 'x' AS source FROM k UNION ALL SELECT DISTINCT 'IMPORTS_FILE', importer, target, 'resolved', 'x' FROM k""")
def resolution_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), c)
    found = table(spark, sf_dir, "lineitem").select(name("o", "l_orderkey").alias("importer"), name("i", "l_suppkey").alias("import_ref"), name("p", "l_partkey").alias("target"), F.lit("x").alias("source"))
    o, p, s = (table(spark, sf_dir, t) for t in ("orders", "part", "supplier"))
    nodes = o.filter("o_orderstatus = 'P'").select(name("o", "o_orderkey").alias("id")).union(p.filter("p_size > 10").select(name("p", "p_partkey"))).union(s.select(name("i", "s_suppkey")))
    return index.ordered_edges(index.resolution_edges(found, nodes))


_PROBLEMS_SQL = "q AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN o_orderstatus = 'O' THEN 'knowledge_event_missing' ELSE 'knowledge_source_drift' END AS code FROM orders WHERE o_orderpriority < '4')"


def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_totalprice") > 200000, "error").otherwise("warning")
    code = F.when(F.col("o_orderstatus") == "O", "knowledge_event_missing").otherwise("knowledge_source_drift")
    return table(spark, sf_dir, "orders").filter("o_orderpriority < '4'").select(F.col("o_orderkey").alias("id"), severity.alias("severity"), code.alias("code"))


_PART_SQL = "SELECT '{}' AS part, CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS error_count, CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warning_count FROM q WHERE {} starts_with(code, 'knowledge_event_')"


@query("record_checks", f"WITH {_PROBLEMS_SQL} {_PART_SQL.format('record_checks', 'NOT')} UNION ALL {_PART_SQL.format('event_checks', '')}")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.record_checks(problem_rows(spark, sf_dir))


@query("candidate_totals", f"""WITH {_PROBLEMS_SQL} SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS candidate_count, CAST(count(DISTINCT o_orderkey) - count(DISTINCT CASE WHEN severity = 'error' THEN id END) AS BIGINT) AS passed_count,
CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS error_count, CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warning_count FROM orders LEFT JOIN q ON o_orderkey = id""")
def candidate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.candidate_totals(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), problem_rows(spark, sf_dir))


@query("all_and_sum", "SELECT l_suppkey, bool_and(l_discount < 0.095) AS cheap, bool_and(l_tax >= 0) AS taxed, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_suppkey")
def all_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") < 0.095).alias("cheap"), (F.col("l_tax") >= 0).alias("taxed"), F.col("l_linenumber").cast("long").alias("lines"))
    return reports.all_and_sum(rows, "l_suppkey", ["cheap", "taxed"], ["lines"])


@query("gate_totals", "SELECT CAST(count(*) AS BIGINT) AS gate_count, CAST(count(*) FILTER (WHERE p_size < 30) AS BIGINT) AS passed_count, CAST(count(*) FILTER (WHERE p_size >= 30) AS BIGINT) AS failed_count FROM part")
def gate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gate_totals(table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 30, True).alias("ok")))


_SUMS = "SELECT l_partkey, CAST(sum(l_linenumber) AS DOUBLE) / 7 AS v FROM lineitem WHERE l_returnflag = '{}' GROUP BY l_partkey"


@query("summary_deltas", f"SELECT b.l_partkey AS key, round(b.v, 6) AS baseline, round(c.v, 6) AS candidate, round(c.v - b.v, 6) AS delta FROM ({_SUMS.format('A')}) AS b JOIN ({_SUMS.format('R')}) AS c ON b.l_partkey = c.l_partkey")
def summary_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    side = lambda flag: x.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("key")).agg((F.sum("l_linenumber").cast("double") / 7).alias("value"))
    return reports.summary_deltas(side("A"), side("R"))


@query("change_summary", """WITH n AS (SELECT user_id, event_id, event_type || event_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, CAST(count(*) AS BIGINT) AS task_new, string_agg(path, '|' ORDER BY event_id) FILTER (WHERE n <= 5) AS task_new_files, count(*) > 5 AS task_new_files_truncated FROM n GROUP BY user_id""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", "event_id").alias("path"))
    return reports.change_summary(changes, "user_id", "event_id", 5).withColumn("task_new_files", F.array_join("task_new_files", "|"))


_WORKER_SQL = "l_discount < 0.08 AND l_linestatus = 'F' AND l_tax < 0.07 AND (l_linenumber % 3 = 0 OR l_linenumber % 3 = 1)"


@query("workers_ready", f"SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AND l_quantity > 10 AND l_linenumber % 3 = 0 AND {_WORKER_SQL} AS ready, {_WORKER_SQL} AND l_quantity > 5 AS ready_to_retry FROM lineitem")
def workers_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    third = F.col("l_linenumber") % 3
    rows = x.select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("required"), F.when(F.col("l_discount") < 0.08, True).alias("invoked"), F.when(F.col("l_quantity") > 5, "w").otherwise("").alias("worker"), F.lit("kind").alias("evidence_kind"),
        F.when(F.col("l_linestatus") == "F", "passed").alias("status"), F.when(F.col("l_tax") >= 0.07, F.array(F.lit("open"))).otherwise(F.array().cast("array<string>")).alias("blocking_findings"), F.when(third < 2, "a.json").alias("artifact_path"),
        F.when(third == 0, "00").alias("artifact_sha256"), F.lit("").alias("schema_version"), F.when(F.col("l_quantity") <= 10, " ").alias("evidence"), F.lit("done").alias("summary"), F.lit(True).alias("structured_evidence_valid"),
    )
    return rows.select("l_orderkey", "l_linenumber", reports.worker_ready().alias("ready"), reports.worker_ready_to_retry().alias("ready_to_retry"))


@query("missing_group_refs", "SELECT o_orderstatus AS kind, 'c/' || o_custkey AS path, o_orderpriority AS section FROM orders WHERE o_totalprice > 150000 AND (o_orderstatus, o_custkey, o_orderpriority) NOT IN (SELECT o_orderstatus, o_custkey, o_orderpriority FROM orders WHERE o_totalprice < 150000)")
def missing_group_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = lambda where: table(spark, sf_dir, "orders").filter(where).select(F.col("o_orderstatus").alias("kind"), F.concat(F.lit("c/"), "o_custkey").alias("path"), F.col("o_orderpriority").alias("section"))
    return reports.missing_refs(refs("o_totalprice > 150000"), refs("o_totalprice < 150000"))


@query("cleanup_entries", "SELECT event_type AS kind, 'u/' || user_id AS path, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def cleanup_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("u/"), "user_id").alias("path"), F.lit(None).cast("string").alias("content_sha256"), F.lit("").alias("stop_at"), "event_id")
    return reports.first_of_each(rows, ["kind", "path", "content_sha256", "stop_at"], ["event_id"]).select("kind", "path", "event_id")


@query("change_sources", """SELECT change, path, old_path, CAST(min(source) AS INTEGER) AS source FROM (SELECT o_orderstatus AS change, 'c/' || o_custkey AS path, '' AS old_path, 0 AS source FROM orders WHERE o_totalprice < 60000
UNION ALL SELECT o_orderstatus, 'c/' || o_custkey, '', 1 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'untracked', 'c/' || c_custkey, '', 2 FROM customer) AS x GROUP BY change, path, old_path""")
def change_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string").alias("old_path")
    some = lambda where: table(spark, sf_dir, "orders").filter(where).select(F.col("o_orderstatus").alias("change"), F.concat(F.lit("c/"), "o_custkey").alias("path"), none)
    new = table(spark, sf_dir, "customer").select(F.lit("untracked").alias("change"), F.concat(F.lit("c/"), "c_custkey").alias("path"), none)
    return reports.changes_once(some("o_totalprice < 60000"), some("o_orderpriority = '1-URGENT'"), new)


@query("score_parts", "SELECT event_id, event_type <> 'error' AS complete FROM events")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.when(F.col("event_type") == "error", "other").otherwise("authority")
    parts = F.create_map(*[x for k in [*map(F.lit, reports.SCORE_KEYS[:4]), fifth, F.lit("extra")] for x in (k, F.col("value"))])
    return table(spark, sf_dir, "events").select("event_id", reports.has_score_parts(parts).alias("complete"))


@query("implemented_files", "SELECT event_type || value::INTEGER AS path, min(event_id) AS first FROM events WHERE user_id = 8 AND event_type IN ('view', 'click') GROUP BY 1")
def implemented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    named = F.concat("event_type", F.round("value").cast("int"))
    kind = F.when(F.col("event_type").isin("view", "click", "error"), "implementation-allow").otherwise("other")
    own = F.when(F.col("event_type") == "error", F.concat(F.lit(reports.OWN_FILES), named))
    return reports.implemented_files(e.select(F.col("user_id").alias("workflow_id"), kind.alias("event"), own.alias("artifact_path"), named.alias("path"), F.col("event_id").alias("seq")), 8)


@query("seed_query", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority || chr(10) END || 'x' || chr(10) || o_orderstatus AS query FROM orders")
def seed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("\n "), "o_orderpriority", F.lit("\t")))
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.seed_query([title, F.lit(" \n"), F.lit("x\n"), F.lit(None).cast("string"), F.col("o_orderstatus")]).alias("query"))
