"""Lifecycle queries over events (one user is a record, its events the log), customers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import lifecycle
from tessella.registry import query, table

#: What the driver's event types stand for.
TYPES = {"signup": "approved", "error": "rejected", "view": "refreshed", "purchase": "superseded", "click": "deprecated"}
_TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " END"
LOG_SQL = f"log AS (SELECT event_id, ts, user_id AS record_id, {_TYPE_SQL} AS type, value FROM events)"
FOLD_SQL = f"{LOG_SQL}, f AS (SELECT record_id, CASE WHEN bool_or(type = 'approved') THEN 'approved' WHEN bool_or(type = 'rejected') THEN 'rejected' WHEN bool_or(type = 'refreshed') THEN 'refreshed' ELSE 'pending' END AS status FROM log GROUP BY record_id)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in TYPES.items()])
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("record_id"), kind.alias("type"), "value")


@query("status_fold", f"WITH {FOLD_SQL} SELECT record_id, status FROM f")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.folded_status(log(spark, sf_dir), "record_id")


@query("status_counts", f"WITH {FOLD_SQL} SELECT status, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.folded_status(log(spark, sf_dir), "record_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


DERIVED_SQL = f"{LOG_SQL}, d AS (SELECT record_id, bool_or(type = 'superseded') AS a, bool_or(type = 'deprecated') AS b, avg(value) > 60 AS c FROM log GROUP BY record_id)"


@query("derived_status", f"""WITH {DERIVED_SQL} SELECT record_id, CASE WHEN a THEN 'superseded' WHEN b THEN 'deprecated' WHEN coalesce(c, FALSE) THEN 'stale' ELSE 'stored' END AS for_query,
CASE WHEN coalesce(c, FALSE) THEN 'stale' WHEN a THEN 'superseded' WHEN b THEN 'deprecated' ELSE 'stored' END AS for_page FROM d""")
def derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("type") == kind)
    d = log(spark, sf_dir).groupBy("record_id").agg(has("superseded").alias("a"), has("deprecated").alias("b"), (F.avg("value") > 60).alias("c"))
    flags = (F.col("a"), F.col("b"), F.col("c"), F.lit("stored"))
    return d.select("record_id", lifecycle.status_for_query(*flags).alias("for_query"), lifecycle.status_for_page(*flags).alias("for_page"))


@query("event_filters", f"WITH {LOG_SQL} SELECT event_id, record_id, value FROM log WHERE type = 'approved'")
def event_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.chosen(log(spark, sf_dir), "approved").select("event_id", "record_id", "value")


@query("lifecycle_relations", f"""WITH {LOG_SQL} SELECT c_custkey AS record_id, CAST(count(*) FILTER (WHERE type = 'superseded') AS BIGINT) AS superseded, CAST(count(*) FILTER (WHERE type = 'deprecated') AS BIGINT) AS deprecated,
coalesce(min(event_id), -1) AS first_event, coalesce(max(event_id), -1) AS last_event FROM customer LEFT JOIN log ON c_custkey = record_id GROUP BY c_custkey""")
def lifecycle_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"))
    return lifecycle.relations(records, log(spark, sf_dir), "record_id")


@query("event_integrity", f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'event_record_missing' ELSE 'event_digest_mismatch' END AS code
FROM log LEFT JOIN customer ON c_custkey = record_id WHERE c_custkey IS NULL OR c_nationkey % 5 <> event_id % 5""")
def event_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), (F.col("c_nationkey") % 5).cast("long").alias("digest"))
    return lifecycle.integrity(log(spark, sf_dir).withColumn("digest", F.col("event_id") % 5), records, "record_id").select("event_id", "code")


@query("same_claim", "SELECT source, md5(lower(trim(text))) AS claim, CAST(count(*) AS BIGINT) AS records, min(doc_id) AS first_id FROM documents GROUP BY source, md5(lower(trim(text))) HAVING count(*) > 1")
def same_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.same_claim(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "source", F.col("text"))


@query("still_open", "SELECT user_id, arg_max(event_type = 'signup', event_id) AS open FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id")
def still_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.still_open(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["signup"], ["purchase", "error"])


@query("wall_clock", "SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS seconds FROM events GROUP BY user_id")
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.span_seconds(table(spark, sf_dir, "events"), "user_id", "ts")


@query("budget_usage", """SELECT user_id, e.event_type, CAST(count(*) AS BIGINT) AS used, coalesce(most, -1) AS most, coalesce(count(*) > most, FALSE) AS over FROM events AS e
LEFT JOIN (VALUES ('click', 3::BIGINT), ('view', 5), ('error', 0)) AS l(event_type, most) ON e.event_type = l.event_type GROUP BY user_id, e.event_type, most""")
def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("click", 3), ("view", 5), ("error", 0)], "event_type string, most long")
    return lifecycle.usage(table(spark, sf_dir, "events"), ["user_id", "event_type"], limits, "event_type")


SEEN_SQL = "s AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY user_id)"


@query("pass_eligibility", f"WITH {SEEN_SQL} SELECT user_id, concat_ws(',', CASE WHEN NOT v THEN 'no_view' END, CASE WHEN NOT s THEN 'no_signup' END, CASE WHEN e > 1 THEN 'errors' END) AS blockers FROM s")
def pass_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(has("view").alias("v"), has("signup").alias("s"), F.count_if(F.col("event_type") == "error").alias("e"))
    return s.select("user_id", lifecycle.blockers([("no_view", ~F.col("v")), ("no_signup", ~F.col("s")), ("errors", F.col("e") > 1)]).alias("blockers"))


ORDER = ["error", "purchase", "signup", "click", "view"]
_ORDER_SQL = "(VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(ORDER)) + ") AS o(event_type, place)"


@query("decision_precedence", f"SELECT user_id, arg_min(e.event_type, place) AS decision FROM events AS e JOIN {_ORDER_SQL} ON e.event_type = o.event_type GROUP BY user_id")
def decision_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([(x, i) for i, x in enumerate(ORDER)], "event_type string, place int")
    return table(spark, sf_dir, "events").join(F.broadcast(places), "event_type").groupBy("user_id").agg(F.min_by("event_type", "place").alias("decision"))


@query("route_cursor", f"WITH {SEEN_SQL} SELECT user_id, CASE WHEN NOT v THEN 'view' WHEN NOT c THEN 'click' WHEN NOT s THEN 'signup' WHEN NOT p THEN 'purchase' END AS next_stage FROM s")
def route_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    return done.select("user_id", lifecycle.first_missing(F.col("done"), ["view", "click", "signup", "purchase"]).alias("next_stage"))


@query("phase_reached", f"SELECT user_id, arg_max(e.event_type, -place) AS stage FROM events AS e JOIN {_ORDER_SQL} ON e.event_type = o.event_type GROUP BY user_id")
def phase_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.furthest(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), ORDER[::-1])


@query("artifact_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def artifact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


_MONO_SQL = "SELECT user_id, min(event_id) AS first_bad, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS before FROM events) AS x WHERE ts < before GROUP BY user_id"


@query("timestamp_monotonic", _MONO_SQL)
def timestamp_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    bad = table(spark, sf_dir, "events").withColumn("before", before).filter("ts < before")
    return bad.groupBy("user_id").agg(F.min("event_id").alias("first_bad"), F.count(F.lit(1)).alias("n"))
