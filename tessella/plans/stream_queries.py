"""Streaming queries: the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.registry import query, table
from tessella.sources.shared import fresh_path
from tessella.streaming import revisions, trace

ORDER = ["view", "click", "signup", "purchase", "error"]
_PLACES = "(VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(ORDER)) + ") AS o(event_type, place)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("trace_stream_state", f"SELECT user_id, arg_max(e.event_type, event_id) AS latest, arg_max(e.event_type, place) AS phase, CAST(count(*) AS BIGINT) AS n FROM events AS e JOIN {_PLACES} ON e.event_type = o.event_type GROUP BY user_id")
def trace_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.final(spark, trace.running_state(stream(spark, sf_dir), "user_id", "event_id", "event_type", ORDER), "complete", ["user_id"])


@query("trace_phase_machine")
def trace_phase_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = {"idle": ["signup"], "signup": ["view", "click"], "view": ["click", "purchase"], "click": ["view", "purchase"], "purchase": ["view"]}
    return trace.final(spark, trace.phase_machine(stream(spark, sf_dir), "user_id", "event_id", "event_type", allowed, "idle"), "update", ["user_id"])


#: What an event of the log is to the artifacts of its user's workflow.
RECORDS = {"click": ("artifact", "plan.md"), "view": ("artifact", "notes.md"), "error": ("artifact", "plan.md"), "purchase": ("pass", None), "signup": ("queue", None)}


@query("artifact_revisions", """WITH x AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'queue' ELSE 'artifact' END AS kind, event_type = 'error' AS other, CASE event_type WHEN 'view' THEN 'notes.md' WHEN 'click' THEN 'plan.md' WHEN 'error' THEN 'plan.md' END AS path FROM events),
s AS (SELECT *, sum(CASE kind WHEN 'queue' THEN 1 WHEN 'pass' THEN -1 ELSE 0 END) OVER w AS level FROM x WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, coalesce(min(level) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) < 0 AS over, min(level) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0 AS before_over FROM s),
e AS (SELECT *, coalesce(before_over, FALSE) AS was_over, coalesce(sum(CASE WHEN kind = 'pass' AND NOT over THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM d),
q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS epoch, 'c' || seq AS candidate FROM x WHERE kind = 'queue'),
a AS (SELECT e.*, coalesce(q.candidate, 'first') AS active FROM e LEFT JOIN q ON q.user_id = e.user_id AND q.epoch = e.epoch)
SELECT user_id, seq, kind, CASE WHEN kind = 'queue' AND NOT was_over THEN 'c' || seq ELSE active END AS candidate, path,
CAST(CASE WHEN kind = 'artifact' AND NOT other AND NOT was_over THEN row_number() OVER (PARTITION BY user_id, epoch, path, kind = 'artifact' AND NOT other AND NOT was_over ORDER BY seq) ELSE 0 END AS INTEGER) AS revision,
CASE WHEN was_over THEN 'refused_decided' WHEN kind = 'queue' THEN 'queued' WHEN kind = 'pass' THEN CASE WHEN over THEN 'decided' ELSE 'continued' END WHEN other THEN 'refused_candidate' ELSE 'recorded' END AS outcome FROM a""")
def artifact_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision is 0 where an event records none."""
    kind = F.col("event_type")
    of = lambda i: F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in RECORDS.items()])
    candidate = F.when(kind == "signup", F.concat(F.lit("c"), "event_id")).when(kind == "error", "other")
    events = stream(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), of(0).alias("kind"), candidate.alias("candidate"), of(1).alias("path"))
    found = revisions.run(events, "user_id", fresh_path(spark, "revisions"), fresh_path(spark, "revision-marks"))
    return found.withColumn("revision", F.coalesce("revision", F.lit(0)))
