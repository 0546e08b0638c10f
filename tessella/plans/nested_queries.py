"""Nested values over the driver's events, each as a state of three levels with a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import nested
from tessella.registry import query, table

#: A state in JSON of an event's props ({p}), value ({v}), and a key by its type ({k}).
STATE = '{"outer": {p}, "list": [{p}, {"{k}": 1, "inner": {"temp_path": {v}}}], "deep": {"x": {"y": {v}, "t": true, "n": null, "s": "1"}}, "phase": 1, "{k}": "x"}'
KEYS = {"error": "credential", "click": "approval", "view": "phase"}
REQUIRED = ["schema_version", "phase", "outer", "fine"]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KEYS.items() if v != "phase"], F.lit("fine"))
    out = F.lit(STATE)
    for name, value in {"p": F.col("props"), "v": F.col("value").cast("string"), "k": key}.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    # a view's state is no JSON
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") == "view", F.concat(F.lit("{"), out)).otherwise(out).alias("state"))


_FLAT_SQL = """SELECT event_id, unnest(['outer.k', 'deep.x.y', 'deep.x.t', 'phase']) AS path, unnest([CAST(json_extract_string(props, '$.k') AS DOUBLE), value, 1.0, 1.0]) AS value FROM events WHERE event_type <> 'view'"""


@query("flatten_numeric", _FLAT_SQL)
def flatten_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_numbers(states(spark, sf_dir), "event_id", "state")


@query("flat_number_deltas", f"""WITH f AS ({_FLAT_SQL}) SELECT a.event_id, a.path, round(a.value, 6) AS baseline, round(b.value, 6) AS candidate, round(b.value - a.value, 6) AS delta FROM f AS a JOIN f AS b ON b.event_id = a.event_id + 1 AND b.path = a.path""")
def flat_number_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's numbers against the next one's."""
    flat = nested.flat_numbers(states(spark, sf_dir), "event_id", "state")
    return nested.number_deltas(flat, flat.withColumn("event_id", F.col("event_id") - 1), "event_id")


@query("forbidden_keys", """SELECT event_id, 'credential' AS name, CAST(unnest([1, 3]) AS INTEGER) AS depth FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'approval', 1 FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'temp_path', 4 FROM events WHERE event_type <> 'view'""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.forbidden_keys(states(spark, sf_dir), "event_id", "state")


@query("missing_state_keys", """SELECT event_id, unnest(CASE WHEN event_type = 'view' THEN ['schema_version', 'phase', 'outer', 'fine'] WHEN event_type IN ('error', 'click') THEN ['schema_version', 'fine'] ELSE ['schema_version'] END) AS name FROM events""")
def missing_state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.missing_keys(states(spark, sf_dir), "event_id", "state", REQUIRED)
