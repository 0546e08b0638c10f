"""Nested values to any depth: JSON is read once into VARIANT, and walked level by level in the JVM.

A level explodes the containers that the one before left; it is written, so that each value is looked at once, and the walk ends
with the first level without containers. Text that is no JSON, and null, have no values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import kept

NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"

# Keys that a state may not hold at any depth, at its top, and those that it must have there.
FORBIDDEN = ["plan_body", "critic_findings", "implementation_summary_body", "evaluation_matrix", "failure_mode_replay_matrix", "skeptic_review_body", "transcript_body", "tool_event_body", "worker_output_body", "temp_path", "sidecar_path", "credential"]
FORBIDDEN_TOP = ["approval", "workers", "retry_target"]


def _kind(value: Column) -> Column:
    """object, array, number, truth, or other."""
    told = F.schema_of_variant(value)
    return F.when(F.startswith(told, F.lit("OBJECT")), "object").when(F.startswith(told, F.lit("ARRAY")), "array").when(told == "BOOLEAN", "truth").when(told.rlike(NUMBER), "number").otherwise("other")


def values(rows: DataFrame, key: str, json: str, into_arrays: bool = False) -> DataFrame:
    """key, depth, path (names of objects, joined by dots), name (null in arrays), kind, value: every value of every object.

    Arrays are values; what they hold comes only with ``into_arrays``, under the path of the array.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("value")).filter("value is not null")
    level = level.withColumn("kind", _kind(F.col("value")))
    inner, found, depth = ["object", "array"] if into_arrays else ["object"], [], 0
    open_ = level.filter(F.col("kind").isin(inner))
    while True:
        depth += 1
        # a container's names and values, beside where it stands
        held = open_.select(F.col("key").alias("held"), F.col("path").alias("above"), F.col("value").alias("container")).lateralJoin(spark.tvf.variant_explode(F.col("container").outer()))
        held = held.toDF("held", "above", "container", "at", "name", "value")
        name = F.col("name")
        path = F.when(name.isNull(), F.col("above")).when(F.col("above") == "", name).otherwise(F.concat_ws(".", "above", name))
        level = kept(held.select(F.col("held").alias("key"), F.lit(depth).alias("depth"), path.alias("path"), name.alias("name"), _kind(F.col("value")).alias("kind"), "value"), "nested")
        found.append(level)
        open_ = level.filter(F.col("kind").isin(inner))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found).withColumnRenamed("key", key)


def flat_numbers(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, value: the numbers of nested objects, truth values as 1 and 0; of one path told twice the greatest."""
    found = values(rows, key, json).filter("kind in ('number', 'truth')")
    value = F.when(F.col("kind") == "truth", F.try_variant_get("value", "$", "boolean").cast("double")).otherwise(F.try_variant_get("value", "$", "double"))
    return found.select(key, "path", value.alias("value")).groupBy(key, "path").agg(F.max("value").alias("value"))


def number_deltas(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """key, path, baseline, candidate, delta of paths that both sides have."""
    a, b = (x.select(key, "path", F.col("value").alias(n)) for x, n in ((baseline, "baseline"), (candidate, "candidate")))
    six = lambda x: F.round(x, 6)
    return a.join(b, [key, "path"]).select(key, "path", six("baseline").alias("baseline"), six("candidate").alias("candidate"), six(F.col("candidate") - F.col("baseline")).alias("delta"))


def forbidden_keys(rows: DataFrame, key: str, json: str, names: list[str] = FORBIDDEN, top: list[str] = FORBIDDEN_TOP) -> DataFrame:
    """key, name, depth: keys no state may hold, at any depth, in arrays too, and those it may not have at its top."""
    found = values(rows, key, json, into_arrays=True)
    return found.filter(F.col("name").isin(names) | ((F.col("depth") == 1) & F.col("name").isin(top))).select(key, "name", "depth")


def missing_keys(rows: DataFrame, key: str, json: str, required: list[str]) -> DataFrame:
    """key, name: what a state must have at its top and hasn't; all of them where it is no object."""
    held = F.coalesce(F.json_object_keys(F.col(json)), F.array().cast("array<string>"))
    return rows.select(key, F.explode(F.array_except(F.array(*map(F.lit, required)), held)).alias("name"))
