"""Lifecycle of records: status from append-only events, relations, integrity, drift, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded_status(events: DataFrame, key: str) -> DataFrame:
    """key, status: approved beats rejected beats refreshed, in any order of events; pending without these."""
    has = lambda kind: F.bool_or(F.col("type") == kind)
    status = F.when(has("approved"), "approved").when(has("rejected"), "rejected").when(has("refreshed"), "refreshed").otherwise("pending")
    return events.groupBy(key).agg(status.alias("status"))


def status_for_query(superseded: Column, deprecated: Column, stale: Column, stored: Column) -> Column:
    return F.when(superseded, "superseded").when(deprecated, "deprecated").when(stale, "stale").otherwise(stored)


def status_for_page(superseded: Column, deprecated: Column, stale: Column, stored: Column) -> Column:
    """As for queries, but staleness comes first."""
    return F.when(stale, "stale").when(superseded, "superseded").when(deprecated, "deprecated").otherwise(stored)


def chosen(events: DataFrame, kind: str | None = None, record: int | None = None, candidate: int | None = None) -> DataFrame:
    """Events of a type, record and candidate, each where given."""
    for column, value in (("type", kind), ("record_id", record), ("candidate_id", candidate)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events


def relations(records: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Each record with how many events of each kind name it, and the first and last of them (-1: none)."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    named = events.groupBy(key).agg(n("superseded").alias("superseded"), n("deprecated").alias("deprecated"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    filled = [F.coalesce(c, F.lit(none).cast("long")).alias(c) for c, none in (("superseded", 0), ("deprecated", 0), ("first_event", -1), ("last_event", -1))]
    return records.join(named, key, "left").select(key, *filled)


def integrity(events: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Problems of events: their record is missing, or its digest isn't the one they name."""
    known = records.select(key, F.col("digest").alias("its_digest"), F.lit(True).alias("there"))
    code = F.when(F.col("there").isNull(), "event_record_missing").when(~F.col("digest").eqNullSafe(F.col("its_digest")), "event_digest_mismatch")
    return events.join(known, key, "left").withColumn("code", code).filter("code is not null").drop("there", "its_digest")


def drift(refs: DataFrame, now: DataFrame) -> DataFrame:
    """``refs`` (path, digest, ...) with status: missing, drift or current."""
    here = now.select("path", F.col("digest").alias("now_digest"))
    status = F.when(F.col("now_digest").isNull(), "missing").when(F.col("now_digest") == F.col("digest"), "current").otherwise("drift")
    return refs.join(here, "path", "left").withColumn("status", status).drop("now_digest")


def same_claim(records: DataFrame, group: str, claim: Column) -> DataFrame:
    """group, claim digest, records, first record: claims that more than one record of a group makes."""
    key = F.md5(F.lower(F.trim(claim)))
    found = records.groupBy(group, key.alias("claim")).agg(F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"))
    return found.filter("records > 1")


def latest(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def still_open(events: DataFrame, key: str, seq: str, kind: str, opens: list[str], closes: list[str]) -> DataFrame:
    """Whether the last of a key's opening and closing events opens."""
    told = events.filter(F.col(kind).isin(opens + closes))
    return told.groupBy(key).agg(F.max_by(F.col(kind).isin(opens), F.col(seq)).alias("open"))


def span_seconds(events: DataFrame, key: str, at: str) -> DataFrame:
    """Seconds from a key's first to its last event; 0 for fewer than two."""
    return events.groupBy(key).agg((F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))).alias("__us")).select(key, F.floor(F.col("__us") / 1_000_000).alias("seconds"))


def usage(events: DataFrame, keys: list[str], limits: DataFrame, by: str) -> DataFrame:
    """Counts by keys against ``limits`` (by, most); without a limit (-1) never over."""
    n = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"))
    return n.join(F.broadcast(limits), by, "left").withColumn("over", F.coalesce(F.col("used") > F.col("most"), F.lit(False))).withColumn("most", F.coalesce("most", F.lit(-1).cast("long")))


def blockers(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order, joined by commas."""
    return F.concat_ws(",", *[F.when(holds, F.lit(name)) for name, holds in rules])


def first_missing(done: Column, route: list[str]) -> Column:
    """The first stage of a route that the array ``done`` lacks; null at the end."""
    return F.coalesce(*[F.when(~F.array_contains(done, stage), stage) for stage in route])


def furthest(rows: DataFrame, key: str, stage: Column, order: list[str]) -> DataFrame:
    """The stage of highest order that a key has reached."""
    place = F.array_position(F.array(*map(F.lit, order)), stage)
    return rows.groupBy(key).agg(F.max(place).alias("p")).select(key, F.element_at(F.array(*map(F.lit, order)), F.col("p").cast("int")).alias("stage"))
