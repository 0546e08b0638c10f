"""The workflow event log as a stream: running state of every workflow, and its phase machine.

State is one row a workflow: the latest event, the furthest phase, the number of events. Late events change
the count and maybe the phase, never the latest event, which goes by the event's own number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.sources.shared import fresh_path


def running_state(events: DataFrame, key: str, seq: str, kind: str, order: list[str]) -> DataFrame:
    """key, latest, phase, n of a batch or stream of events."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    found = events.groupBy(key).agg(F.max_by(kind, seq).alias("latest"), F.max(place).alias("p"), F.count(F.lit(1)).alias("n"))
    phase = F.when(F.col("p") > 0, F.element_at(F.array(*map(F.lit, order)), F.greatest(F.col("p"), F.lit(1)).cast("int")))
    return found.select(key, "latest", phase.alias("phase"), "n")


def phase_machine(events: DataFrame, key: str, seq: str, kind: str, allowed: dict[str, list[str]], start: str) -> DataFrame:
    """key, phase, refused of a stream: an event moves the phase where ``allowed`` lets it, else counts as refused.

    Events of one micro-batch go in order of ``seq``.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, refused = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values(seq)
        for to in rows[kind]:
            if to in allowed.get(phase, []):
                phase = to
            else:
                refused += 1
        state.update((phase, refused))
        yield pd.DataFrame({key: [keys[0]], "phase": [phase], "refused": [refused]})

    kinds = dict(events.dtypes)
    return events.select(key, seq, kind).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, phase string, refused long", "phase string, refused long", "update", GroupStateTimeout.NoTimeout)


def final(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Runs a stream over all there is now; the last row of each key. Batches are written to the shared folder by number,
    so a repeated batch replaces itself."""
    out, marks = fresh_path(spark, "stream"), fresh_path(spark, "stream-marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])
