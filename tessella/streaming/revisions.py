"""Artifact revisions and the candidate queue of workflows, with keyed state: which artifact has which revision, what comes next.

A workflow works on one candidate at a time. A recorded artifact gets the revision after the last one of its path, if it is
the active candidate's; others are refused. When a candidate passes, the next in the queue becomes active and the artifacts
start anew; without a next one the workflow is decided, and everything after is refused. State is kept in a map of paths, a list
as queue and two values, so that an event touches what it needs and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FIRST = "first"
KINDS = ("artifact", "queue", "pass")
RESULT = "seq long, kind string, candidate string, path string, revision int, outcome string"


class Revisions(StatefulProcessor):
    """Events (key, seq, kind, candidate: null for the active one, path) to one row each, in order of ``seq`` within a batch."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revisions = handle.getMapState("revisions", "path string", "revision int")
        self.queue = handle.getListState("queue", "candidate string")
        self.active = handle.getValueState("active", "candidate string")
        self.decided = handle.getValueState("decided", "yes boolean")

    def _next(self) -> str | None:
        waiting = [x[0] for x in self.queue.get()]
        if waiting:
            self.queue.put([(x,) for x in waiting[1:]]) if len(waiting) > 1 else self.queue.clear()
            self.active.update((waiting[0],))
            self.revisions.clear()
            return waiting[0]
        self.decided.update((True,))
        return None

    def _told(self, kind: str, candidate: str | None, path: str | None) -> tuple[str | None, int | None, str]:
        """candidate, revision, outcome of one event."""
        active = self.active.get()[0] if self.active.exists() else FIRST
        if self.decided.exists():
            return active, None, "refused_decided"
        if kind == "queue":
            self.queue.appendValue((candidate,))
            return candidate, None, "queued"
        if kind == "pass":
            return active, None, "continued" if self._next() else "decided"
        if candidate is not None and candidate != active:
            return active, None, "refused_candidate"
        revision = 1 + (self.revisions.getValue((path,))[0] if self.revisions.containsKey((path,)) else 0)
        self.revisions.updateValue((path,), (revision,))
        return active, revision, "recorded"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # one key's rows of one micro-batch, which the source bounds
        batch = pd.concat(list(rows)).sort_values("seq")
        given = lambda x: None if x is None or x != x else x
        told = [(seq, kind, *self._told(kind, given(candidate), given(path)), given(path)) for seq, kind, candidate, path in zip(batch["seq"], batch["kind"], batch["candidate"], batch["path"], strict=True)]
        seqs, kinds, candidates, revisions, outcomes, paths = zip(*told, strict=True)
        yield pd.DataFrame({self.key: [key[0]] * len(told), "seq": seqs, "kind": kinds, "candidate": candidates, "path": paths, "revision": pd.array(revisions, "Int32"), "outcome": outcomes})

    def close(self) -> None:
        pass


def revisions(events: DataFrame, key: str) -> DataFrame:
    """key and ``RESULT`` for a stream of events (key, seq, kind, candidate, path)."""
    kind = dict(events.dtypes)[key]
    rows = events.select(key, "seq", "kind", "candidate", "path")
    return rows.groupBy(key).transformWithStateInPandas(Revisions(key), f"{key} {kind}, {RESULT}", "append", "None")


def run(events: DataFrame, key: str, out: str, marks: str) -> DataFrame:
    """Runs the stream over all there is now; goes on from the checkpoint ``marks``. Rows so far, from the folder ``out``.

    Batches are written by number, so a repeated batch replaces itself.
    """
    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        for k, v in STORE.items():  # several states a key need this store
            spark.conf.set(k, v)
        query = revisions(events, key).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(out).drop("batch")
