"""Artifact revisions by keyed state: the rules, a restart in the middle, and equal results however the events arrive."""

import pytest
from pyspark.sql import functions as F

from tessella.streaming import revisions

SCHEMA = "wf long, seq long, kind string, candidate string, path string"
EVENTS = [
    (1, 1, "artifact", None, "plan.md"), (1, 2, "artifact", "first", "plan.md"), (1, 3, "queue", "c2", None), (1, 4, "artifact", "c2", "plan.md"), (1, 5, "queue", "c3", None), (1, 6, "pass", None, None),
    (1, 7, "artifact", "c2", "plan.md"), (1, 8, "artifact", "first", "plan.md"), (1, 9, "pass", None, None), (1, 10, "artifact", None, "notes.md"), (1, 11, "pass", None, None), (1, 12, "artifact", None, "notes.md"),
    (2, 1, "pass", None, None), (2, 2, "queue", "x", None), (3, 1, "artifact", None, None),
]
EXPECTED = {
    (1, 1): ("first", 1, "recorded"), (1, 2): ("first", 2, "recorded"), (1, 3): ("c2", None, "queued"), (1, 4): ("first", None, "refused_candidate"), (1, 5): ("c3", None, "queued"), (1, 6): ("first", None, "continued"),
    (1, 7): ("c2", 1, "recorded"), (1, 8): ("c2", None, "refused_candidate"), (1, 9): ("c2", None, "continued"), (1, 10): ("c3", 1, "recorded"), (1, 11): ("c3", None, "decided"), (1, 12): ("c3", None, "refused_decided"),
    (2, 1): ("first", None, "decided"), (2, 2): ("first", None, "refused_decided"), (3, 1): ("first", 1, "recorded"),
}


def got(frame):
    rows = frame.collect()
    found = {(r["wf"], r["seq"]): (r["candidate"], r["revision"], r["outcome"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("cut", [15, 7])
def test_restart_in_the_middle(spark, tmp_path, cut):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    events.filter(F.col("seq") <= cut).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    first = got(revisions.run(stream(), "wf", str(tmp_path / "out"), str(tmp_path / "marks")))
    assert first == {k: v for k, v in EXPECTED.items() if k[1] <= cut}
    if cut < 15:
        events.filter(F.col("seq") > cut).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert got(revisions.run(stream(), "wf", str(tmp_path / "out"), str(tmp_path / "marks"))) == EXPECTED
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
