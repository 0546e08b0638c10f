"""Sinks: logs, pages, manifests, envelopes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import build


def append_log(rows: DataFrame, path: str) -> None:
    """Adds the rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def pages(items: DataFrame, group: str, order: list[str], line: str) -> DataFrame:
    """name, content, digest: one page a group, its lines in order. A page is one row."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line)))
    content = F.array_join(F.transform(listed, lambda x: x[line]), "\n")
    return items.groupBy(F.col(group).alias("name")).agg(content.alias("content")).withColumn("digest", t.digest(F.col("content")))


def manifest_digest(made: DataFrame) -> str:
    """One digest of all pages' names and digests, however they are dealt to partitions."""
    return build.table_digest(made, ["name", "digest"])


def freshness(expected: DataFrame, present: DataFrame) -> DataFrame:
    """name, state of pages: missing, stale, current or left over."""
    a, b = expected.select("name", F.col("digest").alias("e")), present.select("name", F.col("digest").alias("p"))
    state = F.when(F.col("p").isNull(), "missing").when(F.col("e").isNull(), "left_over").when(F.col("e") == F.col("p"), "current").otherwise("stale")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def broken_links(made: DataFrame) -> DataFrame:
    """name, target of links to pages that aren't there."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\]\(([^)#\s]+\.md)(?:#[^)]*)?\)"), 1)))
    return made.select("name", target.alias("target")).join(made.select(F.col("name").alias("target")), "target", "left_anti")


def envelope(command: str, data: list[Row], problems: list[Row]) -> str:
    """The JSON answer of a command: ok where no problem is an error."""
    found = [p.asDict() for p in problems]
    errors = [p for p in found if p.get("severity") == "error"]
    return json.dumps({"ok": not errors, "command": command, "data": [r.asDict(True) for r in data], "problems": found}, sort_keys=True, ensure_ascii=False, default=str)
