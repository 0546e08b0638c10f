"""State of boards, changes, plans: differences of sets, validators that emit problem rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM = ["severity", "code", "message", "path"]


def problems(rows: DataFrame, rules: list[tuple[str, str, Column, Column]], path: Column) -> DataFrame:
    """severity, code, message, path for each rule (severity, code, test, message) that a row breaks. One pass."""
    found = [F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), m.alias("message"), path.alias("path"))) for s, c, test, m in rules]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("p")).select("p.*")


def all_problems(*frames: DataFrame) -> DataFrame:
    """Problems of all validators, each (code, path, message) once."""
    return reduce(DataFrame.unionByName, [f.select(*PROBLEM) for f in frames]).dropDuplicates(["code", "path", "message"])


def board_difference(board: DataFrame, live: DataFrame, files: DataFrame) -> DataFrame:
    """path, code: board lines without file, live tasks not on the board, lines whose task isn't live."""
    code = lambda frame, name: frame.select("path", F.lit(name).alias("code"))
    there = board.join(files, "path", "left_semi")
    return code(board.join(files, "path", "left_anti"), "board_file_missing").union(code(live.join(board, "path", "left_anti"), "live_task_missing")).union(code(there.join(live, "path", "left_anti"), "board_task_not_live"))


def change_delta(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Changes of ``now`` (key, fingerprint) since ``before``: new, conflict where the fingerprint differs or is missing, same."""
    old = before.select(*key, F.col("fingerprint").alias("old"), F.lit(True).alias("was"))
    same = (F.col("fingerprint") == F.col("old")) & F.col("fingerprint").isNotNull()
    state = F.when(F.col("was").isNull(), "new").when(F.coalesce(same, F.lit(False)), "same").otherwise("conflict")
    return now.join(old, key, "left").withColumn("state", state).drop("old", "was")


def plan_difference(wanted: DataFrame, present: DataFrame, installed: DataFrame) -> DataFrame:
    """path, action from digests of what is wanted, present and was installed before.

    create: wanted, absent. skip: equal. replace: as installed but no longer as wanted. remove: installed, as it was,
    not wanted. conflict: changed by hand.
    """
    side = lambda f, n: f.select("path", F.col("digest").alias(n))
    all_ = side(wanted, "w").join(side(present, "p"), "path", "full_outer").join(side(installed, "i"), "path", "full_outer")
    w, p, i = F.col("w"), F.col("p"), F.col("i")
    action = (
        F.when(w.isNotNull() & p.isNull(), "create").when(w.isNotNull() & (w == p), "skip").when(w.isNotNull() & p.eqNullSafe(i), "replace")
        .when(w.isNotNull(), "conflict").when(p.isNotNull() & p.eqNullSafe(i), "remove").when(p.isNotNull() & i.isNotNull(), "conflict").otherwise("keep")
    )
    return all_.select("path", action.alias("action"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose key isn't known."""
    return rows.join(known, key, "left_anti")


def profile(parts: DataFrame, key: str, critical: Column, standard: Column, prose: Column) -> DataFrame:
    """critical where any part is, else standard where any is, else prose where all are, else mixed."""
    found = F.when(F.bool_or(critical), "critical").when(F.bool_or(standard), "standard").when(F.bool_and(prose), "prose").otherwise("mixed")
    return parts.groupBy(key).agg(found.alias("profile"))


def parents_without_live_children(tasks: DataFrame) -> DataFrame:
    """Live parents (id) none of whose children (parent) is live."""
    children = tasks.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count_if("live").alias("n"))
    return tasks.filter("live").join(children.filter("n = 0"), "id").select("id")
