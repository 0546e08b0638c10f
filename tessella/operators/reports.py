"""What checks, gates and workers report: counts of problems, all and sum metrics, changes, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.index import first_given, nonblank, trimmed

#: Prefix of problem codes that belong to events; keys of a score's parts; where the harness keeps its own files.
EVENT_PREFIX = "knowledge_event_"
SCORE_KEYS = ["exact_claim", "exact_summary", "exact_source", "fts", "authority"]
OWN_FILES = "ops/agent-harness/"


def record_checks(problems: DataFrame) -> DataFrame:
    """part (record_checks, event_checks), error_count, warning_count of problems (severity, code); a row for each part."""
    of = lambda severity, event: F.count_if((F.col("severity") == severity) & (F.col("code").startswith(EVENT_PREFIX) == event))
    part = lambda name, event: F.struct(F.lit(name).alias("part"), of("error", event).alias("error_count"), of("warning", event).alias("warning_count"))
    return problems.agg(F.array(part("record_checks", False), part("event_checks", True)).alias("parts")).select(F.explode("parts").alias("p")).select("p.*")


def candidate_totals(candidates: DataFrame, problems: DataFrame) -> DataFrame:
    """candidate_count, passed_count (no error), error_count, warning_count over candidates (id) and their problems (id, severity)."""
    of = lambda severity: F.count_if(F.col("severity") == severity)
    told = problems.groupBy("id").agg(of("error").alias("errors"), of("warning").alias("warnings"))
    each = candidates.join(told, "id", "left").na.fill(0, ["errors", "warnings"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("errors") == 0).alias("passed_count"), total("errors").alias("error_count"), total("warnings").alias("warning_count"))


def all_and_sum(metrics: DataFrame, by: str, all_of: list[str], sum_of: list[str]) -> DataFrame:
    """Whether each of ``all_of`` holds in every row (null: it doesn't), and sums of ``sum_of``, by a key."""
    holds = [F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in all_of]
    return metrics.groupBy(by).agg(*holds, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sum_of])


def gate_totals(gates: DataFrame) -> DataFrame:
    """gate_count, passed_count, failed_count; a gate without a result has failed."""
    n, passed = F.count(F.lit(1)), F.count_if("ok")
    return gates.agg(n.alias("gate_count"), passed.alias("passed_count"), (n - passed).alias("failed_count"))


def summary_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """key, baseline, candidate, delta to six places, for keys (key, value) of both."""
    met = baseline.select("key", F.col("value").alias("b")).join(candidate.select("key", F.col("value").alias("c")), "key").filter("b is not null and c is not null")
    return met.select("key", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("candidate"), F.round(F.col("c") - F.col("b"), 6).alias("delta"))


def change_summary(changes: DataFrame, key: str, order: str, shown: int = 20) -> DataFrame:
    """key, task_new, the first ``shown`` paths in order, and whether there are more."""
    top = changes.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("n") <= shown)
    first = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("f"))
    count = changes.groupBy(key).agg(F.count(F.lit(1)).alias("task_new"))
    return count.join(first, key).select(key, "task_new", F.col("f.path").alias("task_new_files"), (F.col("task_new") > shown).alias("task_new_files_truncated"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def worker_ready() -> Column:
    """Whether a worker's row lets a workflow pass: required, invoked, named, passed without findings, with valid evidence."""
    blocking = F.exists("blocking_findings", lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(True)))
    stored = ((first_given(F.col("artifact_path")) != "") & (first_given(F.col("artifact_sha256")) != "")) | (first_given(F.col("schema_version")) != "")
    told = nonblank(first_given(F.col("evidence"), F.col("summary")))
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("required", "invoked", "structured_evidence_valid")]
    return _all(*flags, nonblank(F.col("worker")), nonblank(F.col("evidence_kind")), F.col("status").eqNullSafe("passed"), ~F.coalesce(blocking, F.lit(False)), stored, told)


def worker_ready_to_retry() -> Column:
    """As worker_ready(), but for retries: nothing need be required or told, and a path alone stores an artifact."""
    given = lambda c: first_given(F.col(c)) != ""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("invoked", "structured_evidence_valid")]
    return _all(*flags, given("worker"), given("evidence_kind"), F.col("status").eqNullSafe("passed"), F.coalesce(F.size("blocking_findings"), F.lit(0)) <= 0, given("artifact_path") | given("schema_version"))


def _all(*tests: Column) -> Column:
    return reduce(Column.__and__, tests)


def missing_refs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Refs (kind, path, section) of the baseline that the candidate lacks; null counts as empty."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("kind", "path", "section")]
    return baseline.select(*key).join(candidate.select(*key), ["kind", "path", "section"], "left_anti")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, in order, of each combination of keys; a null key counts as empty."""
    same = [F.coalesce(F.col(k), F.lit("")) for k in keys]
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[k.alias(f"__{i}") for i, k in enumerate(same)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def changes_once(*sources: DataFrame) -> DataFrame:
    """change, path, old_path from all sources, each once, with the number of the first source that has it; entries without path go."""
    told = [s.select("change", "path", F.coalesce("old_path", F.lit("")).alias("old_path"), F.lit(i).alias("source")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.union, told).filter(nonblank(F.col("path")))
    return every.groupBy("change", "path", "old_path").agg(F.min("source").alias("source"))


def has_score_parts(parts: Column) -> Column:
    """Whether a map of a score's parts holds all that a score has."""
    return F.size(F.array_except(F.array(*map(F.lit, SCORE_KEYS)), F.map_keys(parts))) == 0


def implemented_files(events: DataFrame, workflow: str | int) -> DataFrame:
    """path, first: what a workflow's implementation-allow events (workflow_id, event, artifact_path, path, seq) name, by the place they first do."""
    path = first_given(F.col("artifact_path"), F.col("path"))
    mine = events.filter((F.col("workflow_id") == workflow) & (F.col("event") == "implementation-allow")).select(path.alias("path"), "seq")
    return mine.filter((F.col("path") != "") & ~F.col("path").startswith(OWN_FILES)).groupBy("path").agg(F.min("seq").alias("first"))


def seed_query(parts: list[Column]) -> Column:
    """A task's title, area and sections as one text: blanks dropped, the rest trimmed, a line each."""
    return F.array_join(F.filter(F.array(*map(trimmed, parts)), lambda x: x != ""), "\n")
