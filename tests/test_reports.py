"""Index and report operators where the tables hold no such rows: nulls, empty frames, ties, white space."""

from pyspark.sql import functions as F

from tessella.operators import index, reports


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_summary_counts_what_is_returned(spark):
    f = spark.createDataFrame([("b", "ok"), ("a", "parse_error"), ("c", None)], "path string, parse_status string")
    assert rows(index.index_summary(f, 2)) == [(3, 2, True, 1, 1, 0, 1)]
    assert rows(index.index_summary(f, -1)) == [(3, 3, False, 0, 1, 0, 1)]
    assert rows(index.index_summary(f.limit(0), 2)) == [(0, 0, False, 0, 0, 0, 0)]


def test_visible_keeps_files_without_class(spark):
    f = spark.createDataFrame([("a", "excluded_override"), ("b", None), ("c", "indexed")], "path string, classification string")
    assert rows(index.visible(f).select("path")) == [("b",), ("c",)]


def test_symbol_target(spark):
    fields = "id string, provider string, provider_symbol_id string, path string, qualified_name string, name string"
    f = spark.createDataFrame([(" x\n", "p", "q", None, None, None), (None, "p", " q ", None, None, None), ("", "p", None, "a", "", "n"), (None,) * 6, ("", "", "", "a", "", "")], fields)
    found = [r[0] for r in f.select(index.symbol_target(F.struct("*"))).collect()]
    assert found == ["x", "p:q", "a:n", "", ""]


def test_edges_need_all_nodes_and_come_once(spark):
    nodes = spark.createDataFrame([("o",), ("i",), ("p",)], "id string")
    r = spark.createDataFrame([("o", "i", "p", "x")] * 2 + [("o", "i", None, "x"), ("o", "j", "p", "x")], "importer string, import_ref string, target string, source string")
    assert rows(index.resolution_edges(r, nodes)) == [("IMPORTS_FILE", "o", "p", "resolved", "x"), ("RESOLVES_TO", "i", "p", "resolved", "x")]
    c = spark.createDataFrame([("o", "i", "s"), ("o", "z", "s"), (None, "i", "s")], "caller string, callee string, source string")
    assert rows(index.call_edges(c, nodes.select(F.col("id").alias("symbol"), "id"))) == [("CALLS", "o", "i", "resolved", "s")]


def test_checks_of_nothing(spark):
    none = spark.createDataFrame([], "id long, severity string, code string")
    assert rows(reports.record_checks(none)) == [("event_checks", 0, 0), ("record_checks", 0, 0)]
    assert rows(reports.candidate_totals(none.select("id"), none)) == [(0, 0, 0, 0)]
    assert rows(reports.gate_totals(spark.createDataFrame([(True,), (False,), (None,)], "ok boolean"))) == [(3, 1, 2)]


def test_all_and_sum_with_nulls(spark):
    f = spark.createDataFrame([("a", True, 1), ("a", None, None), ("b", True, None)], "k string, ok boolean, n long")
    assert rows(reports.all_and_sum(f, "k", ["ok"], ["n"])) == [("a", False, 1), ("b", True, 0)]


def test_deltas_of_keys_on_both_sides(spark):
    side = lambda *x: spark.createDataFrame(x, "key string, value double")
    assert rows(reports.summary_deltas(side(("a", 1.0), ("b", 1.0), ("c", None)), side(("a", 1.1234567), ("c", 2.0), ("d", 1.0)))) == [("a", 1.0, 1.123457, 0.123457)]


def test_change_summary_shows_the_first(spark):
    f = spark.createDataFrame([("t", i, f"p{i}") for i in range(25)] + [("u", 1, "q")], "task string, n_ int, path string")
    found = {r["task"]: r for r in reports.change_summary(f, "task", "n_").collect()}
    assert found["t"]["task_new_files"] == [f"p{i}" for i in range(20)] and found["t"]["task_new"] == 25 and found["t"]["task_new_files_truncated"]
    assert found["u"]["task_new_files"] == ["q"] and not found["u"]["task_new_files_truncated"]


def test_worker_readiness(spark):
    names = ["required", "invoked", "structured_evidence_valid", "worker", "evidence_kind", "status", "artifact_path", "artifact_sha256", "schema_version", "evidence", "summary", "blocking_findings"]
    kinds = ["boolean"] * 3 + ["string"] * 8 + ["array<string>"]
    good = dict(zip(names, [True, True, True, "w", "k", "passed", "a", "0", None, None, "s", None], strict=True))
    cases = [{}, {"required": None}, {"worker": " "}, {"blocking_findings": [" "]}, {"blocking_findings": [None]}, {"artifact_sha256": ""}, {"evidence": " "}, {"invoked": None}, {"schema_version": "1", "artifact_path": None}]
    f = spark.createDataFrame([tuple((good | c)[n] for n in names) for c in cases], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    found = [tuple(r) for r in f.select(reports.worker_ready(), reports.worker_ready_to_retry()).collect()]
    assert found == [(True, True), (False, True), (False, True), (True, False), (False, False), (False, True), (False, True), (False, False), (True, True)]


def test_refs_entries_and_changes_with_nulls(spark):
    ref = lambda *x: spark.createDataFrame(x, "kind string, path string, section string")
    assert rows(reports.missing_refs(ref(("d", "a", None), ("d", "b", "s"), ("d", "b", "s")), ref(("d", "a", "")))) == [("d", "b", "s")] * 2
    e = spark.createDataFrame([(2, None, "a"), (1, "", "b"), (3, "x", "c")], "seq int, kind string, v string")
    assert rows(reports.first_of_each(e, ["kind"], ["seq"])) == [(1, "", "b"), (3, "x", "c")]
    c = lambda *x: spark.createDataFrame(x, "change string, path string, old_path string")
    assert rows(reports.changes_once(c(("m", "a", None), ("m", " ", None)), c(("m", "a", ""), ("r", "b", "a")))) == [("m", "a", "", 0), ("r", "b", "a", 1)]


def test_implemented_files_and_seed_query(spark):
    e = spark.createDataFrame(
        [("w", "implementation-allow", None, "b", 1), ("w", "implementation-allow", "a", "z", 2), ("w", "implementation-allow", "", "b", 3), ("w", "implementation-allow", None, None, 4), ("w", "x", None, "c", 5), ("v", "implementation-allow", None, "d", 6)],
        "workflow_id string, event string, artifact_path string, path string, seq int",
    )
    assert rows(reports.implemented_files(e, "w")) == [("a", 2), ("b", 1)]
    one = spark.range(1)
    assert one.select(reports.seed_query([F.lit(" t \n"), F.lit(None).cast("string"), F.lit(" \n"), F.lit("a\nb")])).head()[0] == "t\na\nb"
    assert one.select(reports.seed_query([F.lit(" ")])).head()[0] == ""
