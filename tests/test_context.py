"""Context queries: modes, code terms, signals of a score, nodes, edges, blocks."""

import pytest
from pyspark.sql import functions as F

from tessella.api import Engine
from tessella.operators import context


def test_modes(spark):
    asked = {"Why this decision": "past_decision", "why is the source so": "authority_or_contract", "what must hold": "invariant", "impact of a change in src/x.py": "file_impact", "impact of x": "call_impact", "where is x": "code_location", "nothing": "authority_or_contract", "": "authority_or_contract", "실패": "failure_mode"}
    rows = spark.createDataFrame([(k,) for k in asked], "q string").select("q", context.mode(F.col("q")).alias("mode")).collect()
    assert {r["q"]: r["mode"] for r in rows} == asked
    named = spark.createDataFrame([("Call-Impact",), (" contract ",), (None,)], "e string").select(context.mode(F.lit("x"), F.col("e")).alias("m")).collect()
    assert [r["m"] for r in named] == ["call_impact", "authority_or_contract", "authority_or_contract"]


@pytest.mark.parametrize("term, expected", [("Where", True), ("a_b", True), ("x::y", True), ("a.py", True), (".hidden", False), ("getToken", True), ("Token", False), ("TOKEN", False), ("plain", False), ("HTTPServer", True)])
def test_code_terms(spark, term, expected):
    assert spark.range(1).select(context.is_code_term(F.lit(term)).alias("x")).head()["x"] is expected


def test_graph_evidence(spark):
    frame = spark.createDataFrame
    nodes = frame([("f1", "file", "a.py", None, "a.py"), ("s1", "symbol", "runAll", "a.runAll", "a.py"), ("s2", "symbol", "go", "b.go", "b.py"), ("f2", "file", "b.py", None, "b.py")], "id string, kind string, name string, qualified_name string, path string")
    edges = frame([("DEFINES", "f1", "s1"), ("CALLS", "s2", "s1"), ("DEFINES", "f2", "s2")], "kind string, src string, dst string")
    evidence = frame([("graph_node", f"<graph:{x}>", f"symbol {x}", 1, "node") for x in ("s1", "s2", "f1", "f2")] + [("doc", "n.md", "", 1, None)], "kind string, path string, section string, line_start int, text string")
    engine = Engine(nodes, edges, evidence)
    rows = engine.context_query("who calls runAll").collect()
    # the caller weighs more than the match itself and its file; the caller's file is two steps away
    by_node = [r["path"] for r in rows if r["kind"] == "graph_node"]
    assert by_node == ["<graph:s2>", "<graph:s1>", "<graph:f1>"] and {r["group_name"] for r in rows if r["kind"] == "graph_node"} == {"likely_change_surface"}
    # callers and impact, each with a path
    answers = [r for r in rows if r["kind"] == "graph_query"]
    assert {(r["section"], r["score"], r["group_name"]) for r in answers} == {("callers_of", 4.0, "callers_and_dependents"), ("impact_symbol", 4.0, "callers_and_dependents")}
    assert engine.context_mode("who calls runAll") == "call_impact"
    assert {r["kind"] for r in Engine(nodes, edges, evidence.limit(0)).context_query("who calls runAll").collect()} == {"graph_query"}


def test_boosts(spark):
    rows = spark.createDataFrame([("docs/PRD.md", "doc"), ("r", "completion_receipt"), ("t", "task_artifact"), ("docs/contracts/a", "doc"), ("x", "doc")], "path string, kind string")
    got = lambda low: [r["b"] for r in rows.select(context.product_boost(F.col("path"), F.col("kind"), F.lit(low)).alias("b")).collect()]
    assert got("the project") == [0.9, 0.45, 0.35, -0.2, 0.0]
    assert got("why") == [0.9, 0.8, 0.65, 0.0, 0.0]
    assert got("other") == [0.0] * 5


def test_edge_recall(spark):
    edges = spark.createDataFrame([("CALLS", "a", "b", "seen", None), ("CALLS", "a", "b", "told", None)], "kind string, src string, dst string, assertion string, source string")
    required = [(1, "CALLS", "a", "b", None, None), (1, "CALLS", "a", "b", "never", ""), (2, "CALLS", "b", "a", "", ""), (1, "CALLS", "a", "b", "told", "")]
    rows = context.edge_recall(spark.createDataFrame(required, "q int, kind string, src string, dst string, assertion string, source string"), edges).collect()
    assert {r["q"]: (r["hits"], r["wanted"]) for r in rows} == {1: (2, 3), 2: (0, 1)}


def test_backlog_blocks(spark):
    text = "intro\n- one\n  more\n\nclosed\n  lost\n- two\n\n"
    rows = context.backlog_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string"), "k", "text").orderBy("line_start").collect()
    assert [(r["k"], r["line_start"], r["line_end"]) for r in rows] == [(1, 2, 3), (1, 7, 7)]


def test_prioritised(spark):
    a, b = (spark.createDataFrame(x, "ref string, n int") for x in ([("x", 2), ("x", 1)], [("x", 0), ("y", 5), (None, 1)]))
    rows = context.prioritised([a, b], ["ref"], [F.col("n")]).collect()
    assert {(r["ref"], r["n"], r["priority"]) for r in rows} == {("x", 1, 0), ("y", 5, 1), (None, 1, 1)}
