"""The engine's questions on a small repository."""

import pytest
from pyspark.sql import functions as F

from tessella.api import Ambiguous, BadQuestion, Engine
from tessella.operators import rules


RECORDS = "id string, kind string, status string, title string, claim string, summary string, source_refs array<struct<path: string, kind: string, section: string, content_sha256: string>>, supersedes array<string>, record_digest string"
EVENTS = "id string, type string, record_id string, superseded_by string, record_digest string, event_digest string, content_digest string"


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [("f1", "file", "a.py", None, "a.py"), ("f2", "file", "b.py", None, "b.py"), ("s1", "symbol", "run", "a.run", "a.py"), ("s2", "symbol", "run", "b.run", "b.py"), ("s3", "symbol", "go", "b.go", "b.py"), ("t1", "topic", "auth", None, None), ("i1", "import_ref", "a", None, None)]
    edges = [("DEFINES", "f1", "s1"), ("DEFINES", "f2", "s2"), ("DEFINES", "f2", "s3"), ("CALLS", "s3", "s1"), ("IMPORTS_FILE", "f2", "f1"), ("HAS_TOPIC", "f1", "t1"), ("DECLARES_IMPORT", "f2", "i1")]
    evidence = [("doc", "docs/contracts/token.md", "Rules", 1, "A token must be verified. " * 20), ("doc", "README.md", "", 1, "token"), ("doc", "notes.md", "x", 3, "nothing here")]
    files = [("src/auth/token_store.py", "module", "auth", True), ("src/web/page.py", "module", "web", False)]
    ref = [("docs/a.md", "document", "", "d1")]
    records = [
        ("K-1", "rule", "reviewed", "Token rule", "tokens expire", "", ref, ["K-2"], "g1"), ("K-2", "rule", "reviewed", "Old token rule", "tokens stay", "", ref, None, "g2"),
        ("K-3", None, "reviewed", None, None, None, [("docs/a.md", "document", "", "old")], [], "g3"), ("K-4", "rule", "reviewed", "Token", "", "", ref, [], "g4"), ("K-5", "rule", "draft", "Token", "", "", ref, [], "g5"),
    ]
    events = [("E-1", "approved", "K-1", None, "g1", "x", "x"), ("E-2", "superseded", "K-2", "K-1", "g1", "x", "x"), ("E-3", "deprecated", "K-4", None, "g4", "x", "x")]
    frame = spark.createDataFrame
    return Engine(
        frame(nodes, "id string, kind string, name string, qualified_name string, path string"), frame(edges, "kind string, src string, dst string"), frame(evidence, "kind string, path string, section string, line_start int, text string"),
        frame(files, "path string, role string, topic string, annotated boolean"), frame(records, RECORDS), frame(events, EVENTS), frame([("docs/a.md", "d1")], "path string, content_sha256 string"),
    )


def test_selectors(engine):
    pairs = lambda f: {(r["src"], r["dst"]) for r in f.collect()}
    assert pairs(engine.graph_query(callers_of="a.run")) == {("s3", "s1")}
    assert pairs(engine.graph_query(callees_of="go")) == {("s3", "s1")}
    assert pairs(engine.graph_query(topic="auth")) == {("f1", "t1")}
    assert pairs(engine.graph_query(raw_import="a")) == {("f2", "i1")}
    assert len(pairs(engine.graph_query(file="b.py"))) == 4
    assert pairs(engine.graph_query(symbol="run", in_file="b.py")) == {("f2", "s2")}
    assert {r["id"]: r["depth"] for r in engine.graph_query(impact_symbol="a.run", depth=2).collect()} == {"s1": 0, "s3": 1, "f1": 1, "f2": 2}


def test_bad_questions(engine):
    for bad in ({}, {"file": "a.py", "topic": "x"}, {"depth": 0, "file": "a.py"}, {"colour": "red"}):
        with pytest.raises(BadQuestion):
            engine.graph_query(**bad)
    with pytest.raises(Ambiguous) as found:
        engine.graph_query(symbol="run")
    assert found.value.count == found.value.matches.count() == 2


def test_context(engine):
    rows = engine.context_query("how is the token verified").collect()
    assert [r["path"] for r in rows] == ["docs/contracts/token.md", "README.md"]
    assert [r["path"] for r in engine.context_query("token", budget_tokens=20).collect()] == ["README.md"]


def test_meta(engine):
    assert [r["path"] for r in engine.meta_query(role=["module"], topic=["auth", "web"]).collect()] == ["src/auth/token_store.py", "src/web/page.py"]
    assert [(r["path"], r["score"]) for r in engine.meta_suggest("token store auth tok").collect()] == [("src/auth/token_store.py", 24)]


def test_knowledge(spark, engine):
    assert [(r["rank"], r["id"], r["status"]) for r in engine.knowledge_query("token rule").collect()] == [(1, "K-1", "reviewed")]
    every = engine.knowledge_query("token rule", include=("superseded", "deprecated", "stale")).collect()
    # K-1: 2 terms in the title, one in the claim; K-2 as well; K-4: its kind and its title; K-3: reviewed only
    assert [(r["id"], r["status"]) for r in every] == [("K-1", "reviewed"), ("K-2", "superseded"), ("K-4", "deprecated"), ("K-3", "stale")]
    identity, title, claim, text = 0.5, 1.0, 0.5, 1 / (1 + 1e-6 * 2.2 / 2.2 * 1 + 1e-6 * 2 * 2.2 / 3.2)
    assert every[0]["score"] == round(identity + 2.4 * title + 2.0 * claim + 1.2 * text + 0.5, 6)
    assert every[3]["score"] == 0.5
    assert engine.knowledge_query("token rule", limit=-1, include=("superseded",)).count() == 1
    assert {r["status"]: (r["available"], r["excluded"]) for r in engine.knowledge_status().collect()} == {"reviewed": (1, 0), "superseded": (1, 1), "deprecated": (1, 1), "stale": (1, 1), "draft": (1, 0)}
    wrong = Engine(records=engine.records, events=engine.events.withColumn("record_digest", F.lit("no")), sources=engine.sources)
    assert wrong.knowledge_problems().count() == 3 and wrong.knowledge_query("token rule").count() == 0
    assert {(r["what"], r["kind"]): r["n"] for r in engine.kind_counts().collect()}[("edge", "DEFINES")] == 3


def test_integrity_of_events(spark, engine):
    bad = [
        ("E-1", "approved", "K-1", None, "g1", "x", "y"), ("E-2", "approved", "K-9", None, "g1", "x", "x"), ("E-3", "deprecated", None, None, None, "x", "x"), ("E-4", "superseded", "K-9", None, "g1", "x", "x"),
        ("E-5", "superseded", "K-2", "K-1", "old", "x", "x"), ("E-6", "rejected_candidate", None, None, None, "x", "x"), ("E-7", None, None, None, None, "x", "x"), ("E-8", "refreshed_record_candidate", "K-2", None, "old", "x", "x"),
    ]
    found = {(r["code"].removeprefix("knowledge_event_"), r["subject"]) for r in Engine(records=engine.records, events=spark.createDataFrame(bad, EVENTS)).knowledge_problems().collect()}
    assert found == {("digest_mismatch", "E-1"), ("record_missing", "K-9"), ("record_missing", "E-3"), ("superseded_by_missing", "E-4"), ("record_digest_mismatch", "K-1"), ("type_unknown", "E-7"), ("record_digest_mismatch", "K-2")}


def test_facets_of_lists(spark):
    files = spark.createDataFrame(
        [("a.py", "module", ["Auth", "web"], True, "annotated"), ("b.py", "MODULE", ["auth"], False, "indexed_only"), ("c.py", "script", None, True, "annotated"), ("d.py", "module", ["auth"], True, "excluded")],
        "path string, role string, topics array<string>, annotated boolean, classification string",
    )
    got = lambda **w: [(r["path"], r["score"]) for r in Engine(files=files).meta_query(**w).collect()]
    assert got(topics=["auth", "WEB "], role=["module"]) == [("a.py", 35), ("b.py", 20)]
    assert got() == [("a.py", 15), ("c.py", 15), ("b.py", 10)]
    assert got(topics=["none"]) == [] and got(topics=[]) == got() and got(limit=-1) == []


def test_rules(spark):
    rows = spark.createDataFrame([("docs/adr/1.md", "doc", "Decision"), ("docs/adr/1.md", "doc", "x"), ("<graph:repo:web%20x:file:a>", "graph_node", ""), ("z.md", "doc", "")], "path string, kind string, section string")
    got = rows.select(rules.authority(F.col("path"), F.col("kind"), F.col("section")).alias("a"), rules.repository_of(F.col("path")).alias("r")).collect()
    assert [r["a"] for r in got] == [0.5, 0.4, 0.05, 0.1] and [r["r"] for r in got] == [None, None, "web x", None]
    found = rules.leaks(rows.withColumn("repo_id", F.lit("")), F.lit("main")).collect()
    assert len(found) == 1
    kind = rules.first_class(F.col("path"), [("prose", ["docs/**"]), ("note", ["*.md"])], "other")
    assert [r[0] for r in rows.select(kind).collect()] == ["prose", "prose", "other", "note"]
