"""Operators on small inputs: edge cases and what the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import code, graph, inventory, lifecycle, retrieval, state
from tessella.sources import files, sinks


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("r")).head()[0]


def test_globs_cross_slashes(spark):
    x = F.col("x")
    assert one(spark, t.glob_any(x, ["a/*.py"]), "a/b/c.py")
    assert not one(spark, t.glob_any(x, ["**/tests/**"]), "tests/x")
    assert one(spark, t.glob_any(x, ["[!b]?.md"]), "ab.md")
    assert one(spark, t.within_surface(x, "src/**"), "src") and not one(spark, t.within_surface(x, "src/**"), "srcs/a")


def test_paths_and_tokens(spark):
    x = F.col("x")
    assert one(spark, t.normal_path(x), "./a//b/.") == "a/b" and one(spark, t.normal_path(x), "a/../b") is None
    assert one(spark, t.identifier_tokens(x), "parseHTTPTokens2go") == ["parse", "http", "tokens", "2go"]
    assert one(spark, t.words(x), "Ünder an_older a x1") == ["ünder", "an", "older", "x1"]
    assert one(spark, t.token_estimate(x), "") == 1 and one(spark, t.token_estimate(x), "abcde") == 2
    assert one(spark, t.percent_encoded(x), "a b/~*é") == "a%20b%2F~%2A%C3%A9"
    assert one(spark, t.slug(x), "  Hello, World! ") == "hello-world"
    assert one(spark, t.cut(x, 10), "abcdefghijklm") == "abcdefg..."
    assert "[REDACTED]" in one(spark, t.redacted(x), "Authorization: Bearer abc.def")


def test_redaction_as_its_sql(spark, tmp_path):
    import duckdb

    from tessella.registry import ORACLE_SQL, QUERIES

    texts = ["TOKEN = ABC x", "token = abc\nnext line, more", "mytoken=1 b", "Bearer  a.b\tc", "bearer\tx", "API-KEY: 1", "Api_Key:\t1;2", "secret\n= 3", "password=\u00a0x y", "Ünï token: é " * 3000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(ORACLE_SQL["redact_secrets"]).fetchall())
    assert {r["doc_id"]: r["digest"] for r in QUERIES["redact_secrets"](spark, str(tmp_path)).collect()} == want and len(want) == len(texts)
    assert one(spark, t.redacted(F.col("x")), "TOKEN = ABC\nx") == "TOKEN = [REDACTED]\nx"  # in general any case is meant


def test_walk_ends_and_keeps_least_depth(spark):
    e = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "b", "c"), ("CALLS", "c", "a"), ("DEFINES", "f", "b"), ("CALLS", None, "b")], "kind string, src string, dst string")
    seeds = spark.createDataFrame([("c",)], "id string")
    got = {r["id"]: r["depth"] for r in graph.impact(e, seeds, 4).collect() if r["id"]}
    assert got == {"c": 0, "b": 1, "a": 2, "f": 2}
    with pytest.raises(ValueError):
        graph.impact(e, seeds, 0)
    assert {r["id"] for r in graph.neighborhood(e, spark.createDataFrame([("f",)], "id string"), 1).collect()} == {"f", "b"}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "kind string, src string, dst string")
    assert graph.impact(e, spark.createDataFrame([("c",)], "id string"), 2).count() == 1
    assert graph.kind_counts(e).count() == 0


def test_packing_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([("q", 1, 60), ("q", 2, 50), ("q", 3, 30), ("q", 4, 20)], "q string, rank long, tokens long")
    assert sorted(r["rank"] for r in retrieval.packed(items, "q", "rank", "tokens", 100).collect()) == [1, 3]


def test_status_is_free_of_order(spark):
    e = spark.createDataFrame([(1, "approved"), (1, "rejected"), (2, "refreshed"), (2, "rejected"), (3, "created")], "id long, type string")
    assert {r["id"]: r["status"] for r in lifecycle.folded_status(e, "id").collect()} == {1: "approved", 2: "rejected", 3: "pending"}


def test_ratio_and_mean_defaults(spark):
    assert one(spark, t.ratio(F.lit(0), F.lit(0))) == 1.0
    empty = spark.createDataFrame([], "v double")
    assert empty.agg(t.mean_if(F.col("v"), F.lit(True)).alias("m")).head()[0] == 0.0


def test_counts_are_zero_filled(spark):
    files_ = spark.createDataFrame([("a", "annotated")], "path string, classification string")
    assert {r["classification"]: r["n"] for r in inventory.counts(files_, ["annotated", "excluded"]).collect()} == {"annotated": 1, "excluded": 0, "total": 1}


def test_conflicts_where_a_fingerprint_is_missing(spark):
    now = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k long, fingerprint string")
    old = spark.createDataFrame([(1, "x"), (2, None)], "k long, fingerprint string")
    assert {r["k"]: r["state"] for r in state.change_delta(now, old, ["k"]).collect()} == {1: "same", 2: "conflict", 3: "new"}


def test_problems_once(spark):
    rows = spark.createDataFrame([(1,), (1,), (7,)], "n long")
    p = state.problems(rows, [("error", "small", F.col("n") < 5, F.lit("m")), ("warning", "odd", F.col("n") % 2 == 1, F.lit("o"))], F.col("n").cast("string"))
    assert state.all_problems(p, p).count() == 3


def test_imports_two_files_fit_resolve_to_none(spark):
    f = spark.createDataFrame([("m.py",), ("m/__init__.py",), ("n.py",)], "path string")
    i = spark.createDataFrame([("a.py", "m", None, "m", 0), ("a.py", "n.sub", "x", "x", 0), ("a.py", "gone", None, "gone", 0)], "path string, module string, name string, alias string, level int")
    assert {(r["module"], r["target"]) for r in code.resolved_python(i, f).collect()} == {("n.sub", "n.py")}


def test_files_frontmatter_sections(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "docs" / "a.md").write_text("---\nid: T-1\ntitle: 'x: y'\ntags: [a, 'b']\n---\n## One\ntext\n```\n## no\n```\n## Two\nend")
    (tmp_path / "skip" / "b.md").write_text("no")
    docs = files.scan_documents(spark, str(tmp_path), ["*.md"], ["skip"])
    row = files.frontmatter(docs).select("path", "meta", "body", files.list_value(F.col("meta")["tags"]).alias("tags")).collect()
    assert [(r["path"], r["meta"]["title"], r["tags"]) for r in row] == [("docs/a.md", "x: y", ["a", "b"])]
    found = files.sections(files.frontmatter(docs).select("path", F.col("body").alias("text"))).orderBy("line_start").collect()
    assert [(r["title"], r["line_start"], r["line_end"]) for r in found] == [("One", 1, 5), ("Two", 6, 7)]


def test_logs_strict_and_lenient(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert files.json_log(spark, str(p), "a int", strict=False).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.json_log(spark, str(p), "a int", strict=True).collect()


def test_artifact_digests(spark):
    data = {"b": "é", "a": [1, 2]}
    import hashlib

    good = data | {"digest": "sha256:" + hashlib.sha256(files.canonical_json(data).encode()).hexdigest()}
    rows = spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(data | {"digest": "sha256:0"})), ("n", "{"), ("m", "{}")], "path string, text string")
    ok, bad = files.verified(rows, "digest")
    assert [r["path"] for r in ok.collect()] == ["g"]
    assert {(r["path"], r["code"]) for r in bad.collect()} == {("b", "artifact_digest_mismatch"), ("n", "artifact_unreadable"), ("m", "artifact_digest_missing")}


def test_pages_and_freshness(spark):
    items = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, "[x](gone.md)")], "page string, ord int, line string")
    made = sinks.pages(items, "page", ["ord"], "line")
    assert {r["name"]: r["content"] for r in made.collect()} == {"p": "a\nb", "q": "[x](gone.md)"}
    assert {r["name"]: r["state"] for r in sinks.freshness(made, made.filter("name = 'p'")).collect()} == {"p": "current", "q": "missing"}
    assert [r["target"] for r in sinks.broken_links(made).collect()] == ["gone.md"]
    assert sinks.manifest_digest(made).startswith("sha256:")


def test_definition_rows_and_symbols(spark):
    symbols = spark.createDataFrame([("s1", "f", "m.f", "m.py"), ("s2", "f", "n.f", "n.py")], "id string, name string, qualified_name string, path string")
    found = graph.select_symbol(symbols, "f").collect()
    assert len(found) == 2 and all(r["ambiguous"] for r in found)
    assert [r["id"] for r in graph.select_symbol(symbols, "f", "n.py").collect()] == ["s2"]


def test_every_page_has_a_node_id(spark, sf_dir):
    from urllib.parse import quote

    from tessella.registry import QUERIES, table

    pages = table(spark, sf_dir, "pages").select("page_id", "url").collect()
    want = {r["page_id"]: None if r["url"] is None else "file:" + quote(r["url"], safe="") for r in pages}
    assert {r["page_id"]: r["id"] for r in QUERIES["node_ids_all"](spark, sf_dir).collect()} == want
    odd = "a=1&b#c%20+é~*☃😀"
    assert one(spark, t.percent_encoded(F.lit(odd))) == quote(odd, safe="")


def test_a_definition_within_a_level_is_stepped_once(spark):
    edges = spark.createDataFrame([("DEFINES", "f", "a"), ("DEFINES", "f", "b"), ("CALLS", "b", "a")], "kind string, src string, dst string")
    reached = spark.createDataFrame([("a", 0), ("f", 1), ("b", 1)], "id string, depth int")
    found = sorted(map(tuple, graph.impact_paths(edges, reached, 2).collect()))
    assert found == [("a", "b", "CALLS", 1), ("a", "f", "DEFINES", 1), ("f", "a", "DEFINES", 2), ("f", "b", "DEFINES", 2)]
