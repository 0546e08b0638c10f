"""Graph candidates, phrases, node documents, calls and the file index, on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from tessella.api import Engine
from tessella.functions import text
from tessella.operators import candidates, code, context, inventory, nested, textindex
from tessella.sources import files

NODES = "id string, kind string, name string, qualified_name string, path string"
EDGES = "kind string, src string, dst string"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("f1", "file", None, None, "a/x.py"), ("f2", "file", None, None, "b.py"), ("s1", "symbol", "run", "run", "a/x.py"), ("s2", "symbol", "go", "go", "b.py"), ("s3", "symbol", "again", "again", "b.py"), ("s4", "symbol", "run", "T.run", "b.py"), ("n", None, None, None, None)]
    edges = [("DEFINES", "f1", "s1"), ("DEFINES", "f2", "s2"), ("DEFINES", "f2", "s3"), ("DEFINES", "f2", "s4"), ("CALLS", "s2", "s1"), ("CALLS", "s3", "s2"), ("CALLS", "s2", "s2"), ("IMPORTS_FILE", "f2", "f1"), ("ANCHORS", "s2", "a2"), ("HAS_TOPIC", "f1", "t"), (None, None, "s1")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def asked(spark, *questions):
    return candidates.small_questions(spark.createDataFrame(list(enumerate(questions)), "q int, question string"))


def test_what_tokens_ask(spark):
    rows = candidates.asked(asked(spark, "impact of a change in ./a/x.py, `go` and T.run.", "where is go", "who calls go go", "why this on b.py", "", "x")).collect()
    got = {(r["q"], r["token"], r["selector"]) for r in rows}
    assert {(0, "/a/x.py", "impact_file"), (0, "/a/x.py", "file"), (0, "go", "callers_of"), (0, "T.run", "impact_symbol"), (1, "go", "symbol"), (2, "go", "callers_of"), (3, "b.py", "file")} <= got
    assert not any(q in (4, 5) for q, _, _ in got) and not any(q == 3 and s != "file" for q, _, s in got) and len([1 for r in rows if r["q"] == 2 and r["token"] == "go"]) == 2


def test_candidates(spark, graph):
    rows = {(r["token"], r["selector"]): r for r in candidates.graph_candidates(asked(spark, "who calls go or run or T.run, and what of ./a//x.py or gone"), *graph).collect()}
    assert set(rows) == {("go", "callers_of"), ("go", "impact_symbol"), ("run", "callers_of"), ("run", "impact_symbol"), ("T.run", "callers_of"), ("T.run", "impact_symbol"), ("/a//x.py", "impact_file"), ("/a//x.py", "file")}
    assert rows["go", "callers_of"]["text"] == "match go b.py\ngo --CALLS--> go: caller invokes selected symbol\nagain --CALLS--> go: caller invokes selected symbol"
    assert rows["go", "callers_of"]["score"] == 4.0 and rows["T.run", "callers_of"]["score"] == 3.0
    assert (rows["run", "callers_of"]["n_matches"], rows["run", "callers_of"]["n_paths"]) == (2, 0)
    assert rows["/a//x.py", "impact_file"]["text"].split("\n") == [
        "match a/x.py a/x.py", "a/x.py --DEFINES--> run: depth 1: file defines potentially changed symbol", "b.py --IMPORTS_FILE--> a/x.py: depth 1: file imports changed file", "go --CALLS--> run: depth 2: caller depends on changed symbol",
        "a/x.py --DEFINES--> run: depth 2: symbol belongs to changed file", "b.py --DEFINES--> go: depth 2: file defines potentially changed symbol", "b.py --DEFINES--> again: depth 2: file defines potentially changed symbol",
        "b.py --DEFINES--> T.run: depth 2: file defines potentially changed symbol",
    ]
    warned = candidates.warnings(candidates.graph_candidates(asked(spark, "who calls run"), *graph)).collect()
    assert {(r["token"], r["code"]) for r in warned} == {("run", "graph_query_ambiguous_symbol")}
    assert candidates.graph_candidates(asked(spark, "nothing here"), *graph).count() == 0


def test_questions_alike_are_answered_once(spark, graph, monkeypatch):
    asked_of = []
    answers = candidates.answers
    monkeypatch.setattr(candidates, "answers", lambda labels, *rest: (asked_of.append(labels.count()), answers(labels, *rest))[1])
    labels = spark.createDataFrame([(q, x, "callers_of") for q in range(20) for x in ("go", "run", "gone", f"own{q}")] + [(None, "go", "callers_of")], "q int, token string, selector string")
    rows = candidates.of_labels(labels, *graph).collect()
    assert asked_of == [23] and {(r["q"], r["token"], r["n_matches"], r["n_paths"]) for r in rows} == {(q, *x) for q in range(20) for x in (("go", 1, 2), ("run", 2, 0))} and len(rows) == 40


def test_labels_walk_apart(spark, graph):
    seeds = spark.createDataFrame([("a", "f1"), ("b", "s3"), ("b", "s3"), ("c", "zz")], "label string, id string")
    seen, paths = candidates.labelled_walk(graph[1], seeds, ["label"], 2)
    assert {(r["label"], r["id"], r["depth"]) for r in seen.collect()} == {("a", "f1", 0), ("a", "s1", 1), ("a", "f2", 1), ("a", "s2", 2), ("a", "s3", 2), ("a", "s4", 2), ("b", "s3", 0), ("b", "f2", 1), ("b", "s2", 2), ("b", "s4", 2), ("c", "zz", 0)}
    assert {(r["src"], r["dst"], r["depth"]) for r in paths.filter("label = 'b'").collect()} == {("f2", "s3", 1), ("f2", "s2", 2), ("f2", "s3", 2), ("f2", "s4", 2)}
    with pytest.raises(ValueError):
        candidates.labelled_walk(graph[1], seeds, ["label"], 0)


def test_payload(spark, graph):
    edges, nodes = candidates.payload(asked(spark, "who calls go"), *graph)
    got = {(r["selector"], r["kind"], r["src"], r["dst"]) for r in edges.collect()}
    # what defines the symbol and its callers, from the file's first wanted symbol on, and the anchor
    assert {x[1:] for x in got if x[0] == "callers_of"} == {("CALLS", "s2", "s2"), ("CALLS", "s3", "s2"), ("DEFINES", "f2", "s2"), ("DEFINES", "f2", "s3"), ("DEFINES", "f2", "s4"), ("ANCHORS", "s2", "a2")}
    assert {r["id"] for r in nodes.filter("selector = 'callers_of'").collect()} == {"f2", "s2", "s3", "s4"}


def test_phrases_by_position(spark, tmp_path):
    docs = spark.createDataFrame([(1, "src/main.py", "main py src"), (2, "x", "src main-py; SRC.main.py src main py"), (3, None, None), (4, "src", "main py"), (5, "z", "src main " * 2000)], "id int, path string, body string")
    textindex.write(docs, str(tmp_path / "i"), "id", ["path", "body"], "body", buckets=5)
    index = textindex.read(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(0, ["src/main.py", "SRC.main.PY", "none"]), (1, ["::"]), (2, ["main src main"])], "q int, terms array<string>")
    assert {(r["q"], tuple(r["phrase"]), r["times"]) for r in textindex.phrases(q).collect()} == {(0, ("src", "main", "py"), 2), (0, ("none",), 1), (2, ("main", "src", "main"), 1)}
    found = {(" ".join(r["phrase"]), r["doc"]): r["f"] for r in textindex.frequencies(index, textindex.phrases(q)).collect()}
    assert found == {("src main py", 1): 1, ("src main py", 2): 3, ("main src main", 5): 1999}  # never across fields
    sizes = {r["doc"]: (r["length"], r["n_words"]) for r in index.sizes.collect()}
    assert sizes[1] == (6, 3) and sizes[2] == (10, 6) and sizes[3] == (0, 0)
    built = textindex.build(docs, "id", ["path", "body"], "body")
    assert sorted(map(str, textindex.phrase_bm25(built, q).collect())) == sorted(map(str, textindex.phrase_bm25(index, q).collect()))


def test_index_tasks_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SORTED", 1000)
    monkeypatch.setattr(textindex, "GROUPED", 500)
    docs = spark.range(2000).select(F.col("id"), F.lit("one one one two one").alias("body"))
    textindex.write(docs, str(tmp_path / "i"), "id", ["body"], "body", buckets=4)
    index = textindex.read(spark, str(tmp_path / "i"))
    held = [r["count"] for r in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 10_000 and max(held) < 2500  # a word of four fifths of all places is cut too
    found = textindex.frequencies(index, spark.createDataFrame([(["one", "one"],)], "phrase array<string>")).collect()
    assert len(found) == 2000 and {r["f"] for r in found} == {2}


def test_short_texts_by_their_own_words(spark):
    body = [("doc", "docs/a/long/path.md", "A long section", 1, "token two"), ("doc", "b.md", "", 1, "token and five more words here")]
    evidence = spark.createDataFrame(body, "kind string, path string, section string, line_start int, text string").withColumn("id", F.col("path"))
    asked_ = spark.createDataFrame([(0, ["token"])], "q int, terms array<string>")
    index = textindex.build(evidence, "id", ["path", "section", "text"], "text")
    score = {r["id"]: r["fts"] for r in textindex.text_scores(index, asked_).collect()}
    bm25 = {r["doc"]: r["score"] for r in textindex.phrase_bm25(index, asked_).collect()}
    assert score["docs/a/long/path.md"] == pytest.approx(0.3 / (1 + bm25["docs/a/long/path.md"])) and score["b.md"] == pytest.approx(1 / (1 + bm25["b.md"]))


def test_from_nodes_to_bundle(spark, graph):
    nodes, edges = graph
    documents = files.nodes_as_documents(nodes.filter("kind is not null"))
    assert {(r["kind"], r["path"], r["section"]) for r in documents.collect()} >= {("graph_node", "<graph:f1>", "file a/x.py"), ("graph_node", "<graph:s2>", "symbol s2")}
    engine = Engine(nodes, edges, documents.unionByName(files.whole_text(spark.createDataFrame([("docs/adr/1.md", "who calls go: a test")], "path string, text string"), "document")))
    rows = engine.context_query("who calls go").collect()
    assert {r["kind"] for r in rows} == {"graph_node", "graph_query", "document"} and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert {r["path"]: r["group_name"] for r in rows}["docs/adr/1.md"] == "must_read"
    assert [r["token"] for r in engine.context_warnings("who calls run").collect()] == ["run", "run"]
    assert {r["section"] for r in engine.context_query("who calls go", mode="code-location").collect() if r["kind"] == "graph_query"} == {"symbol"}


def test_groups_read_the_excerpt(spark):
    rows = spark.createDataFrame([("x " * 600 + "test",), ("x test",)], "text string")
    name = context.group_name(F.lit("document"), F.lit("a.md"), F.lit(""), F.col("text"), F.lit(False))
    assert [r[0] for r in rows.select(name).collect()] == ["supporting_evidence", "tests_and_verification"]


CALLERS = '''
from lib import make, make as build, other
from lib import twice
import os.path


def make(x):
    def inner():
        return make(1)
    return make(0)


class Runner:
    def go(self):
        def later():
            return self.step()
        return [self.go() for _ in range(2)]

    def step(self):
        return build(1)

    class Inner:
        def on(self):
            return self.off()

        def off(self):
            pass


def start():
    class Local:
        def m(self):
            return self.n() or build(3)
    return make(2)


def hides(build):
    return build(1)


def twin():
    return twice()


if True:
    from lib import late

    def guarded():
        return make(1)


def uses_late():
    return late()
'''


def test_calls(spark):
    sources = spark.createDataFrame([("app.py", CALLERS), ("lib.py", "def make():\n    pass\n\n\ndef other():\n    pass\n\n\ndef twice():\n    pass\n\n\ndef twice():\n    pass\n\n\ndef late():\n    pass\n"), ("bad.py", "def (:")], "path string, text string")
    parsed = code.parsed_python(sources)
    resolved = code.resolved_python(parsed.filter("kind = 'import'").select("path", "module", "name", "alias", "level"), sources)
    got = {(r["caller"], r["target_path"], r["target"]) for r in code.calls(parsed, resolved).collect()}
    assert got == {
        ("make", "lib.py", "make"),  # the imported one, beside its own
        ("Runner.go", "app.py", "Runner.step"),  # from a function inside the method
        ("start", "app.py", "make"), ("start", "lib.py", "make"),
    }


def test_parsed_in_small_blocks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(code, "ROWS", 10)
    texts = ["def f():\n    pass\n" * 3] * 50 + [None, "def (:"]
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.py" for i in range(52)], "text": texts})
    blocks = list(code._blocks(iter([batch, batch])))
    assert max(map(len, blocks)) < 10 + 4 and [r for x in blocks for r in x] == [r for i in (*range(52), *range(52)) for r in code._parse(f"{i}.py", texts[i] or "")]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256 or code.parsed_python(spark.createDataFrame([("a", "b")], "path string, text string")) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "256"


def test_sources_are_parsed_once(spark, sf_dir):
    from tessella.plans import build_queries, code_queries

    frames = [code_queries._resolved(spark, sf_dir)[0], *build_queries._tables(spark, sf_dir, build_queries._files(spark, sf_dir))]
    assert not any("MapIn" in x._jdf.queryExecution().optimizedPlan().toString() for x in frames)  # read again, not parsed again


def test_file_index(spark):
    sources = spark.createDataFrame(
        [("a.py", "import os.path\nfrom . import x\nfrom ..b.c import d\n\n\nclass K:\n    def f(self):\n        self.g(open('x'))\n        h().i.j()\n"), ("b.py", "def (:"), ("c/d.TS", "import {a} from 'axios';\nexport async function go() { if (x) run.it(1); }\nconst y = () => Date.now()"), ("Dockerfile", "RUN x"), ("e", None), ("f.mjs", None), (".py", "x")],
        "path string, text string",
    )
    got = {r["path"]: r for r in code.file_index(sources).collect()}
    assert len(got) == 7 and {p: (r["language"], r["status"]) for p, r in got.items()} == {"a.py": ("python", "ok"), "b.py": ("python", "parse_error"), "c/d.TS": ("typescript", "ok"), "Dockerfile": ("dockerfile", "skipped"), "e": ("unknown", "skipped"), "f.mjs": ("javascript", "ok"), ".py": ("unknown", "skipped")}
    a = got["a.py"]
    assert a["symbols"] == ["K", "f"] and a["imports"] == ["..b.c.d", ".x", "os.path"] and a["calls"] == ["h", "i.j", "open", "self.g"] and a["packages"] == ["os"] and a["effects"] == ["fs"]
    s = got["c/d.TS"]
    assert s["symbols"] == ["go", "y"] and s["imports"] == ["axios"] and s["calls"] == ["Date.now", "go", "run.it"] and s["packages"] == ["axios"] and s["effects"] == ["net", "time"]


GLOBS = ["*.md", "docs/**", "a?c.py", "[a-c]/x*", "[!a]b", "a[b", "x.y+(z)|{1}^$", "src/*/test_?.py", "README.md", "*"]
NAMES = ["x.md", "xmd", "docs/a/b", "docs", "abc.py", "a/c.py", "b/xyz", "d/x", "zb", "ab", "a[b", "x.y+(z)|{1}^$", "xay+(z)|{1}^$", "src/u/v/test_1.py", "README.md", "src/test_1.py", "a\nb.md"]


def test_globs_of_columns(spark):
    import fnmatch

    rows = spark.createDataFrame([(g, n) for g in GLOBS for n in NAMES], "g string, n string").select("g", "n", F.rlike("n", text.glob_regex_of(F.col("g"))).alias("met")).collect()
    assert {(r["g"], r["n"]) for r in rows if r["met"]} == {(g, n) for g in GLOBS for n in NAMES if fnmatch.fnmatchcase(n, g)}


def test_rules_by_folder(spark):
    import fnmatch

    rules = [(i, g, f"r{i}", f"t{i % 3}") for i, g in enumerate(GLOBS)]
    met = inventory.glob_matches(spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "path string"), spark.createDataFrame(rules, "ord int, pattern string, reason string, topic string"))
    assert sorted((r["path"], r["ord"]) for r in met.collect()) == sorted((n, i) for i, g in enumerate(GLOBS) for n in NAMES if fnmatch.fnmatchcase(n, g))
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_pattern_overlaps(spark):
    import fnmatch
    import re

    def prefix(x):
        head = re.match(r"[^*?\[]*", x)[0]
        return head.rsplit("/", 1)[0] + "/" if "/" in head else head

    def overlap(a, b):
        p, q = prefix(a), prefix(b)
        return fnmatch.fnmatchcase(a, b) or fnmatch.fnmatchcase(b, a) or bool(p and q and (p.startswith(q) or q.startswith(p)))

    every = GLOBS + ["docs/a/*.md", "d*", "src/**", "src/u/x.py", "src/*/y", "*.py", ""]
    found = {(r["a"], r["b"]) for r in inventory.pattern_overlaps(spark.createDataFrame([(x,) for x in every + every[:3]], "pattern string")).collect()}
    assert found == {(a, b) for a in every for b in every if a < b and overlap(a, b)}


def test_nested_values(spark):
    states = [(1, '{"a": {"b": {"c": 1, "t": true}, "l": [1, {"credential": 2, "x": {"temp_path": 3}}]}, "f": 2.5, "n": null, "s": "1", "workers": []}'), (2, "not json"), (3, None), (4, '[1, {"approval": 1}]'), (5, "{}"), (6, "3")]
    rows = spark.createDataFrame(states, "id int, j string")
    assert {(r["id"], r["path"]): r["value"] for r in nested.flat_numbers(rows, "id", "j").collect()} == {(1, "a.b.c"): 1.0, (1, "a.b.t"): 1.0, (1, "f"): 2.5}
    assert {(r["id"], r["name"], r["depth"]) for r in nested.forbidden_keys(rows, "id", "j").collect()} == {(1, "workers", 1), (1, "credential", 4), (1, "temp_path", 5)}
    assert {(r["id"], r["name"]) for r in nested.missing_keys(rows, "id", "j", ["a", "z"]).collect()} == {(1, "z")} | {(i, x) for i in range(2, 7) for x in "az"}
    a, b = (spark.createDataFrame(x, "id int, j string") for x in ([(1, '{"x": 1, "y": {"z": 2}}')], [(1, '{"x": 1.25, "y": {"w": 2}}')]))
    got = nested.number_deltas(nested.flat_numbers(a, "id", "j"), nested.flat_numbers(b, "id", "j"), "id").collect()
    assert [(r["path"], r["baseline"], r["candidate"], r["delta"]) for r in got] == [("x", 1.0, 1.25, 0.25)]
    assert nested.flat_numbers(rows.limit(0), "id", "j").count() == 0
