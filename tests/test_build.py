"""Graph build, its update, digests, and task packs on small tables with known answers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import build, code, packs
from tessella.registry import QUERIES
from tessella.sources import shared, sinks

META = "path string, areas array<string>, policy_topics array<string>, annotation_topics array<string>"
RECEIPTS = "task_id string, status string, task_path string, archive_path string, content_sha256 string, changed_entries array<struct<change: string, path: string, old_path: string>>"


def tables(spark, files):
    frame = spark.createDataFrame(sorted(files.items()), "path string, text string")
    return code.parsed_python(frame.filter("path like '%.py'")), code.file_index(frame).withColumn("classification", F.lit("indexed_only"))


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([("a.py", ["core"], ["web", " "], ["auth", "auth"]), ("gone.py", None, ["x"], None)], META)


@pytest.fixture(scope="module")
def receipts(spark):
    rows = [("T-1", "done", "t/1.md", None, "h", [("modified", "a.py", ""), ("renamed", "b c.py", "old.py"), ("", "x.py", "")]), ("T-2", "done", "", "", None, None), (None, "done", "t", "t", "h", None)]
    return spark.createDataFrame(rows, RECEIPTS)


FILES = {"a.py": "from lib import make\nimport os\n\n\ndef go():\n    return make()\n", "lib.py": "def make():\n    return help()\n\n\ndef help():\n    pass\n", "bad.py": "def (:", "w/x.ts": "import {y} from './y';\n", "w/y.ts": "export const y = 1;\n"}


def snapshot(graph):
    return sorted(map(tuple, graph.nodes.collect())), sorted(map(tuple, graph.edges.select(*build.EDGE_KEY, "facts").collect()))


def test_build(spark, meta, receipts):
    parsed, index = tables(spark, FILES)
    graph = build.build("main", index, parsed, meta, receipts)
    nodes, edges = snapshot(graph)
    by_id = {n[0]: n for n in nodes}
    assert len(by_id) == len(nodes)
    # a file that only a receipt names is invented; one that the index has isn't
    assert '"present_in_current_inventory":false' in by_id["repo:main:file:b%20c.py"][2] and "receipt" not in by_id["repo:main:file:a.py"][2]
    assert "repo:main:file:gone.py" not in by_id and "repo:main:topic:x" not in by_id and "task:T-2" in by_id and "task:" not in by_id
    kinds = {(e[0], e[1].split(":")[-1], e[2].split(":")[-1], e[3]) for e in edges}
    assert {("HAS_TOPIC", "a.py", "web", "default"), ("HAS_TOPIC", "a.py", "auth", "declared"), ("IMPORTS_FILE", "a.py", "lib.py", "resolved"), ("IMPORTS_FILE", "w%2Fx.ts", "w%2Fy.ts", "resolved"), ("DECLARES_IMPORT", "a.py", "os", "observed"), ("CHANGE_AFFECTED_FILE", "1", "old.py", "recorded")} <= kinds
    calls = [(e[1], e[2], e[5]) for e in edges if e[0] == "CALLS"]
    assert len(calls) == 2 and sum('"cross_file_import"' in c[2] for c in calls) == 1
    assert sum(e[0] == "TASK_RECORDED_CHANGE" for e in edges) == 2 and sum(e[0] == "TASK_VERIFIED_BY" for e in edges) == 1
    with pytest.raises(build.Truncated):
        build.build("main", index, parsed, meta, receipts, truncated=True)
    ends = {x for e in edges for x in e[1:3]}
    assert ends <= set(by_id)


def test_update_equals_build(spark, meta, receipts):
    after = FILES | {"lib.py": "def other():\n    pass\n", "new/__init__.py": "", "w/y.ts": "", "bad.py": "from lib import other\n\n\ndef f():\n    other()\n"}
    del after["w/x.ts"]
    changed = spark.createDataFrame([(p,) for p in sorted(set(FILES) | set(after)) if FILES.get(p) != after.get(p)], "path string")
    old = build.build("main", *reversed(tables(spark, FILES)), meta, receipts)
    new = build.updated("main", old, tables(spark, FILES), tables(spark, after), meta, receipts.filter("task_id = 'T-1'"), changed)
    whole = build.build("main", *reversed(tables(spark, after)), meta, receipts.filter("task_id = 'T-1'"))
    assert snapshot(new) == snapshot(whole)
    # a.py is as it was, but what it imports isn't: its call is gone
    assert not any(e[0] == "CALLS" and "a.py" in e[1] for e in snapshot(new)[1])
    assert {r["path"] for r in build.affected(changed, tables(spark, FILES), tables(spark, after)).collect()} >= {"a.py", "lib.py", "bad.py"}


def test_few_changes_are_folded_by_what_they_touch(spark, meta, receipts, monkeypatch):
    after = FILES | {"lib.py": "def other():\n    pass\n", "w/y.ts": ""}
    changed = spark.createDataFrame([("lib.py",), ("w/y.ts",)], "path string")
    old = build.build("main", *reversed(tables(spark, FILES)), meta, receipts)
    monkeypatch.setattr(build, "FEW", 1.0)
    new = build.updated("main", old, tables(spark, FILES), tables(spark, after), meta, receipts.filter("task_id = 'T-1'"), changed)
    assert snapshot(new) == snapshot(build.build("main", *reversed(tables(spark, after)), meta, receipts.filter("task_id = 'T-1'")))


def test_update_parses_and_tells_once(spark, sf_dir, monkeypatch):
    parsed, told, real = [], [], code.parsed_python
    monkeypatch.setattr(code, "parsed_python", lambda files: parsed.append(files.count()) or real(files))
    monkeypatch.setattr(build, "kept", lambda df, what: told.append(what) or shared.kept(df, what))
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    QUERIES["graph_build_delta"](spark, sf_dir)
    # both states share what doesn't differ; edges are told for each state, and no nodes, which nothing asks for
    assert sum(parsed) == len(ids) + sum(i % 9 == 0 for i in ids) and told.count("told") == 2
    table = shared.kept(spark.range(3), "x")
    assert shared.kept(table, "x") is table


def test_scripts_by_plain_patterns(spark):
    symbol = r"\b(?:export\s+)?(?:async\s+)?(?:function|class)\s+([A-Za-z_$][\w$]*)|\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*="
    call = r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*\("
    texts = ["", "(", "a.b.c(", "if (x) foo \n(1)(2)", "x(()y(", "export async function f(a) { g(", "export export const y = 1; constx = 2; const z\n= f.g (", "let let = 3 class K", "a$b.$c (", "\u00e9(\u00e9a(a\u00e9(", "1a(2.b(", "export async const q = 1", "function (", "a . b(c .d(", "x)y(", "var v == 2; a..b(", "words only and no end"]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["a", ".", "(", " ", "$", "1", "\n", "export ", "function ", "class ", "const ", "async ", "=", "\u00e9", "if"]) for _ in range(40)) for _ in range(300)]
    found = code.file_index(spark.createDataFrame([(f"{i}.ts", x) for i, x in enumerate(texts)], "path string, text string"))
    for r in found.collect():
        x = texts[int(r["path"][:-3])]
        assert r["symbols"] == sorted({y for z in re.findall(symbol, x) for y in z if y}), x
        assert r["calls"] == sorted(set(re.findall(call, x)) - set(code.NO_CALLS)), x


def test_digests_are_free_of_order_and_partitions(spark):
    rows = [(i % 50, random.Random(i).choice(["x", "", None, "1:x"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "a int, b string")
    one = build.table_digest(frame, ["a", "b"])
    assert one == build.table_digest(frame.repartition(7).orderBy(F.rand()), ["a", "b"]) == build.table_digest(spark.createDataFrame(rows[::-1], "a int, b string"), ["a", "b"])
    assert one != build.table_digest(frame.limit(299), ["a", "b"]) and one != build.table_digest(frame.union(frame.limit(1)), ["a", "b"])
    pair = lambda *r: build.table_digest(spark.createDataFrame([r], "a string, b string"), ["a", "b"])
    assert len({pair("x", None), pair(None, "x"), pair("x", ""), pair("x\u001f-", "y"), pair("x", "-\u001fy")}) == 5
    assert build.table_digest(frame.limit(0), ["a", "b"]).startswith("sha256:")
    pages = spark.createDataFrame([("p", "d1"), ("q", "d2")], "name string, digest string")
    assert sinks.manifest_digest(pages) == sinks.manifest_digest(pages.repartition(3)) != sinks.manifest_digest(pages.limit(1))


CHUNKS = "kind string, path string, section string, line_start int, text string"
TASKS = "task string, repo_id string, title string, area string, context_docs string, goal string, discovery string, handoff string"


@pytest.fixture(scope="module")
def packed(spark):
    chunks = spark.createDataFrame(
        [("document", "docs/adr/1.md", "Decision", 1, "a"), ("document", "docs/adr/1.md", "More", 9, "b"), ("document", "notes.md", "", 1, "n"), ("document", "README.md", "", 1, "r"), *[("document", "docs/PRD.md", f"s{i}", i, "p") for i in range(6)], ("document", "tests/x.md", "", 1, "t")],
        CHUNKS,
    )
    tasks = spark.createDataFrame(
        [("T-1", "main", "Fix GetToken", "core", "read `docs/adr/1.md`, `gone.md` and `a/../../out.md` or `docs/adr/1.md`", None, "in `repos/main/a.py`.", "x"), ("T-2", "web", None, None, "", None, " ", None), ("T-3", None, "t", None, "`notes.md`", None, "d", None)], TASKS
    )
    bundle = spark.createDataFrame([("T-1", 1, "document", "tests/x.md", "", 1, "t"), ("T-1", 2, "document", "docs/adr/1.md", "More", 9, "b"), ("T-2", 1, "document", "README.md", "", 1, "r"), ("T-3", 1, "completion_receipt", "r.json", None, 1, "r")], "task string, rank int, " + CHUNKS)
    return tasks, chunks, packs.pack(tasks, chunks, bundle)


def test_tiers(packed):
    got = [(r["task"], r["tier"], r["path"], r["section"], r["group_name"]) for r in packed[2].orderBy("task", "place").collect()]
    assert got == [
        ("T-1", 0, "docs/adr/1.md", "Decision", "must_read"), ("T-1", 0, "docs/adr/1.md", "More", "must_read"), ("T-1", 2, "tests/x.md", "", "verification_hints"),
        *[("T-2", 1, "docs/PRD.md", f"s{i}", "must_read") for i in range(4)], ("T-2", 1, "README.md", "", "must_read"),
        ("T-3", 0, "notes.md", "", "maybe_relevant"), ("T-3", 2, "r.json", None, "verification_hints"),
    ]
    problems = {(r["task"], r["code"].removeprefix("context_pack_context_doc_"), r["path"]) for r in packs.document_problems(packed[0], packed[1]).collect()}
    assert problems == {("T-1", "missing", "gone.md"), ("T-1", "outside_workspace", "a/../../out.md")}


def test_pack_warnings_and_scores(spark, packed):
    tasks, _, pack = packed
    warned = packs.warnings(tasks, pack, "main", with_graph=False)
    short = {(r["task"], r["code"].removeprefix("context_pack_")) for r in warned.collect()}
    every = {(t, c) for t in ("T-1", "T-2", "T-3") for c in ("not_authoritative", "graph_unavailable")}
    assert short == every | {("T-2", "repo_mismatch"), ("T-2", "no_structured_discovery"), ("T-3", "no_must_read")}
    required = spark.createDataFrame([("T-1", "document", "docs/adr/1.md", "Decision"), ("T-1", None, "docs/adr/1.md", ""), ("T-1", "other", "docs/adr/1.md", None), ("T-3", "", "notes.md", "")], "task string, kind string, path string, section string")
    scored = packs.scores(tasks, required, pack, warned)
    assert {r["task"]: (r["must_read_recall"], r["required"], r["warnings"]) for r in scored.collect()} == {"T-1": (0.666667, 3, 2), "T-2": (1.0, 0, 4), "T-3": (0.0, 1, 3)}
    one = packs.summary(scored).head()
    assert (one["mean_must_read_recall"], one["required"], one["warnings"]) == (0.555556, 4, 9)
    assert packs.summary(scored.limit(0)).head()["mean_must_read_recall"] == 0.0


def test_packs_by_documents(spark, monkeypatch):
    monkeypatch.setattr(packs, "DEALT", 3)  # so that both sides of the join are dealt
    chunks = spark.createDataFrame([("document", "README.md", f"s{i % 2}", i, f"r{i}") for i in range(10)] + [("document", "a.md", "", 1, "a"), ("document", "a.md", "", 1, "a")], CHUNKS)
    tasks = spark.createDataFrame([(f"T-{i}", None, None, None, "`a.md` `README.md`" if i % 2 else None, None, None, None) for i in range(20)], TASKS)
    bundle = tasks.select("task", F.lit(7).alias("rank")).join(chunks.filter("line_start in (1, 9)").distinct(), how="cross")
    plan = packs.plan(tasks, chunks, bundle)
    rows = plan.placed().orderBy("task", "place").collect()
    for task in (f"T-{i}" for i in range(20)):
        its = [r for r in rows if r["task"] == task]
        assert [r["place"] for r in its] == list(range(1, len(its) + 1)) and [r["tier"] for r in its] == sorted(r["tier"] for r in its)
        # those that name documents have all pieces, the repeated one once; the others four of README.md and what the bundle adds
        want = [("a.md", 1), *[("README.md", i) for i in range(10)]] if int(task[2:]) % 2 else [*[("README.md", i) for i in range(4)], ("README.md", 9), ("a.md", 1)]
        assert [(r["path"], r["line_start"]) for r in its[:4]] == want[:4] and {(r["path"], r["line_start"]) for r in its} == set(want) and len(its) == len(want)
    key = lambda r: (r["task"], r["path"], r["line_start"], r["text"])
    assert sorted(map(key, plan.rows().collect())) == sorted(map(key, rows))
    counted = {(r["task"], r["group_name"]): r["n"] for r in plan.counted(["group_name"]).collect()}
    assert counted == Counter((r["task"], r["group_name"]) for r in rows)


def test_packs_from_lists_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(packs, "LISTED", 3)  # so that both sides of the join are dealt
    monkeypatch.setattr(packs, "BESIDE", 2)
    chunks = spark.createDataFrame([("document", "README.md", f"s{i % 2}", i, f"r{i}") for i in range(10)] + [("document", "a.md", None, 1, "a"), ("document", "b.md", "", 1, "b")], CHUNKS)
    tasks = spark.createDataFrame([(f"T-{i}" if i else None, None, None, None, [None, "`a.md` `README.md`", "`b.md`"][i % 3], None, None, None) for i in range(30)], TASKS).withColumn("bundle", F.crc32("task") % 2)
    shared = chunks.filter("line_start in (1, 9)").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("bundle"), F.lit(7).alias("rank"), "*").filter("bundle = 0 or path <> 'b.md'")
    apart = tasks.select("task", "bundle").join(shared, "bundle").drop("bundle")
    key = lambda r: (str(r["task"]), r["tier"], r["path"], str(r["section"]), r["line_start"], r["text"], r["group_name"])
    rows, want = (packs.plan(tasks, chunks, b).rows() for b in (shared.union(shared.filter("line_start = 1")), apart))
    found = Counter(map(key, rows.collect()))
    assert found == Counter(map(key, want.collect())) and max(found.values()) == 1 and len(found) > 150
    # rows are made last: nothing of their number is joined, sorted or shuffled
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(__tasks") == 2


def test_task_seeds(spark, packed):
    rows = packs.graph_labels(packed[0].filter("task = 'T-1'")).collect()
    assert {(r["token"], r["selector"]) for r in rows} == {(x, s) for x in ("Fix", "GetToken") for s in ("callers_of", "impact_symbol")} | {("main/a.py", "impact_file")}
