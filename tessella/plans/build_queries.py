"""The graph of sources written from the documents, built whole and brought up to date; digests of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import build, code
from tessella.plans import code_queries as c
from tessella.registry import query, table
from tessella.sources.shared import kept

REPO = "main"
Sources = tuple[DataFrame, DataFrame, DataFrame, DataFrame]


def _tables(spark: SparkSession, sf_dir: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parsed and index of ``files`` (path, text), each file parsed once."""
    parsed = kept(code.parsed_python(files.filter("path like '%.py'")), "parsed")
    return parsed, kept(code.file_index(files, parsed).withColumn("classification", F.lit("indexed_only")), "index")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.modules(spark, sf_dir).unionByName(c.scripts(spark, sf_dir))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, none = table(spark, sf_dir, "documents"), F.array().cast("array<string>")
    path = F.concat(F.lit("src/d"), "doc_id", F.lit(".py"))
    return d.select(path.alias("path"), none.alias("areas"), F.array("lang").alias("policy_topics"), F.when(F.col("doc_id") % 4 == 0, F.array("source", F.lit(" "))).otherwise(none).alias("annotation_topics"))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    entry = lambda change, path, old: F.struct(F.lit(change).alias("change"), path.alias("path"), old.alias("old_path"))
    here = said("src/d", F.col("user_id") * 8, ".py")
    entries = F.array(entry("modified", here, F.lit("")), entry("renamed", here, said("old/d", F.col("user_id"), ".py")), entry("", here, F.lit("")))
    task = said("T-", F.col("event_id"))
    return e.select(task.alias("task_id"), F.lit("done").alias("status"), F.lit("").alias("task_path"), F.when(F.col("user_id") % 2 == 0, said("archive/", task)).alias("archive_path"), said("h", F.col("event_id")).alias("content_sha256"), entries.alias("changed_entries"))


_URL = "url_encode({})"
_PY, _TS = "'src/d' || doc_id || '.py'", "'web/d' || doc_id || '.ts'"
_F = "'repo:main:file:' || url_encode({})"


def _sym(kind: str, name: str, span: str) -> str:
    return f"'repo:main:symbol:python_ast:' || url_encode('python_ast:' || path || ':' || {name} || ':{kind}:' || {span})"


_SYMS = [
    ("class", "'C' || doc_id", "'6:0:11:24'"), ("method", "'C' || doc_id || '.go'", "'7:4:8:26'"), ("method", "'C' || doc_id || '.step'", "'10:4:11:24'"),
    ("function", "'f' || doc_id", "'13:0:14:' || (22 + length(doc_id::VARCHAR))"), ("function", "'g' || doc_id", "'16:0:17:' || (19 + length(source))"),
]
BASE_SQL = f"""d AS (SELECT doc_id, lang, source, {_PY} AS path, {_TS} AS ts, doc_id % 10 <> 7 AS ok, doc_id + 1 IN (SELECT doc_id FROM documents) AS followed FROM documents),
s AS ({" UNION ALL ".join(f"SELECT doc_id, path, '{k}' AS kind, {n} AS name, {_sym(k, n, span)} AS id, {span} AS span FROM d WHERE ok" for k, n, span in _SYMS)}),
t AS (SELECT 'task:T-' || event_id AS id, user_id, 'task:T-' || event_id || ':artifact:' || url_encode('archive/T-' || event_id) AS artifact, 'src/d' || (user_id * 8) || '.py' AS path, 'old/d' || user_id || '.py' AS old FROM events WHERE event_type = 'purchase')"""
_SYM_OF = "(SELECT doc_id, name, id FROM s)"
EDGES_SQL = f"""SELECT 'CONTAINS' AS kind, 'repo:main' AS src, {_F.format('p')} AS dst, 'observed' AS assertion, 'code_index' AS source FROM (SELECT path AS p FROM d UNION ALL SELECT ts FROM d)
UNION ALL SELECT 'DECLARES_IMPORT', {_F.format('path')}, 'repo:main:import-ref:python:' || url_encode(raw), 'observed', 'code_index' FROM (SELECT path, unnest(['os.path', 'src.d' || (doc_id + 1) || '.f' || (doc_id + 1)]) AS raw FROM d WHERE ok)
UNION ALL SELECT 'DECLARES_IMPORT', {_F.format('ts')}, 'repo:main:import-ref:typescript:' || url_encode('./d' || (doc_id + 1)), 'observed', 'code_index' FROM d
UNION ALL SELECT 'HAS_TOPIC', {_F.format('path')}, 'repo:main:topic:' || lang, 'default', 'metadata_policy' FROM d UNION ALL SELECT 'HAS_TOPIC', {_F.format('path')}, 'repo:main:topic:' || source, 'declared', 'metadata_annotation' FROM d WHERE doc_id % 4 = 0
UNION ALL SELECT 'DEFINES', {_F.format('path')}, id, 'resolved', 'python_ast' FROM s UNION ALL SELECT 'ANCHORS', id, 'repo:main:anchor:python_ast:' || url_encode(path) || ':' || url_encode(span), 'resolved', 'python_ast' FROM s
UNION ALL SELECT 'CALLS', a.id, b.id, 'resolved', 'python_ast' FROM {_SYM_OF} AS a JOIN {_SYM_OF} AS b ON (a.name = 'C' || a.doc_id || '.go' AND b.name = 'C' || a.doc_id || '.step') OR (a.name = 'f' || a.doc_id AND (b.name = 'g' || a.doc_id OR b.name = 'f' || (a.doc_id + 1)))
UNION ALL SELECT 'RESOLVES_TO', 'repo:main:import-ref:python:' || url_encode('src.d' || (doc_id + 1) || '.f' || (doc_id + 1)), {_F.format("'src/d' || (doc_id + 1) || '.py'")}, 'resolved', 'python_import_resolver' FROM d WHERE ok AND followed
UNION ALL SELECT 'IMPORTS_FILE', {_F.format('path')}, {_F.format("'src/d' || (doc_id + 1) || '.py'")}, 'resolved', 'python_import_resolver' FROM d WHERE ok AND followed
UNION ALL SELECT 'RESOLVES_TO', 'repo:main:import-ref:typescript:' || url_encode('./d' || (doc_id + 1)), {_F.format("'web/d' || (doc_id + 1) || '.ts'")}, 'resolved', 'js_ts_relative_import_resolver' FROM d WHERE followed
UNION ALL SELECT 'IMPORTS_FILE', {_F.format('ts')}, {_F.format("'web/d' || (doc_id + 1) || '.ts'")}, 'resolved', 'js_ts_relative_import_resolver' FROM d WHERE followed
UNION ALL SELECT 'TASK_VERIFIED_BY', id, artifact, 'recorded', 'task_completion' FROM t WHERE user_id % 2 = 0 UNION ALL SELECT 'TASK_RECORDED_CHANGE', id, id || ':change:' || k, 'recorded', 'task_completion' FROM t, (SELECT unnest([0, 1]) AS k)
UNION ALL SELECT 'CHANGE_AFFECTED_FILE', id || ':change:' || k, {_F.format('path')}, 'recorded', 'task_completion' FROM t, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT 'CHANGE_AFFECTED_FILE', id || ':change:1', {_F.format('old')}, 'recorded', 'task_completion' FROM t"""
NODES_SQL = f"""SELECT 'repo:main' AS id, 'repository' AS kind, FALSE AS mentioned UNION ALL SELECT {_F.format('p')}, 'file', FALSE FROM (SELECT path AS p FROM d UNION ALL SELECT ts FROM d)
UNION ALL SELECT DISTINCT 'repo:main:import-ref:python:' || url_encode(raw), 'import_ref', FALSE FROM (SELECT unnest(['os.path', 'src.d' || (doc_id + 1) || '.f' || (doc_id + 1)]) AS raw FROM d WHERE ok)
UNION ALL SELECT 'repo:main:import-ref:typescript:' || url_encode('./d' || (doc_id + 1)), 'import_ref', FALSE FROM d UNION ALL SELECT DISTINCT 'repo:main:topic:' || x, 'topic', FALSE FROM (SELECT lang AS x FROM d UNION SELECT source FROM d WHERE doc_id % 4 = 0)
UNION ALL SELECT id, 'symbol', FALSE FROM s UNION ALL SELECT 'repo:main:anchor:python_ast:' || url_encode(path) || ':' || url_encode(span), 'anchor', FALSE FROM s UNION ALL SELECT id, 'task', FALSE FROM t UNION ALL SELECT artifact, 'artifact', FALSE FROM t WHERE user_id % 2 = 0
UNION ALL SELECT id || ':change:' || k, 'change_event', FALSE FROM t, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT DISTINCT {_F.format('p')}, 'file', TRUE FROM (SELECT path AS p FROM t UNION SELECT old FROM t) WHERE p NOT IN (SELECT path FROM d)"""


def _whole(spark: SparkSession, sf_dir: str) -> build.Graph:
    parsed, index = _tables(spark, sf_dir, _files(spark, sf_dir))
    return build.build(REPO, index, parsed, _metadata(spark, sf_dir), _receipts(spark, sf_dir))


def _updated(spark: SparkSession, sf_dir: str) -> build.Graph:
    """From a state without one file in nine, and another in nine broken, to the present one."""
    now = _files(spark, sf_dir)
    ninth = F.regexp_extract("path", r"d(\d+)\.", 1).try_cast("long") % 9
    after = _tables(spark, sf_dir, now)
    # files that don't differ between the states are parsed once
    broken = _tables(spark, sf_dir, now.filter(ninth == 0).withColumn("text", F.lit("def (:")))
    before = tuple(kept(x.filter(~ninth.isin(0, 1)).unionByName(y), "before") for x, y in zip(after, broken, strict=True))
    old = build.build(REPO, before[1], before[0], _metadata(spark, sf_dir), _receipts(spark, sf_dir).filter("task_id < 'T-5'"))
    return build.updated(REPO, old, before, after, _metadata(spark, sf_dir), _receipts(spark, sf_dir), after[1].filter(ninth.isin(0, 1)).select("path"))


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "kind", F.contains("facts", F.lit("present_in_current_inventory")).alias("mentioned"))


@query("graph_build_edges", f"WITH {BASE_SQL} {EDGES_SQL}")
def graph_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).edges.drop("facts")


@query("graph_build_nodes", f"WITH {BASE_SQL} {NODES_SQL}")
def graph_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_whole(spark, sf_dir).nodes)


@query("graph_build_delta", f"WITH {BASE_SQL} {EDGES_SQL}")
def graph_build_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).edges.drop("facts")


@query("graph_build_delta_nodes", f"WITH {BASE_SQL} {NODES_SQL}")
def graph_build_delta_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_updated(spark, sf_dir).nodes)


def _told(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE length({column}::VARCHAR) || ':' || {column}::VARCHAR END"


@query("snapshot_digest", f"""WITH r AS (SELECT sha256(concat_ws(chr(31), {", ".join(map(_told, ("doc_id", "lang", "source", "text")))})) AS h FROM documents), a AS (SELECT h[1:4] AS at4, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM r GROUP BY 1),
b AS (SELECT at4[1:2] AS at2, sha256(string_agg(at4 || ':' || h, chr(10) ORDER BY at4 || ':' || h)) AS h FROM a GROUP BY 1) SELECT 'sha256:' || sha256(string_agg(at2 || ':' || h, chr(10) ORDER BY at2 || ':' || h)) AS digest FROM b""")
def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.digest_tree(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "text"])
