"""Code queries over source files that Spark writes from the documents: a Python module and a script for each, one module in ten broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import code
from tessella.registry import query, table
from tessella.sources.shared import kept

#: A module of document {i}, whose words it holds as a comment: it imports from the next one's module and calls it.
MODULE = """import os.path
from src.d{next} import f{next} as before

# {words}

class C{i}:
    def go(self):
        return self.step()

    def step(self):
        return before(1)

def f{i}():
    return g{i}(before())

def g{i}():
    return open('{source}')
"""
BROKEN = "def (:\n# {words}\n"
SCRIPT = "import {x} from './d{next}';\nexport function h{i}() { return fetch('{source}'); }\nconst k = h{i}();\n// {words}\n"
OK_SQL = "d AS (SELECT doc_id, 'src/d' || doc_id || '.py' AS path FROM documents WHERE doc_id % 10 <> 7)"


def _filled(template: str) -> Column:
    """The template as a column of documents (doc_id, source, text)."""
    words = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")
    out = F.lit(template)
    for name, value in {"i": F.col("doc_id"), "next": F.col("doc_id") + 1, "source": F.col("source"), "words": words}.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt evenly: however the table's files are cut, all tasks write and parse sources."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition("doc_id")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select(F.concat(F.lit("src/d"), "doc_id", F.lit(".py")).alias("path"), F.when(F.col("doc_id") % 10 == 7, _filled(BROKEN)).otherwise(_filled(MODULE)).alias("text"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.concat(F.lit("web/d"), "doc_id", F.lit(".ts")).alias("path"), _filled(SCRIPT).alias("text"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = modules(spark, sf_dir)
    parsed = kept(code.parsed_python(files), "parsed")  # read many times
    return parsed, code.resolved_python(parsed.filter("kind = 'import'").select("path", "module", "name", "alias", "level"), files)


_SYMBOLS = [("class", "'C' || doc_id", 6, 11), ("method", "'C' || doc_id || '.go'", 7, 8), ("method", "'C' || doc_id || '.step'", 10, 11), ("function", "'f' || doc_id", 13, 14), ("function", "'g' || doc_id", 16, 17)]


@query("ast_symbols", f"WITH {OK_SQL} " + " UNION ALL ".join(f"SELECT path, '{k}' AS kind, {n} AS qualified_name, CAST({a} AS INTEGER) AS start_line, CAST({b} AS INTEGER) AS end_line FROM d" for k, n, a, b in _SYMBOLS))
def ast_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.parsed_python(modules(spark, sf_dir)).filter("kind in ('class', 'function', 'method')").select("path", "kind", "qualified_name", "start_line", "end_line")


@query("ast_files", "SELECT 'src/d' || doc_id || '.py' AS path, CASE WHEN doc_id % 10 = 7 THEN 'error' ELSE 'ok' END AS parse_status FROM documents")
def ast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.parsed_python(modules(spark, sf_dir)).filter("kind = 'file'").select("path", "parse_status")


@query("ast_calls", f"""WITH {OK_SQL} SELECT path, 'C' || doc_id || '.go' AS caller, path AS target_path, 'C' || doc_id || '.step' AS target FROM d UNION ALL SELECT path, 'f' || doc_id, path, 'g' || doc_id FROM d
UNION ALL SELECT a.path, 'f' || a.doc_id, b.path, 'f' || b.doc_id FROM d AS a JOIN d AS b ON b.doc_id = a.doc_id + 1""")
def ast_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.calls(*_resolved(spark, sf_dir))


@query("ast_imports", f"WITH {OK_SQL} SELECT d.path, 'before' AS alias, 'src/d' || n.doc_id || '.py' AS target FROM d JOIN documents AS n ON n.doc_id = d.doc_id + 1")
def ast_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[1].select("path", "alias", "target")


@query("script_imports", "SELECT 'web/d' || d.doc_id || '.ts' AS path, './d' || n.doc_id AS raw, 'web/d' || n.doc_id || '.ts' AS target FROM documents AS d JOIN documents AS n ON n.doc_id = d.doc_id + 1")
def script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scripts(spark, sf_dir)
    return code.resolved_scripts(code.script_imports(files), files)


_JOINED = "array_to_string(list_sort([{}]), ',')"
_I, _N = "doc_id", "(doc_id + 1)"


@query("file_index", f"""SELECT 'src/d' || doc_id || '.py' AS path, 'python' AS language, CASE WHEN b THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN b THEN '' ELSE {_JOINED.format("'C' || doc_id, 'f' || doc_id, 'g' || doc_id, 'go', 'step'")} END AS symbols,
CASE WHEN b THEN '' ELSE 'os.path,src.d' || {_N} || '.f' || {_N} END AS imports, CASE WHEN b THEN '' ELSE {_JOINED.format("'before', 'g' || doc_id, 'open', 'self.step'")} END AS calls, CASE WHEN b THEN '' ELSE 'os,src' END AS packages, CASE WHEN b THEN '' ELSE 'fs' END AS effects FROM (SELECT doc_id, doc_id % 10 = 7 AS b FROM documents)
UNION ALL SELECT 'web/d' || doc_id || '.ts', 'typescript', 'ok', 'h' || doc_id || ',k', './d' || {_N}, 'fetch,h' || doc_id, '', 'net' FROM documents UNION ALL SELECT 'notes/' || doc_id || '.md', 'markdown', 'skipped', '', '', '', '', '' FROM documents""")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("path"), "text")
    found = code.file_index(modules(spark, sf_dir).unionByName(scripts(spark, sf_dir)).unionByName(notes))
    return found.select("path", "language", "status", *[F.array_join(c, ",").alias(c) for c in ("symbols", "imports", "calls", "packages", "effects")])
