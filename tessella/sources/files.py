"""Sources: file trees, documents with frontmatter and sections, JSON records and logs, digest-checked artifacts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions import text as t


def scan(spark: SparkSession, root: str, skip_dirs: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """path (below root), length, content of all files below ``root`` without those in directories of a name to skip."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    below = F.regexp_replace("path", rf"^.*?{re.escape(root.rstrip('/'))}/", "")
    files = files.select(below.alias("path"), "length", "content")
    if skip_dirs:
        inside = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
        files = files.filter(~F.arrays_overlap(inside, F.array(*map(F.lit, skip_dirs))))
    return files


def texts(files: DataFrame) -> DataFrame:
    """path, text, digest; files that aren't UTF-8 have null text."""
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    return files.select("path", text.alias("text"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))


def scan_documents(spark: SparkSession, root: str, globs: list[str], skip_dirs: list[str]) -> DataFrame:
    """Documents that fit any of the patterns, each once."""
    files = scan(spark, root, skip_dirs)
    return texts(files.filter(t.glob_any(F.col("path"), globs)))


def frontmatter(docs: DataFrame) -> DataFrame:
    """``docs`` (path, text) with ``meta`` (map of the leading --- block's ``key: value`` lines) and ``body``."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    key = lambda x: F.trim(F.regexp_extract(x, r"^([^:]*):", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return docs.withColumn("meta", last).withColumn("body", F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n|\z)", ""))


def list_value(value: Column) -> Column:
    """``[a, b]`` as an array."""
    inside = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), r"^(['\"])(.*)\1$", "$2")), lambda x: x != "")


SECTION = "path string, title string, line_start int, line_end int, content string"


def sections(docs: DataFrame) -> DataFrame:
    """``## `` sections of ``docs`` (path, text). Headings inside fences of backticks or tildes are text."""

    def one(path: str, text: str) -> Iterator[tuple]:
        fence, title, start, held = None, None, 0, []
        lines = text.split("\n")
        for n, line in enumerate([*lines, None], 1):
            mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line or "")
            if mark and fence is None:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            elif line is None or (fence is None and line.startswith("## ")):
                if title is not None:
                    yield path, title, start, n - 1, "\n".join(held)
                title, start, held = (line or "")[3:].strip(), n, []
                continue
            held.append(line)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in one(path, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION.split(", ")])

    return docs.select("path", "text").mapInPandas(run, SECTION)


def json_log(spark: SparkSession, path: str, schema: StructType | str, strict: bool) -> DataFrame:
    """Lines of JSON; a bad line stops a strict read and is left out otherwise."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def last_lines(log: DataFrame, seq: str, n: int) -> DataFrame:
    return log.orderBy(F.col(seq).desc()).limit(n)


def json_records(spark: SparkSession, path: str, schema: StructType | str, repo_id: str | None = None) -> DataFrame:
    """One JSON object a file, of one repository where given."""
    records = spark.read.schema(schema).option("multiLine", True).json(path)
    return records.filter(F.col("repo_id") == repo_id) if repo_id is not None else records


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(text: Column, without: tuple[str, ...] = ()) -> Column:
    """sha256 of a JSON text in canonical form, some keys of the top object left out; null for bad JSON."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                data = json.loads(x)
            except (TypeError, ValueError):
                return None
            if isinstance(data, dict):
                data = {k: v for k, v in data.items() if k not in without}
            return "sha256:" + hashlib.sha256(canonical_json(data).encode()).hexdigest()

        return values.map(one)

    return digest(text)


def verified(artifacts: DataFrame, digest_key: str) -> tuple[DataFrame, DataFrame]:
    """Artifacts (path, text) whose digest field fits their content, and problems of the others."""
    named = F.get_json_object("text", f"$.{digest_key}")
    told = artifacts.withColumn("told", named).withColumn("is", canonical_digest(F.col("text"), (digest_key,)))
    code = F.when(F.col("is").isNull(), "artifact_unreadable").when(F.col("told").isNull(), "artifact_digest_missing").when(F.col("told") != F.col("is"), "artifact_digest_mismatch")
    told = told.withColumn("code", code)
    return told.filter("code is null").select("path", "text"), told.filter("code is not null").select("code", "path")


def shards(spark: SparkSession, root: str) -> DataFrame:
    """shard, path, and the mark of every annotation in the JSON map of each shard file."""
    kind = "struct<annotations: map<string, struct<role: string, purpose: string, topics: array<string>, declared_effects: array<string>, caution: array<string>>>>"
    files = texts(scan(spark, root, pattern="*.json"))
    read = files.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("shard"), F.from_json("text", kind).alias("j"))
    return read.select("shard", F.explode("j.annotations").alias("path", "mark")).select("shard", "path", "mark.*")


def evidence(*frames: DataFrame) -> DataFrame:
    """Union of evidence (kind, path, section, line_start, line_end, text)."""
    return reduce(DataFrame.unionByName, frames)


def whole_text(docs: DataFrame, kind: str) -> DataFrame:
    """A document as one piece of evidence."""
    lines = F.greatest(F.lit(1), F.size(F.split("text", "\n"))).alias("line_end")
    return docs.select(F.lit(kind).alias("kind"), "path", F.lit("").alias("section"), F.lit(1).alias("line_start"), lines, "text")


def nodes_as_documents(nodes: DataFrame) -> DataFrame:
    """Graph nodes (id, kind, and path, name, provider_symbol_id where there are any) as evidence: their JSON, under ``<graph:id>``.

    The section is the kind and what names the node: a file's path, a topic's or task's name, a symbol's provider id, else the id.
    """
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    kind = F.col("kind")
    label = F.when(kind == "file", has("path")).when(kind.isin("topic", "task"), has("name")).when(kind == "symbol", has("provider_symbol_id"))
    section = F.concat_ws(" ", F.coalesce(kind, F.lit("node")), F.coalesce(F.nullif(label, F.lit("")), "id"))
    path = F.concat(F.lit("<graph:"), "id", F.lit(">"))
    return nodes.select(
        F.lit("graph_node").alias("kind"), path.alias("path"), section.alias("section"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.to_json(F.struct(*sorted(nodes.columns))).alias("text")
    )


def target_state(wanted: DataFrame, present: DataFrame, force: bool) -> DataFrame:
    """path, state of files to be written: created, unchanged, overwritten or conflict."""
    here = present.select("path", F.col("digest").alias("now"))
    other = F.lit("overwritten" if force else "conflict")
    state = F.when(F.col("now").isNull(), "created").when(F.col("now") == F.col("digest"), "unchanged").otherwise(other)
    return wanted.join(here, "path", "left").select("path", state.alias("state"))
