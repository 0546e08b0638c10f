"""The code index as graph parts: facts, symbol names, edges of calls and resolved imports, what an index run tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that discovery hides; parse states that a summary counts.
HIDDEN = ["excluded", "excluded_override", "orphan_annotation", "orphan_exclusion"]
STATES = ["ok", "skipped", "parse_error"]
EDGE_KEY = ["kind", "src", "dst", "assertion", "source"]


def nonblank(text: Column) -> Column:
    """Whether a text holds anything but white space; false for null."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def trimmed(text: Column) -> Column:
    """The text without white space around it; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")


def first_given(*texts: Column) -> Column:
    """The first text that is neither null nor empty; empty without any."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in texts], F.lit(""))


def visible(files: DataFrame) -> DataFrame:
    """Files that discovery shows."""
    return files.filter(~F.coalesce(F.col("classification").isin(HIDDEN), F.lit(False)))


def limited(files: DataFrame, limit: int) -> DataFrame:
    """Files by path, at most ``limit`` of them; all where it is negative."""
    ordered = files.orderBy("path")
    return ordered if limit < 0 else ordered.limit(limit)


def index_summary(files: DataFrame, limit: int) -> DataFrame:
    """One row: total, returned, truncated, dropped_count, and a count for each parse state among those returned."""
    n, none = F.count(F.lit(1)), F.lit(0).cast("long")
    whole = files.agg(n.alias("total"), *[none.alias(c) for c in ("returned", *STATES)])
    shown = limited(files, limit).agg(none.alias("total"), n.alias("returned"), *[F.count_if(F.col("parse_status") == s).alias(s) for s in STATES])
    both = whole.union(shown).agg(*[F.sum(c).alias(c) for c in ("total", "returned", *STATES)])
    missing = F.col("total") - F.col("returned")
    return both.select("total", "returned", (missing > 0).alias("truncated"), missing.alias("dropped_count"), *STATES)


def sorted_distinct(values: Column) -> Column:
    """Values that aren't blank, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, nonblank)))


def annotation_payload(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """path and the given keys; those that are lists sorted and without repeats."""
    lists = {f.name for f in annotations.schema if f.dataType.typeName() == "array"}
    return annotations.select("path", *[sorted_distinct(F.col(k)).alias(k) if k in lists else F.col(k) for k in keys])


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files with the facts noted for their path, null where there are none."""
    return files.join(metadata, "path", "left")


def symbol_target(s: Column) -> Column:
    """Id of a symbol target (struct id, provider, provider_symbol_id, path, qualified_name, name): its own, else provider and its id there, else path and name, else empty."""
    part = {k: trimmed(s[k]) for k in ("id", "provider", "provider_symbol_id", "path")}
    name = trimmed(first_given(s["qualified_name"], s["name"]))
    joined = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(":"), b))
    return F.coalesce(F.when(part["id"] != "", part["id"]), joined(part["provider"], part["provider_symbol_id"]), joined(part["path"], name), F.lit(""))


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """CALLS edges of ``calls`` (caller, callee, source) between nodes of ``symbols`` (symbol, id); calls without both nodes go."""
    end = lambda column, name: symbols.select(F.col("symbol").alias(column), F.col("id").alias(name))
    met = calls.join(end("caller", "src"), "caller").join(end("callee", "dst"), "callee")
    return met.select(F.lit("CALLS").alias("kind"), "src", "dst", F.lit("resolved").alias("assertion"), "source")


def resolution_edges(resolutions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ``resolutions`` (importer, import_ref, target, source) all of whose nodes (id) exist.

    The import resolves to the target and the importer imports it; each edge key once.
    """
    for end in ("importer", "target", "import_ref"):
        resolutions = resolutions.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    edge = lambda kind, src: F.struct(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col("target").alias("dst"), F.lit("resolved").alias("assertion"), F.col("source").alias("source"))
    return resolutions.select(F.explode(F.array(edge("RESOLVES_TO", "import_ref"), edge("IMPORTS_FILE", "importer"))).alias("e")).select("e.*").dropDuplicates(EDGE_KEY)


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*EDGE_KEY)
