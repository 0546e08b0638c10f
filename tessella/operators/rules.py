"""Rule tables of retrieval and policy as data, and the expressions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as t

# Words left out of questions.
STOPWORDS = ["a", "an", "and", "after", "are", "does", "file", "files", "for", "from", "function", "functions", "how", "if", "impact", "impacted", "is", "of", "the", "to", "what", "why", "change", "changed", "changes"]

# Words left out of questions to the knowledge records.
KNOWLEDGE_STOPWORDS = ["a", "an", "and", "are", "for", "from", "how", "is", "of", "the", "to", "what", "why"]

# A term that holds the needle adds the others.
SYNONYMS = {
    "authority": ["authoritative", "source"],
    "authorities": ["authority", "authoritative", "source"],
    "evidence": ["source", "provenance"],
    "non-authoritative": ["authority", "authoritative", "read-only", "derived"],
    "권위": ["authority", "authoritative", "source"],
    "비권위": ["non-authoritative", "authority", "authoritative"],
    "파생": ["derived", "snapshot"],
    "근거": ["evidence", "source"],
    "계약": ["contract", "invariant"],
    "결정": ["decision", "adr"],
    "검증": ["verification", "receipt"],
}

# Prior of a piece of evidence by the first rule it meets: (column, test, value, section or None, prior).
AUTHORITY = [
    ("path", "prefix", "docs/contracts/", None, 0.45),
    ("path", "prefix", "docs/adr/", "decision", 0.5),
    ("path", "prefix", "docs/adr/", None, 0.4),
    ("kind", "equal", "completion_receipt", None, 0.35),
    ("kind", "equal", "task_artifact", None, 0.3),
    ("path", "equal", "AGENTS.md", None, 0.45),
    ("path", "equal", "README.md", None, 0.25),
    ("path", "prefix", "docs/workflows/", None, 0.2),
    ("kind", "prefix", "graph_", None, 0.05),
]
ANY_AUTHORITY = 0.1


def authority(path: Column, kind: Column, section: Column) -> Column:
    of = {"path": path, "kind": kind}
    met = []
    for column, test, value, in_section, prior in AUTHORITY:
        holds = of[column].startswith(value) if test == "prefix" else of[column] == value
        met.append(F.when(holds if in_section is None else holds & (F.lower(section) == in_section), prior))
    return F.coalesce(*met, F.lit(ANY_AUTHORITY))


def synonyms(spark: SparkSession) -> DataFrame:
    """needle, term"""
    return spark.createDataFrame([(needle, x) for needle, others in SYNONYMS.items() for x in others], "needle string, term string")


def first_class(path: Column, classes: list[tuple[str, list[str]]], other: str) -> Column:
    """Name of the first class one of whose patterns the path meets."""
    name = t.surface_name(path)
    found = []
    for label, patterns in classes:
        meets = F.lit(False)
        for p in patterns:
            meets = meets | t.within_surface(name, p.lstrip("./"))
        found.append(F.when(meets, label))
    return F.coalesce(*found, F.lit(other))


def repository_of(path: Column) -> Column:
    """Repository that a graph reference ``<graph:repo:ID:...>`` names, else null."""
    raw = F.regexp_extract(path, r"^<graph:repo:([^:>]+)", 1)
    return F.when(raw != "", F.url_decode(raw))


def leaks(results: DataFrame, expected: Column) -> DataFrame:
    """Results (repo_id, path) of another repository than expected, by their own field or by their reference."""
    repo = F.coalesce(F.when(F.col("repo_id") != "", F.col("repo_id")), repository_of(F.col("path")))
    return results.filter(repo.isNotNull() & (repo != expected))
