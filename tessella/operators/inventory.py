"""Inventory of files under a policy: classes, counts, strays, facets, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessella.functions import text as t
from tessella.operators import index
from tessella.operators.retrieval import small

#: Classes in order of precedence.
CLASSES = ("excluded", "excluded_override", "annotated", "annotation_required", "indexed_only")


def classify(files: DataFrame, annotations: DataFrame, exclusions: DataFrame, excluded: Column, required: Column) -> DataFrame:
    """``files`` (path, ...) with their class. ``excluded`` and ``required`` are policy tests of a file's columns."""
    marked = files.join(annotations.select("path").distinct().withColumn("annotated", F.lit(True)), "path", "left")
    marked = marked.join(exclusions.select("path").distinct().withColumn("listed", F.lit(True)), "path", "left")
    known, listed = F.coalesce("annotated", F.lit(False)), F.coalesce("listed", F.lit(False))
    tests = (excluded, listed, known, required, F.lit(True))
    kind = F.coalesce(*[F.when(test, name) for name, test in zip(CLASSES, tests, strict=True)])
    return marked.withColumn("classification", kind).drop("annotated", "listed")


def counts(classified: DataFrame, names: list[str]) -> DataFrame:
    """Number of files for each of ``names``, zero included, and in total."""
    spark = classified.sparkSession
    n = classified.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    keys = spark.createDataFrame([(x,) for x in names], "classification string")
    total = classified.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("classification"), "n")
    return F.broadcast(keys).join(n, "classification", "left").select("classification", F.coalesce("n", F.lit(0).cast("long")).alias("n")).union(total)


def strays(marks: DataFrame, files: DataFrame) -> DataFrame:
    """Marks whose file isn't there."""
    return marks.join(files.select("path").distinct(), "path", "left_anti")


def moved(changes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Changes whose old path is annotated: where the annotation may have to go."""
    return changes.join(annotations.select(F.col("path").alias("old_path")).distinct(), "old_path", "left_semi")


def glob_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Each of ``files`` (path) with each of ``rules`` (pattern: a glob) that it meets.

    A rule waits at the folder that its beginning names before any wildcard; a path meets the rules of the folders it lies in
    by equality, and only those are tested in full.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    waiting = rules.withColumn("__folder", F.regexp_extract("pattern", r"^([^*?\[]*/)?", 1)).withColumn("__regex", t.glob_regex_of(F.col("pattern")))
    met = files.withColumn("__folder", F.explode(folders)).join(waiting, "__folder")
    return met.filter(F.rlike("path", F.col("__regex"))).drop("__folder", "__regex")


def first_reason(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The reason of the first of ``rules`` (ord, pattern: a glob, reason) that a path meets."""
    return glob_matches(files, rules).groupBy("path").agg(F.min_by("reason", "ord").alias("reason"))


def topics(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path, topics: the topics of all rules (ord, pattern: a glob, topic) a path meets, in rule order."""
    found = F.array_sort(F.collect_list(F.struct("ord", "topic")))
    return glob_matches(files, rules).groupBy("path").agg(F.array_join(F.array_distinct(F.transform(found, lambda x: x["topic"])), ",").alias("topics"))


#: Points of each value met (or of being listed at all, where nothing is asked), and of an annotated file.
MET_POINTS, LISTED_POINTS = 10, 5


def facets(files: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Visible files that have, for every facet, one of the values wanted, by lower case; lists may meet several.

    The score counts each value met, or one where nothing is asked. Facets without values ask for nothing.
    """
    if "classification" in files.columns:
        files = index.visible(files)
    met, asked = F.lit(0), False
    for column, values in wanted.items():
        values = sorted({str(v).strip().lower() for v in values} - {""})
        if not values:
            continue
        held = F.col(column) if isinstance(files.schema[column].dataType, ArrayType) else F.array(F.col(column))
        held = F.transform(F.coalesce(held.cast("array<string>"), F.array().cast("array<string>")), lambda x: F.lower(x))
        shared = F.size(F.array_intersect(held, F.array(*map(F.lit, values))))
        files, met, asked = files.filter(shared > 0), met + shared, True
    signals = met if asked else F.lit(1)
    return files.withColumn("score", (signals * MET_POINTS + F.when(F.col("annotated"), LISTED_POINTS).otherwise(0)).cast("long"))


#: Points of a word in the base name, else in the path; in the annotation; in the policy's defaults; of an annotated file with points.
BASE_POINTS, PATH_POINTS, NOTE_POINTS, DEFAULT_POINTS, ANNOTATED_POINTS = 8, 5, 10, 4, 3


def suggest(files: DataFrame, tokens: DataFrame, limit: int) -> DataFrame:
    """Files by how whole words of their path, annotation and policy defaults meet ``tokens`` (token, a question's few words).

    files: path, annotated; note (text of the annotation) and defaults (text) where there are any. Words are joined by equality.
    """
    none = F.array().cast("array<string>")
    base, path = t.identifier_tokens(F.element_at(F.split("path", "/"), -1)), t.identifier_tokens(F.col("path"))
    note = F.when(F.col("annotated"), t.identifier_tokens(F.col("note"))) if "note" in files.columns else none
    defaults = t.identifier_tokens(F.col("defaults")) if "defaults" in files.columns else none
    pointed = lambda words, n: F.transform(F.coalesce(words, none), lambda x: F.struct(x.alias("token"), F.lit(n).alias("points")))
    each = F.concat(pointed(base, BASE_POINTS), pointed(F.array_except(path, base), PATH_POINTS), pointed(note, NOTE_POINTS), pointed(defaults, DEFAULT_POINTS))
    words = files.select("path", "annotated", F.inline(each)).join(small(tokens.distinct()), "token")
    scored = words.groupBy("path", "annotated").agg(F.sum("points").alias("score"))
    scored = scored.withColumn("score", F.col("score") + F.when(F.col("annotated"), ANNOTATED_POINTS).otherwise(0))
    return scored.orderBy(F.col("score").desc(), "path").limit(max(0, limit))


def pattern_overlaps(patterns: DataFrame) -> DataFrame:
    """a, b: pairs of ``patterns`` (pattern; a before b) that overlap: one is met by the other as a name, or the literal folder of one lies in the other's.

    Candidates by equality: what begins alike is found by the beginnings of one among the heads of the other.
    """
    every = patterns.select("pattern").distinct()
    head = F.regexp_extract("pattern", r"^([^*?\[]*)", 1)
    prefix = F.when(F.contains(head, F.lit("/")), F.regexp_extract(head, r"^(.*/)", 1)).otherwise(head)
    starts = lambda x, least: F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length(x), F.lit(least))), lambda n: F.substring(x, F.lit(1), n)))
    folders = every.withColumn("prefix", prefix).filter("prefix <> ''")
    inside = folders.select(F.col("pattern").alias("x"), starts(F.col("prefix"), 1).alias("prefix")).join(folders.withColumnRenamed("pattern", "y"), "prefix").select("x", "y")
    globs = every.select(F.col("pattern").alias("y"), head.alias("head"), t.glob_regex_of(F.col("pattern")).alias("regex"))
    met = every.select(F.col("pattern").alias("x"), starts(F.col("pattern"), 0).alias("head")).join(globs, "head").filter(F.rlike("x", F.col("regex"))).select("x", "y")
    pairs = inside.union(met).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def first_shard(marks: DataFrame) -> DataFrame:
    """One mark a path, of the first shard, with the number of shards that hold the path."""
    place = Window.partitionBy("path").orderBy("shard")
    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    return marks.withColumn("shards", n).withColumn("__p", F.row_number().over(place)).filter("__p = 1").drop("__p")
