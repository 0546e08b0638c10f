"""Property graph: selectors, bounded walks, counts. ``edges`` (kind, src, dst), ``nodes`` (id, kind, name).

Walks are level by level: a level joins the frontier with the edges it may take and drops nodes met before by an
anti join, so each level shuffles only the frontier and its edges. Null ends never match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLS, IMPORTS_FILE, DEFINES, HAS_TOPIC, DECLARES_IMPORT, RESOLVES_TO = "CALLS", "IMPORTS_FILE", "DEFINES", "HAS_TOPIC", "DECLARES_IMPORT", "RESOLVES_TO"


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids`` (id), each once."""
    ids = ids.select(F.col("id").alias("__id")).distinct()
    touched = F.explode(F.array_distinct(F.array("src", "dst")))
    return edges.withColumn("__end", touched).join(ids, F.col("__end") == F.col("__id"), "left_semi").drop("__end").dropDuplicates(["kind", "src", "dst"])


def into(edges: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Edges of ``kind`` that end in ``ids``."""
    return edges.filter(F.col("kind") == kind).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def out_of(edges: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Edges of ``kind`` that begin in ``ids``."""
    return edges.filter(F.col("kind") == kind).join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def callers_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return into(edges, CALLS, symbols)


def callees_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return out_of(edges, CALLS, symbols)


def import_edges(edges: DataFrame, nodes: DataFrame, raw_import: Column) -> DataFrame:
    """Declaring and resolving edges of import references whose name equals ``raw_import``."""
    refs = nodes.filter((F.col("kind") == "import_ref") & (F.col("name") == raw_import)).select("id")
    return incident(edges.filter(F.col("kind").isin(DECLARES_IMPORT, RESOLVES_TO)), refs)


def select_symbol(symbols: DataFrame, name: str, in_file: str | None = None) -> DataFrame:
    """Symbols of that name or qualified name, with ``n_matches`` and whether the choice is ``ambiguous``."""
    found = symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name))
    if in_file is not None:
        found = found.filter(F.col("path") == in_file)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return found.withColumn("n_matches", n).withColumn("ambiguous", F.col("n_matches") > 1)


def path_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends and a reason."""
    end = lambda x: nodes.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name"))
    reason = F.concat_ws(" ", F.col("src_name"), F.lower(F.col("kind")), F.col("dst_name"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").withColumn("reason", reason)


def impact_steps(edges: DataFrame) -> DataFrame:
    """What a change reaches in one step: (at, next, kind, rank). Callers, importers, definitions in both directions."""
    step = lambda kind, at, to, rank: edges.filter(F.col("kind") == kind).select(F.col(at).alias("at"), F.col(to).alias("next"), "kind", F.lit(rank).alias("rank"))
    return reduce(DataFrame.unionByName, [step(CALLS, "dst", "src", 0), step(IMPORTS_FILE, "dst", "src", 1), step(DEFINES, "src", "dst", 2), step(DEFINES, "dst", "src", 3)])


def walk(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, depth: nodes within ``depth`` steps of ``seeds`` (id), at their least distance. Ends early where nothing is new."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        new = steps.join(frontier.select(F.col("id").alias("at")), "at").select(F.col("next").alias("id")).distinct()
        frontier = new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level))
        if level < depth:  # each level reads it again: once to go on, once to leave out what was met
            frontier = frontier.persist()
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return walk(impact_steps(edges), seeds, depth)


def impact_paths(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Every step out of a node reached below ``depth``: (src, dst, kind, depth), a step met on two levels twice.

    A definition both of whose ends are on one level is stepped from the definer only.
    """
    at = reached.filter(F.col("depth") < depth).select(F.col("id").alias("at"), (F.col("depth") + 1).alias("depth"))
    told = at.select(F.col("at").alias("next"), "depth", F.lit(3).alias("rank"))
    steps = impact_steps(edges).join(at, "at").join(told, ["next", "depth", "rank"], "left_anti")
    return steps.select(F.col("at").alias("src"), F.col("next").alias("dst"), "kind", "depth")


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` undirected steps."""
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).union(edges.select(F.col("dst").alias("at"), F.col("src").alias("next")))
    return walk(both, seeds, depth)


def definition_closure(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """DEFINES edges (with ``ord``) from a file's first one into ``wanted`` on: what one pass in order takes in."""
    defines = edges.filter(F.col("kind") == DEFINES)
    first = defines.join(wanted.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.min("ord").alias("first"))
    return defines.join(first, "src").filter(F.col("ord") >= F.col("first")).drop("first")


def kind_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def last_wins(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order``."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return edges.withColumn("__place", F.row_number().over(last)).filter("__place = 1").drop("__place")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(first)).filter("__place = 1").drop("__place")


def node_summary(nodes: DataFrame) -> DataFrame:
    """id, kind, label: what names a node of its kind."""
    label = F.when(F.col("kind") == "file", F.col("path")).when(F.col("kind") == "symbol", F.col("qualified_name")).otherwise(F.col("name"))
    return nodes.select("id", "kind", label.alias("label"))


def definition_rows(edges: DataFrame, symbols: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """Symbols with the path of the file that defines them and the line they begin on; absent where unknown."""
    defined = edges.filter(F.col("kind") == DEFINES).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("file_id"))
    return symbols.join(defined, "id", "left").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").join(anchors.select("id", "start_line"), "id", "left")
