"""Graph evidence for questions: each of a question's tokens asks the graph what its form and the question's mode call for.

All tokens of all questions are answered together. A *label* is one asked thing (q, token, selector); a labelled walk has one
frontier of (label, node) for all of them, so that a level is one join with the steps and one anti join, however many labels
there are. Tables: ``questions`` (q, question, mode), ``nodes`` (id, kind, name, qualified_name, path), ``edges`` (kind, src,
dst), where a symbol's path is that of the file that defines it. Nulls match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import context, graph, retrieval
from tessella.sources.shared import kept

LABEL = ["q", "token", "selector"]
SHOWN_MATCHES, SHOWN_PATHS = 5, 10

# What is cut from a token's ends, endings of code files, the scores with and without paths.
AROUND = "`'\".,()[]{}"
CODE_ENDINGS = (".py", ".ts", ".tsx", ".js", ".jsx")
WITH_PATHS, WITHOUT_PATHS = 4.0, 3.0
DEPTH = 2

# What a changed node reaches in one step: kind of edge, the end it is at, the other end, and why.
STEPS = [
    (graph.CALLS, "dst", "src", "caller depends on changed symbol"),
    (graph.IMPORTS_FILE, "dst", "src", "file imports changed file"),
    (graph.DEFINES, "src", "dst", "file defines potentially changed symbol"),
    (graph.DEFINES, "dst", "src", "symbol belongs to changed file"),
]
ONE_STEP = {"callers_of": ("dst", "caller invokes selected symbol"), "callees_of": ("src", "selected symbol invokes callee")}
AMBIGUOUS = "graph_query_ambiguous_symbol"


def asked(questions: DataFrame) -> DataFrame:
    """q, mode, token, selector: paths ask for their file, other tokens for symbols, both for impact where the mode is about changes."""
    token = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(context.QUESTION_TOKEN), 1), lambda x: F.btrim(x, F.lit(AROUND)))))
    found = questions.select("q", "mode", token.alias("token")).filter(F.length("token") >= 2)
    path = reduce(lambda a, b: a | b, [F.endswith("token", F.lit(x)) for x in CODE_ENDINGS], F.contains("token", F.lit("/")))
    change = F.col("mode").isin("file_impact", "call_impact")
    when = lambda test, name: F.when(test, F.lit(name))
    of_path = F.array(when(change, "impact_file"), F.lit("file"))
    of_name = F.array(when(F.col("mode") == "code_location", "symbol"), when(change, "callers_of"), when(change, "impact_symbol"))
    return found.select("q", "mode", "token", F.explode(F.array_compact(F.when(path, of_path).otherwise(of_name))).alias("selector"))


def matched(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each label with each node it names (id): files by normal path, symbols by name or qualified name."""
    files = nodes.filter("kind = 'file'").select(F.col("path").alias("wanted"), "id", F.lit(True).alias("is_file"))
    symbols = nodes.filter("kind = 'symbol'").select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("wanted"), "id", F.lit(False).alias("is_file"))
    by_file = F.col("selector").isin("file", "impact_file")
    wanted = labels.withColumn("is_file", by_file).withColumn("wanted", F.when(by_file, t.normal_path(F.col("token"))).otherwise(F.col("token")))
    return files.unionByName(symbols).join(wanted, ["wanted", "is_file"]).select(*LABEL, "id").distinct()


def steps(edges: DataFrame) -> DataFrame:
    """at, next, kind, src, dst, rank: each edge from each end it may be taken from, in one pass over the edges."""
    of = lambda rank, at, to: F.struct(F.col(at).alias("at"), F.col(to).alias("next"), F.lit(rank).alias("rank"))
    kinds: dict[str, list[Column]] = {}
    for rank, (kind, at, to, _) in enumerate(STEPS):
        kinds.setdefault(kind, []).append(of(rank, at, to))
    taken = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.array(*kv[1])), kinds.items(), F.when(F.lit(False), F.array(of(0, "src", "dst"))))
    return edges.filter(F.col("kind").isin(*kinds)).select("kind", "src", "dst", F.inline(taken))


def labelled_walk(edges: DataFrame, seeds: DataFrame, by: list[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps of each label's seeds (``by``, id), and the steps taken.

    The nodes have their least depth. A step (kind, src, dst, depth, reason) is taken out of a node at the level it was first
    reached on; an edge taken from both ends on one level has the reason that comes first in ``STEPS``. Each level's steps are
    written, so that the edges are read once a level.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    every = steps(edges)
    seen = seeds.select(*by, "id").distinct().withColumn("depth", F.lit(0))
    frontier, taken = seen, []
    for level in range(1, depth + 1):
        front = frontier.select(*by, F.col("id").alias("at"))
        out = kept(every.join(front, "at"), "walk")
        both_ends = out.filter(F.col("rank") == 3).join(front.withColumnRenamed("at", "next"), [*by, "next"], "left_semi").select(*by, "kind", "src", "dst", "rank")
        taken.append(out.join(both_ends, [*by, "kind", "src", "dst", "rank"], "left_anti").withColumn("depth", F.lit(level)))
        frontier = out.select(*by, F.col("next").alias("id")).distinct().join(seen.select(*by, "id"), [*by, "id"], "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    reason = reduce(lambda c, r: c.when(F.col("rank") == r[0], r[1][3]), list(enumerate(STEPS))[1:], F.when(F.col("rank") == 0, STEPS[0][3]))
    paths = reduce(DataFrame.unionByName, taken)
    return seen, paths.select(*by, "kind", "src", "dst", "depth", F.concat(F.lit("depth "), F.col("depth").cast("string"), F.lit(": "), reason).alias("reason"))


def _paths(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The steps of all labels: one for callers and callees, ``DEPTH`` levels for impact."""
    found = labelled_walk(edges, chosen.filter(F.startswith("selector", F.lit("impact_"))), LABEL, DEPTH)[1]
    ends = F.array(*[F.struct(F.lit(name).alias("selector"), F.col(end).alias("id"), F.lit(why).alias("reason")) for name, (end, why) in ONE_STEP.items()])
    near = edges.filter(F.col("kind") == graph.CALLS).select("kind", "src", "dst", F.inline(ends)).join(chosen, ["selector", "id"])
    return found.unionByName(near.select(*LABEL, "kind", "src", "dst", F.lit(1).alias("depth"), "reason"))


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*LABEL).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def answers(labels: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels with matches (n_matches), their matches (id), and the paths of those that fit a single node.

    A name of several symbols keeps its matches and has no paths; a label that fits nothing isn't there.
    """
    found = kept(matched(labels, nodes), "matches")
    count = found.groupBy(*LABEL).agg(F.count(F.lit(1)).alias("n_matches"))
    single = found.join(count.filter("n_matches = 1"), LABEL, "left_semi")
    return count, found, kept(_paths(edges, single), "paths")


def of_labels(labels: DataFrame, nodes: DataFrame, edges: DataFrame, matches: int = SHOWN_MATCHES, shown_paths: int = SHOWN_PATHS) -> DataFrame:
    """q, token, selector, path, section, score, n_matches, n_paths, text: the evidence of each label that fits something.

    The text has the first ``matches`` matches and ``shown_paths`` paths; ``path`` names the evidence by a digest of what was
    asked, what was found, and that text. What several questions ask alike is answered once, for all of them.
    """
    labels = kept(labels.filter("q is not null").select(*LABEL).distinct(), "labels")
    each = labels.select(F.lit(0).alias("q"), "token", "selector").distinct()
    rows = _evidence(each, nodes, edges, matches, shown_paths)
    return labels.join(rows.drop("q"), ["token", "selector"]).select("q", *rows.drop("q").columns)


def _evidence(labels: DataFrame, nodes: DataFrame, edges: DataFrame, matches: int, shown_paths: int) -> DataFrame:
    count, found, paths = answers(labels, nodes, edges)
    name = F.coalesce("qualified_name", "path", "id")
    shown = nodes.select("id", name.alias("name"), F.coalesce("path", F.lit("")).alias("at"), F.coalesce("qualified_name", F.lit("")).alias("qualified"))
    order = [F.col("at"), F.col("qualified"), F.col("id")]
    lines = _first(found.join(shown, "id"), order, matches).select(*LABEL, F.lit(0).alias("part"), "place", F.rtrim(F.concat_ws(" ", F.lit("match"), "name", "at")).alias("line"))
    first = _first(paths, [F.col(x) for x in ("depth", "kind", "src", "dst")], shown_paths)
    end = lambda x: shown.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name"))
    first = first.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    told = F.concat(F.coalesce("src_name", "src"), F.lit(" --"), "kind", F.lit("--> "), F.coalesce("dst_name", "dst"), F.lit(": "), "reason")
    lines = lines.unionByName(first.select(*LABEL, F.lit(1).alias("part"), "place", told.alias("line")))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"])).alias("text")
    rows = count.join(paths.groupBy(*LABEL).agg(F.count(F.lit(1)).alias("n_paths")), LABEL, "left").join(lines.groupBy(*LABEL).agg(text), LABEL)
    rows = rows.withColumn("n_paths", F.coalesce("n_paths", F.lit(0).cast("long")))
    digest = F.substring(F.sha2(F.concat_ws("\n", "selector", "token", "n_matches", "n_paths", "text"), 256), 1, 12)
    path = F.concat(F.lit("<graph-query:"), "selector", F.lit(":"), digest, F.lit(">"))
    score = F.when(F.col("n_paths") > 0, WITH_PATHS).otherwise(WITHOUT_PATHS)
    return rows.select(*LABEL, path.alias("path"), F.col("selector").alias("section"), score.alias("score"), "n_matches", "n_paths", "text")


def graph_candidates(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The evidence of all that the tokens of ``questions`` (q, question, mode) ask."""
    return of_labels(asked(questions), nodes, edges)


def warnings(candidates: DataFrame) -> DataFrame:
    """q, code, message: names that fit several symbols."""
    told = candidates.filter((F.col("n_matches") > 1) & ~F.col("selector").isin("file", "impact_file"))
    message = F.concat(F.lit("graph symbol query matched "), F.col("n_matches").cast("string"), F.lit(" symbols; pass a file or a qualified name"))
    return told.select("q", "token", F.lit(AMBIGUOUS).alias("code"), message.alias("message"))


def definition_edges(edges: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``by``, kind, src, dst: edges that define what each label wants (``by``, id), and anchors of that.

    One pass in edge order: from a file's first wanted symbol on, the file is wanted and so all its later symbols are.
    """
    wanted = wanted.select(*by, "id").distinct()
    anchors = edges.filter("kind = 'ANCHORS'").join(wanted.withColumnRenamed("id", "src"), "src").select(*by, "kind", "src", "dst")
    defines = edges.filter(F.col("kind") == graph.DEFINES).select("kind", "src", "dst")
    by_symbol = defines.join(wanted.withColumnRenamed("id", "dst"), "dst").groupBy(*by, "src").agg(F.min("dst").alias("first"))
    by_file = wanted.withColumnRenamed("id", "src").withColumn("first", F.lit(""))
    first = by_symbol.unionByName(by_file).groupBy(*by, "src").agg(F.min("first").alias("first"))
    return anchors.unionByName(defines.join(first, "src").filter("dst >= first").select(*by, "kind", "src", "dst"))


def payload(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph behind the answers: each label's edges (kind, src, dst), and nodes (id), each once.

    Callers, callees and symbols come with the edges that define them, files with all edges at them, impact with its steps.
    """
    _, found, paths = answers(asked(questions), nodes, edges)
    steps = paths.select(*LABEL, "kind", "src", "dst")
    ends = steps.filter(F.col("selector").isin(*ONE_STEP)).select(*LABEL, F.explode(F.array("src", "dst")).alias("id"))
    # a name of several symbols shows what defines them, whatever was asked of it
    many = found.join(found.groupBy(*LABEL).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), LABEL, "left_semi")
    defined = found.filter(F.col("selector").isin("symbol", *ONE_STEP)).unionByName(ends).unionByName(many)
    at_file = found.filter(F.col("selector") == "file")
    touching = reduce(DataFrame.unionByName, [edges.join(at_file.withColumnRenamed("id", x), x).select(*LABEL, "kind", "src", "dst") for x in ("src", "dst")])
    whole = steps.unionByName(definition_edges(edges, defined, LABEL)).unionByName(touching).distinct()
    ids = whole.select(*LABEL, F.explode(F.array("src", "dst")).alias("id")).unionByName(found).distinct()
    return whole, ids.join(nodes.select("id"), "id", "left_semi").select(*LABEL, "id")


def merged(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of both (q, kind, path, section, line_start, score and whatever else both have), of each piece of evidence the best."""
    both = [x for x in found.columns if x in evidence.columns]
    keys = ["q", "kind", "path", "section", "line_start"]
    return graph.first_wins(found.select(*both).unionByName(evidence.select(*both)), keys, [F.col("score").desc()])


def small_questions(questions: DataFrame) -> DataFrame:
    """Questions with their mode, checked to be few."""
    return retrieval.small(questions).withColumn("mode", context.mode(F.col("question")))
