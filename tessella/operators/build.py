"""The property graph of a repository: built whole, or brought up to date from what changed, and its digest.

Every node and edge is told by an *owner*, a file or a task: what it tells are contributions (nodes: id, kind, facts, rank,
owner; edges: the five-part key, facts, owner). The snapshot is their fold: of a node the contribution of least rank (indexed
files before what receipts only mention), of an edge key one. A change of files takes back the contributions of these files and
of all that import them or may, tells theirs anew, and folds only the keys that either touched; all else stays as it was, so
that the work is in proportion to the change, and the result equals a whole build. Where a large share of files is touched, what
all tell is folded anew instead.

Tables: ``index`` (as ``code.file_index`` with classification), ``parsed`` (``code.parsed_python``), ``metadata`` (path, areas,
policy_topics, annotation_topics: arrays), ``receipts`` (task_id, status, task_path, archive_path, content_sha256,
changed_entries: array of struct<change, path, old_path>). Null arrays are empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import code
from tessella.operators.index import EDGE_KEY
from tessella.sources.shared import kept

NODE = ["id", "kind", "facts", "rank", "owner"]
EDGE = [*EDGE_KEY, "facts", "owner"]
SURE, TOLD, MENTIONED = 0, 1, 2

# Who resolves imports, by language.
RESOLVERS = {"python": "python_import_resolver", "script": "js_ts_relative_import_resolver"}

#: Of changes that touch more than this share of the files, everything is folded anew: one shuffle, where telling apart what was touched takes several.
FEW = 0.05


class Truncated(ValueError):
    """The index is not complete: a graph of part of the files would look whole."""


@dataclass(frozen=True)
class Graph:
    """A snapshot and the contributions it is folded from: nodes and edges each told, and written, when first asked for."""

    tell_nodes: Callable[[], tuple[DataFrame, DataFrame]]
    tell_edges: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _nodes(self) -> tuple[DataFrame, DataFrame]:
        return self.tell_nodes()

    @cached_property
    def _edges(self) -> tuple[DataFrame, DataFrame]:
        return self.tell_edges()

    nodes = property(lambda self: self._nodes[1])
    edges = property(lambda self: self._edges[1])
    told_nodes = property(lambda self: self._nodes[0])
    told_edges = property(lambda self: self._edges[0])


def _id(*parts: Column | str) -> Column:
    """Parts joined by colons; columns are encoded."""
    return F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else t.percent_encoded(x.cast("string")) for x in parts])


def _fact(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def _node(rows: DataFrame, key: Column, kind: str, rank: int, owner: Column, facts: Column | None = None) -> DataFrame:
    return rows.select(key.alias("id"), F.lit(kind).alias("kind"), (F.lit("{}") if facts is None else facts).alias("facts"), F.lit(rank).alias("rank"), owner.alias("owner"))


def _edge(rows: DataFrame, kind: str, src: Column, dst: Column, assertion: str, source: Column | str, owner: Column, facts: Column | None = None) -> DataFrame:
    told = F.lit(source) if isinstance(source, str) else source
    return rows.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(assertion).alias("assertion"), told.alias("source"), (F.lit("{}") if facts is None else facts).alias("facts"), owner.alias("owner"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _told_by_files(repo: str, index: DataFrame, metadata: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    path, owner = F.col("path"), F.col("path")
    file = _id("repo", F.lit(repo), "file", path)
    rows = index.join(metadata, "path", "left")
    facts = _fact(
        index=F.struct(*[F.col(c) for c in ("language", "classification", "symbols", "calls", "packages", "effects", "status")]),
        annotation=F.when(F.size(_list("annotation_topics")) > 0, F.struct(F.array_sort(F.array_distinct("annotation_topics")).alias("topics"))),
        policy=F.when(F.size(F.concat(_list("areas"), _list("policy_topics"))) > 0, F.struct("areas", F.col("policy_topics").alias("topics"))),
    )
    nodes = [_node(rows, file, "file", SURE, owner, facts)]
    edges = [_edge(rows, "CONTAINS", _id("repo", F.lit(repo)), file, "observed", "code_index", owner)]
    imports = index.select("path", "language", F.explode("imports").alias("raw"))
    ref = _id("repo", F.lit(repo), "import-ref", F.col("language"), F.col("raw"))
    nodes.append(_node(imports, ref, "import_ref", TOLD, owner))
    edges.append(_edge(imports, "DECLARES_IMPORT", file, ref, "observed", "code_index", owner))
    for column, assertion, source in (("policy_topics", "default", "metadata_policy"), ("annotation_topics", "declared", "metadata_annotation")):
        topics = rows.select("path", F.explode(F.filter(_list(column), lambda x: F.trim(x) != "")).alias("topic"))
        topic = _id("repo", F.lit(repo), "topic", F.col("topic"))
        nodes.append(_node(topics, topic, "topic", TOLD, owner))
        edges.append(_edge(topics, "HAS_TOPIC", file, topic, assertion, source, owner))
    return nodes, edges


def symbols(parsed: DataFrame) -> DataFrame:
    """path, kind, name, qualified_name, provider_symbol_id, anchor: each symbol and where it stands."""
    found = parsed.filter("kind in ('class', 'function', 'method')")
    span = F.concat_ws(":", "start_line", "start_col", "end_line", "end_col")
    key = F.concat_ws(":", F.lit("python_ast"), "path", "qualified_name", "kind", span)
    return found.select("path", "kind", "name", "qualified_name", key.alias("provider_symbol_id"), span.alias("anchor"))


def _symbol_id(repo: str, key: Column) -> Column:
    return _id("repo", F.lit(repo), "symbol", F.lit("python_ast"), key)


def _told_by_symbols(repo: str, parsed: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    found, owner = symbols(parsed), F.col("path")
    symbol = _symbol_id(repo, F.col("provider_symbol_id"))
    anchor = _id("repo", F.lit(repo), "anchor", F.lit("python_ast"), F.col("path"), F.col("anchor"))
    facts = _fact(provider=F.struct(F.lit("python").alias("language"), "kind", "name", "qualified_name"))
    nodes = [_node(found, symbol, "symbol", SURE, owner, facts), _node(found, anchor, "anchor", SURE, owner)]
    file = _id("repo", F.lit(repo), "file", F.col("path"))
    return nodes, [_edge(found, "DEFINES", file, symbol, "resolved", "python_ast", owner), _edge(found, "ANCHORS", symbol, anchor, "resolved", "python_ast", owner)]


def _imports(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'import'").select(*code.IMPORT)


def _scripts(index: DataFrame) -> DataFrame:
    return index.filter(F.col("language").isin(code.SCRIPTS)).select("path", "language", F.explode("imports").alias("raw"))


def _told_by_links(repo: str, index: DataFrame, parsed: DataFrame, only: DataFrame | None) -> list[DataFrame]:
    """Resolved imports and calls of all files, or of ``only`` (path) against all files."""
    some = _some(only)
    resolved = kept(code.resolved_python(some(_imports(parsed)), index), "resolved")
    base = F.concat(F.repeat(F.lit("."), F.col("level")), "module")
    raw = F.when(F.col("name").isNull(), F.col("module")).when(F.col("module") == "", F.concat(base, "name")).otherwise(F.concat_ws(".", base, "name"))
    scripts = some(_scripts(index))
    links = resolved.select("path", F.lit("python").alias("language"), raw.alias("raw"), "target", F.lit(RESOLVERS["python"]).alias("source"))
    found = code.resolved_scripts(scripts.select("path", "raw"), index).join(scripts, ["path", "raw"]).select("path", "language", "raw", "target", F.lit(RESOLVERS["script"]).alias("source"))
    links, owner = links.unionByName(found).distinct(), F.col("path")
    target, importer = _id("repo", F.lit(repo), "file", F.col("target")), _id("repo", F.lit(repo), "file", F.col("path"))
    ref = _id("repo", F.lit(repo), "import-ref", F.col("language"), F.col("raw"))
    edges = [_edge(links, "RESOLVES_TO", ref, target, "resolved", F.col("source"), owner, _fact(importer_path=F.col("path"))), _edge(links, "IMPORTS_FILE", importer, target, "resolved", F.col("source"), owner, _fact(raw_import=F.col("raw")))]
    near = parsed
    if only is not None:  # the files themselves, and those whose functions they import
        near = parsed.join(only.union(resolved.select(F.col("target").alias("path"))).distinct(), "path", "left_semi")
    called = some(code.calls(near, resolved))
    last = symbols(near).groupBy("path", "qualified_name").agg(F.max("provider_symbol_id").alias("key"))
    end = lambda path, name, to: last.select(F.col("path").alias(path), F.col("qualified_name").alias(name), F.col("key").alias(to))
    called = called.join(end("path", "caller", "from"), ["path", "caller"]).join(end("target_path", "target", "to"), ["target_path", "target"])
    scope = F.when(F.col("path") == F.col("target_path"), "same_file").otherwise("cross_file_import")
    edges.append(_edge(called, "CALLS", _symbol_id(repo, F.col("from")), _symbol_id(repo, F.col("to")), "resolved", "python_ast", owner, _fact(scope=scope)))
    return edges


def _told_by_receipts(repo: str, receipts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    receipts = receipts.filter(F.coalesce("task_id", F.lit("")) != "")
    owner, task = F.concat(F.lit("task:"), "task_id"), _id("task", F.col("task_id"))
    given = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    facts = _fact(receipt=F.struct(*[given(c).alias(c) for c in ("status", "task_path", "archive_path", "content_sha256")]))
    nodes = [_node(receipts, task, "task", SURE, owner, facts)]
    proven = receipts.withColumn("proof", given("archive_path", "task_path")).filter("proof <> ''")
    artifact = _id("task", F.col("task_id"), "artifact", F.col("proof"))
    nodes.append(_node(proven, artifact, "artifact", SURE, owner, _fact(receipt=F.struct(given("content_sha256").alias("content_sha256")))))
    edges = [_edge(proven, "TASK_VERIFIED_BY", task, artifact, "recorded", "task_completion", owner)]
    changes = receipts.select("task_id", F.posexplode("changed_entries").alias("at", "entry")).select("task_id", "at", "entry.*").filter("coalesce(change, '') <> '' and coalesce(path, '') <> ''")
    event = F.concat(task, F.lit(":change:"), F.col("at").cast("string"))
    nodes.append(_node(changes, event, "change_event", SURE, owner, _fact(receipt=F.struct("change", "path", given("old_path").alias("old_path")))))
    edges.append(_edge(changes, "TASK_RECORDED_CHANGE", task, event, "recorded", "task_completion", owner))
    ends = F.array(F.struct(F.lit("path").alias("role"), F.col("path").alias("file")), F.struct(F.lit("old_path").alias("role"), given("old_path").alias("file")))
    met = changes.select("task_id", "at", F.inline(ends)).filter("file <> ''")
    file = _id("repo", F.lit(repo), "file", F.col("file"))
    nodes.append(_node(met, file, "file", MENTIONED, owner, F.lit('{"receipt":{"present_in_current_inventory":false}}')))
    edges.append(_edge(met, "CHANGE_AFFECTED_FILE", event, file, "recorded", "task_completion", owner, _fact(role=F.col("role"))))
    return nodes, edges


def _some(only: DataFrame | None) -> Callable[[DataFrame], DataFrame]:
    return (lambda rows: rows) if only is None else (lambda rows: rows.join(only, "path", "left_semi"))


def contributed_nodes(repo: str, index: DataFrame, parsed: DataFrame, metadata: DataFrame, receipts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Nodes that all owners tell, or those of ``only`` (path) alone. Receipts are told anew each time."""
    some = _some(only)
    root = _node(index.sparkSession.range(1), _id("repo", F.lit(repo)), "repository", SURE, F.lit(""))
    return _union([root, *_told_by_files(repo, some(index), metadata)[0], *_told_by_symbols(repo, some(parsed))[0], *_told_by_receipts(repo, receipts)[0]])


def contributed_edges(repo: str, index: DataFrame, parsed: DataFrame, metadata: DataFrame, receipts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """As ``contributed_nodes``, of edges."""
    some = _some(only)
    told = [*_told_by_files(repo, some(index), metadata)[1], *_told_by_symbols(repo, some(parsed))[1], *_told_by_receipts(repo, receipts)[1]]
    return _union([*told, *_told_by_links(repo, index, parsed, only)])


def fold_nodes(told: DataFrame) -> DataFrame:
    best = told.groupBy("id").agg(F.min(F.struct("rank", "kind", "facts")).alias("b"))
    return best.select("id", "b.kind", "b.facts")


def fold_edges(told: DataFrame) -> DataFrame:
    return told.groupBy(*EDGE_KEY).agg(F.max("facts").alias("facts"))


def build(repo: str, index: DataFrame, parsed: DataFrame, metadata: DataFrame, receipts: DataFrame, truncated: bool = False) -> Graph:
    """The whole graph. An index that was cut raises ``Truncated``."""
    if truncated:
        raise Truncated("graph build requires a complete code index")
    # read many times: written once, so that no file is parsed twice
    told = (repo, kept(index, "index"), kept(parsed, "parsed"), metadata, receipts)

    def whole(tell: Callable[..., DataFrame], fold: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        rows = kept(tell(*told), "told")
        return rows, fold(rows)

    return Graph(lambda: whole(contributed_nodes, fold_nodes), lambda: whole(contributed_edges, fold_edges))


def affected(changed: DataFrame, *parsed_and_index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """path of the ``changed`` files (path) and of those that import them, or may, in any of the given states."""
    # what the states have alike is looked at once
    imports = _union([_imports(parsed) for parsed, _ in parsed_and_index]).distinct()
    scripts = _union([_scripts(index).select("path", "raw") for _, index in parsed_and_index]).distinct()
    may = code.python_targets(imports).select("path", "target").unionByName(code.script_targets(scripts))
    importers = may.join(changed.select(F.col("path").alias("target")), "target", "left_semi").select("path")
    return changed.select("path").union(importers).distinct()


def updated(repo: str, old: Graph, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], metadata: DataFrame, receipts: DataFrame, changed: DataFrame) -> Graph:
    """``old`` brought up to date: ``before`` and ``after`` are (parsed, index), ``changed`` (path) the files added, removed or altered.

    Equal to a whole build of ``after``.
    """
    before, after = ((kept(parsed, "parsed"), kept(index, "index")) for parsed, index in (before, after))
    some = kept(affected(changed, before, after), "affected")
    few = some.count() <= FEW * after[1].count()
    # files by what is affected, and all that isn't one: tasks and the repository are told anew
    files, rest = some.select(F.col("path").alias("owner")), F.coalesce((F.col("owner") == "") | F.startswith("owner", F.lit("task:")), F.lit(False))

    def anew(tell: Callable[..., DataFrame], fold: Callable[[DataFrame], DataFrame], told: DataFrame, folded: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
        rows = kept(tell(repo, after[1], after[0], metadata, receipts, some), "told")
        every = told.filter(~rest).join(files, "owner", "left_anti").unionByName(rows)
        if not few:
            return every, fold(every)
        gone = told.filter(rest).unionByName(told.filter(~rest).join(files, "owner", "left_semi").select(told.columns))
        keys = gone.select(*key).union(rows.select(*key)).distinct()
        return every, folded.join(keys, key, "left_anti").unionByName(fold(every.join(keys, key, "left_semi")))

    return Graph(lambda: anew(contributed_nodes, fold_nodes, old.told_nodes, old.nodes, ["id"]), lambda: anew(contributed_edges, fold_edges, old.told_edges, old.edges, EDGE_KEY))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: each value with its length before it, so that no two rows read alike."""
    told = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *told), 256)


def table_digest(rows: DataFrame, columns: list[str]) -> str:
    """One digest of all rows, whatever their order and partitions: a tree over their digests, by these digests' first signs.

    A leaf holds the digests of 1 / 65,536 of the rows in order, repeats with them; each level above at most 256 digests.
    """
    return digest_tree(rows, columns).head()["digest"]


def digest_tree(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, digest."""
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    level = rows.select(row_digest(columns).alias("digest")).select(F.substring("digest", 1, 4).alias("at"), "digest")
    for signs in (2, 0):
        level = level.groupBy("at").agg(joined(F.col("digest")).alias("digest"))
        level = level.select(F.substring("at", 1, signs).alias("at"), F.concat("at", F.lit(":"), "digest").alias("digest"))
    return level.agg(F.concat(F.lit("sha256:"), joined(F.col("digest"))).alias("digest"))
