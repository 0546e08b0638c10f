"""The engine as an object: one repository's tables, and the questions asked of them.

Every answer is a DataFrame and lazy, but for checks of a question's form and the size of its terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import candidates, context, graph, inventory, knowledge, lifecycle, retrieval, rules, textindex

SELECTORS = ("file", "topic", "raw_import", "symbol", "callers_of", "callees_of", "impact_file", "impact_symbol")


class BadQuestion(ValueError):
    """The question's form is wrong: no selector, several, or a depth below one."""


class Ambiguous(ValueError):
    """A name fits several symbols; ``matches`` has all of them as rows (id, path, qualified_name), not collected here."""

    def __init__(self, name: str, count: int, matches: DataFrame):
        super().__init__(f"{name} fits {count} symbols")
        self.count, self.matches = count, matches


class Engine:
    """nodes (id, kind, name, qualified_name, path), edges (kind, src, dst), evidence (kind, path, section, line_start, text),
    files (path and facets), records, events and sources (as ``knowledge`` has them) of one repository. Tables that aren't
    needed may be left out."""

    def __init__(
        self, nodes: DataFrame | None = None, edges: DataFrame | None = None, evidence: DataFrame | None = None, files: DataFrame | None = None, records: DataFrame | None = None, events: DataFrame | None = None, sources: DataFrame | None = None
    ):
        self.nodes, self.edges, self.evidence, self.files, self.records, self.events, self.sources = nodes, edges, evidence, files, records, events, sources

    def _symbol(self, name: str, in_file: str | None) -> DataFrame:
        found = graph.select_symbol(self.nodes.filter("kind = 'symbol'"), name, in_file)
        count = found.count()
        if count > 1:
            raise Ambiguous(name, count, found.select("id", "path", "qualified_name").orderBy("path", "qualified_name", "id"))
        return found.select("id")

    def graph_query(self, depth: int = 1, in_file: str | None = None, **selector: str) -> DataFrame:
        """Edges for exactly one of file, topic, raw_import, symbol, callers_of, callees_of; for impact_file and impact_symbol nodes with depth."""
        if len(selector) != 1 or next(iter(selector)) not in SELECTORS:
            raise BadQuestion(f"exactly one of {', '.join(SELECTORS)} is needed")
        if depth < 1:
            raise BadQuestion("depth must be at least 1")
        ((kind, value),) = selector.items()
        named = lambda k: self.nodes.filter((F.col("kind") == k) & (F.col("path" if k == "file" else "name") == value)).select("id")
        if kind == "file":
            return graph.incident(self.edges, named("file"))
        if kind == "topic":
            return graph.into(self.edges, graph.HAS_TOPIC, named("topic"))
        if kind == "raw_import":
            return graph.import_edges(self.edges, self.nodes, F.lit(value))
        if kind == "impact_file":
            return graph.impact(self.edges, named("file"), depth)
        symbol = self._symbol(value, in_file)
        if kind == "impact_symbol":
            return graph.impact(self.edges, symbol, depth)
        return {"symbol": graph.incident, "callers_of": graph.callers_of, "callees_of": graph.callees_of}[kind](self.edges, symbol)

    def _asked(self, spark, question: str, mode: str) -> DataFrame:
        asked = spark.createDataFrame([(0, question)], "q int, question string")
        terms = retrieval.expanded_terms(asked, "q", "question", rules.STOPWORDS, rules.synonyms(spark)).groupBy("q").agg(F.array_sort(F.collect_list("term")).alias("terms"))
        named = asked.withColumn("mode", context.mode(F.col("question"), F.lit(mode)))
        return named.join(terms, "q", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))

    def graph_evidence(self, question: str, mode: str = "") -> DataFrame:
        """What the graph says to a question's tokens: q, token, selector, path, section, score, n_matches, n_paths, text."""
        return candidates.graph_candidates(self._asked(self.nodes.sparkSession, question, mode), self.nodes, self.edges)

    def context_warnings(self, question: str, mode: str = "") -> DataFrame:
        """token, code, message of what a question's graph evidence leaves open."""
        return candidates.warnings(self.graph_evidence(question, mode)).select("token", "code", "message")

    def context_query(self, question: str, budget_tokens: int = 3000, limit: int = 40, mode: str = "") -> DataFrame:
        """kind, path, section, rank, score, tokens, group_name of the evidence packed into the budget, best first.

        The ``limit`` best pieces of evidence by all signals; with nodes and edges, these score by the graph too, and what the
        graph answers to the question's tokens joins them.
        """
        spark = self.evidence.sparkSession
        asked = self._asked(spark, question, mode)
        evidence = self.evidence.withColumn("id", F.concat_ws("\n", "kind", "path", "section", "line_start"))
        with_graph = self.nodes is not None and self.edges is not None
        nodes = spark.createDataFrame([], "q int, id string, graph double")
        if with_graph:
            values = F.array_compact(F.array("id", "kind", "name", "qualified_name", "path"))
            flags = asked.select("q", context.is_code_question(F.col("terms")).alias("is_code"), context.holds_any(F.lower("question"), context.ON_CALLS).alias("on_calls"))
            by_node = context.graph_scores(self.edges, context.node_matches(self.nodes.select("id", values.alias("values")), asked.select("q", "terms")), flags)
            named = by_node.select("q", F.concat(F.lit("<graph:"), "id", F.lit(">")).alias("path"), "graph")
            nodes = named.join(evidence.filter("kind = 'graph_node'").select("path", "id"), "path").select("q", "id", "graph")
        texts = textindex.build(evidence, "id", ["path", "section", "text"], "text")
        found = context.scores(evidence, asked, textindex.text_scores(texts, asked), nodes).select("q", "id", F.round("score", 6).alias("score"))
        shown = found.join(evidence.select("id", "kind", "path", "section", "line_start", t.excerpt(F.col("text")).alias("text")), "id")
        best = retrieval.top(shown, "q", [F.col("score").desc(), F.col("path"), F.col("line_start")], limit).withColumn("has_path", F.lit(False))
        if with_graph:
            answers = candidates.graph_candidates(asked, self.nodes, self.edges)
            answers = answers.select("q", F.lit("graph_query").alias("kind"), "path", "section", F.lit(0).alias("line_start"), "score", "text", (F.col("n_paths") > 0).alias("has_path"))
            best = candidates.merged(answers, best)
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "path", "line_start", "section")
        ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("tokens", t.token_estimate(F.coalesce("text", F.lit(""))))
        ranked = ranked.withColumn("group_name", context.group_name(F.col("kind"), F.col("path"), F.col("section"), F.col("text"), F.col("has_path")))
        taken = retrieval.packed(ranked, "q", "rank", "tokens", budget_tokens).select(F.col("rank").alias("__rank"))
        return ranked.join(taken, F.col("rank") == F.col("__rank"), "left_semi").select("kind", "path", "section", "rank", "score", "tokens", "group_name").orderBy("rank")

    def context_mode(self, question: str, asked: str = "") -> str:
        """What the question is about: the mode asked for, else by its words."""
        return self.evidence.sparkSession.range(1).select(context.mode(F.lit(question), F.lit(asked)).alias("mode")).head()["mode"]

    def meta_query(self, limit: int = 50, **wanted: list[str]) -> DataFrame:
        """Visible files by facets: of every facet one of the values, best first."""
        return inventory.facets(self.files, wanted).orderBy(F.col("score").desc(), "path").limit(max(0, limit))

    def meta_suggest(self, text: str, limit: int = 20) -> DataFrame:
        spark = self.files.sparkSession
        tokens = spark.createDataFrame([(text,)], "x string").select(F.explode(t.words(F.col("x"))).alias("token"))
        return inventory.suggest(self.files, tokens, limit)

    def knowledge_problems(self) -> DataFrame:
        """code, subject of events that don't fit the records: while there are any, queries answer nothing."""
        return knowledge.integrity_problems(self.events, self.records)

    def knowledge_query(self, question: str, limit: int = 10, include: tuple[str, ...] = ()) -> DataFrame:
        """rank, id, status, score of the best records; stale, superseded and deprecated ones where ``include`` has their status."""
        spark = self.records.sparkSession
        if not self.knowledge_problems().isEmpty():
            return spark.createDataFrame([], "rank int, id string, status string, score double")
        asked = spark.createDataFrame([(0, question)], "q int, question string")
        return knowledge.query(self.records, self.events, self.sources, asked, limit, include).drop("q").orderBy("rank")

    def knowledge_status(self, hidden: tuple[str, ...] = ("stale", "superseded", "deprecated")) -> DataFrame:
        """status, available, excluded: records by derived status."""
        return knowledge.status_report(knowledge.with_status(self.records, self.events, self.sources), list(hidden))

    def status_counts(self) -> DataFrame:
        """Records by the status that their events alone give."""
        return lifecycle.folded_status(self.events, "record_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def kind_counts(self) -> DataFrame:
        """Number of nodes and edges by kind."""
        both = graph.kind_counts(self.nodes).withColumn("what", F.lit("node")).union(graph.kind_counts(self.edges).withColumn("what", F.lit("edge")))
        return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("what")))
