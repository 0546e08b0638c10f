"""Context queries: what a question is about, all its signals in one score, groups of evidence, backlog blocks.

Rules are tables of fixed values and expressions made of them. Questions are a stated set, checked to be small; the
evidence is read once for all of them, and after its text was searched only keys and signals move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import graph, retrieval, rules

# Words that make a question one about code.
CODE_WORDS = ["call", "calls", "called", "define", "defined", "defines", "import", "imports", "imported", "method", "symbol", "where"]

# Other names of a mode.
MODE_NAMES = {"authority": "authority_or_contract", "contract": "authority_or_contract"}

# A question's mode by the first rule one of whose words it holds; then words that lead to another mode.
MODES = [
    (["failure", "failed", "장애", "실패"], "failure_mode"),
    (["invariant", "must", "contract", "깨뜨", "계약"], "invariant"),
    (["decision", "decided", "why", "왜", "adr"], "past_decision"),
    (["call", "caller", "callee", "호출"], "call_impact"),
    (["impact", "impacted", "change", "변경", "영향"], "call_impact"),
    (["where", "defined", "symbol", "어디"], "code_location"),
]
OTHER_MODE = "authority_or_contract"
ON_AUTHORITY = ["authority", "authoritative", "source", "권위", "generated wiki", "llmwiki"]
CHANGE_RULE, DECISION_RULE = 4, 2
QUESTION_TOKEN = r"([A-Za-z_][A-Za-z0-9_./:-]*|[./][A-Za-z0-9_./:-]+)"

# Words of questions on the product and on decisions, and what these add to evidence.
ON_PRODUCT = ["project", "product", "architecture", "current", "recent", "최근", "현재", "프로젝트", "구조", "결정"]
ON_DECISION = ["decision", "decisions", "why", "invariant", "failure", "receipt", "결정", "불변식", "장애", "실패", "검증"]
ON_CALLS = ["call", "function", "impact"]
MISMATCH, SHORT_TEXT, SHORT_WORDS = 0.3, 0.3, 5
NODE_BOOST = 0.4
MUST_READ_SECTIONS = ["decision", "authority rules", "future layer rules"]


def holds_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def mode(question: Column, explicit: Column | None = None) -> Column:
    """The mode of a question: the one asked for, else that of the first rule met."""
    low = F.lower(question)
    by_path = F.exists(F.regexp_extract_all(question, F.lit(QUESTION_TOKEN), 1), lambda x: x.rlike("[./]"))
    chain = None
    for i, (words, name) in enumerate(MODES):
        found = F.lit(name)
        if i == DECISION_RULE:
            found = F.when(holds_any(low, ON_AUTHORITY), OTHER_MODE).otherwise(found)
        elif i == CHANGE_RULE:
            found = F.when(by_path, "file_impact").otherwise(found)
        chain = F.when(holds_any(low, words), found) if chain is None else chain.when(holds_any(low, words), found)
    chosen = chain.otherwise(OTHER_MODE)
    if explicit is None:
        return chosen
    asked = F.replace(F.lower(F.trim(explicit)), F.lit("-"), F.lit("_"))
    named = reduce(lambda c, kv: c.when(asked == kv[0], kv[1]), list(MODE_NAMES.items()), F.when(asked.isNull() | (asked == ""), chosen))
    return named.otherwise(asked)


def is_code_term(term: Column) -> Column:
    """A word of code questions, a path or qualified name, or mixed case that isn't a capitalised word."""
    named = term.rlike("[_/]|::") | (F.contains(term, F.lit(".")) & ~F.startswith(term, F.lit(".")))
    mixed = term.rlike("[a-z]") & term.rlike("[A-Z]") & ~term.rlike("^[A-Z][^A-Z]*$")
    return F.lower(term).isin(CODE_WORDS) | named | mixed


def is_code_question(terms: Column) -> Column:
    return F.exists(terms, is_code_term)


def node_boost(kind: Column, section: Column, low: Column, is_code: Column) -> Column:
    """For code questions about functions or files: nodes of that kind."""
    meets = (F.contains(low, F.lit("function")) & F.startswith(section, F.lit("symbol "))) | (F.contains(low, F.lit("file")) & F.startswith(section, F.lit("file ")))
    return F.when(is_code & (kind == "graph_node") & meets, NODE_BOOST).otherwise(0.0)


def product_boost(path: Column, kind: Column, low: Column) -> Column:
    """For questions about the product or decisions: its main documents, receipts and task artifacts."""
    product, decision = holds_any(low, ON_PRODUCT), holds_any(low, ON_DECISION)
    boost = (
        F.when(~product & ~decision, 0.0)
        .when(path == "docs/PRD.md", 0.9)
        .when(path.isin("README.md", "docs/README.md"), 0.55)
        .when(kind == "completion_receipt", F.when(decision, 0.8).otherwise(0.45))
        .when(kind == "task_artifact", F.when(decision, 0.65).otherwise(0.35))
        .when(F.startswith(path, F.lit("docs/contracts/")) & product & ~decision, -0.2)
    )
    return boost.otherwise(0.0)


def text_score(bm25: Column, n_words: Column) -> Column:
    """Of a text match; a better one gives a smaller share, as the fixed formula has it."""
    return F.when(n_words < SHORT_WORDS, SHORT_TEXT).otherwise(1.0) / (1 + F.abs(bm25))


def text_scores(evidence: DataFrame, questions: DataFrame, pattern: str = r"([\p{L}\p{N}]+)", most: int = 50) -> DataFrame:
    """q, id, fts of the ``most`` best texts of each question by BM25: ``evidence`` (id, text), ``questions`` (q, terms).

    Terms of several words meet nothing here. Only words of the questions leave the scan.
    """
    tokens = evidence.select("id", F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1).alias("tokens"))
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean")).head()
    words = questions.select("q", F.explode("terms").alias("word")).select("q", F.lower("word").alias("word")).distinct()
    wanted = F.array(*[F.lit(r["word"]) for r in retrieval.small(words.select("word").distinct()).collect()]).cast("array<string>")
    found = tokens.select(F.col("id").alias("doc"), F.size("tokens").alias("length"), F.explode(F.filter("tokens", lambda x: F.array_contains(wanted, x))).alias("word"))
    found = found.groupBy("doc", "length", "word").agg(F.count(F.lit(1)).alias("f"))
    best = retrieval.top(retrieval.bm25(found, words, size["n"], size["mean"] or 1.0), "q", [F.round("score", 6).desc(), F.col("doc")], most)
    length = tokens.select(F.col("id").alias("doc"), F.size("tokens").alias("length"))
    return best.join(length, "doc").select("q", F.col("doc").alias("id"), text_score(F.col("score"), F.col("length")).alias("fts"))


def node_matches(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """q, id, score for ``nodes`` (id, values) and ``questions`` (q, terms): 1 for a value that is a term, 0.5 for one within the values."""
    met = nodes.withColumn("__all", F.lower(F.array_join("values", " "))).join(retrieval.small(questions), F.expr("arrays_overlap(values, terms) or exists(terms, x -> length(x) >= 3 and contains(__all, lower(x)))"))
    return met.select("q", "id", F.when(F.arrays_overlap("values", "terms"), 1.0).otherwise(0.5).alias("score"))


def graph_scores(edges: DataFrame, matches: DataFrame, questions: DataFrame, most: int = 20) -> DataFrame:
    """q, id, graph for ``questions`` (q, is_code, on_calls): the first ``most`` matches are seeds; they, their neighbours and, for code, callers score."""
    asked = retrieval.small(questions.select("q", "is_code", "on_calls"))
    seeds = retrieval.top(matches, "q", [F.col("score").desc(), F.col("id")], most).select("q", "id").join(asked, "q")
    seeds = F.broadcast(seeds)  # at most ``most`` a question
    near = lambda here, there: edges.join(seeds.withColumnRenamed("id", here), here).select("q", F.col(there).alias("id"), "is_code", "on_calls")
    around = near("src", "dst").union(near("dst", "src")).select("q", "id", F.when(F.col("is_code"), 0.45).otherwise(0.1).alias("graph"))
    own = seeds.select("q", "id", F.when(F.col("is_code"), 1.0).otherwise(0.25).alias("graph"))
    callers = edges.filter(F.col("kind") == graph.CALLS).join(seeds.filter("is_code").withColumnRenamed("id", "dst"), "dst").select("q", F.col("src").alias("id"), "on_calls").distinct()
    called = callers.filter("on_calls").select("q", "id", F.lit(2.2).alias("graph"))
    homes = edges.filter(F.col("kind") == graph.DEFINES).join(callers.select("q", F.col("id").alias("dst")), "dst").select("q", F.col("src").alias("id"), F.lit(2.0).alias("graph"))
    reached = around.select("q", "id").union(own.select("q", "id")).distinct()
    # callers count where they are among the neighbours that are shown
    impact = called.union(homes).join(reached, ["q", "id"], "left_semi")
    return own.union(around).union(impact).groupBy("q", "id").agg(F.max("graph").alias("graph"))


def scores(evidence: DataFrame, questions: DataFrame, fts: DataFrame, nodes: DataFrame) -> DataFrame:
    """q, id, exact, fts, authority, graph, score of the ``evidence`` (id, kind, path, section, text) with any signal and a score above 0.

    questions: (q, question, terms). fts: (q, id, fts) by text_score(). nodes: (q, id, graph).
    """
    asked = retrieval.small(questions.select("q", F.lower("question").alias("low"), "terms", is_code_question(F.col("terms")).alias("is_code")))
    low, is_code, kind = F.col("low"), F.col("is_code"), F.col("kind")
    hay = F.lower(F.concat_ws(" ", "path", "section", "text"))
    boost = product_boost(F.col("path"), kind, low)
    hits = F.expr("size(filter(terms, x -> contains(__hay, lower(x))))")
    held = F.expr("exists(terms, x -> contains(__hay, lower(x)))")
    met = evidence.withColumn("__hay", hay).join(asked, held | (boost > 0))
    none = F.lit(0.0)
    exact = met.select("q", "id", (hits / F.greatest(F.lit(1), F.size("terms"))).alias("exact"), none.alias("fts"), none.alias("graph"))
    signals = exact.union(fts.select("q", "id", none, "fts", none)).union(nodes.select("q", "id", none, none, "graph"))
    signals = signals.groupBy("q", "id").agg(*[F.max(c).alias(c) for c in ("exact", "fts", "graph")])
    slim = evidence.select("id", "kind", "path", "section")
    rows = signals.join(slim, "id").join(asked.drop("terms"), "q")
    factor = F.when((kind == "graph_node") == is_code, 1.0).otherwise(MISMATCH)
    rows = rows.withColumn("exact", F.col("exact") * factor).withColumn("fts", F.col("fts") * factor)
    rows = rows.withColumn("authority", rules.authority(F.col("path"), kind, F.col("section"))).withColumn("__boost", boost)
    total = retrieval.final_score(F.col("exact"), F.col("fts"), F.col("authority"), F.col("graph"), is_code) + node_boost(kind, F.col("section"), low, is_code) + F.col("__boost")
    rows = rows.withColumn("score", total).filter("(exact > 0 or fts > 0 or graph > 0 or __boost > 0) and score > 0")
    return rows.select("q", "id", "exact", "fts", "authority", "graph", "score")


def group_name(kind: Column, path: Column, section: Column, text: Column, has_path: Column) -> Column:
    """Which group of a bundle evidence belongs to; of its text the excerpt counts."""
    p, s, x = F.lower(path), F.lower(section), F.lower(t.excerpt(text))
    return (
        F.when((kind == "graph_query") & has_path, "callers_and_dependents")
        .when(kind.isin("graph_node", "graph_query"), "likely_change_surface")
        .when(p.rlike("^docs/(adr|contracts)/") | (p == "agents.md") | s.isin(MUST_READ_SECTIONS), "must_read")
        .when((kind == "completion_receipt") | F.contains(x, F.lit("verification")) | F.contains(p, F.lit("test")) | F.contains(x, F.lit("test")), "tests_and_verification")
        .otherwise("supporting_evidence")
    )


def prioritised(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of all frames, of equal keys the first: by the frame's place, then by ``order``. ``priority`` says where it came from."""
    whole = reduce(DataFrame.unionByName, [f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)])
    return graph.first_wins(whole, keys, [F.col("priority"), *order])


def edge_recall(required: DataFrame, edges: DataFrame) -> DataFrame:
    """q, hits, wanted, recall for ``required`` (q, kind, src, dst, assertion, source) edges found; null or empty assertion and source ask for nothing."""
    keys = ["kind", "src", "dst"]
    wanted = required.select("q", *keys, F.coalesce("assertion", F.lit("")).alias("wa"), F.coalesce("source", F.lit("")).alias("ws"))
    found = edges.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.coalesce("assertion", F.lit("")).alias("a"), F.coalesce("source", F.lit("")).alias("s"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"e_{k}") for k in keys])
    meets = wanted.join(found, same & ((F.col("wa") == "") | (F.col("wa") == F.col("a"))) & ((F.col("ws") == "") | (F.col("ws") == F.col("s"))), "left_semi")
    hits = meets.groupBy("q").agg(F.count(F.lit(1)).alias("hits"))
    both = wanted.groupBy("q").agg(F.count(F.lit(1)).alias("wanted")).join(hits, "q", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return both.withColumn("recall", F.col("hits") / F.col("wanted"))


def backlog_blocks(docs: DataFrame, key: str, text: str, head: str = r"^- ", more: str = r"^[ \t]|^\s*$") -> DataFrame:
    """key, line_start, line_end, chars: a line that meets ``head`` and those after it that meet ``more``; any other line closes a block."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.withColumn("head", F.col("line").rlike(head)).withColumn("opens", F.col("head") | ~F.col("line").rlike(more))
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("run", F.sum(F.col("opens").cast("long")).over(so_far)).groupBy(key, "run")
    full = F.length("line") > 0
    found = runs.agg(
        F.bool_or("head").alias("kept"), (F.min("at") + 1).cast("long").alias("line_start"), (F.max(F.when(full, F.col("at"))) + 1).cast("long").alias("line_end"),
        F.sum(F.length("line")).cast("long").alias("chars"),
    )
    return found.filter("kept").select(key, "line_start", "line_end", "chars")


def terms(question: Column) -> Column:
    return t.query_terms(question, rules.STOPWORDS)
