"""Context queries over the driver's tables: documents as evidence, parts and orders as graph nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import context, rules
from tessella.plans import graph_queries as g
from tessella.plans.retrieval_queries import BM25_SQL, TERMS_SQL
from tessella.registry import query, table


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


ASKED = ["why this decision", "a decision of Authority", "it must hold", "what calls it", "impact of it", "impact on a/b.py", "where is it", "FAILURE of it", "nothing", "왜 결정"]
ASKED_SQL = f"SELECT p_partkey, p_name || ' ' || ([{', '.join(repr(x) for x in ASKED)}])[p_size % {len(ASKED)} + 1] AS x, CASE WHEN p_brand = 'Brand#2' THEN ' File-Impact ' WHEN p_brand = 'Brand#3' THEN 'contract' ELSE '' END AS e FROM part"


def _mode_sql(x: str) -> str:
    rows = []
    for i, (words, name) in enumerate(context.MODES):
        then = f"'{name}'"
        if i == context.DECISION_RULE:
            then = f"CASE WHEN {_any(f'lower({x})', context.ON_AUTHORITY)} THEN '{context.OTHER_MODE}' ELSE '{name}' END"
        elif i == context.CHANGE_RULE:
            then = f"CASE WHEN len(list_filter(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_./:-]*|[./][A-Za-z0-9_./:-]+'), lambda y: contains(y, '/') OR contains(y, '.'))) > 0 THEN 'file_impact' ELSE '{name}' END"
        rows.append(f"WHEN {_any(f'lower({x})', words)} THEN {then}")
    return f"CASE {' '.join(rows)} ELSE '{context.OTHER_MODE}' END"


@query("context_modes", f"SELECT p_partkey, CASE WHEN trim(e) = '' THEN {_mode_sql('x')} WHEN lower(trim(e)) IN ('authority', 'contract') THEN 'authority_or_contract' ELSE replace(lower(trim(e)), '-', '_') END AS mode FROM ({ASKED_SQL}) AS a")
def context_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, ASKED)), F.col("p_size") % len(ASKED) + 1))
    explicit = F.when(F.col("p_brand") == "Brand#2", " File-Impact ").when(F.col("p_brand") == "Brand#3", "contract").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", context.mode(asked, explicit).alias("mode"))


def _terms_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({x}, '[A-Za-z0-9_./:-]+|[가-힣]+'), lambda y: length(y) >= 2 AND lower(y) NOT IN {_list(rules.STOPWORDS)}))"


def _code_sql(y: str) -> str:
    return f"(lower({y}) IN {_list(context.CODE_WORDS)} OR contains({y}, '_') OR contains({y}, '/') OR contains({y}, '::') OR (contains({y}, '.') AND NOT starts_with({y}, '.')) OR ({y} <> lower({y}) AND {y} <> upper({y}) AND {y} <> upper({y}[1]) || lower({y}[2:])))"


@query("code_terms", f"SELECT doc_id, CAST(len(terms) AS INTEGER) AS n_terms, CAST(len(list_filter(terms, lambda y: {_code_sql('y')})) AS INTEGER) AS n_code FROM (SELECT doc_id, {_terms_sql('text')} AS terms FROM documents) AS x")
def code_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", context.terms(F.col("text")).alias("terms"))
    return d.select("doc_id", F.size("terms").alias("n_terms"), F.size(F.filter("terms", context.is_code_term)).alias("n_code"))


QUESTIONS = ["current license decision", "where token is defined", "une elle pour les", "idiot file src/main.py", "the GetToken function thing"]
QUESTIONS_SQL = " UNION ALL ".join(f"SELECT {i} AS q, '{x}' AS question" for i, x in enumerate(QUESTIONS))
CQ_SQL = f"cq AS (SELECT q, lower(question) AS low, terms, len(list_filter(terms, lambda y: {_code_sql('y')})) > 0 AS is_code FROM (SELECT q, question, {_terms_sql('question')} AS terms FROM ({QUESTIONS_SQL})) AS x)"
PATHS = {"src3": "docs/contracts/", "src4": "docs/adr/", "src0": "<graph:"}
WHOLE = {"src5": "README.md", "src6": "docs/PRD.md"}
KINDS = {"src0": "graph_node", "src1": "completion_receipt", "src2": "task_artifact"}
EVIDENCE_SQL = f"""ev AS (SELECT doc_id AS id, text, lang, CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'document' END AS kind,
CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WHOLE.items())} {' '.join(f"WHEN '{k}' THEN '{v}' || doc_id" for k, v in PATHS.items())} ELSE 'notes/' || doc_id END AS path,
CASE WHEN source = 'src0' THEN CASE WHEN lang = 'en' THEN 'file x' ELSE 'symbol x' END WHEN lang = 'en' THEN 'Decision' ELSE 'body' END AS section FROM documents)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, source = table(spark, sf_dir, "documents"), F.col("source")
    chain = lambda pairs, other: F.coalesce(*[F.when(source == k, v) for k, v in pairs], other)
    path = chain([*WHOLE.items(), *[(k, F.concat(F.lit(v), "doc_id")) for k, v in PATHS.items()]], F.concat(F.lit("notes/"), "doc_id"))
    english = F.col("lang") == "en"
    section = F.when(source == "src0", F.when(english, "file x").otherwise("symbol x")).when(english, "Decision").otherwise("body")
    return d.select(F.col("doc_id").alias("id"), "text", "lang", chain(KINDS.items(), F.lit("document")).alias("kind"), path.alias("path"), section.alias("section"))


_PRODUCT, _DECISION = _any("low", context.ON_PRODUCT), _any("low", context.ON_DECISION)
_BOOST = f"""CASE WHEN NOT {_PRODUCT} AND NOT {_DECISION} THEN 0 WHEN path = 'docs/PRD.md' THEN 0.9 WHEN path IN ('README.md', 'docs/README.md') THEN 0.55 WHEN kind = 'completion_receipt' THEN CASE WHEN {_DECISION} THEN 0.8 ELSE 0.45 END
WHEN kind = 'task_artifact' THEN CASE WHEN {_DECISION} THEN 0.65 ELSE 0.35 END WHEN starts_with(path, 'docs/contracts/') AND {_PRODUCT} AND NOT {_DECISION} THEN -0.2 ELSE 0 END"""
_AUTHORITY = """CASE WHEN starts_with(path, 'docs/contracts/') THEN 0.45 WHEN starts_with(path, 'docs/adr/') THEN CASE WHEN lower(section) = 'decision' THEN 0.5 ELSE 0.4 END WHEN kind = 'completion_receipt' THEN 0.35 WHEN kind = 'task_artifact' THEN 0.3
WHEN path = 'README.md' THEN 0.25 WHEN starts_with(kind, 'graph_') THEN 0.05 ELSE 0.1 END"""
_NODE = "CASE WHEN is_code AND kind = 'graph_node' AND ((contains(low, 'function') AND starts_with(section, 'symbol ')) OR (contains(low, 'file') AND starts_with(section, 'file '))) THEN 0.4 ELSE 0 END"
_LOWER_TERMS = "SELECT q, list_distinct(list_transform(terms, lambda y: lower(y))) AS terms FROM cq"
_RAW = f"""raw AS (SELECT cq.*, ev.id, kind, path, section, len(list_filter(terms, lambda y: contains(lower(path || ' ' || section || ' ' || text), lower(y))))::DOUBLE / greatest(1, len(terms)) AS exact0,
coalesce(fts, 0) AS fts0, CASE WHEN cq.q IN (1, 2) AND kind = 'graph_node' AND lang = 'en' THEN 1.0::DOUBLE ELSE 0 END AS graph FROM ev CROSS JOIN cq LEFT JOIN f ON f.q = cq.q AND f.id = ev.id)"""


@query("context_scores", f"""WITH {CQ_SQL}, {EVIDENCE_SQL}, {BM25_SQL.replace(TERMS_SQL, _LOWER_TERMS)},
f AS (SELECT q, doc AS id, CASE WHEN length < 5 THEN 0.3 ELSE 1 END / (1 + abs(score)) AS fts FROM (SELECT b.*, length, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, b.doc) AS rank FROM b JOIN d ON b.doc = d.doc) AS x WHERE rank <= 50), {_RAW},
s AS (SELECT *, CASE WHEN (kind = 'graph_node') = is_code THEN 1.0::DOUBLE ELSE 0.3 END AS w, {_BOOST} AS boost, {_AUTHORITY} AS authority, {_NODE} AS node FROM raw),
t AS (SELECT q, id, 2 * exact0 * w + 1.2 * fts0 * w + authority + CASE WHEN is_code THEN 2.0 ELSE 0.15 END * graph + node + boost AS score FROM s WHERE exact0 > 0 OR fts0 > 0 OR graph > 0 OR boost > 0)
SELECT q, id, round(score, 6)::DOUBLE AS score FROM t WHERE score > 0""")
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "q int, question string").withColumn("terms", context.terms(F.col("question")))
    e = evidence(spark, sf_dir)
    best = context.text_scores(e, asked, "([a-z0-9]+)")
    nodes = e.filter("kind = 'graph_node' and lang = 'en'").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("q"), "id", F.lit(1.0).alias("graph"))
    return context.scores(e, asked, best, nodes).select("q", "id", F.round("score", 6).alias("score"))


_LINES = "rtrim(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), ' ')"
_EXCERPT_SQL = f"ex AS (SELECT * REPLACE (CASE WHEN length({_LINES}) > 900 THEN substr({_LINES}, 1, 897) || '...' ELSE {_LINES} END AS text) FROM ev)"


@query("context_groups", f"""WITH {EVIDENCE_SQL}, {_EXCERPT_SQL} SELECT id, CASE WHEN kind = 'graph_node' THEN 'likely_change_surface' WHEN regexp_matches(lower(path), '^docs/(adr|contracts)/') OR lower(section) IN {_list(context.MUST_READ_SECTIONS)} THEN 'must_read'
WHEN kind = 'completion_receipt' OR contains(lower(text), 'verification') OR contains(lower(text), 'test') OR contains(lower(path), 'test') THEN 'tests_and_verification' ELSE 'supporting_evidence' END AS group_name FROM ex""")
def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = context.group_name(F.col("kind"), F.col("path"), F.col("section"), F.col("text"), F.lit(False))
    return evidence(spark, sf_dir).select("id", name.alias("group_name"))


NODE_TERMS = {0: ["Brand#2", "ring"], 1: ["ECONOMY", "idge"], 2: ["1-URGENT", "zz"], 3: ["urgent"]}
_ASK = " UNION ALL ".join(f"SELECT {q} AS q, {x} AS terms, {q % 2 == 0} AS is_code" for q, x in NODE_TERMS.items())


def _matches_sql(nodes: str) -> str:
    return f"""SELECT q, is_code, id, CASE WHEN list_has_any(vals, terms) THEN 1.0::DOUBLE ELSE 0.5 END AS score FROM ({nodes}) AS n, ({_ASK}) AS a
WHERE list_has_any(vals, terms) OR len(list_filter(terms, lambda y: length(y) >= 3 AND contains(lower(array_to_string(vals, ' ')), lower(y)))) > 0"""


def _node_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, x, q % 2 == 0, q == 2) for q, x in NODE_TERMS.items()], "q int, terms array<string>, is_code boolean, on_calls boolean")


@query("graph_node_matches", f"SELECT q, id, score FROM ({_matches_sql('SELECT p_partkey AS id, [p_name, p_brand, p_type] AS vals FROM part')}) AS m")
def graph_node_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_brand", "p_type").alias("values"))
    return context.node_matches(nodes, _node_questions(spark).select("q", "terms"))


_ORDERS = "SELECT 'symbol:' || o_orderkey AS id, [o_orderstatus, o_orderpriority] AS vals FROM orders"


@query("context_graph_scores", f"""WITH e AS ({g.EDGES_SQL}), m AS ({_matches_sql(_ORDERS)}), s AS (SELECT q, is_code, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM m) AS x WHERE r <= 20),
nb AS (SELECT q, is_code, dst AS id FROM e JOIN s ON e.src = s.id UNION SELECT q, is_code, src FROM e JOIN s ON e.dst = s.id UNION SELECT q, is_code, id FROM s),
c AS (SELECT DISTINCT q, src AS id FROM e JOIN s ON e.dst = s.id AND is_code WHERE kind = 'CALLS'), h AS (SELECT q, src AS id FROM e JOIN c ON e.dst = c.id WHERE kind = 'DEFINES')
SELECT q, id, CASE WHEN is_code THEN greatest(CASE WHEN (q, id) IN (SELECT (q, id) FROM s) THEN 1.0 ELSE 0.45 END, CASE WHEN q = 2 AND (q, id) IN (SELECT (q, id) FROM c) THEN 2.2 ELSE 0 END, CASE WHEN (q, id) IN (SELECT (q, id) FROM h) THEN 2.0 ELSE 0 END)
ELSE CASE WHEN (q, id) IN (SELECT (q, id) FROM s) THEN 0.25 ELSE 0.1 END END::DOUBLE AS graph FROM nb""")
def context_graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").select(F.concat(F.lit("symbol:"), "o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("values"))
    asked = _node_questions(spark)
    return context.graph_scores(g.edges(spark, sf_dir), context.node_matches(nodes, asked.select("q", "terms")), asked)


@query("priority_union", """SELECT doc_id, CAST(p AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY p, doc_id) AS r FROM (
SELECT doc_id, text, 0 AS p FROM documents WHERE source = 'src0' UNION ALL SELECT doc_id, text, 1 FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, text, 2 FROM documents) AS x) AS y WHERE r = 1""")
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("ref"))
    return context.prioritised([d.filter("source = 'src0'"), d.filter("lang = 'en'"), d], ["ref"], [F.col("doc_id")]).select("doc_id", "priority")


@query("edge_recall", """SELECT o_orderpriority AS q, CAST(count(*) FILTER (WHERE found) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS wanted, (count(*) FILTER (WHERE found))::DOUBLE / count(*) AS recall
FROM (SELECT o_orderpriority, o_totalprice > 100000 AND (o_orderstatus <> 'P' OR o_orderkey % 2 = 0) AS found FROM orders) AS x GROUP BY 1""")
def edge_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = [F.lit("CALLS").alias("kind"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")]
    required = o.select(F.col("o_orderpriority").alias("q"), *keys, F.when(F.col("o_orderstatus") == "P", "0").alias("assertion"), F.lit("").alias("source"))
    return context.edge_recall(required, o.filter("o_totalprice > 100000").select(*keys, (F.col("o_orderkey") % 2).cast("string").alias("assertion"), F.lit("orders").alias("source")))


@query("backlog_blocks", """WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) AS x, range(1, 100000) AS r(i) WHERE i <= len(ls)),
c AS (SELECT *, regexp_matches(line, '^[T-W]') AS head, regexp_matches(line, '^[T-W]') OR NOT regexp_matches(line, '^[A-M]|^$') AS opens FROM l), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c)
SELECT doc_id, min(i) AS line_start, max(i) FILTER (WHERE line <> '') AS line_end, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY doc_id, run HAVING bool_or(head)""")
def backlog_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.backlog_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", "^[T-W]", "^[A-M]|^$")
