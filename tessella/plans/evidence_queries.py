"""Graph evidence for questions, phrases by a positional index, and knowledge records, over the driver's tables.

Customers are files, orders symbols (one in ten with a name of its own); documents are texts and records, events their history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import candidates, context, knowledge, rules, textindex
from tessella.plans import graph_queries as g
from tessella.plans.context_queries import _list, _mode_sql
from tessella.registry import query, table
from tessella.sources.shared import fresh_path

ASKED = [
    "what is the impact of a change of src/c7.py and only_120 or sym_35",
    "where is only_50 defined, and sym_7?",
    "who calls only_200 and only_210, ./src/c8.py",
    "why this decision on src/c9.py or only_30",
    "impact of nothing_here or (only_40.) in src/gone.py",
]
NAME_SQL = "CASE WHEN o_orderkey % 10 = 0 THEN 'only_' || o_orderkey ELSE 'sym_' || (o_orderkey % 400) END"
NODES_SQL = f"""n AS (SELECT 'file:' || c_custkey AS id, 'file' AS kind, NULL::VARCHAR AS name, NULL::VARCHAR AS qualified_name, 'src/c' || c_custkey || '.py' AS path FROM customer
UNION ALL SELECT 'symbol:' || o_orderkey, 'symbol', {NAME_SQL}, 'C' || o_custkey || '.' || {NAME_SQL}, 'src/c' || o_custkey || '.py' FROM orders)"""
_ENDS = " OR ".join(f"ends_with(token, '{x}')" for x in candidates.CODE_ENDINGS)
_STEPS = " UNION ALL ".join(f"SELECT {at} AS here, {to} AS nxt, kind, src, dst, {rank} AS rank, '{why}' AS why FROM e WHERE kind = '{kind}'" for rank, (kind, at, to, why) in enumerate(candidates.STEPS))
_LABEL = "q, token, selector"
_SAME = "f.q = s.q AND f.token = s.token AND f.selector = s.selector"


def _level(k: int) -> str:
    """The steps out of the frontier l<k-1>, without those into it that come last, and the next frontier."""
    met = " UNION ALL ".join(f"SELECT {_LABEL}, id FROM l{j}" for j in range(k))
    return f"""o{k} AS (SELECT f.q, f.token, f.selector, s.* FROM steps AS s JOIN l{k - 1} AS f ON s.here = f.id),
p{k} AS (SELECT {_LABEL}, kind, src, dst, {k} AS depth, 'depth {k}: ' || why AS reason FROM o{k} AS s WHERE NOT (rank = 3 AND EXISTS (SELECT 1 FROM l{k - 1} AS f WHERE {_SAME} AND f.id = s.nxt))),
l{k} AS (SELECT DISTINCT {_LABEL}, nxt AS id FROM o{k} EXCEPT SELECT * FROM ({met}))"""


_ONE_STEP = " UNION ALL ".join(f"SELECT {_LABEL}, e.kind, src, dst, 1, '{why}' FROM e JOIN single AS s ON e.{end} = s.id WHERE selector = '{name}' AND e.kind = 'CALLS'" for name, (end, why) in candidates.ONE_STEP.items())
ANSWERS_SQL = f"""e AS ({g.EDGES_SQL}), {NODES_SQL},
qs AS ({" UNION ALL ".join(f"SELECT {i} AS q, '{x}' AS question" for i, x in enumerate(ASKED))}),
tk AS (SELECT q, mode, unnest(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_./:-]*|[./][A-Za-z0-9_./:-]+'), lambda y: trim(y, '.,()[]{{}}')))) AS token FROM (SELECT *, {_mode_sql('question')} AS mode FROM qs)),
lb AS (SELECT q, token, unnest(list_filter(CASE WHEN contains(token, '/') OR {_ENDS} THEN [CASE WHEN mode IN ('file_impact', 'call_impact') THEN 'impact_file' END, 'file']
  ELSE [CASE WHEN mode = 'code_location' THEN 'symbol' END, CASE WHEN mode IN ('file_impact', 'call_impact') THEN 'callers_of' END, CASE WHEN mode IN ('file_impact', 'call_impact') THEN 'impact_symbol' END] END, lambda y: y IS NOT NULL)) AS selector FROM tk WHERE length(token) >= 2),
m AS (SELECT DISTINCT {_LABEL}, id FROM lb JOIN n ON (selector IN ('file', 'impact_file') AND n.kind = 'file' AND path = array_to_string(list_filter(string_split(token, '/'), lambda y: y NOT IN ('', '.')), '/'))
  OR (selector NOT IN ('file', 'impact_file') AND n.kind = 'symbol' AND (name = token OR qualified_name = token))),
c AS (SELECT {_LABEL}, count(*) AS n_matches FROM m GROUP BY ALL), single AS (SELECT m.* FROM m JOIN c USING ({_LABEL}) WHERE n_matches = 1),
steps AS ({_STEPS}), l0 AS (SELECT * FROM single WHERE starts_with(selector, 'impact_')), {_level(1)}, {_level(2)},
paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL {_ONE_STEP})"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(key % 10 == 0, F.concat(F.lit("only_"), key)).otherwise(F.concat(F.lit("sym_"), key % 400))
    file = lambda c: F.concat(F.lit("src/c"), c, F.lit(".py")).alias("path")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("file:"), "c_custkey").alias("id"), F.lit("file").alias("kind"), none.alias("name"), none.alias("qualified_name"), file(F.col("c_custkey")))
    symbols = table(spark, sf_dir, "orders").select(F.concat(F.lit("symbol:"), key).alias("id"), F.lit("symbol").alias("kind"), name.alias("name"), F.concat(F.lit("C"), owner, F.lit("."), name).alias("qualified_name"), file(owner))
    return files.unionByName(symbols)


def _asked(spark: SparkSession) -> DataFrame:
    return candidates.small_questions(spark.createDataFrame(list(enumerate(ASKED)), "q int, question string"))


@query("graph_candidates", f"""WITH {ANSWERS_SQL}, nm AS (SELECT id, coalesce(qualified_name, path, id) AS name, coalesce(path, '') AS loc, coalesce(qualified_name, '') AS qualified FROM n),
lines AS (SELECT {_LABEL}, 0 AS part, row_number() OVER (PARTITION BY {_LABEL} ORDER BY loc, qualified, id) AS place, rtrim('match ' || name || ' ' || loc) AS line FROM m JOIN nm USING (id) QUALIFY place <= 5
UNION ALL SELECT {_LABEL}, 1, row_number() OVER (PARTITION BY {_LABEL} ORDER BY depth, kind, src, dst) AS place, a.name || ' --' || kind || '--> ' || b.name || ': ' || reason FROM paths JOIN nm AS a ON src = a.id JOIN nm AS b ON dst = b.id QUALIFY place <= 10),
t AS (SELECT {_LABEL}, string_agg(line, chr(10) ORDER BY part, place) AS text FROM lines GROUP BY ALL), k AS (SELECT {_LABEL}, count(*) AS n_paths FROM paths GROUP BY ALL),
r AS (SELECT c.*, coalesce(n_paths, 0)::BIGINT AS n_paths, text FROM c JOIN t USING ({_LABEL}) LEFT JOIN k USING ({_LABEL}))
SELECT {_LABEL}, '<graph-query:' || selector || ':' || substr(sha256(concat_ws(chr(10), selector, token, n_matches, n_paths, text)), 1, 12) || '>' AS path, selector AS section, CASE WHEN n_paths > 0 THEN 4.0 ELSE 3.0 END::DOUBLE AS score, n_matches, n_paths, text FROM r""")
def graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.graph_candidates(_asked(spark), nodes(spark, sf_dir), g.edges(spark, sf_dir))


_WANTED = f"""w AS (SELECT {_LABEL}, id FROM m WHERE selector IN ('symbol', 'callers_of', 'callees_of') UNION SELECT m.* FROM m JOIN c USING ({_LABEL}) WHERE n_matches > 1
UNION SELECT {_LABEL}, unnest([src, dst]) FROM paths WHERE selector IN ('callers_of', 'callees_of')),
fd AS (SELECT {_LABEL}, src, min(dst) AS first FROM e JOIN w ON e.dst = w.id WHERE kind = 'DEFINES' GROUP BY ALL UNION ALL SELECT {_LABEL}, id, '' FROM w),
pe AS (SELECT {_LABEL}, kind, src, dst FROM paths UNION SELECT {_LABEL}, 'DEFINES', e.src, e.dst FROM e JOIN (SELECT {_LABEL}, src, min(first) AS first FROM fd GROUP BY ALL) AS f ON e.src = f.src WHERE kind = 'DEFINES' AND dst >= first
UNION SELECT {_LABEL}, e.kind, e.src, e.dst FROM e JOIN m ON e.src = m.id OR e.dst = m.id WHERE selector = 'file')"""


@query("graph_payload_edges", f"WITH {ANSWERS_SQL}, {_WANTED} SELECT {_LABEL}, kind, src, dst FROM pe")
def graph_payload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.payload(_asked(spark), nodes(spark, sf_dir), g.edges(spark, sf_dir))[0]


@query("graph_payload_nodes", f"WITH {ANSWERS_SQL}, {_WANTED} SELECT {_LABEL}, id FROM (SELECT {_LABEL}, unnest([src, dst]) AS id FROM pe UNION SELECT * FROM m) AS x WHERE id IN (SELECT id FROM n)")
def graph_payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.payload(_asked(spark), nodes(spark, sf_dir), g.edges(spark, sf_dir))[1]


TERMS = {0: ["of/the", "src3", "token"], 1: ["the-the", "The.The", "the"], 2: ["the of the", "inoran inoran inoran"], 3: ["::", "src17", "gone/word"]}


def _tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _found_sql(docs: str, phrases: str) -> str:
    """key, phrase, f for ``docs`` (key, fs: lists of words) and ``phrases`` (phrase) of up to three words."""
    return f"""(SELECT key, phrase, count(*) AS f FROM (SELECT *, lead(word) OVER place AS w2, lead(word, 2) OVER place AS w3 FROM (SELECT key, i, generate_subscripts(fs[i], 1) AS j, unnest(fs[i]) AS word FROM (SELECT key, fs, unnest(range(1, len(fs) + 1)) AS i FROM {docs})) WINDOW place AS (PARTITION BY key, i ORDER BY j)) AS t
JOIN (SELECT DISTINCT phrase FROM {phrases}) AS p ON word = phrase[1] AND (len(phrase) < 2 OR w2 = phrase[2]) AND (len(phrase) < 3 OR w3 = phrase[3]) GROUP BY key, phrase)"""


_PHRASES_SQL = " UNION ALL ".join(f"SELECT {q} AS q, {_tokens_sql(repr(x))} AS phrase" for q, terms in TERMS.items() for x in terms)


@query("phrase_bm25", f"""WITH p AS (SELECT q, phrase, count(*) AS times FROM ({_PHRASES_SQL}) WHERE len(phrase) > 0 GROUP BY ALL),
d AS (SELECT doc_id AS key, [{_tokens_sql('source')}, {_tokens_sql('text')}] AS fs, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_./:-]+|[가-힣]+')) AS n_words FROM documents),
x AS (SELECT phrase, key AS doc_id, n_words, len(fs[1]) + len(fs[2]) AS length, f, count(*) OVER (PARTITION BY phrase) AS n FROM {_found_sql('d', 'p')} AS h JOIN d USING (key)),
s AS (SELECT (SELECT count(*) FROM d) AS nd, (SELECT avg(len(fs[1]) + len(fs[2])) FROM d) AS mean),
z AS (SELECT q, doc_id, n_words, sum(times * CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) > 0 THEN ln((nd - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM x JOIN p USING (phrase), s GROUP BY q, doc_id, n_words)
SELECT q, doc_id, CAST(n_words AS INTEGER) AS n_words, round(score, 6)::DOUBLE AS score FROM z""")
def phrase_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "text-index")
    textindex.write(table(spark, sf_dir, "documents"), path, "doc_id", ["source", "text"], "text")
    found = textindex.phrase_bm25(textindex.read(spark, path), spark.createDataFrame(list(TERMS.items()), "q int, terms array<string>"))
    return found.select("q", F.col("doc").alias("doc_id"), "n_words", F.round("score", 6).alias("score"))


QUESTIONS = ["what is the license of src3 documents", "token idiot docs/src4", "de la elle r77 en", "the of"]
REC_SQL = """r AS (SELECT 'r' || doc_id AS id, lang AS kind, CASE WHEN doc_id % 11 = 0 THEN 'draft' ELSE 'reviewed' END AS status, regexp_extract(text, '^[^.]*') AS title, text AS claim, source AS summary, 'g' || doc_id AS record_digest,
CASE WHEN doc_id % 29 = 0 THEN [] ELSE [{'path': 'docs/' || source, 'digest': CASE WHEN doc_id % 13 = 7 THEN 'old' ELSE 'd' || source END}] END AS refs,
CASE WHEN doc_id % 29 = 0 THEN '[]' ELSE '[{"path":"docs/' || source || '","kind":"document","section":"' || lang || '","content_sha256":"' || CASE WHEN doc_id % 13 = 7 THEN 'old' ELSE 'd' || source END || '"}]' END AS told,
CASE WHEN doc_id % 17 = 3 THEN ['r' || (doc_id - 1)] WHEN doc_id % 17 = 4 THEN ['r' || doc_id] WHEN doc_id % 17 = 5 THEN ['gone', ''] ELSE [] END AS supersedes FROM documents),
ev AS (SELECT 'e' || event_id AS id, CASE WHEN value < 1 THEN 'else' WHEN event_type = 'click' THEN 'approved' WHEN event_type = 'view' THEN 'rejected_candidate' WHEN event_type = 'purchase' THEN 'superseded' WHEN event_type = 'signup' THEN 'refreshed_record_candidate' WHEN value > 95 THEN 'deprecated' ELSE 'refreshed_candidate' END AS type,
CASE WHEN event_id % 31 <> 0 THEN 'r' || (user_id * 7) END AS record_id, CASE WHEN event_id % 37 <> 0 THEN 'r' || (user_id * 7 + 3) END AS superseded_by, CASE WHEN event_id % 5 = 0 THEN 'wrong' WHEN event_type = 'purchase' THEN 'g' || (user_id * 7 + 3) ELSE 'g' || (user_id * 7) END AS record_digest,
'x' AS event_digest, CASE WHEN event_id % 50 = 1 THEN 'y' ELSE 'x' END AS content_digest FROM events)"""


def _numbered(letter: str, number: Column | str) -> Column:
    return F.concat(F.lit(letter), number)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    digest = F.when(i % 13 == 7, "old").otherwise(F.concat(F.lit("d"), "source"))
    ref = F.struct(F.concat(F.lit("docs/"), "source").alias("path"), F.lit("document").alias("kind"), F.col("lang").alias("section"), digest.alias("content_sha256"))
    old = F.when(i % 17 == 3, F.array(_numbered("r", i - 1))).when(i % 17 == 4, F.array(_numbered("r", i))).when(i % 17 == 5, F.array(F.lit("gone"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return d.select(
        _numbered("r", i).alias("id"), F.col("lang").alias("kind"), F.when(i % 11 == 0, "draft").otherwise("reviewed").alias("status"), F.regexp_extract("text", r"^[^.]*", 0).alias("title"), F.col("text").alias("claim"), F.col("source").alias("summary"),
        F.when(i % 29 != 0, F.array(ref)).otherwise(F.array().cast("array<struct<path:string,kind:string,section:string,content_sha256:string>>")).alias("source_refs"), old.alias("supersedes"), _numbered("g", i).alias("record_digest"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind, key = table(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id") * 7
    named = {"click": "approved", "view": "rejected_candidate", "purchase": "superseded", "signup": "refreshed_record_candidate"}
    told = F.when(F.col("value") < 1, "else")
    for k, v in named.items():
        told = told.when(kind == k, v)
    i = F.col("event_id")
    digest = F.when(i % 5 == 0, "wrong").when(kind == "purchase", _numbered("g", key + 3)).otherwise(_numbered("g", key))
    return e.select(
        _numbered("e", i).alias("id"), told.when(F.col("value") > 95, "deprecated").otherwise("refreshed_candidate").alias("type"), F.when(i % 31 != 0, _numbered("r", key)).alias("record_id"), F.when(i % 37 != 0, _numbered("r", key + 3)).alias("superseded_by"),
        digest.alias("record_digest"), F.lit("x").alias("event_digest"), F.when(i % 50 == 1, "y").otherwise("x").alias("content_digest"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.concat(F.lit("docs/"), "source").alias("path"), F.concat(F.lit("d"), "source").alias("content_sha256"))


_STATUS_SQL = f"""{REC_SQL}, st AS (SELECT r.*, CASE WHEN id IN (SELECT unnest(supersedes) FROM r) THEN 'superseded' WHEN id IN (SELECT record_id FROM ev WHERE type = 'deprecated' AND record_id IS NOT NULL) THEN 'deprecated'
WHEN len(refs) = 0 OR len(list_filter(refs, lambda x: x.digest = 'old')) > 0 THEN 'stale' ELSE status END AS derived FROM r)"""


@query("knowledge_statuses", f"WITH {_STATUS_SQL} SELECT derived AS status, count(*) AS available, count(*) FILTER (WHERE derived IN ('stale', 'superseded', 'deprecated')) AS excluded FROM st GROUP BY derived")
def knowledge_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knowledge.with_status(records(spark, sf_dir), events(spark, sf_dir), sources(spark, sf_dir))
    return knowledge.status_report(rows, ["stale", "superseded", "deprecated"])


@query("knowledge_integrity", f"""WITH {REC_SQL}, j AS (SELECT ev.*, a.id AS a_id, a.record_digest AS a_digest, b.id AS b_id, b.record_digest AS b_digest FROM ev LEFT JOIN r AS a ON ev.record_id = a.id LEFT JOIN r AS b ON ev.superseded_by = b.id),
k AS (SELECT * FROM j WHERE content_digest = 'x') SELECT code, subject, count(*) AS n FROM (
SELECT 'knowledge_event_digest_mismatch' AS code, id AS subject FROM j WHERE content_digest <> 'x'
UNION ALL SELECT 'knowledge_event_record_missing', coalesce(record_id, id) FROM k WHERE type IN ('approved', 'deprecated', 'refreshed_record_candidate', 'superseded') AND a_id IS NULL
UNION ALL SELECT 'knowledge_event_record_digest_mismatch', record_id FROM k WHERE type IN ('approved', 'deprecated', 'refreshed_record_candidate') AND a_digest <> record_digest
UNION ALL SELECT 'knowledge_event_superseded_by_missing', coalesce(superseded_by, id) FROM k WHERE type = 'superseded' AND b_id IS NULL
UNION ALL SELECT 'knowledge_event_record_digest_mismatch', superseded_by FROM k WHERE type = 'superseded' AND b_digest <> record_digest
UNION ALL SELECT 'knowledge_event_type_unknown', id FROM k WHERE type = 'else'
UNION ALL SELECT 'knowledge_supersedes_self', id FROM r WHERE list_contains(supersedes, id)
UNION ALL SELECT 'knowledge_supersedes_missing', old FROM (SELECT unnest(supersedes) AS old FROM r) WHERE old <> '' AND old NOT IN (SELECT id FROM r)) GROUP BY code, subject""")
def knowledge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    found = knowledge.integrity_problems(events(spark, sf_dir), r).unionByName(knowledge.supersession_problems(r))
    return found.groupBy("code", "subject").agg(F.count(F.lit(1)).alias("n"))


def _share(field: str) -> str:
    return f"len(list_filter(terms, lambda x: contains(lower({field}), lower(x))))::DOUBLE / len(terms)"


def _topk_sql(shown: str, limit: int) -> str:
    weights = {"id || chr(10) || kind": 1.0, "title": 2.4, "claim": 2.0, "summary": 1.2, "told": 0.8}
    exact = " + ".join(f"{w} * {_share(f)}" for f, w in weights.items())
    return f"""WITH {_STATUS_SQL}, qs AS (SELECT q, list_sort(list_distinct(list_filter(regexp_extract_all(question, '[A-Za-z0-9_./:-]+|[가-힣]+'), lambda x: length(x) >= 2 AND lower(x) NOT IN {_list(rules.KNOWLEDGE_STOPWORDS)}))) AS terms
FROM ({" UNION ALL ".join(f"SELECT {i} AS q, '{x}' AS question" for i, x in enumerate(QUESTIONS))})),
b AS (SELECT *, id AS key, [{_tokens_sql("concat_ws(chr(10), id, kind, title, claim, summary, told)")}] AS fs FROM st WHERE derived IN {shown}),
ph AS (SELECT q, phrase, count(*) AS times FROM (SELECT q, {_tokens_sql('term')} AS phrase FROM (SELECT q, unnest(terms) AS term FROM qs)) WHERE len(phrase) > 0 GROUP BY ALL),
ft AS (SELECT key, q, 1 / (1 + sum(times * 1e-6 * f * 2.2 / (f + 1.2))) AS fts FROM {_found_sql('b', 'ph')} AS fr JOIN ph USING (phrase) GROUP BY key, q),
sc AS (SELECT b.id, qs.q, derived AS status, round(CASE WHEN len(terms) = 0 THEN 0 ELSE {exact} END + 1.2 * coalesce(fts, 0) + CASE WHEN status = 'reviewed' THEN 0.5 ELSE 0 END, 6)::DOUBLE AS score FROM b CROSS JOIN qs LEFT JOIN ft ON ft.key = b.id AND ft.q = qs.q)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank, id, status, score FROM sc WHERE score > 0 QUALIFY rank <= {limit}"""


def _topk(spark: SparkSession, sf_dir: str, limit: int, include: tuple[str, ...]) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "q int, question string")
    return knowledge.query(records(spark, sf_dir), events(spark, sf_dir), sources(spark, sf_dir), asked, limit, include)


@query("knowledge_topk", _topk_sql("('reviewed')", 10))
def knowledge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, 10, ())


@query("knowledge_topk_history", _topk_sql("('reviewed', 'stale', 'superseded', 'deprecated')", 50))
def knowledge_topk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, 50, ("stale", "superseded", "deprecated"))
