"""Inventory queries: documents as files (path = source/lang/id), labels as annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import inventory
from tessella.registry import query, table

FILES_SQL = "SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, source, lang, n_chars FROM documents"
NOTES_SQL = "SELECT d.source || '/' || d.lang || '/' || d.doc_id || '.md' AS path, l.quality, l.toxic FROM labels AS l JOIN documents AS d ON d.doc_id = l.doc_id"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("path"), "source", "lang", "n_chars", "doc_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("path", "quality", "toxic")


CLASSIFY_SQL = f"""f AS ({FILES_SQL}), a AS ({NOTES_SQL}),
c AS (SELECT f.path, CASE WHEN f.source = 'src3' OR regexp_matches(f.path, '^src1./de/.*$') THEN 'excluded'
  WHEN f.path IN (SELECT path FROM a WHERE toxic = 1) THEN 'excluded_override' WHEN f.path IN (SELECT path FROM a) THEN 'annotated'
  WHEN f.n_chars > 5000 THEN 'annotation_required' ELSE 'indexed_only' END AS classification FROM f)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = notes(spark, sf_dir)
    excluded = (F.col("source") == "src3") | t.glob_any(F.col("path"), ["src1?/de/*"])
    return inventory.classify(files(spark, sf_dir), a, a.filter("toxic = 1"), excluded, F.col("n_chars") > 5000)


@query("inventory_classify", f"WITH {CLASSIFY_SQL} SELECT path, classification FROM c")
def inventory_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("path", "classification")


@query("inventory_summary", f"""WITH {CLASSIFY_SQL}, k AS (SELECT unnest(['excluded', 'excluded_override', 'annotated', 'annotation_required', 'indexed_only', 'stale']) AS classification)
SELECT k.classification, CAST(count(c.path) AS BIGINT) AS n FROM k LEFT JOIN c ON k.classification = c.classification GROUP BY k.classification UNION ALL SELECT 'total', count(*) FROM c""")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.counts(_classified(spark, sf_dir), [*inventory.CLASSES, "stale"])


@query("orphans_anti", f"SELECT path FROM ({NOTES_SQL}) AS a WHERE path NOT IN (SELECT path FROM ({FILES_SQL}) AS f WHERE n_chars > 1000)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.strays(notes(spark, sf_dir), files(spark, sf_dir).filter("n_chars > 1000")).select("path")


@query("move_candidates", f"SELECT 'new/' || path AS path, path AS old_path FROM ({FILES_SQL}) AS f WHERE lang = 'fr' AND path IN (SELECT path FROM ({NOTES_SQL}) AS a)")
def move_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = files(spark, sf_dir).filter("lang = 'fr'").select(F.concat(F.lit("new/"), "path").alias("path"), F.col("path").alias("old_path"))
    return inventory.moved(changes, notes(spark, sf_dir)).select("path", "old_path")


RULES = [(1, "src0/*", "hot source", "web"), (2, "*/de/*", "german", "lang"), (3, "src1*", "teens", "group"), (4, "*/e?/*", "english or spanish", "lang")]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "ord int, pattern string, reason string, topic string")


_RULES_SQL = "VALUES (1, '^src0/.*$', 'hot source', 'web'), (2, '^.*/de/.*$', 'german', 'lang'), (3, '^src1.*$', 'teens', 'group'), (4, '^.*/e./.*$', 'english or spanish', 'lang')"


@query("coverage_reason", f"SELECT path, arg_min(reason, ord) AS reason FROM ({FILES_SQL}) AS f JOIN ({_RULES_SQL}) AS r(ord, pattern, reason, topic) ON regexp_matches(path, pattern) GROUP BY path")
def coverage_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.first_reason(files(spark, sf_dir), rules(spark))


@query("default_topics", f"""SELECT path, string_agg(topic, ',' ORDER BY o) AS topics FROM (SELECT path, topic, min(ord) AS o FROM ({FILES_SQL}) AS f
JOIN ({_RULES_SQL}) AS r(ord, pattern, reason, topic) ON regexp_matches(path, pattern) GROUP BY path, topic) AS x GROUP BY path""")
def default_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.topics(files(spark, sf_dir), rules(spark))


@query("facet_query", """SELECT p_partkey, CAST(20 + CASE WHEN p_size > 25 THEN 5 ELSE 0 END AS BIGINT) AS score FROM part
WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21') AND p_size IN (1, 5, 10, 20, 30, 40, 50)""")
def facet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("annotated", F.col("p_size") > 25)
    return inventory.facets(p, {"p_brand": ["Brand#11", "Brand#12", "Brand#21"], "p_size": [1, 5, 10, 20, 30, 40, 50]}).select("p_partkey", "score")


@query("suggest_tokens", f"""WITH w AS (SELECT *, string_split_regex(regexp_replace(path, '([a-z])([0-9])', '\\1 \\2', 'g'), '[^a-z0-9]+') AS p,
string_split_regex(regexp_replace(regexp_extract(path, '[^/]*$'), '([a-z])([0-9])', '\\1 \\2', 'g'), '[^a-z0-9]+') AS b FROM ({FILES_SQL}) AS f)
SELECT path, CAST(sum(CASE WHEN list_contains(b, token) THEN 8 WHEN list_contains(p, token) THEN 5 ELSE 0 END
+ CASE WHEN n_chars > 3000 AND list_contains(['notes', 'on', lang], token) THEN 10 ELSE 0 END + CASE WHEN token = lang THEN 4 ELSE 0 END) + max(CASE WHEN n_chars > 3000 THEN 3 ELSE 0 END) AS BIGINT) AS score
FROM w, (VALUES ('md'), ('en'), ('77')) AS q(token)
WHERE list_contains(p, token) OR token = lang OR (n_chars > 3000 AND list_contains(['notes', 'on', lang], token)) GROUP BY path ORDER BY score DESC, path LIMIT 50""")
def suggest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spark.createDataFrame([("md",), ("en",), ("77",)], "token string")
    noted = files(spark, sf_dir).withColumns({"annotated": F.col("n_chars") > 3000, "note": F.concat_ws(" ", F.lit("notes on"), "lang"), "defaults": F.col("lang")})
    return inventory.suggest(noted, tokens, 50).select("path", "score")


@query("path_shards", f"SELECT substr(sha256(path), 1, 1) AS shard, CAST(count(*) AS BIGINT) AS n FROM ({FILES_SQL}) AS f GROUP BY 1")
def path_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(t.shard(F.col("path")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("prefix_resolve", """WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages),
k AS (SELECT DISTINCT array_to_string(parts[1:2], '/') AS target FROM u),
c AS (SELECT page_id, n, array_to_string(parts[1:n], '/') AS prefix FROM u, range(1, 12) AS r(n) WHERE n <= len(parts))
SELECT page_id, arg_max(prefix, n) AS target FROM c JOIN k ON prefix = target GROUP BY page_id""")
def prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.code import longest_prefix

    parts = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    u = table(spark, sf_dir, "pages").select(F.col("page_id"), parts.alias("parts"))
    known = u.select(F.array_join(F.slice("parts", 1, 2), "/").alias("target")).distinct()
    return longest_prefix(u, "page_id", "parts", "/", known)


@query("candidate_resolve_unique", """WITH c AS (SELECT page_id, url || s AS candidate FROM pages, (VALUES (''), ('/index'), ('.html')) AS x(s)),
k AS (SELECT DISTINCT url AS path FROM pages WHERE length(html) > 1500)
SELECT page_id, min(candidate) AS target FROM c JOIN k ON candidate = path GROUP BY page_id HAVING count(*) = 1""")
def candidate_resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.code import unique_candidate

    p = table(spark, sf_dir, "pages")
    return unique_candidate(p.select("page_id", F.col("url").alias("base")), "page_id", ["", "/index", ".html"], p.filter("length(html) > 1500").select(F.col("url").alias("path")).distinct())


_PATTERNS_SQL = "SELECT DISTINCT unnest([p_brand || '/' || p_size || '*', p_brand || '/**', '*/' || p_size, 'Brand#?/' || (p_size % 7), p_name || '/[a-c]?', 'Br' || chr(42)]) AS x FROM part"
_GLOB_SQL = "regexp_full_match({}, replace(replace({}, '*', '.*'), '?', '.'))"
_HEAD_SQL = "regexp_extract({0}, '^[^*?\\[]*')"
_PREFIX_SQL = f"CASE WHEN contains({_HEAD_SQL}, '/') THEN regexp_extract({_HEAD_SQL}, '^.*/') ELSE {_HEAD_SQL} END"


@query("pattern_overlap", f"""WITH p AS (SELECT x, {_PREFIX_SQL.format('x')} AS h FROM ({_PATTERNS_SQL})) SELECT a.x AS a, b.x AS b FROM p AS a JOIN p AS b ON a.x < b.x
WHERE (a.h <> '' AND b.h <> '' AND (starts_with(a.h, b.h) OR starts_with(b.h, a.h))) OR {_GLOB_SQL.format('a.x', 'b.x')} OR {_GLOB_SQL.format('b.x', 'a.x')}""")
def pattern_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    some = F.array(said(brand, "/", size, "*"), said(brand, "/**"), said("*/", size), said("Brand#?/", (F.col("p_size") % 7).cast("string")), said(F.col("p_name"), "/[a-c]?"), F.lit("Br*"))
    return inventory.pattern_overlaps(table(spark, sf_dir, "part").select(F.explode(some).alias("pattern")))
