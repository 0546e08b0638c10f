"""Retrieval: chunks, term scores, ranking, packing into a budget.

Questions are a stated set held by the caller and checked to be small before they are sent to every task; the
corpus is scanned once for all of them. Word scores go through the words of the questions only, so what is
shuffled is proportional to matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t

MOST_QUESTIONS = 10_000
K1, B = 1.2, 0.75


def small(frame: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """``frame``, to be broadcast, after a check of its size."""
    if frame.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows can't be sent to every task")
    return F.broadcast(frame)


def chunks(docs: DataFrame, key: str, text: str, heading: str = r"^#{1,6}\s+\S") -> DataFrame:
    """key, section, line_start, line_end, chars, title: runs of lines from one heading to the next; blank ones dropped.

    Lines before the first heading are section 0, without title.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", F.col("line").rlike(heading)).withColumn("section", F.sum(F.col("head").cast("long")).over(so_far))
    found = lines.groupBy(key, "section").agg(
        (F.min("at") + 1).cast("long").alias("line_start"), (F.max("at") + 1).cast("long").alias("line_end"),
        F.sum(F.length("line")).cast("long").alias("chars"), F.max(F.length(F.trim("line"))).alias("full"), F.max(F.when(F.col("head"), F.col("line"))).alias("title"),
    )
    return found.filter("full > 0").drop("full")


def expanded_terms(questions: DataFrame, key: str, text: str, stop: list[str], synonyms: DataFrame) -> DataFrame:
    """key, term: a question's terms, and those that synonyms (needle, term) add where a term holds the needle."""
    own = questions.select(key, F.explode(t.query_terms(F.col(text), stop)).alias("term"))
    more = own.join(small(synonyms.withColumnRenamed("term", "other")), F.contains("term", "needle")).select(key, F.col("other").alias("term"))
    return own.union(more).distinct()


def exact_hits(docs: DataFrame, questions: DataFrame, haystack: Column) -> DataFrame:
    """Each document with each question (q, terms) of which it holds a term, and the share of terms it holds."""
    met = docs.withColumn("__hay", F.lower(haystack)).join(small(questions), F.expr("exists(terms, x -> contains(__hay, lower(x)))"))
    hits = F.expr("size(filter(terms, x -> contains(__hay, lower(x))))")
    return met.withColumn("exact", hits / F.size("terms")).drop("__hay", "terms")


def bm25(words: DataFrame, terms: DataFrame, n_docs: int, mean_length: float) -> DataFrame:
    """q, doc, score for ``words`` (doc, length, word, f: how often) and ``terms`` (q, word)."""
    met = words.join(small(terms.select("word").distinct()), "word", "left_semi")
    n = met.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    idf = F.ln((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = n.select("word", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / mean_length))
    return met.join(F.broadcast(weight), "word").join(small(terms), "word").groupBy("q", "doc").agg(F.sum(part).alias("score"))


def top(scores: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each group, with their rank."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def final_score(exact: Column, fts: Column, authority: Column, graph: Column, is_code: Column) -> Column:
    """2 exact + 1.2 text + authority + graph, the last weighing more for questions about code."""
    return 2 * exact + 1.2 * fts + authority + F.when(is_code, 2.0).otherwise(0.15) * graph


def packed(items: DataFrame, group: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """group, rank, tokens of the items taken in rank order, each that still fits: one that doesn't is passed over.

    A group is a ranked list that a top-k has bounded before; it is folded in one row.
    """
    listed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("r"), F.col(tokens).cast("long").alias("n")))).alias("xs"))
    fold = f"""aggregate(xs, named_struct('used', 0L, 'picks', cast(array() as array<struct<r: bigint, n: bigint>>)),
      (s, x) -> case when s.used + x.n <= {budget} then named_struct('used', s.used + x.n, 'picks', array_append(s.picks, x)) else s end, s -> s.picks)"""
    return listed.select(group, F.inline(F.expr(fold))).withColumnsRenamed({"r": rank, "n": tokens})


def recall_at(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """question, hits, wanted, recall at k, precision at k. results: (question, ref, rank); expected: (question, ref)."""
    first = results.filter(F.col("rank") <= k)
    hits = first.join(expected, ["question", "ref"], "left_semi").groupBy("question").agg(F.count(F.lit(1)).alias("hits"))
    shown = first.groupBy("question").agg(F.count(F.lit(1)).alias("shown"))
    wanted = expected.groupBy("question").agg(F.count(F.lit(1)).alias("wanted"))
    both = wanted.join(shown, "question", "full_outer").join(hits, "question", "left")
    both = both.select("question", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("hits", "wanted", "shown")])
    return both.withColumn("recall", t.ratio(F.col("hits"), F.col("wanted"))).withColumn("precision", t.ratio(F.col("hits"), F.col("shown")))


def gates(means: DataFrame, thresholds: DataFrame) -> DataFrame:
    """category, value, least, ok: a category without value counts as 0."""
    value = F.coalesce("value", F.lit(0.0))
    return thresholds.join(means, "category", "left").select("category", value.alias("value"), "least", (value >= F.col("least")).alias("ok"))


def deltas(baseline: DataFrame, candidate: DataFrame, key: str, value: str, most_drop: float) -> DataFrame:
    """Both sides' values by key (absent: 0), what changed, and whether it dropped by more than allowed."""
    a, b = (x.select(key, F.col(value).alias(n)) for x, n in ((baseline, "before"), (candidate, "after")))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("dropped", F.col("delta") < -abs(most_drop))
