"""A positional index of texts, and BM25 of phrases by it.

The index is two tables: postings (word, doc, field, at, bucket), a row for every place of every word, written once, laid out
by a hash of the word and sorted, and sizes (doc, length, n_words). A search reads the buckets of its words only; a phrase is
where the places of its words, each moved back by its own place in the phrase, meet. A word is a run of
letters and digits, lower-cased; a phrase never runs across fields. Null fields are empty; documents without words have a size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import context, retrieval

WORD = r"([\p{L}\p{N}]+)"
#: Fixed value: what counts as a word of a text where short ones are told apart.
COUNTED = r"([A-Za-z0-9_./:-]+|[가-힣]+)"
#: Rows that one task sorts when an index is written, and that one task groups in a search, some 100 to 200 MB of memory.
SORTED, GROUPED = 2_000_000, 500_000
LEAST_IDF = 1e-6


def _words(text: Column, word: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), 1)


def postings(docs: DataFrame, key: str, fields: list[str], word: str = WORD) -> DataFrame:
    """word, doc, field (its place in ``fields``), at: from 0."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), _words(F.col(c), word).alias("words")) for i, c in enumerate(fields)])).alias("x")
    return docs.select(F.col(key).alias("doc"), each).select("doc", "x.field", F.posexplode("x.words").alias("at", "word"))


def sizes(docs: DataFrame, key: str, fields: list[str], text: str, word: str = WORD) -> DataFrame:
    """doc, length (words in all fields) and n_words (of the text alone, by ``COUNTED``)."""
    total = sum((F.size(_words(F.col(c), word)) for c in fields[1:]), F.size(_words(F.col(fields[0]), word)))
    counted = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(COUNTED), 1))
    return docs.select(F.col(key).alias("doc"), total.alias("length"), counted.alias("n_words"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    sizes: DataFrame
    buckets: int = 0

    def of(self, words: DataFrame) -> DataFrame:
        """The postings of ``words`` (word; few); of a written index, only these words' buckets are read."""
        few = retrieval.small(words.select("word").distinct())
        found = self.postings
        if self.buckets:
            read = [r["b"] for r in few.select(_bucket(self.buckets).alias("b")).distinct().collect()]
            found = found.filter(F.col("bucket").isin(read))
        return found.join(few, "word")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(n)).cast("int")


def build(docs: DataFrame, key: str, fields: list[str], text: str, word: str = WORD) -> Index:
    """An index that isn't written: for one search."""
    return Index(postings(docs, key, fields, word), sizes(docs, key, fields, text, word))


def write(docs: DataFrame, path: str, key: str, fields: list[str], text: str, buckets: int = 64, word: str = WORD) -> None:
    """Writes an index under ``path``, a folder that all executors share. Complete when this returns."""
    spark = docs.sparkSession
    sizes(docs, key, fields, text, word).write.parquet(f"{path}/sizes")
    n = spark.read.parquet(f"{path}/sizes").agg(F.sum("length")).head()[0] or 0
    found = postings(docs, key, fields, word).withColumn("bucket", _bucket(buckets))
    # by ranges, so that a frequent word is cut between documents; as many tasks as the postings need
    dealt = found.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-n // SORTED)), "bucket", "word", "doc").sortWithinPartitions("bucket", "word", "doc", "field", "at")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")  # last: the index is whole


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"), spark.read.parquet(f"{path}/layout").head()["buckets"])


def phrases(questions: DataFrame, word: str = WORD) -> DataFrame:
    """q, phrase (array of words), times: the terms of ``questions`` (q, terms) as phrases; those spelled alike count each."""
    found = questions.select("q", F.explode("terms").alias("term")).select("q", _words(F.col("term"), word).alias("phrase"))
    return found.filter(F.size("phrase") > 0).groupBy("q", "phrase").agg(F.count(F.lit(1)).alias("times"))


def frequencies(index: Index, wanted: DataFrame) -> DataFrame:
    """phrase, doc, f: how often each document has each of the ``wanted`` phrases (phrase; few), in any field."""
    parts = wanted.select("phrase").distinct().select("phrase", F.size("phrase").alias("n"), F.posexplode("phrase").alias("i", "word"))
    met = index.of(parts).join(retrieval.small(parts), "word")
    single = met.filter("n = 1").groupBy("phrase", "doc").agg(F.count(F.lit(1)).alias("f"))
    longer = met.filter("n > 1")
    # dealt before they are grouped: nearly every place begins a group of its own
    dealt = longer.repartition(max(longer.sparkSession.sparkContext.defaultParallelism, -(-longer.count() // GROUPED)), "phrase", "doc")
    starts = dealt.groupBy("phrase", "doc", "field", "n", (F.col("at") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("words"))
    longer = starts.filter("words = n").groupBy("phrase", "doc").agg(F.count(F.lit(1)).alias("f"))
    return single.unionByName(longer)


def saturated(f: Column, length: Column, mean: Column) -> Column:
    return f * (retrieval.K1 + 1) / (f + retrieval.K1 * (1 - retrieval.B + retrieval.B * length / mean))


def phrase_bm25(index: Index, questions: DataFrame) -> DataFrame:
    """q, doc, score (the higher the better), n_words for every document with a phrase of ``questions`` (q, terms)."""
    asked = phrases(questions)
    found = frequencies(index, asked)
    whole = index.sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("length"), F.lit(1e-9)).alias("mean"))
    n = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    idf = F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = n.join(F.broadcast(whole), how="cross").select("phrase", "mean", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))  # one row beside each phrase
    scored = found.join(F.broadcast(weights), "phrase").join(index.sizes, "doc").join(F.broadcast(asked), "phrase")
    part = F.col("times") * F.col("idf") * saturated(F.col("f"), F.col("length"), F.col("mean"))
    return scored.groupBy("q", "doc", "n_words").agg(F.sum(part).alias("score"))


def text_scores(index: Index, questions: DataFrame, most: int = 50) -> DataFrame:
    """q, id, fts of each question's ``most`` best texts, as ``context.scores`` takes it: short texts count less."""
    best = retrieval.top(phrase_bm25(index, questions), "q", [F.round("score", 6).desc(), F.col("doc")], most)
    return best.select("q", F.col("doc").alias("id"), context.text_score(F.col("score"), F.col("n_words")).alias("fts"))


def alone(index: Index, questions: DataFrame) -> DataFrame:
    """q, doc, fts of documents scored as if each were the only one: every phrase weighs the least, and is measured by itself."""
    found = frequencies(index, phrases(questions)).join(F.broadcast(phrases(questions)), "phrase")
    total = F.sum(F.col("times") * LEAST_IDF * saturated(F.col("f"), F.lit(1.0), F.lit(1.0)))
    return found.groupBy("q", "doc").agg((1 / (1 + total)).alias("fts"))
