"""Importance resampling towards a target: documents drawn without replacement by hashed n-gram weights and Gumbel noise.

A document's features are its runs of 1 to 2 consecutive words; each falls into one of ``buckets`` by its CRC-32. A bucket's
gain is the scaled log ratio of its smoothed share in the target to that in all documents; a document's weight is the floored
mean of its features' gains, and its score the weight plus Gumbel noise of its id, so that the highest scores are a draw
without replacement in proportion to the exponentiated weights.

1. Arrays of ``buckets`` counts, one a task, are added up by bucket; the gains (one array of ``buckets`` numbers) go to all tasks.
2. Documents are scored from the same arrays, and kept as rows of a few numbers.
3. Scores are whole numbers, so their histogram is exact and small (below). Its suffix sums say how many documents lie above
   each score, which gives the score at which the draw ends. Only surviving scores are ordered, each by ``doc_id`` for itself.

What is bounded: a gain is at most 1000 * ln(2**63 * (buckets + 1)) < 60,000 in size and the noise lies between -3,101 and
22,874, so that the histogram has at most some 150,000 rows at any size of input. Nothing else goes to the driver but
``buckets`` counts. A score's group holds the documents of one whole number, at most about 1 / 2700 of those of equal weight;
rows alike in everything (repeated ids) are counted before they are ordered, and take consecutive ranks.

Null and empty texts have no words: weight 0, no rank. A null ``doc_id`` counts as empty text in the noise, and comes after
all others among ties. Texts are read whole: a word of any length is one word. Ties of score go to the smaller ``doc_id``;
repeated rows are rows of their own. Empty ``docs`` give no rows; an empty target has no features, so that frequent buckets
lose. Other columns of ``docs``, whatever their names, are neither read nor returned by ``resampled``; ``drawn`` keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.session import released, small_batches, written
from tessella.llm.textblock import LOWER, Block, blocks, word_spans

SCALE = 1000
#: Bytes that no word holds: ASCII but digits and letters. As capitals are lowered first, these are all others below 0x80.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Each byte as words see it: capitals lowered, all that lies between words one space.
SEEN = np.where(APART, 32, LOWER).astype(np.uint8)
#: Words of more bytes than this are hashed one by one, not in step with the others.
LONG_WORD = 128


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def _fed(state: np.ndarray, octets: np.ndarray) -> np.ndarray:
    return CRC[(state ^ octets) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_states(data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States of running CRC-32s after each has read its span of ``data``; a CRC is the complement of its last state."""
    length = end - begin
    order = np.argsort(-length, kind="stable")
    start, sizes, out = begin[order], length[order], state[order]
    n_long = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))
    for i in range(n_long):
        out[i] = ~np.uint32(zlib.crc32(data[start[i] : start[i] + sizes[i]].tobytes(), int(~out[i])))
    for k in range(int(sizes[n_long]) if n_long < len(sizes) else 0):
        alive = slice(n_long, int(np.searchsorted(-sizes, -k, side="left")))
        out[alive] = _fed(out[alive], data[start[alive] + k].astype(np.uint32))
    back = np.empty_like(out)
    back[order] = out
    return back


class Features(NamedTuple):
    """Buckets of the words and of the pairs of words of some rows, and where each row's words begin (one more at the end)."""

    words: np.ndarray
    pairs: np.ndarray  # at a word: the pair that begins there; of the last word of a row it means nothing
    rows: np.ndarray


def features(block: Block, buckets: int) -> Features:
    seen = Block(block.first, block.last, SEEN[block.data], block.offsets)
    begin, end, rows = word_spans(seen)
    one = crc_states(seen.data, begin, end, np.full(len(begin), 0xFFFFFFFF, np.uint32))
    two = np.zeros(len(begin), np.uint32)
    if len(begin) > 1:
        two[:-1] = crc_states(seen.data, begin[1:], end[1:], _fed(one[:-1], np.full(len(begin) - 1, 32, np.uint32)))
    return Features((~one % np.uint32(buckets)).astype(np.int64), (~two % np.uint32(buckets)).astype(np.int64), rows)


def _pairs(rows: np.ndarray) -> np.ndarray:
    """Of each word, whether a pair begins there: it isn't the last of its row."""
    inner = np.ones(rows[-1], bool)
    last = rows[1:][rows[1:] > rows[:-1]] - 1
    inner[last] = False
    return inner


def bucket_counts(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                found = features(block, buckets)
                total += np.bincount(found.words, minlength=buckets) + np.bincount(found.pairs[_pairs(found.rows)], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(released(run), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed source share), a bucket."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, which gives way to ``n_words``, ``n_features`` and ``weight``."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in blocks(batch.column(text)):
                found = features(block, buckets)
                parts = np.where(_pairs(found.rows), gain[found.pairs], 0) + gain[found.words]
                total = np.concatenate([[0], np.cumsum(parts)])
                words.append(np.diff(found.rows))
                sums.append(np.diff(total[found.rows]))
            n_words, total = np.concatenate(words), np.concatenate(sums)
            n_features = np.maximum(2 * n_words - 1, 0)
            weight = total // np.maximum(n_features, 1)
            added = [pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + added, names=[*others, "n_words", "n_features", "weight"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "n_words long, n_features long, weight long"])
    return docs.mapInArrow(released(run), schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise, scaled and floored, from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


class Cut(NamedTuple):
    """Where a draw ends: all scores above ``score``, and the first ``left`` documents of that score."""

    drawn: int
    score: int | None
    left: int
    above: dict[int, int]  # of each surviving score, the documents with higher ones


def cut_of(scores: DataFrame, percent: int) -> Cut:
    """The end of the draw of ``percent`` of all rows of ``scores`` (score), by suffix sums over the exact histogram."""
    found = scores.groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    counts = found["n"].to_numpy(np.int64)
    above = np.cumsum(counts) - counts
    drawn = percent * int(counts.sum()) // 100
    surviving = above < drawn
    if not surviving.any():
        return Cut(0, None, 0, {})
    kept = found["score"].to_numpy(np.int64)[surviving]
    return Cut(drawn, int(kept[-1]), drawn - int(above[surviving][-1]), dict(zip(kept.tolist(), above[surviving].tolist(), strict=True)))


def _scored(docs: DataFrame, target: DataFrame, text: str, seed: int, buckets: int, least_words: int) -> DataFrame:
    gain = gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, text))
    lean = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("text"))
    found = weighted(lean, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return written(found.withColumn("eligible", F.col("n_words") >= least_words), "resampling")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_features, weight, score and rank (from 1; null if not drawn)."""
    scored = _scored(docs, target, text, seed, buckets, least_words)
    end = cut_of(scored.filter("eligible"), percent)
    shown = ["doc_id", "n_features", "weight", "score"]
    if not end.drawn:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    spark = docs.sparkSession
    above = F.broadcast(spark.createDataFrame(list(end.above.items()), "score long, above long"))  # no more rows than the histogram
    survives = F.col("eligible") & (F.col("score") >= end.score)
    alike = scored.filter(survives).groupBy(*shown).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    placed = alike.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(above, "score")
    ranked = placed.select(*shown, F.explode(F.sequence(F.col("above") + F.col("upto") - F.col("copies") + 1, F.col("above") + F.col("upto"))).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= end.drawn, F.col("rank")))
    return scored.filter(~survives).select(*shown, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns: no join, only the id and the score say who is in.

    Of rows of one id at the very end of the draw, those of smaller text come first.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id"), F.col(text).cast("string").alias("text"))
    gain = gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, text))
    found = weighted(held, gain).filter(F.col("n_words") >= least_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    found = written(found, "resampling-rows")
    end = cut_of(found, percent)
    if not end.drawn:
        return docs.limit(0)
    last = found.filter(F.col("score") == end.score)
    ids = last.groupBy("doc_id").count().orderBy(F.col("doc_id").asc_nulls_last())
    running = ids.withColumn("upto", F.sum("count").over(Window.orderBy(F.col("doc_id").asc_nulls_last())))  # ids of one whole number only
    at = running.filter(F.col("upto") >= end.left).orderBy("upto").head()
    same = F.col("doc_id").eqNullSafe(F.lit(at["doc_id"]))
    before = F.lit(True) if at["doc_id"] is None else F.col("doc_id") < F.lit(at["doc_id"])
    taken = found.filter((F.col("score") > end.score) | ((F.col("score") == end.score) & ~same & F.coalesce(before, F.lit(False))))
    tied = last.filter(same).orderBy(F.col(f"whole.`{text}`")).limit(int(end.left - (at["upto"] - at["count"])))
    return taken.unionByName(tied).select("whole.*")
