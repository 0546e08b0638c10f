"""Document fingerprints: the bottom k of a document's shingle hashes.

A fingerprint is the k smallest distinct 64-bit hashes of the document's shingles (five words, A-Z lowered;
fewer words make one shingle, no words none). The fingerprint of a union is the k smallest hashes of the
fingerprints' union, so parts are merged in any order. With fewer than k hashes it holds the whole set
and every estimate is exact; else

* distinct shingles: (k - 1) / (largest hash kept as a fraction of 2**64);
* resemblance: of the k smallest hashes of the union, the part in both (error about sqrt(r (1 - r) / k));
* containment of A in B: resemblance * distinct(A or B) / distinct(A).

Equal texts have equal fingerprints. Two empty sets resemble each other fully; an empty and a full one not
at all. As text, a fingerprint is the base64 of its hashes, ascending, eight bytes each, high byte first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.ordering import BUCKET, bounds, bucket_of
from tessella.llm.session import n_partitions, small_batches
from tessella.llm.textblock import BLOCK_BYTES, U64, blocks, shingle_sets

K = 128
WIDTH = 5
SPAN = float(1 << 64)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes."""
    return hashes[:k].copy()


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    return [sketch(x, k) for block in blocks(texts) for x in shingle_sets(block, width)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / SPAN)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    union = len(both) - int(again.sum())
    if union <= k:
        return int(again.sum()) / union
    first = np.concatenate([[True], ~again])
    last = both[first][k - 1]
    return int((again & (both[1:] <= last)).sum()) / k


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of A's shingles that B has too; 1 for an empty A."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(U64)


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated): a row for each row of ``docs``. Null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column("text"), k, width)
            columns = [batch.column("doc_id"), pa.array([to_text(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "n_shingles"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged(prints: DataFrame, group: str, k: int = K) -> DataFrame:
    """One fingerprint for each ``group`` of ``prints`` (group, fingerprint): that of the group's union.

    Partitions first merge what they hold of a group, so a group of a third of all rows moves one
    fingerprint for each partition.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    kind = prints.schema[group].dataType
    schema = StructType([StructField(group, kind), StructField("fingerprint", StringType())])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key = None
        for batch in batches:
            key = batch.schema.field(group)
            for g, text in zip(batch.column(group).to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                if text is not None:
                    held[g] = merge(held.get(g, np.zeros(0, U64)), from_text(text), k)
            if len(held) > 10_000:
                yield _as_batch(held, key)
                held = {}
        if held:
            yield _as_batch(held, key)

    def _as_batch(held: dict, key: pa.Field) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), key.type), pa.array([to_text(x) for x in held.values()], pa.string())], [group, "fingerprint"])

    once = prints.select(group, "fingerprint").mapInArrow(partly, schema)
    return once.repartition(n_partitions(prints.sparkSession), group).mapInArrow(_whole(group, k), schema)


def _whole(group: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key = None
        for batch in batches:
            key = batch.schema.field(group)
            for g, text in zip(batch.column(group).to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                held[g] = merge(held.get(g, np.zeros(0, U64)), from_text(text), k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), key.type), pa.array([to_text(x) for x in held.values()], pa.string())], [group, "fingerprint"])

    return run


def next_and_edited(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text, of an edited text, and their likeness to it and to the next document.

    The next document is the one with the next smaller ``doc_id`` (nulls last; rows with one doc_id follow
    each other by text); after the last comes the first, so a single document is its own next. The edited
    text is the text whose last floor(n/2) code points give way to the first as many, or all, of the next.

    One shuffle moves the texts: ranges of doc_id, each sorted. The driver learns the largest doc_id of each
    range (a number for each partition, which is broadcast), and rows with it go to the range before as well, where the first
    of them follows the last row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    upper = bounds(docs, "doc_id", n_partitions(spark))
    n = len(upper) + 1
    # buckets count from the largest ids, nulls in the last
    bucket = F.lit(n - 1) - bucket_of(F.col("doc_id"), upper)
    tops = docs.select("doc_id").withColumn(BUCKET, bucket).groupBy(BUCKET).agg(F.max("doc_id").alias("top")).collect()
    full = sorted((r[BUCKET], r["top"]) for r in tops)
    before = {full[i][0]: full[i - 1][0] for i in range(len(full))}  # the first one's goes to the last
    places = spark.createDataFrame([(b, top, before[b]) for b, top in full], "own int, top long, goes int")
    first = F.col("doc_id").eqNullSafe(F.col("top"))
    dealt = docs.withColumn("own", bucket).join(F.broadcast(places), "own").withColumn("goes", F.when(first, F.col("goes")))
    rows = F.when(F.col("goes").isNull(), F.array(F.struct(F.col("own").alias(BUCKET), F.lit(0).alias("edge")))).otherwise(
        F.array(F.struct(F.col("own").alias(BUCKET), F.lit(0).alias("edge")), F.struct(F.col("goes").alias(BUCKET), F.lit(1).alias("edge")))
    )
    dealt = (
        dealt.select("doc_id", "text", F.inline(rows))
        .repartitionById(n, F.col(BUCKET))
        .sortWithinPartitions("edge", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
        .select("doc_id", "text", "edge")
    )
    found = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, which waits for the one after it
        over = False
        for batch in batches:
            for part in _parts(batch):
                ids = [x[0] for x in held] + part.column("doc_id").to_pylist()
                texts = [x[1] for x in held] + [x or "" for x in part.column("text").to_pylist()]
                edges = part.column("edge").to_pylist()
                marks = [x[2] for x in held] + sketches(part.column("text"), k, width)
                stop = len(held) + (edges.index(1) + 1 if 1 in edges else len(edges))
                if over or stop < 2:
                    held = [] if over else [(ids[0], texts[0], marks[0])]
                    continue
                ids, texts, marks = ids[:stop], texts[:stop], marks[:stop]
                over = 1 in edges
                held = [(ids[-1], texts[-1], marks[-1])]
                yield _compare(ids, texts, marks, k, width)

    return dealt.mapInArrow(run, found)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about four blocks of text each."""
    size = batch.nbytes
    step = max(1, batch.num_rows if size <= 4 * BLOCK_BYTES else batch.num_rows * 4 * BLOCK_BYTES // size)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _compare(ids: list, texts: list[str], marks: list[np.ndarray], k: int, width: int) -> pa.RecordBatch:
    """Rows for all but the last, each against the one after it."""
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts[:-1], texts[1:], strict=True)]
    changed = sketches(pa.array(edited, pa.large_string()), k, width)
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(x) for x in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array([to_text(x) for x in marks[:-1]], pa.string()),
        pa.array([to_text(x) for x in changed], pa.string()),
        pa.array([resemblance(a, b, k) for a, b in zip(marks[:-1], changed, strict=True)], pa.float64()),
        pa.array([resemblance(a, b, k) for a, b in zip(marks[:-1], marks[1:], strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
