"""Packing: concatenate and cut.

Pass one encodes each document once and writes its ids to a table in the shared folder, together with the
number of ids before it in its partition. Prefix sums over the partitions' totals (one number each reaches
the driver) turn that into an offset in the concatenation of all documents. Pass two cuts each document
where its global range crosses a window of ``length`` ids: windows are the sequences, and a document that
crosses a boundary has one record on each side. Only the last sequence can be short, so padding is below
one sequence altogether. Both passes are local to a row but for the totals; nothing is sorted or shuffled.

Null text counts as empty (its end id alone); null or repeated ``doc_id`` are carried as they are, each
row packed on its own. An empty table gives no pieces. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.session import released, small_batches, written
from tessella.llm.subwords import encoder
from tessella.llm.token_files import crc32, with_end

LENGTH = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """part, before, doc_id, ids (little-endian uint32): each document once, numbered inside its partition."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, e = TaskContext.get().partitionId(), 0, encoder(tokenizer_path).encode
        for batch in batches:
            ids, at = with_end(*e(batch.column("text")), end_id)
            n, raw = batch.num_rows, ids.astype("<u4").tobytes()
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(raw)])
            columns = [pa.array(np.full(n, part, np.int64)), pa.array(before + at[:-1]), batch.column("doc_id"), packed]
            yield pa.RecordBatch.from_arrays(columns, ["part", "before", "doc_id", "ids"])
            before += len(ids)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(released(encode), "part long, before long, doc_id long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``ids`` (binary, little-endian uint32) where asked for."""
    table = written(encoded(docs, tokenizer_path, end_id), "packing")
    totals = table.groupBy("part").agg((F.sum(F.octet_length("ids")) / 4).cast("long").alias("n")).orderBy("part").collect()
    bases = dict(zip([r["part"] for r in totals], np.cumsum([0, *(r["n"] for r in totals)])[:-1].tolist(), strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bases[p] for p in batch.column("part").to_pylist()]
            at = np.array(parts, np.int64) + batch.column("before").to_numpy()
            which, start, size, crc, total, kept = [], [], [], [], [], []
            for i, packed in enumerate(batch.column("ids")):
                ids = np.frombuffer(packed.as_buffer(), "<u4")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + length - int((at[i] + a) % length))
                    which.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(crc32(ids[a:b]))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(ids[a:b].tobytes())
                    a = b
            place = at[which] + np.array(start, np.int64)
            columns = [batch.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total, place // length, place % length))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return table.mapInArrow(released(cut), PIECES + ", ids binary" * with_ids)


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, n_tokens, padded: a sequence is filled up to ``length`` unless its size is a power of two."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return sizes.withColumn("padded", F.when(power, F.col("n_tokens")).otherwise(F.lit(length).cast("long")))
