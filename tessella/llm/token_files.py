"""Token-ID binary output: flat unsigned integer files, 64-bit document offsets, read by memory map.

A set of files is one folder. Documents are dealt to shards by ranges of ``doc_id`` and sorted there, so
shard after shard holds all ids in ascending ``doc_id`` order. Shard k is three flat little-endian files:

* ``.bin``  the token ids, uint16 where the vocabulary fits and uint32 otherwise, without header;
* ``.off``  int64, n_docs + 1: where each document begins in this shard's ``.bin``;
* ``.doc``  int64 pairs, n_docs: the ``doc_id`` and 1, or 0 and 0 for null.

``manifest.json`` names the shards with their counts and their base: the number of ids in all shards
before, a prefix sum over shard totals, so the place of a document is base + offset. Only shard totals,
never rows, reach the driver. A task writes under a name of its own and reports it; files of lost or
repeated attempts are not in the manifest.

Null text counts as empty (its end id alone). Null ``doc_id`` comes first; rows with one ``doc_id`` follow
each other in the order of their text. An empty table gives a manifest without shards. Other columns of
the input play no part.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.ordering import BUCKET, bounds, bucket_of
from tessella.llm.session import n_partitions, small_batches
from tessella.llm.subwords import encoder

READ_DOCS = 2000


def store(uri: str) -> tuple[stores.FileSystem, str]:
    """Arrow's file system for a local path or URI."""
    if local := re.match(r"(?:file:/*)?(/.*)|file:/*(.+)", uri):
        return stores.LocalFileSystem(), "/" + (local[1] or local[2]).lstrip("/")
    return stores.FileSystem.from_uri(uri)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with ``end_id`` after them."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    inner = np.ones(len(out), bool)
    ends = offsets[1:] + np.arange(n)
    inner[ends] = False
    out[inner] = ids
    return out, np.concatenate([np.zeros(1, np.int64), ends + 1])


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int) -> dict:
    """Writes the files of ``docs`` (doc_id, text) to the folder ``uri``; returns the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    upper = bounds(docs, "doc_id", n_partitions(spark))
    kind = "<u2" if encoder(tokenizer_path).vocabulary_size <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, encode = None, encoder(tokenizer_path).encode
        n_docs = n_tokens = bucket = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                target, folder = store(uri)
                target.create_dir(folder, recursive=True)
                bucket = batch.column(BUCKET)[0].as_py()
                name = f"shard-{bucket:06d}-{uuid.uuid4().hex}"
                files = {x: target.open_output_stream(f"{folder}/{name}.{x}") for x in ("bin", "off", "doc")}
                files["off"].write(np.zeros(1, "<i8").tobytes())
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            files["bin"].write(ids.astype(kind).tobytes())
            files["off"].write((n_tokens + offsets[1:]).astype("<i8").tobytes())
            valid = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column("doc_id").fill_null(0).to_numpy()
            files["doc"].write(np.stack([doc, valid], 1).astype("<i8").tobytes())
            n_docs += batch.num_rows
            n_tokens += len(ids)
        if files:
            for f in files.values():
                f.close()
            row = {"bucket": [bucket], "name": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema({"bucket": pa.int32(), "name": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()}))

    shards = (
        docs.withColumn(BUCKET, bucket_of(F.col("doc_id"), upper))
        .repartitionById(len(upper) + 1, F.col(BUCKET))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "bucket int, name string, n_docs long, n_tokens long")
        .collect()  # one row for each shard; a sort in the plan would run the encoder twice, once for its sample
    )
    base, listed = 0, []
    for shard in sorted(shards, key=lambda x: x["bucket"]):
        listed.append({"name": shard["name"], "n_docs": shard["n_docs"], "n_tokens": shard["n_tokens"], "base": base})
        base += shard["n_tokens"]
    manifest = {"dtype": kind, "end_id": end_id, "n_tokens": base, "shards": listed}
    target, folder = store(uri)
    target.create_dir(folder, recursive=True)
    with target.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(uri: str, name: str, dtype: str, length: int) -> np.ndarray:
    """A flat file as an array: a memory map where the store is local, else its bytes."""
    target, folder = store(uri)
    if not length:
        return np.zeros(0, dtype)
    if isinstance(target, stores.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", dtype, "r", shape=(length,))
    with target.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def read_manifest(uri: str) -> dict:
    target, folder = store(uri)
    with target.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, an array) of every document in the files of ``uri``."""
    small_batches(spark)
    manifest = read_manifest(uri)
    kind = manifest["dtype"]
    fields = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    fields |= {"ids": pa.list_(pa.int64())} if with_ids else {}
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                n, name = shard["n_docs"], shard["name"]
                ids = mapped(uri, f"{name}.bin", kind, shard["n_tokens"])
                offsets = mapped(uri, f"{name}.off", "<i8", n + 1)
                doc = mapped(uri, f"{name}.doc", "<i8", 2 * n).reshape(-1, 2)
                for a in range(0, n, READ_DOCS):
                    b = min(n, a + READ_DOCS)
                    at = offsets[a : b + 1].astype(np.int64)
                    columns = [pa.array(doc[a:b, 0], mask=doc[a:b, 1] == 0), pa.array(at[:-1] + shard["base"]), pa.array(np.diff(at)), pa.array([crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids[at[0] : at[-1]].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    shards = spark.createDataFrame([tuple(x[k] for k in ("name", "n_docs", "n_tokens", "base")) for x in manifest["shards"]], "name string, n_docs long, n_tokens long, base long")
    found = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(read, found)
