"""Collocations: phrases of 2 to ``width`` words that occur together more often than their parts let expect, per language.

1. Texts are cut into pieces at punctuation and line ends. Equal pieces become one row with a multiplicity, so that copies and
   lines that documents share are counted once, with their weight.
2. n-grams are counted by length, shortest first. A task adds up those of some megabytes of pieces and sends one compressed
   record for each hash bucket; a bucket's task lets duckdb add these up, out of core: a fixed memory limit, and beyond it a
   folder of the task's own, gone when the task ends and seen by nothing else.
3. A phrase of n words that occurs ``least`` times has parts of n - 1 words that do too. A bit table of fixed size (8 MB) holds
   the hashes of those; an n-gram of which a part isn't in it is not sent. A false hit only costs a row, as counts are by text.
4. Candidates ask for the counts of their parts. Each part is asked for once by every home (a hash of the asking phrase), so
   that a part of a third of all candidates is no more rows than there are homes; the answers go back to the homes.

Scores are whole numbers: products are DECIMAL(38), the quotient is cut, never rounded (exact up to counts of 10**15).

What is bounded: a task's pieces (``CHUNK_BYTES``, or one piece), duckdb's memory, the bit tables; records are chunks x buckets
with at most ``MOST_BUCKETS`` buckets, so they grow in proportion to the input at any size. A hot word, phrase or piece is one
row a chunk. Per language, candidates are cut to the best of each of 16 parts before they meet in one task.

Null and empty texts have no pieces; a null language is ``und``. Texts of any length are cut whole, and a text without
punctuation is one piece. Ties of score go to the greater count, then to the phrase first in byte order; repeated rows count
again. Empty tables give no rows. Other columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.session import n_partitions, released, small_batches, written
from tessella.llm.textblock import LOWER, Block, blocks, mix, span_hashes, word_spans

CHUNK_BYTES = 8 << 20
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 4096
FILTER_BITS = 26
DUCKDB_MEMORY = "256MB"
UNKNOWN = "und"
COUNTED = "lang string, phrase string, f long"

#: Bytes that end a piece, besides the end of the text, and those that end a word within one.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(10, 14)]] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True


def _gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    size = end - begin
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))


def cut_pieces(block: Block) -> tuple[pa.Array, np.ndarray]:
    """The block's pieces that have words, these joined by single spaces, and the row of each (from the block's first)."""
    apart = GAP[block.data]
    seen = Block(block.first, block.last, np.where(apart, 32, LOWER[block.data]).astype(np.uint8), block.offsets)
    begin, end, rows = word_spans(seen)
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    ends_before = np.concatenate([[0], np.cumsum(BREAK[block.data])])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    first = np.ones(len(begin), bool)
    first[1:] = (row[1:] != row[:-1]) | (ends_before[begin[1:]] != ends_before[end[:-1]])
    # every word with one byte behind it, which is made a space; the last of a piece without
    last = np.append(first[1:], True)
    size = end - begin + ~last
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    source = np.append(seen.data, np.uint8(32))
    out = source[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
    out[at[1:][~last] - 1] = 32
    starts = np.append(at[:-1][first], at[-1])
    return pa.StringArray.from_buffers(int(first.sum()), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(out)), row[first]


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The distinct pieces of each language, as lang, piece and m, how often it occurs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column("text")):
                piece, row = cut_pieces(block)
                found.append(pa.table({"lang": batch.column("lang").take(pa.array(row + block.first)), "piece": piece}))
            if found:
                table = pa.concat_tables(found)
                once = table.append_column("m", pa.array(np.ones(len(table), np.int64))).group_by(["lang", "piece"]).aggregate([("m", "sum")])
                yield from once.rename_columns(["lang", "piece", "m"]).to_batches(max_chunksize=10_000)

    lean = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    return lean.mapInArrow(released(run), "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _marks(langs: list[str]) -> np.ndarray:
    """A hash for each language."""
    data = np.frombuffer("".join(langs).encode(), np.uint8)
    ends = np.cumsum([0] + [len(x.encode()) for x in langs])
    return mix(span_hashes(data, ends[:-1], ends[1:]) + np.uint64(1))


def phrase_hashes(phrases: pa.Array, marks: np.ndarray) -> np.ndarray:
    found = [span_hashes(b.data, b.offsets[:-1], b.offsets[1:]) for b in blocks(phrases)]
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)) ^ marks


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def grams(piece: pa.Array, code: np.ndarray, m: np.ndarray, marks: np.ndarray, n: int, bits: np.ndarray | None) -> Iterator[pa.Table]:
    """The n-grams of pieces, those left out of which a part is not held by ``bits``."""
    for block in blocks(piece):
        begin, end, rows = word_spans(block)
        if len(begin) < n:
            continue
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        some = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        if bits is not None:
            parts = np.flatnonzero(row[: len(row) - n + 2] == row[n - 2 :])
            held = np.zeros(len(row) + 1, bool)
            held[parts] = _held(bits, span_hashes(block.data, begin[parts], end[parts + n - 2]) ^ marks[code[block.first + row[parts]]])
            some = some[held[some] & held[some + 1]]
        where = block.first + row[some]
        yield pa.table({"code": pa.array(code[where]), "phrase": _gathered(block.data, begin[some], end[some + n - 1]), "m": pa.array(m[where])})


def _records(n: int, buckets: int, bits: np.ndarray | None) -> Callable:
    """Pieces to rows of bucket and body: the n-grams of a chunk that fall into it, as a compressed Arrow stream."""

    def sent(chunk: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(chunk).combine_chunks()
        coded = table.column("lang").combine_chunks().dictionary_encode()
        langs, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        marks = _marks(langs.to_pylist())
        found = list(grams(table.column("piece"), code, table.column("m").to_numpy(), marks, n, bits))
        if not found:
            return
        once = pa.concat_tables(found).group_by(["code", "phrase"]).aggregate([("m", "sum")]).combine_chunks()
        code = once.column("code").to_numpy()
        bucket = phrase_hashes(once.column("phrase"), marks[code]) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows = pa.table({"lang": langs.take(once.column("code")), "phrase": once.column("phrase"), "m": once.column("m_sum")}).take(pa.array(order)).combine_chunks()
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(edges[k], edges[k + 1] - edges[k]))
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            chunk.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from sent(chunk)
                chunk, size = [], 0
        if chunk:
            yield from sent(chunk)

    return run


def _added_up(least: int) -> Callable:
    """Records of a bucket to its phrases that occur ``least`` times or more, added up by duckdb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = tempfile.mkdtemp(prefix="grams-")
        db = duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            db.execute("CREATE TABLE part (lang VARCHAR, phrase VARCHAR, m BIGINT)")
            for batch in batches:
                for body in batch.column("body"):
                    some = pa.ipc.open_stream(body.as_buffer()).read_all()
                    db.register("record", some)
                    db.execute("INSERT INTO part SELECT lang, phrase, m FROM record")
                    db.unregister("record")
            found = db.sql(f"SELECT lang, phrase, CAST(sum(m) AS BIGINT) AS f FROM part GROUP BY lang, phrase HAVING sum(m) >= {int(least)}")
            yield from found.to_arrow_reader(20_000)
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def counted(cut: DataFrame, n: int, buckets: int, least: int, bits: np.ndarray | None = None) -> DataFrame:
    """The n-grams of pieces that occur ``least`` times or more in a language, with how often."""
    spark = cut.sparkSession
    small_batches(spark)
    records = cut.mapInArrow(released(_records(n, buckets, bits)), "bucket int, body binary")
    found = records.repartitionById(buckets, F.col("bucket")).mapInArrow(released(_added_up(least)), COUNTED)
    return written(found, f"grams-{n}")


def bit_table(counts: DataFrame) -> np.ndarray:
    """The bit table of the phrases of ``counts``: 2**20 words of 64 bits, whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            marks = _marks(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            at = phrase_hashes(batch.column("phrase"), marks) >> np.uint64(64 - FILTER_BITS)
            word, bit = (at >> np.uint64(6)).astype(np.int32), (np.uint64(1) << (at & np.uint64(63))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bit"])

    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = counts.select("lang", "phrase").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy().astype(np.uint64)
    return out


def _whole(x: Column) -> Column:
    return x.cast("decimal(15,0)")


def _joined(words: Column, start: Column, n: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start, n))


def scores(candidates: DataFrame, parts: DataFrame, homes: int) -> DataFrame:
    """Candidates (lang, phrase, a) with the score, l and r of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("home", F.pmod(F.xxhash64("lang", "phrase"), F.lit(homes))).withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cuts = cuts.withColumns({"first": _joined(words, F.lit(1), F.col("k")), "rest": _joined(words, F.col("k") + 1, F.size(words) - F.col("k"))})
    asked = cuts.select("home", "lang", F.explode(F.array("first", "rest")).alias("phrase")).distinct()
    answers = asked.join(parts.withColumnRenamed("f", "part_f"), ["lang", "phrase"])
    left = answers.select("home", "lang", F.col("phrase").alias("first"), F.col("part_f").alias("l"))
    right = answers.select("home", "lang", F.col("phrase").alias("rest"), F.col("part_f").alias("r"))
    both = cuts.join(left, ["home", "lang", "first"]).join(right, ["home", "lang", "rest"])
    million = F.lit(1_000_000).cast("decimal(7,0)")
    both = both.withColumns({"top": million * (_whole(F.col("a")) * _whole(F.col("a"))), "under": _whole(F.col("l")) * _whole(F.col("r"))})
    best = F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.score", "best.l", "best.r")


def kept(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates but those that lie in a longer one which occurs ``share`` % as often or more."""
    words = F.split("phrase", " ")
    lengths = F.sequence(F.lit(2), F.size(words) - 1)
    within = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.concat_ws(" ", F.slice(words, i, n)))))
    inner = candidates.filter(F.size(words) > 2).select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", width: int = 3, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """Each language's ``most`` best phrases as lang, rank, phrase, a, l, r, n and score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the cut that counts, ``n`` the language's words.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, text, lang), "pieces")
    size = cut.agg(F.sum(F.octet_length("piece"))).head()[0] or 0
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
    every = counted(cut, 1, buckets, 1)
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = [every.filter(F.col("f") >= least)]
    for n in range(2, width + 1):
        parts.append(counted(cut, n, buckets, least, bit_table(parts[-1])))
    candidates = parts[1]
    for more in parts[2:]:
        candidates = candidates.unionByName(more)
    candidates = candidates.withColumnRenamed("f", "a")
    known = parts[0]
    for more in parts[1:-1]:
        known = known.unionByName(more)
    found = scores(kept(candidates, share), known, n_partitions(spark)).join(total, "lang")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order))
    found = found.withColumn("rank", some).filter(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
