"""N-gram Jaccard join of documents: a grouped prefix join that links all texts of similarity 0.8 and more.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two sets link when
100 * |intersection| >= 80 * |union|. The result is one row a document with the least doc_id it reaches.

1.  *Chunks.* One pass over the texts makes the sets of some thousand documents at a time. A shingle that only one
    set of a chunk holds goes, packed, to the bucket of its hash, with the set's number in the chunk; one that
    several hold goes there once, with how many. What a chunk knows of itself (documents, hashes and sizes
    of its sets, which sets hold its common shingles) goes to the chunk's home. So however frequent a shingle is, a
    bucket gets it once a chunk, and the bytes a shingle costs don't grow with the number of buckets.
2.  *Frequencies.* A bucket adds up and answers each chunk: its shingles that also others hold, with their frequency.
    At home each set learns how many of its shingles are its own. (Shingles of copies in several chunks count as
    shared here; copies become one set after this step.)
3.  *Prefixes.* A set orders its shingles: its own, then by frequency, ties by hash. Linked sets share one among the
    first size - ceil(0.8 size) + 1. A set whose shingles are its own for more than a fifth leaves here: that's
    nearly all documents.
4.  *Groups.* Sets with equal size and equal prefix are one group. Lists of groups by prefix shingle give group
    pairs, filtered by size and by the place of the common shingle; pairs are expanded to members and
    verified with whole sets.
5.  *Links, not pairs.* Only links between components matter, so each group is first compared with one other: of the
    centres of its lists (groups chosen by hash, others in each round) that which it meets most often; later, where it is
    still apart from others of its lists, with a few, and with a few of those that lack the same shingles of a third set as it
    does. Sets already connected are never compared again: thousands of near
    copies cost some comparisons each. A last round compares all that are still apart in the lists if what
    they share in the prefixes leaves a link possible, so no link is lost.

Between documents a shingle is the number of its bucket and 40 or 48 more bits of its hash, 48 altogether at least. That
only matters within a pair: two sets of 400 shingles share one by chance once in 1.7e9 pairs, and it changes the answer only where
the pair is one shingle from the limit. Sets are told apart by two 64-bit hashes, and the job starts over with another
seed if two sets share the first. Hot rows: joins by set, shingle or centre are plain joins with counts of a few
bytes, which adaptive execution splits.

Null or empty text, and text without words, is the empty set: size 0, linked with nothing. Null doc_id is
carried; a class is named by its least doc_id that isn't null. Repeated rows are one set and each a row of the
result. A very long text is a chunk of its own. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.session import let_go, n_partitions, released, settings, shared_dir, small_batches, written
from tessella.llm.textblock import U64, blocks, mix, shingle_sets

WIDTH, PERCENT = 5, 80
CHUNK = 4096
BUCKET_BYTES = 8 << 20
MANY_BUCKETS = 256  # from here on 40 bits of the hash go with the bucket's number
TEXT_BYTES_A_SHINGLE = 7
ROUNDS, CENTRES = 4, 8
NEAREST, DIFFERENCES = 3, 12
SPARE = 8
PART_SETS = 4096
CHUNK_SHINGLES = 1 << 19


def set_hashes(sets: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from sums of mixed elements."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((2, len(sets)), U64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate(sets)
        starts = (np.cumsum(sizes) - sizes)[some]
        for j in (0, 1):
            out[j, some] = np.add.reduceat(mix(flat + U64((2 * seed + j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), starts)
    return mix(out[0] + sizes.astype(U64)), mix(out[1] ^ sizes.astype(U64))


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and shingle sets of about CHUNK documents at a time, fewer where they are long."""
    ids: list = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches:
        doc = batch.column("doc_id").to_pylist()
        for block in blocks(batch.column("text")):
            for i, found in zip(range(block.first, block.last), shingle_sets(block, width), strict=True):
                ids.append(doc[i])
                sets.append(found)
                held += len(found)
                if len(sets) >= CHUNK or held >= CHUNK_SHINGLES:
                    yield ids, sets
                    ids, sets, held = [], [], 0
    if sets:
        yield ids, sets


def _packed(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    n = max(map(len, rows.values()))
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if len(rows.get(f.name, ())) else pa.nulls(n, f.type) for f in schema], schema=schema)


def n_bytes(n_buckets: int) -> int:
    """Bytes of a shingle beside its bucket's number."""
    return 5 if n_buckets >= MANY_BUCKETS else 6


def short_token(tokens: np.ndarray, n_buckets: int) -> np.ndarray:
    """A shingle from here on: the number of its bucket above 40 or 48 bits of the rest of its hash."""
    bits = 8 * n_bytes(n_buckets)
    return ((tokens % U64(n_buckets)) << U64(bits)) | ((tokens // U64(n_buckets)) & U64((1 << bits) - 1))


def _low(tokens: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of each, as rows."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _from_low(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(U64)


def _steps(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that rise within each part as bytes of differences, 255 standing for 255 and no number, and the parts' ends among the bytes."""
    d = np.diff(numbers, prepend=0)
    first = ends[:-1][np.diff(ends) > 0]
    d[first] = numbers[first]
    width = d // 255 + 1
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.full(at[-1], 255, np.uint8)
    out[at[1:] - 1] = d % 255
    return out, at[ends]


def _from_steps(raw: bytes, sizes: np.ndarray | None = None) -> np.ndarray:
    """The numbers again; ``sizes``: how many of them each part has."""
    d = np.frombuffer(raw, np.uint8)
    sums = np.cumsum(d, dtype=np.int64)[d != 255]
    if sizes is not None and len(sizes):
        sums = sums - np.repeat(np.concatenate([[0], sums[np.cumsum(sizes) - 1][:-1]]), sizes)
    return sums


CELL = {"place": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "alone": pa.binary(), "owners": pa.binary(), "common": pa.binary(), "counts": pa.binary(), "head": pa.binary(), "held": pa.binary()}
CELL_DDL = "place int, bucket int, chunk long, alone binary, owners binary, common binary, counts binary, head binary, held binary"
HEAD = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("set", "<u8"), ("mark", "<u8"), ("n", "<i8")])


def _cells(ids: list, sets: list[np.ndarray], seed: int, n: int, salt: int) -> pa.RecordBatch:
    """A chunk's shingles, a row a bucket, and its head, dealt to the chunk's home."""
    head = np.zeros(len(ids), HEAD)
    head["doc_id"], head["null"] = [0 if x is None else x for x in ids], [x is None for x in ids]
    head["set"], head["mark"] = set_hashes(sets, seed)
    head["n"] = [len(x) for x in sets]
    chunk = int(mix(np.array([(head["set"] * np.arange(1, 2 * len(ids), 2, dtype=U64)).sum(dtype=U64) + U64(salt)], U64)).view(np.int64)[0])
    _, one = np.unique(head["set"], return_index=True)
    mine = [sets[i] for i in one]
    token = short_token(np.concatenate(mine), n)
    owner = np.repeat(np.arange(len(mine)), [len(x) for x in mine])
    order = np.argsort(token, kind="stable")  # then by owner
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(token)))
    many = np.repeat(counts > 1, counts)
    common, times, holders = token[starts][counts > 1], counts[counts > 1], owner[many]
    token, owner = token[~many], owner[~many]
    width = n_bytes(n)
    bits = U64(8 * width)
    bucket = (token >> bits).astype(np.int64)
    order = np.lexsort((owner, bucket))
    token, owner = token[order], owner[order]
    wall = np.arange(n + 1)
    ends, walls = np.searchsorted(bucket, wall), np.searchsorted((common >> bits).astype(np.int64), wall)
    steps, at = _steps(owner, ends)
    full = np.flatnonzero((np.diff(ends) > 0) | (np.diff(walls) > 0))
    alone, shared, times_byte = _low(token, width), _low(common, width), np.minimum(times, 255).astype(np.uint8)
    cut = lambda x, e: [x[e[b] : e[b + 1]].tobytes() for b in full]
    rows = {"place": full.tolist(), "bucket": full.tolist(), "chunk": [chunk] * len(full), "alone": cut(alone, ends), "owners": cut(steps, at), "common": cut(shared, walls), "counts": cut(times_byte, walls), "head": [None] * len(full), "held": [None] * len(full)}
    held, _ = _steps(holders, np.concatenate([[0], np.cumsum(times)]))
    for name, value in {"place": chunk % n, "bucket": None, "chunk": chunk, "alone": None, "owners": None, "common": common.astype("<u8").tobytes(), "counts": times.astype("<u4").tobytes(), "head": head.tobytes(), "held": held.tobytes()}.items():
        rows[name].append(value)
    return _packed(rows, pa.schema(CELL))


def _dealt(docs: DataFrame, width: int, seed: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (ids, sets) in enumerate(_chunks(batches, width)):
            yield _cells(ids, sets, seed, n, (part << 24) + k)  # chunks of equal sets have names of their own

    return docs.mapInArrow(released(run), CELL_DDL).repartitionById(n, F.col("place"))


def code(often: np.ndarray) -> np.ndarray:
    """A frequency in one byte, its order kept; 0 for 1 only."""
    return np.minimum(255, np.floor(8 * np.log2(often))).astype(np.uint8)


def _answered(dealt: DataFrame, n: int) -> DataFrame:
    """Of each cell the lone shingles that other chunks hold too, with codes of their frequency, and the codes of all common ones; heads as they are."""

    width = n_bytes(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, list] = {x: [] for x in ("bucket", "chunk", "alone", "owners", "common", "counts")}
        for batch in batches:
            is_head = batch.column("head").is_valid()
            heads = batch.filter(is_head)
            if heads.num_rows:
                yield heads
            if heads.num_rows < batch.num_rows:
                rest = batch.filter(pc.invert(is_head))
                for x in cells:
                    cells[x] += rest.column(x).to_pylist()
        if not cells["chunk"]:
            return
        size, many = (np.array([len(x) // width for x in cells[k]], np.int64) for k in ("alone", "common"))
        bucket = np.array(cells["bucket"], U64) << U64(8 * width)
        token = np.concatenate([_from_low(b"".join(cells["alone"]), width) | np.repeat(bucket, size), _from_low(b"".join(cells["common"]), width) | np.repeat(bucket, many)])
        weight = np.concatenate([np.ones(int(size.sum()), np.int64), np.frombuffer(b"".join(cells["counts"]), np.uint8)])
        order = np.argsort(token)
        starts = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
        often = np.empty(len(token), np.uint8)
        often[order] = np.repeat(code(np.add.reduceat(weight[order], starts)), np.diff(np.append(starts, len(token))))
        alone, common = often[: size.sum()], often[size.sum() :].tobytes()
        ends, walls = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(many)])
        low = _low(token[: size.sum()], width)
        rows: dict[str, list] = {x: [] for x in CELL}
        for i, chunk in enumerate(cells["chunk"]):
            shared = np.flatnonzero(alone[ends[i] : ends[i + 1]])
            if not len(shared) and not many[i]:
                continue
            owners = _from_steps(cells["owners"][i])[shared]
            at = ends[i] + shared
            values = (chunk % n, cells["bucket"][i], chunk, low[at].tobytes(), _steps(owners, np.array([0, len(owners)]))[0].tobytes(), common[walls[i] : walls[i + 1]], alone[at].tobytes(), None, None)
            for name, value in zip(CELL, values, strict=True):
                rows[name].append(value)
            if len(rows["chunk"]) >= 4096:
                yield _packed(rows, pa.schema(CELL))
                rows = {x: [] for x in CELL}
        if rows["chunk"]:
            yield _packed(rows, pa.schema(CELL))

    return dealt.mapInArrow(released(run), CELL_DDL).repartitionById(n, F.col("place"))


def needed(n: int, percent: int) -> int:
    """Common shingles that a set of n needs at least for any link."""
    return -(-percent * n // 100)


FOUND = {"doc_id": pa.int64(), "set": pa.int64(), "mark": pa.int64(), "n": pa.int64(), "own": pa.int64(), "p": pa.int32(), "tokens": pa.list_(pa.int64())}
FOUND_DDL = "doc_id long, set long, mark long, n long, own long, p int, tokens array<long>"


def _at_home(answers: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """doc_id, set, mark, n of every document; and, with p not null, set, n, own (shingles in no other set), p (length of the
    prefix without these), tokens of sets that can have a link."""
    schema, width = pa.schema(FOUND), n_bytes(n_buckets)

    def of_chunk(row: dict, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        head = np.frombuffer(row["head"], HEAD)
        ids = pa.array(head["doc_id"].copy(), mask=head["null"] > 0)
        yield _packed({"doc_id": ids, "set": head["set"].copy().view(np.int64), "mark": head["mark"].copy().view(np.int64), "n": head["n"].copy()}, schema)
        keys, one = np.unique(head["set"], return_index=True)
        size = head["n"][one]
        answers.sort(key=lambda r: r["bucket"])
        times = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        common, holders = np.repeat(np.frombuffer(row["common"], "<u8"), times), _from_steps(row["held"], times)
        often = np.repeat(np.frombuffer(b"".join(r["common"] for r in answers), np.uint8), times)
        alone = [(_from_low(r["alone"], width) | (U64(r["bucket"]) << U64(8 * width)), _from_steps(r["owners"]), np.frombuffer(r["counts"], np.uint8)) for r in answers if r["alone"]]
        token, owner, often = (np.concatenate(x) for x in zip((common, holders, often), *alone, strict=True))
        order = np.lexsort((token, often, owner))
        token, owner = token[order], owner[order]
        ends = np.searchsorted(owner, np.arange(len(keys) + 1))
        rows: dict[str, list] = {x: [] for x in FOUND}
        held = 0
        for i, (key, n) in enumerate(zip(keys.view(np.int64).tolist(), size.tolist(), strict=True)):
            a, b = ends[i], ends[i + 1]
            own, least = n - int(b - a), needed(n, percent)
            if n and b - a >= least:
                for name, value in zip(FOUND, (None, key, None, n, own, n - least + 1 - own, token[a:b].view(np.int64)), strict=True):
                    rows[name].append(value)
                held += b - a
            if held >= 1 << 19:
                yield _packed(rows, schema)
                rows, held = {x: [] for x in FOUND}, 0
        if rows["set"]:
            yield _packed(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, answers = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["head"] is None:
                    answers.setdefault(r["chunk"], []).append(r)
                elif r["chunk"] in heads:
                    raise ValueError("two chunks with one name")
                else:
                    heads[r["chunk"]] = r
        if answers.keys() - heads.keys():
            raise ValueError("a chunk changed between two runs of its task: write the documents to a table first")
        for name, row in heads.items():
            yield from of_chunk(row, answers.pop(name, []))

    return answers.mapInArrow(released(run), FOUND_DDL)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of sets that are linked. ``sets`` lie by set already, so only pairs move, once with the one's shingles."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    met = pairs.join(side("a"), "a").filter(F.col("n_a") > 0).join(side("b"), "b")
    return met.filter((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _near(percent: int):
    """Filters on a pair of groups of the sizes n, m with a common shingle at places i, j."""
    n, m = F.col("n"), F.col("m")
    most = F.least(n - F.col("i"), m - F.col("j"))  # this shingle and what can follow in both
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _enough(percent: int):
    """Condition on a pair of groups with the prefixes p, q: what these share, with all that can follow the last of it, is enough for a link."""
    both = "array_intersect(p, q)"
    after = lambda size, own, prefix: f"{size} - {own} - array_position({prefix}, element_at({both}, -1))"
    most = f"size({both}) + least({after('n', 'own', 'p')}, {after('m', 'others', 'q')})"
    return F.expr(f"size({both}) > 0 and {100 + percent} * ({most}) >= {percent} * (n + m)")


def _unlike_lists(lists: DataFrame) -> DataFrame:
    """Of lists with the same entries one, each entry at its first place in any of them: near copies share hundreds of shingles,
    and their lists would yield every pair as often."""
    mark = lambda k: F.sum(F.xxhash64("r", F.lit(k)).cast("decimal(20,0)")).alias(f"mark{k}")
    same = lists.groupBy("token").agg(mark(1), mark(2)).groupBy("mark1", "mark2").agg(F.collect_list("token").alias("tokens"))
    same = same.select(F.array_min("tokens").alias("list"), F.explode("tokens").alias("token"))
    return lists.join(same, "token").groupBy("list", "r").agg(F.min("i").alias("i"), *[F.first(x).alias(x) for x in ("g", "n", "c")])


def _by_difference(now: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of sets still apart, a few each: those with most in common of what tells them from one set that both meet.

    Copies of one text, each changed in other places, share nearly all of their lists, whether they link or not. What they lack
    of a third copy tells them apart: two sets differ by what both differ from the third, less what they differ in alike.
    Lists are of two such shingles, of a few by hash, so that sets which share two changes meet in a short one.
    """
    chosen = lambda *k: F.struct(F.xxhash64("r", *[F.lit(x) for x in k]), F.col("r"))
    first = now.groupBy("token").agg(F.min_by("r", chosen(turn)).alias("z"))
    met = now.join(first, "token").filter("r <> z").groupBy("r", "n", "c", "z").agg(F.count(F.lit(1)).alias("times"))
    met = met.groupBy("r", "n", "c").agg(F.max_by("z", F.struct("times", "z")).alias("z"))
    met = met.join(sets.select(F.col("set").alias("r"), "own", F.col("tokens").alias("t")), "r").join(sets.select(F.col("set").alias("z"), F.col("tokens").alias("u")), "z")
    met = met.withColumn("differ", F.array_except("u", "t")).filter((F.size("differ") > 0) & (2 * F.size("differ") <= F.col("n")))
    some = f"slice(array_sort(transform(differ, x -> struct(xxhash64(x, {turn}) as h, x as x))), 1, {DIFFERENCES})"
    twos = "flatten(transform(some, (x, i) -> transform(slice(some, i + 1, size(some)), y -> xxhash64(x.x, y.x))))"
    met = met.withColumn("some", F.expr(some)).withColumn("scale", F.size("differ") / F.size("some"))
    lists = met.select("z", "r", "c", "scale", (F.size("differ") + F.size(F.array_except("t", "u")) + F.col("own")).alias("away"), F.explode(F.expr(twos)).alias("token"))
    centre = [F.min_by(F.struct("r", "c", "away"), chosen(turn, k)).alias(f"z{k}") for k in range(NEAREST)]
    centres = lists.groupBy("z", "token").agg(*centre).select("z", "token", F.explode(F.array_distinct(F.array(*[f"z{k}" for k in range(NEAREST)]))).alias("x"))
    centres = centres.select("z", "token", F.col("x.r").alias("a"), F.col("x.c").alias("d"), F.col("x.away").alias("far"))
    met = lists.join(centres, ["z", "token"]).filter("c <> d").groupBy("r", "a").agg((F.first("far") - 2 * F.first("scale") * F.sqrt(2 * F.count(F.lit(1)))).alias("far"))
    near = F.row_number().over(Window.partitionBy("r").orderBy("far", F.xxhash64("a", F.lit(turn))))  # no more than differences and centres
    return met.withColumn("place", near).filter(F.col("place") <= CENTRES).select(F.least("a", "r").alias("a"), F.greatest("a", "r").alias("b"))


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """set, class for the ``sets`` (set, n, own, p, tokens; repeats are one) that link with another."""
    spark = sets.sparkSession
    shared_dir(spark)
    parts = max(1, math.ceil(sets.count() / PART_SETS))
    kept = lambda frame: frame.coalesce(parts).checkpoint()
    # stays partitioned by set, in as many parts as joins make, so that they leave it where it lies
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):  # an adaptive plan would forget how it is partitioned
        sets = sets.repartition(max(parts, n_partitions(spark)), "set").dropDuplicates(["set"]).checkpoint()
    prefix = sets.select("set", "n", "own", F.slice("tokens", 1, F.col("p")).alias("prefix"))
    alike = prefix.select("set", F.xxhash64("n", "own", "prefix").alias("x"), F.xxhash64(F.lit(percent), "prefix", "n").alias("y"))
    members = kept(alike.join(alike.groupBy("x", "y").agg(F.min("set").alias("g")), ["x", "y"]).select("set", "g"))
    groups = prefix.join(members.filter("set = g").select("set"), "set").withColumnRenamed("set", "g")
    by_token = groups.select("g", "n", "own", F.posexplode("prefix").alias("i", "token")).select("token", "g", "n", (F.col("i") + F.col("own")).alias("i")).repartition("token")
    lists = kept(by_token.join(by_token.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "token"))
    classes = None  # set, class: of those linked so far

    def known(frame: DataFrame, column: str, name: str) -> DataFrame:
        if classes is None:
            return frame.withColumn(name, F.col(column))
        found = classes.select(F.col("set").alias(column), F.col("class").alias(name))
        return frame.join(found, column, "left").withColumn(name, F.coalesce(name, column))

    def join_up(pairs: DataFrame) -> DataFrame:
        """Classes after the links among ``pairs``."""
        new = known(known(_verified(pairs, sets, percent), "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        stars = components(new, parts).select(F.col("node").alias("old"), F.col("component").alias("new"))
        if classes is None:
            return kept(stars.select(F.col("old").alias("set"), F.col("new").alias("class")))
        moved = classes.join(stars, classes["class"] == stars["old"], "left").select("set", F.coalesce("new", "class").alias("class"))
        fresh = stars.join(classes.select(F.col("set").alias("old")), "old", "left_anti").select(F.col("old").alias("set"), F.col("new").alias("class"))
        return kept(moved.union(fresh))

    def entries(lists: DataFrame) -> DataFrame:
        """Of lists whose members are still apart: of each group (g) and class (c) in it one member (r), with how many of the list are of other classes."""
        of_class = known(members, "set", "c").groupBy("g", "c").agg(F.min("set").alias("r"))
        with_class = lists.join(of_class, "g")
        alike = with_class.groupBy("token", "c").agg(F.count(F.lit(1)).alias("alike"))
        apart = alike.groupBy("token").agg(F.sum("alike").alias("size"), F.max("alike").alias("most")).filter("most < size")
        return kept(with_class.join(apart.select("token", "size"), "token").join(alike, ["token", "c"]).withColumn("apart", F.col("size") - F.col("alike")).drop("size", "alike"))

    now, postings = entries(lists.select("token", "g", "n", "i")), None
    let_go(spark)
    for turn in range(ROUNDS):
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum("apart").alias("pairs")).head()
        postings = postings or sums["n"]
        if turn and (sums["pairs"] or 0) <= SPARE * postings:
            break
        many = CENTRES if turn else 1  # the first round is of all groups, the others of those still apart
        centre = [F.min_by(F.struct("r", "n", "i", "c"), F.struct(F.xxhash64("r", F.lit(turn), F.lit(k)), F.col("r"))) for k in range(many)]
        centres = now.groupBy("token").agg(*[x.alias(f"z{k}") for k, x in enumerate(centre)])
        centres = centres.withColumnRenamed("z0", "z") if many == 1 else centres.select("token", F.explode(F.array_distinct(F.array(*[f"z{k}" for k in range(many)]))).alias("z"))
        centres = centres.select("token", F.col("z.r").alias("a"), F.col("z.n").alias("m"), F.col("z.i").alias("j"), F.col("z.c").alias("d"))
        met = now.join(centres, "token").filter("c <> d").filter(_near(percent))
        often = F.row_number().over(Window.partitionBy("r").orderBy(F.col("times").desc(), F.xxhash64("a", F.lit(turn))))  # no more than lists and centres
        pairs = met.groupBy("r", "a").agg(F.count(F.lit(1)).alias("times")).withColumn("place", often).filter(F.col("place") <= many)
        pairs = pairs.select(F.least("a", "r").alias("a"), F.greatest("a", "r").alias("b"))
        if turn:
            pairs = pairs.union(_by_difference(now, sets, turn))
        else:
            pairs = pairs.union(members.filter("set <> g").select(F.col("g").alias("a"), F.col("set").alias("b")))
        classes = join_up(pairs.distinct())
        let_go(spark)
        now = entries(now.select("token", "g", "n", "i").distinct())
        let_go(spark)
    now = kept(_unlike_lists(now))
    let_go(spark)
    other = now.select("list", F.col("r").alias("s"), F.col("g").alias("h"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
    pairs = now.join(other, "list").filter("r < s and c <> d").filter(_near(percent)).select("r", "g", "s", "h").distinct()
    pairs = pairs.join(groups.select("g", "n", "own", F.col("prefix").alias("p")), "g")
    pairs = pairs.join(groups.select(F.col("g").alias("h"), F.col("n").alias("m"), F.col("own").alias("others"), F.col("prefix").alias("q")), "h").filter(_enough(percent)).select("r", "s")
    of_entry = known(members, "set", "c")
    of_entry = of_entry.join(of_entry.groupBy("g", "c").agg(F.min("set").alias("r")), ["g", "c"]).select("r", "set")
    mine, its = of_entry.select("r", F.col("set").alias("a")), of_entry.select(F.col("r").alias("s"), F.col("set").alias("b"))
    pairs = pairs.join(mine, "r").join(its, "s").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return join_up(pairs)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    return _classified(docs, width, percent, seed)[0].drop("set")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _classified(docs: DataFrame, width: int, percent: int, seed: int = 0) -> tuple[DataFrame, int]:
    """As near_duplicates(), with the set's hash of each row and the seed of these."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _slim(docs)
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).head()["bytes"] or 0
    n = max(1, n_partitions(spark), math.ceil(6 * size / TEXT_BYTES_A_SHINGLE / BUCKET_BYTES))
    n = max(n, MANY_BUCKETS) if n > MANY_BUCKETS // 4 else n
    let_go(spark)
    found = written(_at_home(_answered(_dealt(docs, width, seed, n), n), n, percent), "jaccard-sets")
    rows = found.filter("p is null").select("doc_id", "n", "set", "mark")
    sets = rows.groupBy("set").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.max("n").alias("m"), F.min("mark").alias("mark"), F.max("mark").alias("other"))
    if not sets.filter("n <> m or mark <> other").isEmpty():
        return _classified(docs, width, percent, seed + 1)
    # dozens of small joins: sending a side to all would fill the driver with what it keeps of each
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "2m"}):
        classes = links(found.filter("p is not null").select("set", "n", "own", "p", "tokens"), percent)
    named = sets.filter("n > 0").select("set", "least").join(classes, "set", "left").withColumn("class", F.coalesce("class", "set"))
    names = named.groupBy("class").agg(F.min("least").alias("component"))
    of_set = named.join(names, "class").select("set", "component")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    return rows.join(of_set, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), component, "set"), seed


def keyed(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, set (the set's hash) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(set_hashes(sets, seed)[0].view(np.int64))], ["doc_id", "set"])

    return docs.mapInArrow(run, "doc_id long, set long")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class, that of least doc_id, and all documents without words.

    Rows that share a doc_id are told apart by their text: of equal ones one stays, and each stays or goes by its own
    class. Rows with null doc_id can't be named by a class and stay, once for each text.
    """
    found, seed = _classified(docs, width, percent)
    found = written(found.select("doc_id", "component_id", "set"), "jaccard-classes")
    # a table of its own, so that Spark knows its size: texts only move if it is too large to be sent to all
    gone = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "jaccard-gone")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    many = found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("many"))
    if not many.isEmpty():
        same = F.col("id").eqNullSafe(F.col("many"))
        shared = rows.join(many, same, "left_semi").dropDuplicates(["id", "t"]).withColumn("key", F.xxhash64("id", "t"))
        of_key = keyed(shared.select(F.col("key").alias("doc_id"), F.col("t").cast("string").alias("text")), width, seed)
        of_key = of_key.select(F.col("doc_id").alias("its_key"), "set").dropDuplicates(["its_key"])
        other = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("other"), F.col("set").alias("its_set")).distinct()
        stay = shared.join(of_key, F.col("key") == F.col("its_key")).join(other, (F.col("id") == F.col("other")) & (F.col("set") == F.col("its_set")), "left_anti")
        kept = kept.join(many, same, "left_anti").union(stay.select("id", "t", "row"))
    return kept.select("row.*")
