"""Toxicity: a counterfactual-regularised logistic classifier on words and word beginnings.

Features of a text are its distinct words (longest runs of letters, lower case) and their beginnings of 3 to
10 bytes, present or not. From at most ``SAMPLE`` labelled rows (the smallest by MD5 of doc_id, a documented
bound), in Spark: how many toxic and other texts hold each feature; the ``FEATURES`` of highest z-score are
kept. Then the sampled rows, as lists of these features, reach the driver, where the classifier is fitted.

Counterfactuals: in each labelled sentence that names a group (``IDENTITY``), the name is swapped for other
names of its list, and the fit is penalised by the squared change of the score (before the logistic), so
that a mention of a group moves no score by itself.

Only text is looked at when scoring. Null counts as empty; an empty text scores by the intercept. Labels null
or of unknown documents are left out; a document labelled twice counts each time. Without both classes
among the labels every score is the share of toxic ones (0 without labels). Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.session import released, small_batches, trim, written
from tessella.llm.textblock import LENGTH_SALT, LOWER, U64, Block, blocks, mix, powers

SAMPLE = 16_000
FEATURES = 4096
LEAST_TEXTS = 4
SWAPS = 2
SHORTEST, LONGEST = 3, 10
#: Names of groups; those of one line stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "latino", "hispanic"),
    ("mexican", "american", "chinese", "indian", "european", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "disabled", "blind", "deaf"),
)

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
OTHERS = {word: [x for x in line if x != word] for line in IDENTITY for word in line}
NAMED = re.compile(rf"\b({'|'.join(sorted(OTHERS, key=len, reverse=True))})\b", re.IGNORECASE | re.ASCII)
SENTENCE = re.compile(r"[^.!?\n]+")


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the block's row of each, not yet distinct."""
    data = LOWER[block.data]
    if len(data) > 1:  # capital letters of Latin-1
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][after] += 0x20
    full = LETTER[data]
    if not full.any():
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    edges = block.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = full[edges]
    last[edges - 1] = full[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(block.offsets, begin, side="right") - 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    inside = np.append((data & 0xC0) == 0x80, False)  # no beginning ends within a code point
    hashes, rows = [], []
    for k in (*range(SHORTEST, LONGEST + 1), 0):
        stop = begin + k if k else end
        some = (stop < end) & ~inside[np.minimum(stop, len(data))] if k else np.ones(len(begin), bool)
        b, e = begin[some], stop[some]
        hashes.append(mix((sums[e] - sums[b]) * down[b] + (e - b).astype(U64) * LENGTH_SALT + U64(not k)))
        rows.append(row[some])
    return np.concatenate(hashes), np.concatenate(rows)


def distinct_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """As features(), each once for each row."""
    hashes, rows = features(block)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> U64(44)).astype(np.int64)] = True

    def places(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Row and place among ``hashes`` of every feature of the block that is one of them, each pair once."""
        found, rows = features(block)
        some = self.maybe[(found >> U64(44)).astype(np.int64)]
        found, rows = found[some], rows[some]
        at = np.minimum(np.searchsorted(self.hashes, found), max(0, len(self.hashes) - 1))
        same = self.hashes[at] == found if len(self.hashes) else np.zeros(0, bool)
        pairs = np.unique(rows[same] * np.int64(len(self.hashes)) + at[same])
        return np.divmod(pairs, max(1, len(self.hashes)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for block in blocks(texts):
            rows, at = self.places(block)
            out[block.first : block.last] += np.bincount(rows, self.weights[at], minlength=block.last - block.first)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def swapped(text: str, turn: int) -> str | None:
    """The text with each group's name in its sentences changed for another of its list; None without names."""
    count = 0

    def other(found: re.Match) -> str:
        nonlocal count
        count += 1
        choice = OTHERS[found[0].lower()]
        return choice[turn % len(choice)]

    changed = SENTENCE.sub(lambda sentence: NAMED.sub(other, sentence[0]), text)
    return changed if count else None


def fit(at: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], n: int, decay: float = 1e-5, tied: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by full gradient steps (Adam). at: features of each row; pairs: row and the features after a swap."""
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    cols = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
    # what a swap adds (+1) and takes away (-1)
    where, which, sign = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, (row, after) in enumerate(pairs):
        gone, come = np.setdiff1d(at[row], after), np.setdiff1d(after, at[row])
        where.append(np.full(len(gone) + len(come), k))
        which += [gone, come]
        sign += [np.full(len(gone), -1.0), np.ones(len(come))]
    where, which, sign = np.concatenate(where), np.concatenate(which).astype(np.int64), np.concatenate(sign)
    w, b = np.zeros(n), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        s = b + np.bincount(rows, w[cols], minlength=len(at))
        error = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - labels) / len(at)
        g = np.bincount(cols, error[rows], minlength=n) + decay * w
        if len(pairs):
            change = np.bincount(where, sign * w[which], minlength=len(pairs))
            g += tied * np.bincount(which, sign * change[where], minlength=n) / len(at)
        g = np.append(g, error.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """Fits on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = labels.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(sample)  # the bound lets it be broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = written(docs.join(F.broadcast(chosen), "doc_id"), "toxicity")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).head()
    n, toxic = count["n"], count["toxic"] or 0
    if not 0 < toxic < n:
        return Model(np.zeros(0, U64), np.zeros(0), 500.0 if toxic else -500.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("toxic").to_numpy()
            for block in blocks(batch.column("text")):
                found, row = distinct_features(block)
                kinds, which = np.unique(found, return_inverse=True)
                pos = np.bincount(which, y[block.first + row], minlength=len(kinds)).astype(np.int32)
                total = np.bincount(which, minlength=len(kinds)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(pos), pa.array(total - pos)], ["feature", "pos", "neg"])

    share = toxic / n
    total = F.col("pos") + F.col("neg")
    z = F.abs(F.col("pos") - total * share) / F.sqrt(total * share * (1 - share))
    best = (
        rows.select("toxic", "text").mapInArrow(released(counted), "feature long, pos int, neg int")
        .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(total >= LEAST_TEXTS)
        .orderBy(z.desc(), "feature").limit(n_features)
        .select("feature").toArrow()
    )
    hashes = np.sort(best.column("feature").to_numpy().astype(np.int64).view(U64))
    blank = Model(hashes, np.zeros(len(hashes)), 0.0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            made = [(i, changed) for i, text in enumerate(texts) for turn in range(SWAPS) if (changed := swapped(text, turn)) is not None]
            out = [_lists(blank, pa.array(x, pa.large_string())) for x in (texts, [x for _, x in made])]
            swaps = [[] for _ in texts]
            for (i, _), places in zip(made, out[1], strict=True):
                swaps[i].append(places)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out[0], pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], ["toxic", "at", "swaps"])

    # of each sampled row a few hundred numbers, as Arrow arrays; a doc_id that documents repeat counts as often
    seen = rows.select("toxic", "text").mapInArrow(released(listed), "toxic int, at array<int>, swaps array<array<int>>").toArrow()
    y = seen.column("toxic").to_numpy()
    at = _arrays(seen.column("at"))
    swaps = seen.column("swaps").combine_chunks()
    owner = np.repeat(np.arange(len(at)), pa.compute.list_value_length(swaps).to_numpy(zero_copy_only=False))
    after = _arrays(swaps.flatten())
    order = sorted(range(len(at)), key=lambda i: (y[i], at[i].tobytes()))  # for any order of rows the same sums
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    pairs = sorted(((int(place[i]), x) for i, x in zip(owner, after, strict=True)), key=lambda p: (p[0], p[1].tobytes()))
    weights, intercept = fit([at[i] for i in order], y[order].astype(float), pairs, len(hashes))
    del seen, at, after, pairs, swaps
    trim()
    return Model(hashes, weights, intercept)


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(sizes)[:-1]) if len(lists) else []


def _lists(model: Model, texts: pa.Array) -> list[list[int]]:
    out: list[list[int]] = []
    for block in blocks(texts):
        rows, at = model.places(block)
        ends = np.searchsorted(rows, np.arange(block.last - block.first + 1))
        out += [at[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def score_column(text: Column, model: Model) -> Column:
    """Score of each text, as a column."""
    hashes, weights, intercept = model.hashes, model.weights, model.intercept

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Model(hashes, weights, intercept).scores(texts))

    return score(text.cast("string"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and others) with a column ``score``, a row for each row."""
    small_batches(docs.sparkSession)
    return docs.withColumn("score", score_column(F.col("text"), model))


def clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``least`` or more."""
    small_batches(docs.sparkSession)
    return docs.filter(score_column(F.col("text"), model) < least)
