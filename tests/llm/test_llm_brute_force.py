"""Operators against brute force over whole small tables, with the limits that come into play at scale made small."""

import glob
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import fingerprints, jaccard, mixing, oracles, queries, scoring
from tessella.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """doc_id, size of the set, least reachable doc_id, of rows of distinct doc_ids."""
    sets = [shingles(t) for _, t in rows]
    holders, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def crowd(n=2000, seed=6):
    """Documents with a common passage, chains of near copies, long texts, and groups that share a prefix but don't link."""
    rng = random.Random(seed)
    word = lambda: f"v{int(rng.paretovariate(0.6)) % 4000}"
    passage, form = ([word() for _ in range(k)] for k in (60, 130))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([3, 8, 40, 90, 200, 200, 600]))]
        kind = rng.random()
        if kind < 0.3:
            base += passage
        if kind > 0.85:  # a form: three quarters in common
            base = form + [word() for _ in range(rng.randint(20, 60))]
        out.append(list(base))
        if kind < 0.15:
            for _ in range(rng.randint(1, 12)):  # a chain: each near the one before
                base = list(base)
                base[rng.randrange(len(base))] = word()
                out.append(base)
        if rng.random() < 0.1:
            out += [list(base)] * rng.randint(1, 4)
    out += [[word() for _ in range(20_000)]] * 2
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_jaccard_links_every_document_right(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 150)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "PART_SETS", 300)
    rows = crowd()
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(map(tuple, found)) == classes(rows)


def test_jaccard_with_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPARE", 1)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = crowd(400, 9)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, found)) == classes(rows)


@pytest.mark.parametrize("width", [300, 255, 1])
def test_steps_come_back(width):
    rng = np.random.default_rng(width)
    sizes = rng.integers(1, 6, 50)
    parts = [np.sort(rng.choice(4096, k, replace=False)) for k in sizes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    raw, at = jaccard._steps(np.concatenate(parts), ends)
    assert (jaccard._from_steps(raw.tobytes(), sizes) == np.concatenate(parts)).all()
    for i, p in enumerate(parts):
        assert (jaccard._from_steps(raw[at[i] : at[i + 1]].tobytes()) == p).all()


def scored(docs):
    found = scoring.score(docs, F.col("doc_id") % 3 != 0, tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()


def base(rows):
    """doc_id, n_tokens, n_known, train_tokens, base_score by the formula."""
    texts = [(d, WORD.findall((t or "").translate(LOW)) + [None]) for d, t in rows]
    counts = Counter(w for d, t in texts if d % 3 for w in t)
    whole, kinds = sum(counts.values()), len(counts)
    return [(d, len(t), sum(w in counts for w in t), whole, sum(math.log10((counts[w] + 0.1) / (whole + 0.1 * (kinds + 1))) for w in t)) for d, t in texts]


@pytest.mark.parametrize("times", [1, 2])
def test_base_scores(spark, times):
    rows = [(i, t) for i, (_, t) in enumerate(crowd(150, 3))] + [(10_000, None), (10_001, "")]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = one.union(one) if times == 2 else one  # equal batches
    found, expected = sorted(map(tuple, scored(docs))), sorted(base(rows * times))
    assert [x[:4] for x in found] == [x[:4] for x in expected]
    assert np.allclose([x[4] for x in found], [x[4] for x in expected])
    assert all(x[5] < 0 for x in found)


def test_likeness_of_fingerprints(spark):
    rows = sorted(crowd(120, 4), key=lambda r: -r[0])
    found = {r["doc_id"]: r for r in fingerprints.next_and_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    off = []
    for i, (d, a) in enumerate(rows):
        b = rows[(i + 1) % len(rows)][1]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        for name, other in (("near_edited", edited), ("near_next", b)):
            x, y = shingles(a), shingles(other)
            off.append(abs(found[d][name] - len(x & y) / max(1, len(x | y))))
        assert found[d]["near_edited"] == pytest.approx(fingerprints.resemblance(fingerprints.from_text(found[d]["fingerprint"]), fingerprints.from_text(found[d]["edited_fingerprint"])), abs=1e-12)
    assert np.mean(off) < 0.02 and max(off) < 0.2


def words_of(sources):
    rng = random.Random(11)
    return [(i, " ".join(rng.choices("abcdefg", k=rng.randint(0, 400))), s) for i, s in enumerate(rng.choices(list(sources), list(sources.values()), k=900))]


def test_every_source_comes_near_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    monkeypatch.setattr(mixing, "BUNDLE", 4)
    rows = words_of({"hot": 600, "b": 100, "c": 30, None: 20, "tiny": 2})
    docs = spark.createDataFrame([*rows, (1, "one small text", "small"), (7, None, "none"), rows[5], rows[5]], "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    found = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    for k, t in target.items():
        assert abs(taken[k] - t) <= max(2 * mixing.BLOCK, 0.01 * t), (k, taken[k], t)
    mixed = mixing.mixed_documents(docs).collect()
    got, want = Counter(), Counter()
    for r in mixed:
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    for r in found:
        want[r["doc_id"]] += r["taken"]
    assert +got == +want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in theirs.description)
    want = theirs.df()[columns]
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(found.columns) == columns
    key = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    assert Counter(map(key, found[columns].itertuples(index=False))) == Counter(map(key, want.itertuples(index=False)))


def test_oracles_name_columns():
    assert all("SELECT" in getattr(oracles, x) for x in ("TOP_K", "PREFERENCES", "MIXING"))


def test_copies_with_changes_of_their_own_are_joined_before_the_last_round(spark, monkeypatch):
    """Most pairs of copies of one text, two or three words changed in each, miss the limit; few may be left for the join of all pairs."""
    rng = random.Random(3)
    text, n = [f"b{i}" for i in range(150)], 400
    rows = []
    for i in range(n):
        words = list(text)
        for _ in range(rng.choice([2, 2, 3])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    left, plain = [], jaccard._unlike_lists

    def spied(lists):
        now = plain(lists).checkpoint()
        other = now.select("list", F.col("r").alias("s"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
        left.append(now.join(other, "list").filter("r < s and c <> d").filter(jaccard._near(80)).count())
        return now

    monkeypatch.setattr(jaccard, "_unlike_lists", spied)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(map(tuple, found)) == classes(rows)
    assert left[0] <= 60 * n  # 33,415 with centres of lists alone
