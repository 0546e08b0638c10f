"""Main text, collocations and resampling: against brute force, SQL twins, held-out pages, and the cases the docstrings name."""

import glob
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import collocations, extraction, oracles, queries, resampling
from tessella.llm.html import leaves
from tessella.llm.textblock import blocks
from test_llm_operators import CLASHING, LOW, SCHEMA, nasty


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(frame):
    whole = lambda v: None if v is None else int(v) if isinstance(v, float) and v == int(v) else v
    columns = sorted(frame.columns)
    return columns, sorted(repr([whole(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", ["op12_collocations", "op13_resampling"])
def test_same_as_sql(spark, db, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(db.execute(oracles.__dict__[name[5:].upper()]).df())


# --- collocations


def brute_phrases(rows, width=3, least=10, share=50, most=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, width + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        n, rank = sum(a for p, a in c.items() if len(p) == 1), []
        for p, a in found.items():
            if p in inner and 100 * inner[p] >= share * a:
                continue
            cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rank.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(rank)[:most])]
    return sorted(out)


def phrase_rows(seed=2, n=80):
    rng = random.Random(seed)
    words = ["a", "b", "cc", "Dd", "é", "😀", "x-y", "\x00", "ſ", "A"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ";!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("width", [2, 3, 4])
def test_phrases_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 200)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 100)
    monkeypatch.setattr(collocations, "MOST_BUCKETS", 7)
    given = phrase_rows() + [(None, "en"), ("", "de"), ("one.two!", "fr"), ("far too long " * 30_000, "xx")]
    table = spark.createDataFrame(given, "text string, lang string").repartition(3)
    found = collocations.collocations(table, width=width, least=3, most=50).collect()
    assert sorted(map(tuple, found)) == brute_phrases(given, width, 3, most=50)


def test_phrases_without_filter_are_the_same(spark, monkeypatch):
    table = spark.createDataFrame(phrase_rows(5), "text string, lang string")
    found = sorted(map(tuple, collocations.collocations(table, least=2).collect()))
    monkeypatch.setattr(collocations, "bit_table", lambda counts: np.full(1 << (collocations.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    assert found and found == sorted(map(tuple, collocations.collocations(table, least=2).collect()))


def test_products_past_64_bits_are_exact(spark):
    a, left, right = 3_000_000_019, 5_000_000_029, 4_000_000_007
    got = collocations.scores(spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, f long"), 3).head()
    assert (got["score"], got["l"], got["r"]) == (1_000_000 * a * a // (left * right), left, right)
    even = collocations.scores(spark.createDataFrame([("en", "x y", 10**14)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "x", 10**14), ("en", "y", 10**14 + 1)], "lang string, phrase string, f long"), 3).head()
    assert even["score"] == 999_999


def test_pieces_are_deduplicated(spark):
    table = spark.createDataFrame([("Hello  World. hello\tworld!", "en")] * 5 + [("hello world", None)], "text string, lang string")
    assert sorted(map(tuple, collocations.pieces(table).collect())) == [("en", "hello world", 10), ("und", "hello world", 1)]


# --- resampling


def brute_scores(rows, target, percent=25, least=20, seed=7, buckets=10_000):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted(map(repr, (x[:5] for x in out)))


TARGET = ["changed abcdefg é abc", "a b c d e f g h", None, ""] * 3


@pytest.mark.parametrize("percent,least", [(25, 20), (50, 1), (100, 0), (0, 20), (33, 5)])
def test_draws_against_brute_force(spark, docs, percent, least):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    found = resampling.resampled(docs, target, percent=percent, least_words=least).collect()
    assert sorted(repr(list(r)) for r in found) == brute_scores([r[:2] for r in nasty()], TARGET, percent, least)


def test_repeated_rows_take_ranks_of_their_own(spark):
    given = [(1, "word " * 30)] * 40 + [(i, f"other words {i} " * 12) for i in range(2, 30)] + [(None, "no id " * 20)] * 3
    table, target = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame([("word word",)], "text string")
    found = resampling.resampled(table, target, percent=90)
    assert sorted(repr(list(r)) for r in found.collect()) == brute_scores(given, ["word word"], 90)
    kept = resampling.drawn(table, target, percent=90).collect()
    taken = Counter(r["doc_id"] for r in found.collect() if r["rank"] is not None)
    assert Counter(r["doc_id"] for r in kept) == taken and len(kept) == 63


def test_drawn_documents_are_those_with_ranks(spark, docs):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    clashing = docs.withColumns({c: F.lit("x") for c in CLASHING if c not in ("source",)})
    kept = resampling.drawn(clashing, target, percent=40, least_words=3)
    ranks = resampling.resampled(clashing, target, percent=40, least_words=3)
    assert kept.columns == clashing.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in ranks.filter("rank is not null").collect())


def test_long_words_and_crc(monkeypatch):
    words = ["a" * 5, "é" * 300, "z" * 129, "x", "0" * 128, "mixed1é"]
    block = next(blocks(pa.array([" ".join(words), "", words[1]])))
    found = resampling.features(block, 10_000)
    assert found.words.tolist() == [zlib.crc32(w.encode()) % 10_000 for w in [*words, words[1]]]
    assert found.pairs[:5].tolist() == [zlib.crc32(f"{a} {b}".encode()) % 10_000 for a, b in zip(words, words[1:], strict=False)]
    assert found.rows.tolist() == [0, 6, 6, 7]


def test_suffix_sums_end_the_draw(spark):
    scores = [5, 5, 5, 9, 1, 1, 7, -3]
    end = resampling.cut_of(spark.createDataFrame([(x,) for x in scores], "score long"), 50)
    assert end.drawn == 4 and end.score == 5 and end.left == 2 and end.above == {9: 0, 7: 1, 5: 2}
    assert resampling.cut_of(spark.createDataFrame([], "score long"), 50).drawn == 0


# --- main text


@pytest.fixture(scope="module")
def model():
    return extraction.default_model()


def test_held_out_pages(model):
    right = wrong = missed = 0
    for page, texts in extraction.labelled_pages(200, seed=5):
        found, wanted = leaves(page), set(texts)
        chosen = model.chosen(found)
        right += sum(c and x.text in wanted for c, x in zip(chosen, found, strict=True))
        wrong += sum(c and x.text not in wanted for c, x in zip(chosen, found, strict=True))
        missed += sum(not c and x.text in wanted for c, x in zip(chosen, found, strict=True))
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_given_pages(spark, sf_dir, model):
    import html

    def article(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", inner)))
        return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in inner.split("\n")) if x)

    found = {r["page_id"]: r for r in queries.op11_main_text(spark, sf_dir).collect()}
    pages = queries.table(spark, sf_dir, "pages").collect()
    assert len(found) == len(pages) and all(found[p["page_id"]]["n_chars"] == len(found[p["page_id"]]["text"]) for p in pages)
    assert sum(found[p["page_id"]]["text"] == article(p["html"]) for p in pages) >= 0.98 * len(pages)


def test_viterbi_and_sums_against_all_labellings():
    rng = np.random.default_rng(1)
    emit, steps = rng.normal(size=(1, 6)), rng.normal(size=(2, 2, 2))
    same, real = rng.integers(0, 2, (1, 6)), np.ones((1, 6), bool)

    def score(y):
        return sum(emit[0, t] * y[t] for t in range(6)) + sum(steps[same[0, t], y[t - 1], y[t]] for t in range(1, 6))

    every = [tuple(int(c) for c in f"{k:06b}") for k in range(64)]
    total = np.log(sum(np.exp(score(y)) for y in every))
    labels = np.array([every[37]])
    got, by_emit, by_step = extraction.likelihood(emit, same, labels, real, steps)
    assert abs(got - (score(every[37]) - total)) < 1e-9
    chance = np.array([np.exp(score(y) - total) for y in every])
    assert np.allclose(by_emit[0], labels[0] - (chance[:, None] * np.array(every)).sum(0))
    for k in np.ndindex(2, 2, 2):
        moved = steps.copy()
        moved[k] += 1e-6
        assert abs((extraction.likelihood(emit, same, labels, real, moved)[0] - got) / 1e-6 - by_step[k]) < 1e-4

    class Fixed(extraction.Field):
        def path(self, element):
            return 0.0

    from tessella.llm.html import Element, Leaf

    places = [Element("a", frozenset({"a"})), Element("b", frozenset({"b"}))]
    at, found = 0, []
    for t in range(6):
        at = at if t == 0 or same[0, t] else 1 - at
        found.append(Leaf(f"w{t}", 0, places[at]))
    weights = {f"only:{t}": float(emit[0, t]) for t in range(6)}
    old = extraction.traits_of
    extraction.traits_of = lambda leaf: [f"only:{leaf.text[1:]}"]
    try:
        best = Fixed(weights, steps).chosen(found)
    finally:
        extraction.traits_of = old
    assert tuple(map(int, best)) == max(every, key=score)


@pytest.mark.parametrize(
    "page,texts",
    [
        (None, []), ("", []), ("  \n ", []), ("plain & <b>bold</b>", ["plain & bold"]),
        ("<p>a<p>b<br>c<div>d</div>e", ["a", "b c", "d", "e"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x&amp;lt;&#233;&nbsp;y</p>", ["x&lt;é y"]),
        ("<!-- <p>no</p> --><p title='a>b'>yes</p></div></p>", ["yes"]),
        ("<p>open <!-- never closed <p>gone</p>", ["open"]), ("<p>a < b <3 <i", ["a < b <3 <i"]), ("<p title=\"never>text</p>", ["text"]),
        ("<UL><LI>one<LI>two</UL><table><tr><td>x<td>y<tr><td>z</table>", ["one", "two", "x", "y", "z"]),
        ("<textarea>no</textarea><script>unclosed", []),
    ],
)
def test_leaf_blocks(page, texts):
    assert [x.text for x in leaves(page)] == texts


def test_implied_ends_and_paths():
    found = leaves("<div class='ad'><ul><li>a<ul><li>b</ul><li>c</ul></div><p>d")
    assert [sorted(x for x in f.within.traits if x.startswith("in:")) for f in found] == [["in:div", "in:li", "in:ul"]] * 3 + [["in:p"]]
    assert "name:ad" in found[0].within.traits and "name:ad" not in found[3].within.traits


def test_pages_with_nulls_long_texts_and_repeats(spark, model):
    long = "<html><body><article><h1>T</h1>" + "<p>Some long text, with commas, and a stop.</p>" * 20_000 + "</article></body></html>"
    given = [(1, "u", long), (None, None, "<article><p>A sentence of some words.</p></article>"), (2, "v", None), (2, "v", ""), (3, "w", "<" * 100_000), (4, "x", "<div>" * 50_000 + "</p>" * 50_000), (1, "u", long)]
    table = spark.createDataFrame(given, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    found = extraction.main_text(table, model).collect()
    assert len(found) == 7 and [len(r) for r in found] == [4] * 7
    by_id = {r["page_id"]: r for r in found}
    assert by_id[2]["text"] == "" and by_id[2]["n_chars"] == 0 and by_id[1]["text"].count("Some long text") == 20_000
    assert by_id[None]["text"] == "A sentence of some words."


# --- all


@pytest.mark.parametrize("empty", ["docs", "both"])
def test_empty_tables(spark, docs, model, empty):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    assert extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    assert resampling.resampled(none, docs if empty == "docs" else none).count() == 0 and resampling.drawn(none, none).count() == 0
    assert resampling.resampled(docs, none).count() == docs.count()


def test_clashing_columns(spark, docs):
    clashing = docs.withColumns({c: F.lit("x") for c in [*CLASHING, "piece", "phrase", "lang_", "f", "m", "home", "n_words", "weight", "rank", "eligible", "above"] if c not in ("source", "lang")})
    for run in (lambda d: collocations.collocations(d, least=3), lambda d: resampling.resampled(d, d.limit(5).select("text"))):
        assert len(run(clashing).collect()) == len(run(docs).collect())
    same = [sorted(map(repr, collocations.collocations(d, least=3).collect())) for d in (docs, clashing)]
    assert same[0] == same[1]


