"""The ten operators on small inputs: against brute force, and nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import attention, chat, fingerprints, jaccard, mixing, packing, scoring, secrets, token_files, topk, toxicity
from tessella.llm.queries import tokenizer_path
from tessella.llm.subwords import WordEncoder, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
#: Names the operators use inside.
CLASHING = ["n", "set", "mark", "token", "bucket", "__bucket", "edge", "own", "goes", "top", "size", "src", "shard", "order", "before", "words", "times", "row", "copy", "key", "ids", "training", "score", "spans", "target", "taken", "__gone", "gone", "weight", "first", "last", "parts", "lead"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 7))) for _ in range(80)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(n)]
    out = []
    for t in base:
        w = t.split(" ")
        out.append(t)
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "changed"
            out.append(rng.choice([" ", "\n", "\t"]).join(w).title())
        if rng.random() < 0.2:
            out.append(t)
    return out


def nasty():
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", len(t)) for i, t in enumerate(texts())]
    n = len(rows)
    rows += [(n, None, "s0", None, None), (n + 1, "", None, "en", 0), (n + 2, " \n\t ", "s1", "en", 4), (None, "no id at all here today", "s1", "en", 5), (None, None, None, None, None)]
    rows += [(n + 3, "word " * 30_000, "s2", "en", 150_000), rows[3], rows[3], (5, "another text of a taken id", "s0", "en", 1)]
    rows += [(n + 4, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" 😀 <|endoftext|> don't İ ſ", "s1", "fr", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(50)] + [(None, 1, 1), (3, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


OPERATORS = {
    "fingerprints": lambda d: fingerprints.next_and_edited(d),
    "marks": lambda d: fingerprints.fingerprints(d),
    "jaccard": lambda d: jaccard.near_duplicates(d),
    "one_of_each": lambda d: jaccard.one_of_each(d).select("doc_id", "text"),
    "packing": lambda d: packing.pack(d, tokenizer_path(), 2).select("doc_id", "start", "length", "doc_tokens") if d.count() == 0 else packing.pack(d, tokenizer_path(), 2).groupBy("doc_id").agg(F.sum("length").alias("n")),
    "secrets": lambda d: secrets.digest(secrets.scan(d, secrets.learn())),
    "redacted": lambda d: secrets.redacted(d, secrets.learn()).select("doc_id", "text"),
    "mixing": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed_documents(d).select("doc_id", "text"),
    "toxicity": lambda d: toxicity.scored(d.select("doc_id", "text"), toxicity.train(d, labels(d.sparkSession))).select("doc_id", F.round("score", 6)),
    "scoring": lambda d: scoring.score(d, F.col("doc_id") % 3 != 0, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "n_known", "base_score", "score"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(docs, clashing, name):
    got = [sorted(map(repr, OPERATORS[name](d).collect())) for d in (docs, clashing)]
    if name == "scoring":  # parameters are sums over partitions
        assert len(got[0]) == len(got[1])
    else:
        assert got[0] == got[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_against_sets(docs):
    rows = sorted(nasty(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    found = fingerprints.next_and_edited(docs).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for i, r in enumerate(rows):
        a, b = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        expected[(r[0], len(a), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
    by_id = {r["doc_id"]: r for r in found}
    for i in range(20, 40):
        real = shingles(rows[i][1])
        mark = fingerprints.from_text(by_id[rows[i][0]]["fingerprint"])
        assert abs(fingerprints.distinct(mark) - len(real)) <= 0.2 * len(real)


def test_sketches_merge_in_any_order():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)) for _ in range(3)]
    marks = [fingerprints.sketch(x) for x in sets]
    whole = fingerprints.sketch(np.unique(np.concatenate(sets)))
    a = fingerprints.merge(fingerprints.merge(marks[0], marks[1]), marks[2])
    assert (a == whole).all() and (fingerprints.merge(marks[2], fingerprints.merge(marks[1], marks[0])) == whole).all()
    assert abs(fingerprints.distinct(whole) - 9000) < 3000
    half = np.unique(np.concatenate([sets[0][:1500], sets[1]]))
    assert abs(fingerprints.containment(fingerprints.sketch(np.sort(sets[0][:1500])), fingerprints.sketch(half)) - 1) < 0.35


def test_merged_by_group(spark, docs):
    prints = fingerprints.fingerprints(docs.filter("doc_id is not null")).withColumn("g", F.col("doc_id") % 2)
    found = {r["g"]: r["fingerprint"] for r in fingerprints.merged(prints, "g").collect()}
    for g in (0, 1):
        one = np.zeros(0, np.uint64)
        for r in prints.filter(F.col("g") == g).collect():
            one = fingerprints.merge(one, fingerprints.from_text(r["fingerprint"]))
        assert found[g] == fingerprints.to_text(one)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 24))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=24) * 0.2 if i % 4 else np.ones(24) * 0.25)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 22), (302, [float("nan")] * 24), (303, [float("inf")] * 24), (350, [1.0, 2.0]), (400, [0.5, -1.0]), (None, [1.0] * 24), (450, []), (500, [1e300] * 24), (501, [300_000.0] + [-1.0] * 23), (550, [-3e9] + [0.1] * 23)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("r", "q", "id", "v", "meeting", "score")})
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    good = {i: [256 * int(x) if abs(x) > 1e15 else math.floor(256 * x) for x in v] for i, v in rows[:300] + rows[304:] if i is not None}
    fit = lambda x: max(-(2**63), min(2**63 - 1, x))
    expected = {}
    for q in (x for x in good if x % 50 == 0):
        scored = sorted((-fit(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored[:5])}
    assert found == expected
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(50, [1.0, 1.0]), (1, [300000.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(few, F.col("vec_id") == 50).orderBy("rank").collect()] == [1, 2]


def test_top_k_ties_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 7)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "AT_ONCE", 1)
    rows = [(i % 40, [float(i % 3), 1.0]) for i in range(80)]  # every id twice
    found = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 6).collect())
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    expected = []
    for q, a in whole:
        if q % 20 == 0:
            expected.append((q, sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:6]))
    assert len(found) == 6 * len({q for q, _ in expected})  # repeated queries share their ranks
    for q in (0, 20):
        best = sorted(x for p, found_here in expected if p == q for x in found_here)[:6]
        assert [(-s, i) for p, _, i, s in found if p == q] == best


def test_classes_against_brute_force(docs):
    rows = nasty()
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), 10**9), r[0])
    expected = Counter((r[0], len(sets[i]), names.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert found == expected


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    found = {r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0}


def test_one_of_each_keeps_one(docs):
    kept = jaccard.one_of_each(docs).collect()
    classes = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).filter("n_shingles > 0 and doc_id is not null").collect()}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None and WORD.search(r["text"] or "")} == {c for _, c in classes}


def test_rows_of_one_id_stay_or_go_by_their_own_text(spark):
    base, unique = (" ".join(f"{c}{i}" for i in range(200)) for c in "wu")
    rows = [(1, base), (2, base + " more"), (2, unique), (2, unique), (3, unique + " more"), (4, None), (4, base), (4, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, base), (2, unique), (4, None), (4, "")])


def test_encoder_is_the_tokenizer():
    rng = random.Random(4)
    alphabet = list("abcXYZ019 .,'<|>&\n\t") + ["é", "É", "×", "÷", "…", "́", "中", " ", "<|endoftext|>", "'s", "😀", "İ", "\x00", "\x1c"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(3000)] + [None, "", "x" * 5000]
    t, e = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path())
    ids, at = e.encode(pa.array(made))
    for i, x in enumerate(made):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def expected_ids(end):
    t = Tokenizer.from_file(tokenizer_path())
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in nasty()]


def test_pieces_make_up_every_document(docs):
    found = packing.pack(docs, tokenizer_path(), 2, length=64, with_ids=True).collect()
    ids = Counter((i, tuple(x)) for i, x in expected_ids(2))
    sequences = {}
    for r in found:
        part = np.frombuffer(r["ids"], "<u4")
        assert len(part) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(sequences)
    stream = sorted(((r["sequence_id"] * 64 + r["offset"]), r) for r in found)
    got, held = Counter(), []
    for _, r in stream:
        held += np.frombuffer(r["ids"], "<u4").tolist()
        if r["start"] + r["length"] == r["doc_tokens"]:
            got[(r["doc_id"], tuple(held))] += 1
            held = []
    assert got == ids
    assert {r["padded"] for r in packing.padding(packing.pack(docs, tokenizer_path(), 2, 64), 64).collect()} <= {1, 2, 4, 8, 16, 32, 64}


def test_token_files_round_trip(spark, docs, tmp_path):
    manifest = token_files.write_token_files(docs, str(tmp_path / "out"), tokenizer_path(), 1)
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "out")).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, tuple(x)) for i, x in expected_ids(1))
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert manifest["n_tokens"] == at
    empty = token_files.write_token_files(docs.limit(0), str(tmp_path / "none"), tokenizer_path(), 1)
    assert empty["shards"] == [] and token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def turns(*parts):
    return [{"role": r, "text": t} for r, t in parts]


def test_preferences(spark):
    rows = [
        (1, turns(("user", "hi"), ("assistant", "yes")), turns(("user", "hi"), ("assistant", "no"), ("user", "why"))),
        (2, turns(("user", "a")), turns(("user", "a"))),
        (3, None, turns(("assistant", "x"))),
        (4, [], []),
    ]
    kind = "array<struct<role: string, text: string>>"
    found = {r["conv_id"]: r for r in chat.preferences(spark.createDataFrame(rows, f"conv_id long, chosen {kind}, rejected {kind}")).collect()}
    assert found[1]["prompt"] == "<|user|>\nhi<|end|>\n" and found[1]["common_turns"] == 1
    for side, text in (("chosen", "yes"), ("rejected", "no")):
        (span,) = found[1][f"{side}_learned"]
        assert found[1][f"{side}_completion"][span["start"] : span["end"]] == f"{text}<|end|>"
    assert found[2]["chosen_completion"] == found[2]["rejected_completion"] == "" and found[2]["common_turns"] == 1
    assert found[3]["prompt"] == "" and found[3]["chosen_completion"] == "" and len(found[3]["rejected_learned"]) == 1
    assert found[4]["common_turns"] == 0


def test_pairs_and_masks(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "long answer"), (3, 0, "user", "z"), (3, 1, "assistant", "other"), (8, 0, None, None), (None, 0, "user", "lost")]
    pairs = chat.last_turn_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = chat.preferences(pairs)
    found = {r["conv_id"]: r for r in chat.tokenized(made, tokenizer_path()).collect()}
    assert set(found) == {2, 3, 8}
    t = Tokenizer.from_file(tokenizer_path())
    learned = [i for i, m in zip(found[2]["chosen_ids"], found[2]["chosen_mask"]) if m]
    assert learned == t.encode("long answer<|end|>").ids and sum(found[8]["rejected_mask"]) == 0


def test_model_is_causal_and_counts_once():
    rng = np.random.default_rng(1)
    n = 50257
    ids = rng.integers(0, 300, 400)
    lengths = np.array([1, 150, 0, 249])
    words = attention.Vocabulary.of(np.bincount(ids, minlength=n), rng.random(n) < 0.5)
    words = words.after(words.last_classes(ids, lengths), ids, np.ones(len(ids)))
    p = attention.initial() | {"prior": attention.prior_of(np.ones((attention.INPUTS + 1, attention.CLASSES)))}
    whole = attention.log10_chances(p, words, ids, lengths)
    assert len(whole) == len(ids) and (whole < 0).all()
    changed = ids.copy()
    changed[100:151] = 7
    again = attention.log10_chances(p, words, changed, lengths)
    assert np.allclose(whole[:100], again[:100], atol=1e-5) and np.allclose(whole[152:], again[152:], atol=1e-5)
    # chances of all ids after one place sum to one
    shares = np.exp(words.log_share[3]).reshape(-1)
    assert np.allclose(np.bincount(words.to_class, shares, minlength=attention.CLASSES)[np.unique(words.to_class)], 1, atol=1e-3)


def test_gradients():
    rng = np.random.default_rng(2)
    p = attention.initial() | {"prior": attention.prior_of(rng.integers(1, 9, (attention.INPUTS + 1, attention.CLASSES)))}
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rows, real, target = attention.windows(rng.integers(0, 50, 70), np.array([40, 30]))
    classes = rng.integers(0, attention.CLASSES, 70)

    def loss(q):
        z = attention.forward(q, rows, real)["logits"]
        z = z - z.max(1, keepdims=True)
        want = target.reshape(-1)
        some = want >= 0
        return -(z - np.log(np.exp(z).sum(1, keepdims=True)))[some, classes[want[some]]].sum()

    f = attention.forward(p, rows, real)
    d = np.exp(f["logits"] - f["logits"].max(1, keepdims=True))
    d /= d.sum(1, keepdims=True)
    want = target.reshape(-1)
    some = want >= 0
    d[np.arange(len(d))[some], classes[want[some]]] -= 1
    d *= some[:, None]
    grads = attention.backward(p, f, rows, d)
    for k in ("query", "key", "value", "into", "out", "head", "inner_bias", "place"):
        at = tuple(0 if k == "inner_bias" else x // 2 for x in p[k].shape)
        q = {**p, k: p[k].copy()}
        q[k][at] += 1e-5
        assert abs((loss(q) - loss(p)) / 1e-5 - grads[k][at]) < 1e-2 * max(1, abs(grads[k][at]))


def test_base_scores_against_brute_force(docs):
    rows = [r for r in nasty()]
    tokens = [WORD.findall((r[1] or "").translate(LOW)) + ["\n"] for r in rows]
    training = [r[0] is not None and r[0] % 3 != 0 for r in rows]
    c = Counter(w for t, y in zip(tokens, training) if y for w in t)
    n, v = sum(c.values()), len(c)
    expected = sorted((repr(r[0]), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for r, t in zip(rows, tokens))
    found = scoring.score(docs, F.col("doc_id") % 3 != 0, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in found) == expected
    assert {r["train_tokens"] for r in found} == {n}


BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def test_training_reads_every_training_document(spark, monkeypatch):
    e = encoder(tokenizer_path("byte_bpe_50k.json"), WordEncoder)
    names = sorted(t[1:] for t in e.tokenizer.get_vocab() if t.startswith("Ġ") and re.fullmatch("[a-z]{5}", t[1:]))[:900]
    made = [" ".join([x] * 4) for x in names]
    seen, plain = [], scoring._scored
    monkeypatch.setattr(scoring, "_scored", lambda table, words, p: seen.append((words, p)) or plain(table, words, p))
    scoring.score(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), F.lit(True), tokenizer_path("byte_bpe_50k.json"))
    words, p = seen[0]
    ids, at = e.encode(pa.array(made))
    rows = np.unique(words.to_input[ids])
    assert len(rows) > 500
    moved = (p["token"] != attention.initial()["token"]).any(1)  # each document's own rows have no gradient but by it
    assert moved[rows].all()


def test_runs_hold_every_document(monkeypatch):
    monkeypatch.setattr(scoring, "RUN_TOKENS", 1000)
    rng = random.Random(3)
    made = [np.arange(rng.randint(1, 90), dtype="<u4") + 100 * i for i in range(950)]
    batches = [pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes() for x in made[i : i + n]], pa.binary())}) for i, n in ((0, 500), (500, 0), (500, 450))]
    got = list(scoring._runs(iter(batches)))
    assert len(got) > 2
    assert np.array_equal(np.concatenate([x for x, _ in got]), np.concatenate(made)) and np.concatenate([n for _, n in got]).tolist() == list(map(len, made))


def test_secret_rules_against_plain_patterns():
    rng = random.Random(9)
    parts = ["token", "Secret", " = ", ":", "'", '"', "AKIA", "A7", "0123456789abcdef", "xyz", " ", "é", "api_key", "\n", "=", "ſecret: abcdefgh", "passwd=short", "ghp_"]
    formats = secrets.learn()
    made = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    got = list(secrets._found(pa.array(made), formats, secrets.BITS))
    for text, found in zip(made, got):
        expected = [(m.start(), k, m.end()) for k, (p, g, least) in BASE.items() for m in p.finditer(text) if len(m[g]) >= least]
        assert sorted((a, k, b) for k, a, b, _ in found if k != "format") == sorted(expected), text


def test_learned_formats_hold_out():
    formats = secrets.learn()
    for kind, examples in secrets.labelled_credentials(40, seed=123).items():
        assert sum(formats.gain(x) >= secrets.BITS for x in examples) >= 38, kind
    ordinary = [x for x in secrets.labelled_ordinary(400, seed=321) if secrets.CANDIDATE.fullmatch(x)]
    assert not [x for x in ordinary if formats.gain(x) >= secrets.BITS]
    text = f"see {secrets.labelled_credentials(1, 5)['personal token'][0]} here and password = 'hunter2hunter2' too"
    found = secrets.spans(text, formats)
    assert [k for k, *_ in found] == ["format", "assign"]
    assert secrets.redact(text, found) == "see [SECRET] here and password = '[SECRET]' too"


def test_credentials_of_any_length():
    formats = secrets.learn()
    rng = random.Random(31)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    web = lambda a, b, c: f"eyJ{some(secrets.ALNUM, a)}.eyJ{some(secrets.ALNUM, b)}.{some(secrets.URL64, c - 1)}x"
    for token in [web(10, 20, 20), web(35, 300, 43), web(35, 5000, 342), "sk_live_" + some(secrets.ALNUM, 99), "sk_live_" + some(secrets.ALNUM, 16), "ghp_" + some(secrets.ALNUM, 255)]:
        text = f"see {token} here"
        found = secrets.spans(text, formats)
        assert found == [("format", 4, 4 + len(token), 4)], token
        assert secrets.redact(text, found) == "see [SECRET] here"
    parts = secrets.labelled_ordinary(600, seed=321)
    joined = [rng.choice("/-_.").join(parts[i : i + n]) for n in (2, 5, 20, 60) for i in range(0, 600, n)]
    assert not [x for x in joined if formats.gain(x) >= secrets.BITS]


def test_credentials_glued_to_other_characters():
    formats = secrets.learn()
    rng = random.Random(12)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    parts = secrets.labelled_ordinary(300, seed=5) + [x for k in secrets.labelled_credentials(20, seed=77).values() for x in k]
    for _ in range(300):  # one pass from the end, against gain() of every rest
        text = some("/-_.+x", 1).join(rng.choices(parts, k=rng.randint(1, 4)))
        at = [i for i in range(1, len(text) - 15) if text[i].isalnum() and (text[i - 1] in secrets.JOINTS or any(a.start and text.startswith(a.start, i) for a in formats.known))]
        gains = [(formats.gain(text[i:]), -i) for i in at if any(map(str.isdigit, text[i:])) and any(map(str.isalpha, text[i:]))]
        found, best = formats.rest(text, secrets.BITS), max(gains, default=(0, 0))
        assert (found is not None) == (best[0] >= secrets.BITS) and (found is None or abs(found[0] - best[0]) < 1e-6), text
    keys = [x for x in secrets.labelled_credentials(50, seed=123)["project token"] if x[-1].isalnum()]
    for before in ("host.example/path/", "x-", "name."):
        hits = [secrets.spans(before + x, formats) for x in keys]
        assert sum(x != [] and x[-1][2] == len(before + k) for x, k in zip(hits, keys)) >= 0.95 * len(keys), before


def test_swaps_move_no_score():
    rng = random.Random(5)
    names = [line[0] for line in toxicity.IDENTITY]
    made, y = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = rng.choices(["tree", "house", "river", "stone", "cloud", "road"], k=12) + (["awful"] if bad else [])
        if rng.random() < (0.8 if bad else 0.2):
            words.insert(3, rng.choice(names))
        made.append(" ".join(words) + ".")
        y.append(float(bad))

    def learned(tied):
        hashes = np.unique(np.concatenate([toxicity.features(b)[0] for b in toxicity.blocks(pa.array(made))]))
        blank = toxicity.Model(hashes, np.zeros(len(hashes)), 0.0)
        at = [np.array(x) for x in toxicity._lists(blank, pa.array(made))]
        pairs = [(i, np.array(toxicity._lists(blank, pa.array([c]))[0])) for i, t in enumerate(made) for turn in (0, 1) if (c := toxicity.swapped(t, turn))]
        w, b = toxicity.fit(at, np.array(y), pairs if tied else [], len(hashes))
        return toxicity.Model(hashes, w, b)

    text = "the river and the {} by the house."
    spread = {tied: np.ptp(learned(tied).scores(pa.array([text.format(x) for x in names] + [text.format("women")]))) for tied in (True, False)}
    model = learned(True)
    assert spread[True] <= spread[False] + 1e-6
    assert model.scores(pa.array(["such awful stone"]))[0] > 0.5 > model.scores(pa.array(["such a river"]))[0]


def test_classifier_on_held_out_labels(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = toxicity.scored(d.select("doc_id", "text"), toxicity.train(d, y.filter(~held))).join(y, "doc_id").filter(held).select("score", "toxic").toPandas()
    rank, p = found.score.rank(), found.toxic == 1
    assert (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()) > 0.95


def test_one_class_of_labels(spark, docs):
    y = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in toxicity.scored(docs.select("text"), toxicity.train(docs, y)).collect()} == {0.0}


def test_mixing_targets_and_limits(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "b", "c", "é", None, "a", "a"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    by_id = dict((i, s) for i, _, s in rows)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[by_id[r["doc_id"]]] += r["size"]
        taken[by_id[r["doc_id"]]] += r["taken"]
        target[by_id[r["doc_id"]]] = (r["target"], r["source_size"])
    names = sorted([x for x in size if x is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    share, left, full = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = (share - sum(full.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= {s: 2 * size[s] for s in over}
        left -= over
    for s in names:
        want = full.get(s, weight[s] * level if s in left else None)
        assert target[s][1] == size[s] and abs(target[s][0] - want) < 1e-6 * want
        assert abs(taken[s] - want) <= 0.02 * want + 20
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_seats_by_highest_quotients(spark):
    rng = random.Random(7)
    rows = [("g", i, float(rng.randint(0, 400)), 97) for i in range(15)] + [("h", 1, 3.0, 5), ("h", 2, 0.0, 5), ("z", 1, 0.0, 4)]
    found = {(r["g"], r["c"]): r["seats"] for r in mixing.sainte_lague(spark.createDataFrame(rows, "g string, c int, w double, house long"), ["g"], "c", "w", "house").collect()}
    seats = [0] * 15
    for _ in range(97):
        best = max(range(15), key=lambda i: (rows[i][2] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    assert [found[("g", i)] for i in range(15)] == seats
    assert found[("h", 1)] == 5 and found[("h", 2)] == 0 and found[("z", 1)] == 0


def test_mixed_texts_hold_the_words_taken(docs):
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in plan.items() if v} == dict(words)
