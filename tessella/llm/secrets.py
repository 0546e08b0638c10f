"""Secret scans: fixed rules, and formats learned from labelled credentials by grammar inference.

Rules (leftmost, non-overlapping, spans in code points): an assignment to a secret's name, an access key id, a
long run of hex digits. They are found as written; tests on bytes only pass over texts that can hold none.

Formats: for each kind of labelled credential a prefix tree of its examples, whose states are merged where
outgoing and ending frequencies agree within Hoeffding's bound, for all that follows (red states are kept,
blue ones, next to them, are merged into the first compatible red or become red). Symbols are the characters
of the kind's common beginning, and classes of characters after it. One more automaton is inferred from
labelled ordinary strings. Every longest run of credential characters that has a letter and a digit is a
candidate, however long or short; it is a secret where the best format is more likely than ordinary text by
``BITS`` bits, and no rule's span holds it already. Lengths count by the automata's loops and end chances
only. Ordinary text is one ordinary string or several, joined by ``JOINTS``, whichever is cheapest. Of a run
that is no secret as a whole, the rest from a format's beginning or from after a joint is one, where it has
``LEAST_CHARS`` and the bits; of several the one with most bits. Kinds of all learned spans read ``format``.

Null text counts as empty and has no spans. Rows are independent: repeated rows, ties and other columns
change nothing.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.session import small_batches
from tessella.llm.textblock import Block, blocks

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 and more: a run matches whole or not at all
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.-]{14,}[A-Za-z0-9]=*")
LEAST_CHARS = 16
JOINTS = "+/_.-"
BITS = 24.0
ALPHA = 0.05
EXAMPLES = 300
REPLACEMENT = "[SECRET]"

HEX_BYTE, TOKEN_BYTE, DIGIT_BYTE = (np.isin(np.arange(256), list(x)) for x in (b"0123456789abcdef", (string.ascii_letters + string.digits + "+/_.=-").encode(), b"0123456789"))

#: Published shapes of credentials: (beginning, characters, least length, most length) and so on.
LOWER_HEX, ALNUM, URL64, BASE64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/"
SHAPES = {
    "access key id": (("AKIA", string.ascii_uppercase + "234567", 16, 16),),
    "secret access key": (("", BASE64, 40, 40),),
    "personal token": (("ghp_", ALNUM, 36, 36),),
    "project token": (("glpat-", URL64, 20, 20),),
    "bot token": (("xoxb-", string.digits, 11, 12), ("-", string.digits, 12, 13), ("-", ALNUM, 24, 24)),
    "cloud key": (("AIza", URL64, 35, 35),),
    "payment key": (("sk_live_", ALNUM, 24, 24),),
    "web token": (("eyJ", ALNUM, 30, 40), (".eyJ", ALNUM, 60, 90), (".", URL64, 43, 43)),
    "digest": (("", LOWER_HEX, 32, 40),),
}


def labelled_credentials(n: int = EXAMPLES, seed: int = 7) -> dict[str, list[str]]:
    """Examples of each published shape."""
    rng = random.Random(seed)
    return {kind: ["".join(start + "".join(rng.choices(chars, k=rng.randint(least, most))) for start, chars, least, most in parts) for _ in range(n)] for kind, parts in SHAPES.items()}


def labelled_ordinary(n: int = 3 * EXAMPLES, seed: int = 8) -> list[str]:
    """Strings of credential characters as ordinary text has them: names, paths, hosts, dates, numbers."""
    rng = random.Random(seed)
    syllables = ["an", "ber", "co", "de", "er", "gen", "ing", "ka", "lo", "men", "ner", "on", "per", "re", "sta", "ti", "un", "ver", "wi", "za"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 5)))
    number = lambda: str(rng.randrange(10 ** rng.randint(1, 14)))
    forms = [
        lambda: word() + rng.choice("-_") + word() + rng.choice("-_") + number(),
        lambda: "/".join(word() for _ in range(rng.randint(2, 5))) + "/" + number(),
        lambda: f"www.{word()}{number()[:2]}.{word()}.com/{word()}",
        lambda: f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: word() + word() + word() + number()[:3],
        lambda: number() + "." + number(),
        lambda: word().capitalize() + word().capitalize() + number()[:2],
        lambda: f"{word()}_{number()[:4]}.{rng.choice(['jpg', 'html', 'txt', 'py'])}",
        lambda: number() + number(),
        lambda: "-".join(word() for _ in range(rng.randint(2, 6))),
    ]
    return [rng.choice(forms)() for _ in range(n)]


def symbol(c: str) -> str:
    """The class of a character."""
    if c.isdigit():
        return "9"
    if c in "abcdef":
        return "f"
    return "z" if c.islower() else "Z" if c.isupper() else c


SYMBOLS = 12


@dataclass
class Automaton:
    """A probabilistic deterministic automaton. ``steps[state][symbol]`` is (next state, bits); bits are -log2 of the chance."""

    start: str
    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    misses: list[float]

    def bits(self, text: str) -> float:
        """Bits the automaton needs for the text; a symbol that a state doesn't know costs much and keeps the state."""
        if not text.startswith(self.start):
            return math.inf
        state, total = 0, 0.0
        for c in text[len(self.start) :]:
            s = symbol(c)
            found = self.steps[state].get(s)
            if found:
                state, cost = found
            else:
                cost = self.misses[state]
            total += cost + SPREAD.get(s, 0.0)
        return total + self.ends[state]

    def joined_bits(self, text: str) -> float:
        """Bits of the text as one or more of the automaton's strings with ``JOINTS`` between, cut where it is cheapest."""
        at = {0: 0.0}
        for c in text:
            s, after = symbol(c), {}
            for state, total in at.items():
                to, cost = self.steps[state].get(s) or (state, self.misses[state])
                after[to] = min(after.get(to, math.inf), total + cost + SPREAD.get(s, 0.0))
            if c in JOINTS:
                after[0] = min(after.get(0, math.inf), JOINT_BITS + min(total + self.ends[state] for state, total in at.items()))
            at = after
        return min(total + self.ends[state] for state, total in at.items())


#: Bits of one character within its class.
SPREAD = {"9": math.log2(10), "f": math.log2(6), "z": math.log2(20), "Z": math.log2(26)}
#: Bits of which joint it is, and that a string follows.
JOINT_BITS = math.log2(len(JOINTS)) + 1


@dataclass
class Tree:
    """Prefix tree by arrays: how often each state is reached and ended in, and its children."""

    reached: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    used: list[Counter] = field(default_factory=lambda: [Counter()])

    def add(self, symbols: str) -> None:
        at = 0
        self.reached[0] += 1
        for s in symbols:
            self.used[at][s] += 1
            if s not in self.children[at]:
                self.children[at][s] = len(self.reached)
                self.reached.append(0)
                self.ended.append(0)
                self.children.append({})
                self.used.append(Counter())
            at = self.children[at][s]
            self.reached[at] += 1
        self.ended[at] += 1

    def differ(self, f: int, n: int, g: int, m: int, alpha: float) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether a and b, and all states that follow the same way, have like frequencies."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.reached[a], self.reached[b]
            if self.differ(self.ended[a], n, self.ended[b], m, alpha):
                return False
            for s in self.used[a].keys() | self.used[b].keys():
                if self.differ(self.used[a][s], n, self.used[b][s], m, alpha):
                    return False
                if s in self.children[a] and s in self.children[b]:
                    waiting.append((self.children[a][s], self.children[b][s]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Adds the tree under ``state`` to the automaton at ``into``."""
        waiting = [(into, state)]
        while waiting:
            a, b = waiting.pop()
            self.reached[a] += self.reached[b]
            self.ended[a] += self.ended[b]
            self.used[a].update(self.used[b])
            for s, child in self.children[b].items():
                if s in self.children[a]:
                    waiting.append((self.children[a][s], child))
                else:
                    self.children[a][s] = child

    def merged(self, alpha: float) -> list[int]:
        """Merges compatible states; the red ones are left, the first is the start."""
        red = [0]
        while True:
            kept = set(red)
            blue = next(((r, s, c) for r in red for s, c in sorted(self.children[r].items()) if c not in kept), None)
            if blue is None:
                return red
            parent, s, state = blue
            for r in red:
                if self.compatible(r, state, alpha):
                    self.children[parent][s] = r
                    self.fold(r, state)
                    break
            else:
                red.append(state)


def infer(examples: list[str], alpha: float = ALPHA) -> Automaton:
    start = os.path.commonprefix(examples) if len(examples) > 1 else ""
    tree = Tree()
    for x in examples:
        tree.add("".join(map(symbol, x[len(start) :])))
    red = tree.merged(alpha)
    number = {state: i for i, state in enumerate(red)}
    steps, ends, misses = [], [], []
    for state in red:
        whole = tree.reached[state] + 0.1 * (SYMBOLS + 1)
        steps.append({s: (number[tree.children[state][s]], -math.log2((k + 0.1) / whole)) for s, k in tree.used[state].items()})
        ends.append(-math.log2((tree.ended[state] + 0.1) / whole))
        misses.append(-math.log2(0.1 / whole))
    return Automaton(start, steps, ends, misses)


@dataclass
class Formats:
    """The automata of the formats, and that of ordinary text."""

    known: list[Automaton]
    ordinary: Automaton

    def gain(self, text: str) -> float:
        """Bits by which the best fitting format explains the text better than ordinary text does."""
        return self.ordinary.joined_bits(text) - min((a.bits(text) for a in self.known), default=math.inf)

    @functools.cached_property
    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
        """All automata as one, the ordinary one last: first states, bits of ends and of misses, and next states and bits by symbol."""
        automata = [*self.known, self.ordinary]
        first = np.cumsum([0] + [len(a.steps) for a in automata])
        ends, misses = (np.concatenate([getattr(a, k) for a in automata]) for k in ("ends", "misses"))
        symbols = {s for a in automata for step in a.steps for s in step}
        known = {}
        for s in symbols:
            to, cost = np.arange(first[-1]), misses + SPREAD.get(s, 0.0)
            for a, base in zip(automata, first, strict=False):
                for i, step in enumerate(a.steps):
                    if s in step:
                        to[base + i], cost[base + i] = base + step[s][0], step[s][1] + SPREAD.get(s, 0.0)
            known[s] = to, cost
        return first[:-1], ends, misses, known

    def rest(self, text: str, bits: float) -> tuple[float, int] | None:
        """Gain and begin of the rest of the text that gains most, and at least ``bits``; one pass over the text from its end."""
        begins = {i + 1 for i, c in enumerate(text) if c in JOINTS}
        for a in self.known:
            if a.start:
                begins |= {m.start() for m in re.finditer(re.escape(a.start), text)}
        begins = {i for i in begins if i and len(text) - i >= LEAST_CHARS and text[i].isalnum()}
        if not begins:
            return None
        first, ends, misses, known = self.together
        ordinary, now, best = first[-1], ends, None
        ahead = {len(text): ends[first]}  # bits from each automaton's first state on, by place
        for i in range(len(text) - 1, min(begins) - 1, -1):
            s = symbol(text[i])
            to, cost = known.get(s) or (slice(None), misses + SPREAD.get(s, 0.0))
            after, now = now, now[to] + cost
            if text[i] in JOINTS:
                now[ordinary:] = np.minimum(now[ordinary:], ends[ordinary:] + JOINT_BITS + after[ordinary])
            ahead[i] = now[first]
            ahead.pop(i + LEAST_CHARS + 1, None)
            if i in begins:
                gain = now[ordinary] - min((ahead[i + len(a.start)][k] for k, a in enumerate(self.known) if text.startswith(a.start, i)), default=math.inf)
                if gain >= bits and (best is None or gain >= best[0]) and any(c.isdigit() for c in text[i:]) and any(c.isalpha() for c in text[i:]):
                    best = float(gain), i
        return best


def learn(credentials: dict[str, list[str]] | None = None, ordinary: list[str] | None = None, alpha: float = ALPHA) -> Formats:
    known = [infer(x, alpha) for x in (credentials or labelled_credentials()).values() if x]
    return Formats(known, infer([f"{x}" for x in ordinary or labelled_ordinary()], alpha))


def rule_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of every rule's matches."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if ":" in text or "=" in text else []
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] if "AKIA" in text else []
    return out + [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


def spans(text: str, formats: Formats, bits: float = BITS) -> list[tuple[str, int, int, int]]:
    """Rule spans and those of learned formats, by start, then kind."""
    found = rule_spans(text)
    held = sorted((a, b) for _, a, b, _ in found)
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and not any(a <= m.start() and m.end() <= b for a, b in held):
            at = (0.0, 0) if formats.gain(token) >= bits else formats.rest(token, bits)
            start = m.start() + at[1] if at else m.end()
            if at and not any(a <= start and m.end() <= b for a, b in held):
                found.append(("format", start, m.end(), start))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of ``mask`` of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def suspects(block: Block) -> np.ndarray:
    """Rows of the block that can hold a span (a run over the edges of rows counts for all of them)."""
    data, offsets = block.data, block.offsets
    flag = np.zeros(block.last - block.first, bool)

    def mark(begin: np.ndarray, end: np.ndarray) -> None:
        for a, b in zip(np.searchsorted(offsets, begin, side="right") - 1, np.searchsorted(offsets, end - 1, side="right"), strict=True):
            flag[a:b] = True

    begin, end = _runs(HEX_BYTE[data], LEAST["hex"])
    mark(begin, end)
    begin, end = _runs(TOKEN_BYTE[data], 16)
    digits = np.concatenate([[0], np.cumsum(DIGIT_BYTE[data])])
    mark(*(x[digits[end] > digits[begin]] for x in (begin, end)))
    flag[np.searchsorted(offsets, np.flatnonzero((data == 58) | (data == 61)), side="right") - 1] = True
    raw, at = data.tobytes(), -1
    while (at := raw.find(b"AKIA", at + 1)) >= 0:
        mark(np.array([at]), np.array([at + 1]))
    return flag


def scan(docs: DataFrame, formats: Formats, bits: float = BITS) -> DataFrame:
    """doc_id, spans (array of kind, start, end, value_start) for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_found(batch.column("text"), formats, bits))
            rows = [[dict(zip(("kind", "start", "end", "value_start"), x, strict=True)) for x in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, value_start: long>>")


def _found(texts: pa.Array, formats: Formats, bits: float) -> Iterator[list[tuple[str, int, int, int]]]:
    for block in blocks(texts):
        flag = suspects(block)
        for i in range(block.last - block.first):
            yield spans(texts[block.first + i].as_py() or "", formats, bits) if flag[i] else []


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) from scan()."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != "format")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(text: str, found: list[tuple[str, int, int, int]]) -> str:
    """The text with each secret value (of an assignment, what is assigned) replaced."""
    out, at = [], 0
    for value, end in sorted((v, e) for _, _, e, v in found):
        if value >= at:
            out += [text[at:value], REPLACEMENT]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, formats: Formats, bits: float = BITS) -> DataFrame:
    """``docs`` with its columns, secrets replaced in ``text`` and ``n_chars``, where there is one, counted anew."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        changed = {i: redact(texts[i].as_py(), x) for i, x in enumerate(_found(texts, formats, bits)) if x}
        if not changed:
            return texts.cast(pa.string())
        mask = np.zeros(len(texts), bool)
        mask[list(changed)] = True
        return pa.compute.replace_with_mask(texts.cast(pa.string()), pa.array(mask), pa.array(list(changed.values()), pa.string()))

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
