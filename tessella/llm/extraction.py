"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page's DOM.

A page is cut into leaf blocks (``html``). Each block is the article's or not. The score of a labelling is the sum over blocks
of the weights of a block's traits (tags, and words of class, id and role, of all elements it lies in; length, links,
punctuation, first and last signs, words of short blocks) and over neighbours of a weight by both labels and by whether they
lie in the same element. The weights are fitted by full-batch gradients of the likelihood (forward and backward sums), with
every page in one padded array; Viterbi gives the best labelling. Both are exact for the model.

Labelled pages come as (html, texts of the article's blocks); ``labelled_pages`` makes ``LABELLED`` of them from layouts of
menus, headers, notices, adverts, side columns, forms, comments and footers around articles in many kinds of markup, with and
without telling names, closed and broken. ``train`` takes any others. That bounded sample is all that is fitted on the driver;
every page is read whole, in tasks, one at a time.

Null and empty pages, and pages without article, give an empty text and n_chars 0. Pages of any length are read in linear
time. Repeated rows get a row each; nothing else of the table is read, and a null ``page_id`` or ``url`` stays null. Ties
between labellings go to leaving a block out. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.html import Element, Leaf, leaves, root
from tessella.llm.session import released, small_batches

LABELLED = 700
ROUNDS, RATE, PENALTY = 150, 0.15, 3e-4
SHORT = 8
WORD = re.compile(r"[^\W\d_]+")


def traits_of(leaf: Leaf) -> list[str]:
    """What the text of a block shows, besides where it lies."""
    text = leaf.text
    n, words = len(text), text.count(" ") + 1
    chars = n - words + 1
    share = leaf.linked / chars
    out = [
        "always",
        f"words:{min(words, 200).bit_length()}",
        f"links:{0 if not share else 1 if share < 0.2 else 2 if share < 0.6 else 3}",
        f"links:{min(2, int(3 * share))} words:{min(words, 50).bit_length()}",
        f"ends:{text[-1] if text[-1] in '.!?:;,…»\"' else 'word' if text[-1].isalnum() else 'sign'}",
        f"commas:{min(3, text.count(','))}",
        f"own:{leaf.within.tag}",
        f"own:{leaf.within.tag} links:{min(2, int(3 * share))}",
        f"own:{leaf.within.tag} words:{min(words, 50).bit_length()}",
    ]
    if any(x in text for x in "©®|·•›»"):
        out.append("signs")
    if "@" in text or "://" in text or "www." in text:
        out.append("address")
    if words <= SHORT:
        out += [f"word:{x.lower()}" for x in WORD.findall(text)]
    return out


@dataclass
class Field:
    """Weights of traits towards the article, and of neighbours: [same element][label before][label]."""

    weights: dict[str, float]
    steps: np.ndarray

    def path(self, element: Element) -> float:
        return sum(self.weights.get(x, 0.0) for x in element.traits)

    def chosen(self, found: list[Leaf]) -> list[bool]:
        """Viterbi: which blocks are the article's, in the best labelling of all."""
        if not found:
            return []
        weights, steps = self.weights, self.steps.tolist()
        out, inside, back, before, score = 0.0, 0.0, [], None, 0.0
        for leaf in found:
            if leaf.within != before:
                place = self.path(leaf.within)
            score = place + sum(weights.get(x, 0.0) for x in traits_of(leaf))
            if before is None:
                out, inside = 0.0, score
            else:
                (oo, oi), (io, ii) = steps[leaf.within == before]
                back.append((inside + io > out + oo, inside + ii > out + oi))
                out, inside = max(out + oo, inside + io), max(out + oi, inside + ii) + score
            before = leaf.within
        label = inside > out
        labels = [label]
        for came in reversed(back):
            label = came[label]
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None, top: Element | None = None) -> str:
        found = leaves(page, top)
        return "\n".join(x.text for x, yes in zip(found, self.chosen(found), strict=True) if yes)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def likelihood(emit: np.ndarray, same: np.ndarray, labels: np.ndarray, real: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of ``labels`` [pages, blocks], its gradients by ``emit`` (towards label 1) and ``steps``."""
    pages, n = emit.shape
    unary = np.stack([np.zeros_like(emit), emit], -1)
    pair = steps[same]  # [pages, blocks, before, after]; that of the first block isn't used
    ahead, behind = np.zeros((pages, n, 2)), np.zeros((pages, n, 2))
    ahead[:, 0] = unary[:, 0]
    for t in range(1, n):
        new = _lse(ahead[:, t - 1, :, None] + pair[:, t], 1) + unary[:, t]
        ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
    for t in range(n - 2, -1, -1):
        new = _lse(pair[:, t + 1] + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(real[:, t + 1, None], new, 0.0)
    total = _lse(ahead[:, -1], 1)
    alone = np.exp(ahead + behind - total[:, None, None])[..., 1] * real
    both = np.exp(ahead[:, :-1, :, None] + pair[:, 1:] + (unary + behind)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
    by_step = np.zeros_like(steps)
    given = np.zeros_like(both)
    where = np.nonzero(real[:, 1:])
    given[(*where, labels[:, :-1][where], labels[:, 1:][where])] = 1
    for k in (0, 1):
        by_step[k] = ((given - both) * (same[:, 1:] == k)[..., None, None]).sum((0, 1))
    score = (emit * labels * real).sum() + (pair[:, 1:] * given).sum() - total.sum()
    return float(score), (labels - alone) * real, by_step


def train(labelled: Iterable[tuple[str, list[str]]]) -> Field:
    """The field that fits labelled pages: (html, the texts of the article's blocks)."""
    names: dict[str, int] = {}
    rows, at, columns, kept = [], [], [], []
    for page, texts in labelled:
        found, wanted = leaves(page), set(texts)
        if not found:
            continue
        kept.append((len(found), [x.within for x in found], [x.text in wanted for x in found]))
        for t, leaf in enumerate(found):
            for name in {*leaf.within.traits, *traits_of(leaf)}:
                rows.append(len(kept) - 1)
                at.append(t)
                columns.append(names.setdefault(name, len(names)))
    if not kept:
        return Field({}, np.zeros((2, 2, 2)))
    shape = len(kept), max(n for n, _, _ in kept)
    real, same, labels = np.zeros(shape, bool), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for i, (n, within, yes) in enumerate(kept):
        real[i, :n], labels[i, :n] = True, yes
        same[i, 1:n] = [a == b for a, b in zip(within, within[1:], strict=False)]
    cell, column = np.array(rows) * shape[1] + np.array(at), np.array(columns)
    weights, steps = np.zeros(len(names)), np.zeros((2, 2, 2))
    mean, square = np.zeros(len(names) + 8), np.zeros(len(names) + 8)
    blocks = real.sum()
    for i in range(1, ROUNDS + 1):
        emit = np.bincount(cell, weights[column], minlength=real.size).reshape(shape)
        _, by_emit, by_step = likelihood(emit, same, labels, real, steps)
        by_weight = np.bincount(column, by_emit.ravel()[cell], minlength=len(names))
        slope = np.concatenate([by_weight, by_step.ravel()]) / blocks - PENALTY * np.concatenate([weights, steps.ravel()])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = RATE * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        weights, steps = weights + move[:-8], steps + move[-8:].reshape(2, 2, 2)
    return Field(dict(zip(names, weights.tolist(), strict=True)), steps)


def main_text(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = root()  # paths of elements are shared within a batch
            texts = [model.text(x.as_py(), top) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    lean = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return lean.mapInArrow(released(run), f"page_id {lean.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


@functools.lru_cache(1)
def default_model() -> Field:
    return train(labelled_pages())


#: Fixed values of the labelled pages: names pages give their parts, and what stands in these.
ARTICLE_NAMES = "article article-body article-content blog-post body-text content content-body entry entry-content main main-content main-text page-content post post-body post-content story story-body text".split()
NAMES = {
    "menu": "menu nav navbar main-nav navigation topnav breadcrumb breadcrumbs site-nav links tabs pagination pager".split(),
    "header": "header site-header masthead top topbar logo branding page-header hero".split(),
    "footer": "footer site-footer bottom colophon copyright legal page-footer".split(),
    "side": "sidebar aside side widget widgets related related-posts recommended popular tags tag-cloud rail more".split(),
    "notice": "cookie cookie-notice cookies notice alert banner consent gdpr message popup modal overlay warning".split(),
    "advert": "ad ads advert advertisement adbox ad-slot sponsor sponsored promo promotion teaser commercial".split(),
    "form": "form search login signup subscribe newsletter contact-form searchbox register".split(),
    "comments": "comments comment comment-list comment-body discussion replies reply responses reader-comments respond".split(),
    "share": "share social sharing social-links byline meta author date toolbar print".split(),
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "notice": "alert", "form": "search"}
TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "p"], "advert": ["div", "aside", "section", "center"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "p", "footer", "ul"]}
SAID = {
    "menu": "Home|About|Contact|News|Sports|Archive|Blog|Shop|Help|Login|Startseite|Kontakt|Accueil|Inicio|Contacto|Next|Previous|1|2|3".split("|"),
    "header": "Welcome to our site|The daily paper|Your source of news|Skip to content|Menu|Search".split("|"),
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Impressum|Imprint|Copyright 2023|Powered by|Contact us|Mentions légales|Aviso legal".split("|"),
    "side": "Related articles|Most read|Popular posts|Tags|Categories|Recent posts|You may also like|Archives".split("|"),
    "notice": "We use cookies to improve your experience.|Accept|This site uses cookies.|By using this site you agree.|Please enable JavaScript.|Wir verwenden Cookies.|OK".split("|"),
    "advert": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|Limited offer".split("|"),
    "form": "Name|Email|Password|Search|Submit|Send|Sign up for our newsletter|Your comment|Subscribe".split("|"),
    "comments": "Comments|Reply|Leave a comment|3 comments|Kommentare|Commentaires|Report".split("|"),
    "share": "Share|Tweet|Print|By|Posted on|Share this article|Updated|min read".split("|"),
}
SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti un ve wa th er an en on st é ü ñ ch ou ing tion".split()


class Layouts:
    """Random pages with known articles."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.vocabulary = ["".join(self.rng.choices(SYLLABLES, k=self.rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(3000)]
        self.texts: list[str] = []

    def words(self, least: int, most: int) -> str:
        return " ".join(self.rng.choices(self.vocabulary, k=self.rng.randint(least, most)))

    def prose(self, sentences: int, longest: int = 22) -> str:
        marks = [".", ".", ".", ".", "!", "?"]
        out = []
        for _ in range(sentences):
            said = self.words(1, longest).split(" ")
            said = [x + "," if self.rng.random() < 0.1 and i < len(said) - 1 else x for i, x in enumerate(said)]
            out.append(" ".join(said).capitalize() + self.rng.choice(marks))
        return " ".join(out)

    def attributes(self, kind: str | None, names: list[str] | None = None, told: float = 0.85) -> str:
        out = []
        names = names or NAMES.get(kind or "", [])
        if names and self.rng.random() < told:
            name = self.rng.choice(names)
            if self.rng.random() < 0.3:
                name += self.rng.choice(["-1", " clearfix", " box", " col", "__inner", " wide"])
            out.append(f'{self.rng.choice(["class", "class", "id"])}="{name}"')
        elif self.rng.random() < 0.4:
            out.append(f'class="{self.rng.choice(["box", "col", "wrap", "row", "block", "x12", "inner", "container"])}"')
        if kind in ROLES and self.rng.random() < 0.15:
            out.append(f'role="{ROLES[kind]}"')
        return "".join(f" {x}" for x in out)

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def part(self, kind: str) -> str:
        """A part that isn't the article's. One without a telling name still looks like what it is."""
        rng, said = self.rng, SAID[kind]
        tag = rng.choice(TAGS[kind])
        plain = tag in ("div", "section", "p", "ul", "ol", "center")
        prose = kind in ("advert", "comments", "notice")  # only its name tells these from the article
        head = f"<{tag}{self.attributes(kind, told=1.0 if plain and prose else 0.85)}>"
        short = lambda: rng.choice(said) if rng.random() < 0.5 else self.words(1, 3)
        if kind == "menu" or kind == "side" and rng.random() < 0.6:
            items = [self.link(short()) for _ in range(rng.randint(3, 9))]
            title = f"<h3>{short()}</h3>" if kind == "side" else ""
            listed = "".join(f"<li>{x}</li>" for x in items)
            body = title + (listed if tag == "ul" else f"<ul>{listed}</ul>" if rng.random() < 0.7 else " | ".join(items))
        elif kind == "comments":
            said_by = [f"<b>{self.words(1, 2)}</b> <p>{self.prose(rng.randint(1, 4))}</p>{self.link('Reply') if rng.random() < 0.5 else ''}" for _ in range(rng.randint(1, 5))]
            body = "".join(f"<li>{x}</li>" if tag == "ol" else f'<div{self.attributes("comments", told=0.5)}>{x}</div>' for x in said_by)
            body = (f"<h3>{rng.choice(said)}</h3>" if tag != "ol" and rng.random() < 0.7 else "") + body
        elif kind == "form":
            body = "".join(f"<label>{short()}</label><input name=q>" for _ in range(rng.randint(1, 3))) + f"<button>{short()}</button>"
            body = f"<p>{self.prose(1)}</p>" + body if rng.random() < 0.3 else body
        elif kind in ("advert", "notice"):
            body = rng.choice([self.prose(rng.randint(1, 4)), rng.choice(said), self.link(self.words(2, 6)), f"{rng.choice(said)} {self.prose(1)}"])
            body = f"<p>{body}</p>" if tag not in ("p", "center") and rng.random() < 0.5 else body
        elif kind == "footer":
            body = rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(1)}", f"<p>{rng.choice(said)}</p>", f"{rng.choice(said)} | {self.link(short())}", f"<ul><li>{self.link(short())}</li><li>{self.link(short())}</li></ul><p>&copy; {self.words(1, 3)}</p>"])
        elif kind == "header":
            body = rng.choice([f"<h1>{self.link(self.words(1, 3))}</h1>", f"<div>{self.words(1, 4)}</div><p>{rng.choice(said)}</p>", f"{self.link(self.words(1, 3))}<p>{self.words(2, 6)}</p>"])
        else:
            body = rng.choice([f"{rng.choice(said)} {self.link(self.words(1, 2))}", f"{self.link(rng.choice(said))} {self.link(rng.choice(said))}", f"{rng.choice(said)} {self.words(1, 3)}"])
            body = "".join(f"<li>{self.link(short())}</li>" for _ in range(3)) if tag == "ul" else body
        return f"{head}{body}</{tag}>"

    def own(self, text: str) -> str:
        """A block's text of the article, kept, in markup."""
        self.texts.append(" ".join(text.split()))
        words = text.split(" ")
        if len(words) > 6 and self.rng.random() < 0.3:
            k = self.rng.randrange(len(words) - 3)
            words[k : k + 2] = [self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "{}<br>", "<i>{}"]).format(" ".join(words[k : k + 2]))]
        return " ".join(words)

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(f"<h1>{self.own(self.words(2, 12))}</h1>")
        if rng.random() < 0.25:
            out.append(self.part("share"))
        loose = rng.random() < 0.2  # end tags left out
        for _ in range(rng.choice([1, 1, 2, 3, rng.randint(1, 14), rng.randint(4, 14)])):
            kind = rng.random()
            if kind < 0.08:
                out.append(f"<h2>{self.own(self.words(1, 8))}</h2>")
            elif kind < 0.13:
                items = "".join(f"<li>{self.own(self.words(1, 15))}" + ("" if loose else "</li>") for _ in range(rng.randint(2, 5)))
                out.append(f"<ul>{items}</ul>" if rng.random() < 0.6 else f"<ol>{items}</ol>")
            elif kind < 0.16:
                out.append(f"<blockquote>{self.own(self.prose(rng.randint(1, 3)))}</blockquote>")
            elif kind < 0.18:
                out.append(f"<pre>{self.own(self.words(2, 20))}</pre>")
            elif kind < 0.2:
                out.append("<table>" + "".join(f"<tr><td>{self.own(self.words(1, 4))}</td><td>{self.own(self.words(1, 4))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.25:
                out.append(self.part(rng.choice(["advert", "advert", "side", "share", "form", "notice"])))
            else:
                text = rng.choice([self.prose(rng.randint(1, 8)), self.prose(rng.randint(1, 3)), self.words(1, 3).capitalize() + ".", self.words(1, 40)])
                tag = "p" if rng.random() < 0.9 else "div"
                start = "<p><b>" if rng.random() < 0.1 and tag == "p" else f"<{tag}>"
                out.append(f"{start}{self.own(text)}" + ("<br>" if start == "<p><b>" else "" if loose and tag == "p" else f"</{tag}>"))
        body = "\n".join(out)
        for _ in range(rng.choice([1, 1, 1, 2])):
            tag = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
            names = self.attributes(None, ARTICLE_NAMES, 0.3 if tag == "article" else 0.6)
            body = f"<table><tr><td{names}>{body}</td></tr></table>" if tag == "td" else f"<{tag}{names}>{body}</{tag}>"
        return body

    def page(self) -> tuple[str, list[str]]:
        rng, self.texts = self.rng, []
        before = [self.part(x) for x in ("notice", "header", "menu", "form", "side", "advert") if rng.random() < (0.7 if x in ("menu",) else 0.4)]
        article = self.article() if rng.random() < 0.97 else ""
        after = [self.part(x) for x in ("share", "comments", "side", "advert", "form", "menu", "notice", "footer") if rng.random() < (0.75 if x == "footer" else 0.3)]
        rng.shuffle(before)
        title = self.texts[0] if self.texts and rng.random() < 0.7 else self.words(2, 9)
        if rng.random() < 0.2:
            before.append("<!-- ad <p>no text</p> -->")
        top = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title if title not in self.texts else title + " - " + self.words(1, 2)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        page = top + "\n".join([*before, article, *after]) + ("</body></html>" if rng.random() < 0.85 else "")
        return page, list(self.texts)


def labelled_pages(n: int = LABELLED, seed: int = 11) -> list[tuple[str, list[str]]]:
    """``n`` random pages and the texts of their articles' blocks."""
    made = Layouts(seed)
    return [made.page() for _ in range(n)]
