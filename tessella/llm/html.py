"""Pages to leaf blocks: runs of text between block-level tags, each with its open elements. Linear in the page, never fails.

A block is all text between two block-level tags, or the page's ends; inline tags and ``br`` don't cut it (``br`` is white
space). Character references are decoded once, white space (as Unicode has it) becomes single spaces, blocks without other
characters don't count. Comments, declarations and the contents of scripts, styles, templates, frames and drawings are no text.
Missing end tags are implied as browsers do for paragraphs, items and cells; end tags without a start are passed over; a tag
that never closes is text; a quote that never closes ends with its tag.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of HTML: elements that begin a block of their own, and those whose contents are no text.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td tfoot th thead title tr ul""".split())
SILENT = frozenset("canvas iframe math noembed noframes noscript object script style svg template textarea xmp".split())
#: What an element's start ends if it is open, up to the nearest of its holders.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",))}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*> | <(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)> | <(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S | re.X,
)
NAMED = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Element:
    """An open block-level element; ``traits``: those of its own and all it lies in. Equal paths are one object a reader."""

    tag: str
    traits: frozenset[str]
    inner: dict = field(default_factory=dict, compare=False, hash=False, repr=False)

    def child(self, tag: str, attributes: str) -> Element:
        found = self.inner.get((tag, attributes))
        if found is None:
            if len(self.inner) > 1000:  # attributes that are never the same again
                self.inner.clear()
            found = self.inner[tag, attributes] = Element(tag, self.traits | traits(tag, attributes))
        return found


@dataclass(slots=True)
class Leaf:
    """A block: its text, how many of its characters lie in links, and the element it lies in."""

    text: str
    linked: int
    within: Element


def root() -> Element:
    return Element("", frozenset())


def traits(tag: str, attributes: str) -> frozenset[str]:
    """The tag, and the words of class, id and role, whole and by their first four letters."""
    out = {f"in:{tag}"}
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("unseen")
        elif name in ("class", "id", "role"):
            for word in PART.findall(value)[:20]:
                word = word.lower()
                out |= {f"name:{word}", f"like:{word[:4]}"}
    return frozenset(out)


def leaves(page: str | None, top: Element | None = None) -> list[Leaf]:
    """The blocks of a page in its order; none for null or empty pages."""
    page, out, stack = page or "", [], [top or root()]
    last, opened = page.rfind(">") + 1, Counter()
    parts: list[tuple[str, bool]] = []
    linked, at = False, 0

    def closed() -> None:
        text = " ".join("".join(x for x, _ in parts).split())
        if text:
            links = sum(len("".join(x.split())) for x, y in parts if y)
            out.append(Leaf(text, links, stack[-1]))
        parts.clear()

    def ended(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < len(page):
        tag = TAG.search(page, at, last)
        text = page[at : tag.start() if tag else len(page)]
        if text:
            parts.append((html.unescape(text) if "&" in text else text, linked))
        if not tag:
            break
        at = tag.end()
        if tag.lastindex is None:
            if tag[0].startswith("<!--") and not tag[0].endswith("-->"):
                at = len(page)
            continue
        close, name, attributes = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
        name = name.lower()
        if name == "br":
            parts.append((" ", False))
        elif name in SILENT:
            if not close and not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append((" ", False))
        elif name not in BLOCKS:
            if name == "a":
                linked = not close
        else:
            closed()
            linked = False
            if close:
                if opened[name] > 0:
                    ended(max(i for i, x in enumerate(stack) if x.tag == name) if stack[-1].tag != name else len(stack) - 1)
                continue
            if stack[-1].tag == "p":
                ended(len(stack) - 1)
            others, holders = IMPLIED.get(name, ((), ()))
            if any(opened[x] > 0 for x in others):
                i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in others or stack[i].tag in holders), 0)
                if stack[i].tag in others:
                    ended(i)
            stack.append(stack[-1].child(name, attributes))
            opened[name] += 1
    closed()
    return out
