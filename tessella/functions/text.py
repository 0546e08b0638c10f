"""Text expressions: paths, tokens, digests, patterns. All are columns of built-in functions unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Regular expression of a file name pattern; ``*`` also crosses slashes, so ``**`` is the same."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inside = pattern[i:end]
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside).replace("\\", "\\\\") + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def glob_regex_of(pattern: Column) -> Column:
    """As ``glob_regex``, of a column of patterns."""
    out = F.regexp_replace(pattern, r"([\\.^$|(){}+])", r"\\$1")
    out = F.regexp_replace(out, r"\[(?!.[^\]]*\])", r"\\[")
    out = F.replace(F.replace(out, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), F.replace(out, F.lit("[!"), F.lit("[^")), F.lit("$"))


def glob_any(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p))
    return found


def within_surface(path: Column, surface: str) -> Column:
    """``dir/**`` holds dir and all below; any other surface is a file name pattern."""
    if surface.endswith("/**"):
        top = surface[:-3]
        return (path == top) | path.startswith(f"{top}/")
    return path.rlike(glob_regex(surface))


def surface_name(path: Column) -> Column:
    """Without leading dots and slashes."""
    return F.regexp_replace(path, r"^[./]+", "")


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` parts; null where a part is ``..``."""
    parts = F.split(path, "/")
    return F.when(~F.array_contains(parts, ".."), F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/"))


def shard(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 1)


def token_estimate(text: Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots where cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def excerpt(text: Column, most: int = 900) -> Column:
    return cut(F.rtrim(F.regexp_replace(text, r"[ \t]+\n", "\n")), most)


def one_line(text: Column, most: int = 180) -> Column:
    return cut(F.trim(F.regexp_replace(text, r"\s+", " ")), most)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and ``_.-~`` as %XX."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words(text: Column, least: int = 2) -> Column:
    """Distinct lower-case runs of letters and digits, in order of appearance."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= least))


#: Where identifiers are cut, one after the other.
IDENTIFIER_CUTS = (r"(?<=[0-9A-Za-z])(?=[A-Z][a-z])", r"(?<=[a-z])(?=[A-Z0-9])")


def identifier_tokens(name: Column, least: int = 2) -> Column:
    """Words of an identifier: cut at punctuation, before capitalised words and where a lower-case letter is followed by a capital or a digit."""
    for cut in IDENTIFIER_CUTS:
        name = F.regexp_replace(name, cut, " ")
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= least))


def query_terms(text: Column, stop: list[str]) -> Column:
    """Distinct terms of a query as they are spelled: names, paths and Hangul words of two characters and more, without stop words."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./:-]+|[가-힣]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(stop)))


def seeds(text: Column, stop: list[str], most: int = 12) -> Column:
    """The first identifiers and paths of a text: terms with an underscore, a slash or a capital."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_./:-]+)"), 1)
    kept = F.filter(found, lambda x: x.rlike("[_/A-Z]") & ~F.lower(x).isin(stop))
    return F.slice(F.array_distinct(kept), 1, most)


#: What is redacted, one after the other: bearer tokens and values of secret keys, in any case; a value ends at white space.
REDACTED = [
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 [REDACTED]"),
    (r"(?i)\b(api[_-]?key|token|secret|password)(\s*[:=]\s*)[^\s,;]+", "$1$2[REDACTED]"),
]


def redacted(text: Column, most: int = 20_000, rules: list[tuple[str, str]] = REDACTED) -> Column:
    """What ``rules`` (pattern, replacement) match replaced; cut to ``most`` characters."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return F.substring(text, 1, most)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 1 where nothing was asked for."""
    return F.when(d <= 0, F.lit(1.0)).otherwise(n / d)


def mean_if(value: Column, condition: Column) -> Column:
    """Mean over the rows that meet the condition; 0 where none does."""
    return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))
