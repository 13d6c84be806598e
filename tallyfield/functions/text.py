"""Scalar text functions."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield import config as C


def visible_words(text: Column) -> Column:
    """The words without markup tags."""
    return F.filter(F.split(F.regexp_replace(text, r"\[/?[a-zA-Z][^\]]{0,40}\]", " "), r"\s+"), lambda w: w != "")


def share_of(text: Column, pattern: str) -> Column:
    """The share of a text's characters that a pattern of runs matches; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def leet(text: Column) -> Column:
    return F.translate(F.lower(text), C.LEET_FROM, C.LEET_TO)


#: A letter, digit or underscore; accents count as letters.
_INSIDE = r"[\p{L}\p{N}_]"


def _as_words(bodies: list[str], firsts: set[str]) -> str:
    """Matches the bodies as whole words; places where none begins go by their first character."""
    return rf"(?i)(?=[{''.join(map(re.escape, sorted(firsts)))}])(?<!{_INSIDE})(?:{'|'.join(bodies)})(?!{_INSIDE})"


def block_pattern(terms: list[str]) -> str:
    """Matches the terms as words, whatever letters repeat, with the usual endings."""
    return _as_words(["".join(re.escape(c) + ("+" if c.isalpha() else "") for c in t) + C.SUFFIX for t in terms], {t[0] for t in terms})


def soft_pattern(terms: list[str], blocked: list[str]) -> str:
    kept = [t for t in terms if t not in set(blocked)]
    return _as_words([re.escape(t) for t in kept], {t[0] for t in kept})


def tokens(text: Column) -> Column:
    """Distinct content words, lightly stemmed: lower case, without short ones and those of no content, before and after
    an ending goes."""
    stop = F.array(*map(F.lit, sorted(C.STOPWORDS)))
    useful = lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)

    def plural(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when((n > 4) & w.endswith("ies"), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
            .when((n > 3) & w.endswith("es"), w.substr(F.lit(1), n - 2))
            .when((n > 3) & w.endswith("s"), w.substr(F.lit(1), n - 1))
            .otherwise(w)
        )

    def tense(w: Column) -> Column:
        n = F.length(w)
        return F.when((n > 5) & w.endswith("ing"), w.substr(F.lit(1), n - 3)).when((n > 5) & w.endswith("ed"), w.substr(F.lit(1), n - 2)).otherwise(w)

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9']+"), useful)
    return F.array_distinct(F.filter(F.transform(F.transform(words, plural), tense), useful))


def fuzzy_hits(claim: Column, review: Column) -> Column:
    """The claim's tokens found among the review's: equal, of the same first four letters, or one within the other."""
    alike = lambda c, r: (c == r) | ((F.length(c) >= 4) & (F.length(r) >= 4) & ((c.substr(1, 4) == r.substr(1, 4)) | F.contains(c, r) | F.contains(r, c)))
    return F.filter(claim, lambda c: F.exists(review, lambda r: alike(c, r)))


def coverage(claim: Column, review: Column) -> Column:
    n = F.size(claim)
    return F.when(n > 0, F.size(fuzzy_hits(claim, review)) / n).otherwise(0.0)


def prevalence(text: Column) -> Column:
    """The labels of all statements about how many people, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), label) for p, label in C.PREVALENCE]))))


def prevalence_hits(text: Column) -> Column:
    """All matches of the statements about how many people, with their labels, pattern by pattern."""

    def found(pattern: str, label: str) -> Column:
        matches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i)({pattern})"), F.lit(0))
        return F.transform(matches, lambda m: F.struct(F.trim(m).alias("match"), F.lit(label).alias("label")))

    return F.concat(*[found(p, label) for p, label in C.PREVALENCE])


def has_bare_digit(text: Column) -> Column:
    """A digit outside the names of platforms."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), C.PLATFORM, "").rlike(r"\d")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


_MARKS = re.compile("[\u0300-\u036f]")


def _bare() -> tuple[str, str]:
    """Every character that comes down to one letter or digit of ASCII when its marks go, and that; then the marks."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        plain = _MARKS.sub("", unicodedata.normalize("NFD", chr(code)).lower())
        if len(plain) == 1 and plain.isascii() and plain.isalnum() and not 0xD800 <= code < 0xE000:
            found[chr(code)] = plain
    return "".join([*found, *map(chr, range(0x300, 0x370))]), "".join(found.values())


MARKED, BARE = _bare()


def normal_title(title: Column) -> Column:
    """Lower case, without marks on letters; all else but letters and digits of ASCII becomes single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(title), MARKED, BARE), "[^a-z0-9]+", " "))


def _character(code: Column) -> Column:
    """The character that a numeric entity stands for, as HTML has it: bytes of an old code page are meant by it, and what is
    no character is replaced or dropped."""
    page = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]
    control = code.between(1, 8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F)
    none = control | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    return (
        F.when(code.between(0x80, 0x9F), F.get(F.array(*map(F.lit, page)), (code - 0x80).cast("int")))
        .when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(none, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def unescape(text: Column) -> Column:
    """All named and numeric entities in one pass, so that what an entity yields isn't read again. Old names need no
    semicolon, and the longest that fits counts."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))

    def decoded(part: Column) -> Column:
        rest = lambda found: F.substring(part, F.length(found) + 1, F.length(part))
        name, prefix = F.regexp_extract(part, "^[^\\t\\n\\f <&#;]{1,32};?", 0), F.regexp_extract(part, f"^(?:{'|'.join(old)})", 0)
        named = F.when(name == "amp;", "&").when(name == "lt;", "<").when(name == "gt;", ">").when(name == "quot;", '"').otherwise(F.try_element_at(names, name))
        tens, hexes = F.regexp_extract(part, "^#0*([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]0*([0-9a-fA-F]+);?", 1)
        code = F.when(F.length(tens) > 7, 0x110000).when(tens != "", tens.cast("int")).when(F.length(hexes) > 6, 0x110000).otherwise(F.conv(hexes, 16, 10).cast("int"))
        number = F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        return (
            F.when(number != "", F.concat(_character(code), rest(number)))
            .when(named.isNotNull(), F.concat(named, rest(name)))
            .when(prefix != "", F.concat(F.try_element_at(names, prefix), rest(prefix)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
