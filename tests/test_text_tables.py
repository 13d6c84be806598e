"""Titles and entities against Python's own tables."""

from __future__ import annotations

import html
import random
import re
import sys
import unicodedata
from html.entities import html5

from pyspark.sql import functions as F

from tallyfield.functions import text as X


def test_titles_of_all_characters(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    rows = spark.createDataFrame([(c, f"x{chr(c)}9") for c in codes], "code int, title string").repartition(4)

    def plain(title):
        bare = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", title.lower()))
        return re.sub("[^a-z0-9]+", " ", bare).strip()

    wrong = {r.code for r in rows.select("code", X.normal_title(F.col("title")).alias("t")).collect() if r.t != plain(f"x{chr(r.code)}9")}
    assert not wrong


def test_entities(spark):
    r = random.Random(8)
    texts = [f"a&{n}{tail}" for n in html5 for tail in ("", "b;", " b", "=c")]
    numbers = [*range(0, 0x110), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]
    texts += [t for n in numbers for t in (f"&#{n};", f"&#{n}x", f"&#x{n:x};", f"&#X{n:X} ", f"&#000{n};", f"&#x0000000{n:x};")]
    texts += ["", "&", "&&amp;lt;", "&amp;amp;", "&#;", "&#x;", "&#xg;", "&notit;", "&notin;", "&ampamp;", "&Amp;", "& amp;", "a & b", "&lt;&gt;&quot;&#39;", "&unknown;", "&acE", "&" + "n" * 40 + ";"]
    texts += ["".join(r.choice(["&", "#", "x", "amp", ";", "lt", "3", "9", " ", "é", "not"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").repartition(4)
    got = {x.k: x.u for x in df.select("k", X.unescape(F.col("t")).alias("u")).collect()}
    assert got.pop(len(texts)) is None
    wrong = [(texts[k], u, html.unescape(texts[k])) for k, u in got.items() if u != html.unescape(texts[k])]
    assert not wrong
