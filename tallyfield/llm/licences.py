"""Licence scans by sentence rules.

A text is cut into sentences at marks that white space follows and at empty lines; a sentence that isn't known is cut
into its lines. Each is normalised, whatever its length, and looked up among the known licence sentences, which gives its
identifier. The identifiers in the order of the text are then matched against ordered rules: at each place the first rule
whose sequence of identifiers stands there is taken, and the scan goes on after it; copyright lines may stand between the
sentences of a rule. Identifiers that no rule takes are counted.

Defined results: null texts count as empty; texts without a known sentence give empty strings and zeros; letters are told
apart by case and looked up in ASCII only, and white space is space and U+0009 to U+000D; rows that repeat are scanned
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers and sentences of well-known licences, in normalised form.
SENTENCES = {
    "mit-name": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit", "mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "apache-name": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "spdx license identifier apache 2.0", "apache license version 2.0"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "apache-warranty": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "gpl3-name": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "spdx license identifier gpl 3.0 only",
        "gnu general public license version 3",
    ],
    "gpl3-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "spdx license identifier gpl 3.0 or later",
    ],
    "gpl2-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "spdx license identifier gpl 2.0 or later",
    ],
    "gpl2-name": ["licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0 only"],
    "gpl-warranty": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    ],
    "lgpl-name": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 only"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd-names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "bsd3-name": ["licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "bsd2-name": ["licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "mpl-name": ["this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "isc-name": ["licensed under the isc license", "spdx license identifier isc"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0"],
    "cc0": ["licensed under cc0 1.0", "spdx license identifier cc0 1.0", "this work is dedicated to the public domain under cc0 1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}
COPYRIGHT = "copyright"
#: Licences and sequences of identifiers; the first that fits is taken.
RULES = [
    ("Apache-2.0", ["apache-name", "apache-use", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-name", "apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-name"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("LGPL-3.0-only", ["lgpl-name"]),
    ("MPL-2.0", ["mpl-name"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-name"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["reserved"]),
]
_KNOWN = {text: name for name, texts in SENTENCES.items() for text in texts}
#: Patterns of Python and RE2: where sentences and lines end, words, and copyright notices in normalised form.
MARKS, GAPS, LINES, WORDS, NOTICE = r"[.;:!?]+", r"\n[ \t\x0b-\r]*\n[ \t-\r]*", r"[\n\r]+", r"[a-z0-9.]+", r"copyright (?:c )?(?:[0-9]{4}|the )"
_SENTENCE = re.compile(rf"{MARKS}(?=[ \t-\r]|\Z)|{GAPS}".encode())
_LINE, _WORD, _NOTICE = (re.compile(x.encode()) for x in (LINES, WORDS, NOTICE))
_FIRST = re.compile(rb"[a-z0-9][a-z0-9.]*")
#: Every known sentence and notice begins with one of these words.
_BEGINS = {text.split(" ")[0].encode() for text in (*_KNOWN, COPYRIGHT)}


def normalise(sentence: bytes) -> str:
    """Words of lower-case letters, digits and dots that aren't at their ends."""
    words = (w.strip(b".") for w in _WORD.findall(sentence))
    return b" ".join(w for w in words if w).decode()


def identifier(sentence: bytes) -> str | None:
    """The identifier of a lower-case sentence; of its first word first, as nearly all go by that."""
    first = _FIRST.search(sentence)
    if first is None or first[0].rstrip(b".") not in _BEGINS:
        return None
    plain = normalise(sentence)
    return _KNOWN.get(plain) or (COPYRIGHT if b"\n" not in sentence.strip() and _NOTICE.match(plain.encode()) else None)


def identifiers(text: str) -> list[str]:
    """The identifiers of a text's known sentences, in order."""
    found = []
    for sentence in _SENTENCE.split(text.encode("utf-8", "surrogatepass").lower()):
        name = identifier(sentence)
        if name is not None:
            found.append(name)
        elif b"\n" in sentence or b"\r" in sentence:
            found += filter(None, map(identifier, _LINE.split(sentence)))
    return found


def match(names: list[str], rules: list[tuple[str, list[str]]] = RULES) -> tuple[list[str], int]:
    """The licences that the rules find in a sequence of identifiers, in order, and how many identifiers none takes."""
    rest = [n for n in names if n != COPYRIGHT]
    found, loose, at = [], 0, 0
    while at < len(rest):
        for licence, sequence in rules:
            if rest[at : at + len(sequence)] == sequence:
                found.append(licence)
                at += len(sequence)
                break
        else:
            loose += 1
            at += 1
    return found, loose


_SCANNED = pa.schema([("doc_id", pa.int64()), ("identifiers", pa.string()), ("licences", pa.string()), ("n_sentences", pa.int64()), ("n_loose", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, identifiers (in order, by commas), licences (distinct, sorted, by commas), n_sentences known and n_loose,
    those of them that no rule takes, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = identifiers(text.as_py())
                found, loose = match(names)
                rows.append((key, ",".join(names), ",".join(sorted(set(found))), len(names), loose))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCANNED)], schema=_SCANNED)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, identifiers string, licences string, n_sentences bigint, n_loose bigint")
