"""Line dedup, in DataFrame functions only.

The key of a line is the line without white space at its ends, in lower case of A to Z. Keys of at least MIN_CHARS code
points are exploded as hashes with their line's position, and each hash is counted over distinct documents. Where at least
MIN_DOCS hold it, its lines go but those of the largest doc_id among them. Documents are put together again from the
positions that are left. Only hashes, ids and positions are dealt by key; a text moves once, to its own positions.

Two independent 64-bit hashes of a key are compared together. The keys that go are broadcast behind a count, else joined by
exchange, where adaptive execution splits a key that very many documents share.

Defined results: a null or empty text is one empty line; rows that share a doc_id are one document where documents are
counted, and each is judged by its own lines; rows without a doc_id count for no document, and their lines go like others;
an empty table gives no rows; other columns, whatever their names, are kept by `drop_lines`, which leaves a null text null.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.broadcasts import small
from tallyfield.llm.common import cut, own_columns, text_mark, unused

MIN_CHARS = 40
MIN_DOCS = 5
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """The key of a line that is stripped already. A line of ASCII only takes Spark's fast lower case, to the same result."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, mark (of the text), place (from 0) and the two hashes of the key of each line that is long enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    rows = rows.select("doc_id", "mark", "place", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= min_chars)
    rows = rows.select("doc_id", "mark", "place", key_of(F.col("line")).alias("key"))
    return rows.select("doc_id", "mark", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, mark and gone, the places of the lines that go, of every text that loses lines."""
    lines = line_hashes(docs, min_chars)
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    frequent = cut(counted.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    hits = lines.join(small(frequent), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return hits.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("gone"))


def _plain(docs: DataFrame) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def _judged(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, str, str]:
    """`docs` with their text cut down, null where it was, and the names of two more columns: how many lines there were, and
    how many went. Texts are split before the join, so that each is split once."""
    n, gone, lines, key, mark = (unused(docs, x) for x in ("n_lines", "n_gone", "own_lines", "own_id", "own_mark"))
    others = [c for c, name in zip(_plain(docs), docs.columns) if name.lower() != "text"]
    rows = docs.select(*others, F.split("text", "\n").alias(lines), F.col("doc_id").cast("long").alias(key), text_mark(F.col("text")).alias(mark))
    found = repeated_lines(docs, min_chars, min_docs).alias("g")
    rows = rows.alias("d").join(found, F.col(key).eqNullSafe(F.col("g.doc_id")) & (F.col(mark) == F.col("g.mark")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.gone"))
    text = F.when(F.col("g.gone").isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    went = F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")).cast("long")
    size = F.when(F.col(lines).isNull(), 1).otherwise(F.size(lines)).cast("long")
    own = [text.alias(name) if name.lower() == "text" else c for name, c in zip(docs.columns, own_columns(docs, "d"))]
    return rows.select(*own, size.alias(n), went.alias(gone)), n, gone


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left of every row."""
    rows, n, gone = _judged(docs.select("doc_id", "text"), min_chars, min_docs)
    return rows.select("doc_id", n, F.col(gone).alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of `docs` with their own columns, the text without the lines that go."""
    return _judged(docs, min_chars, min_docs)[0].select(*_plain(docs))
