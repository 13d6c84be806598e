"""Toxicity after noisy-channel deobfuscation.

A character language model (trigrams over a to z and a word edge, counted over the whole corpus, so of a fixed size)
decodes obfuscated words: every observed character becomes the letters it may stand for, at a channel cost, or nothing
if it is a separator or repeats the letter before it, and Viterbi finds the cheapest path through that lattice, however
long the word is. Words of letters only pass unchanged. Tokens of several parts are looked up by runs of their parts, too;
runs of single characters, and tokens longer than a word, are decoded as one and searched for known words.

The restored words of at most TRAIN_ROWS labelled rows, near copies among them counted once, give a lexicon: words and
first letters of words whose share of toxic documents is high and significantly so; all that are, without a cut-off. A
text's score joins the shares of the lexicon words it holds, as if each made it toxic on its own, with the share of toxic
rows among those without any.

Defined results: null texts count as empty and get the share of rows without a lexicon word; without toxic labels every
score is that share; null doc_ids aren't held out; rows that repeat are scored each, and one
text of a doc_id, by its hash, is learnt from; labels that contradict each other count as toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import cut, text_mark
from tallyfield.llm.word_hashes import WordHashes, rolling

TRAIN_ROWS = 30_000
LEAST_SHARE, LEAST_EVIDENCE, LEAST_DOCS, LEAST_MORE = 0.9, 13.0, 3, 0.75
STEMS = range(4, 8)
THRESHOLD = 0.7
EDGE = 26
#: The letters that a character may stand for besides itself, and the characters that may stand for none.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i",
    "v": "u", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "ѕ": "s", "у": "y",
    "à": "a", "á": "a", "â": "a", "ä": "a", "å": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i",
    "ï": "i", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "c",
}
SEPARATORS = set(".-_*~'`´^,:;/\\#=\"?!$%&|)(<>[]{}•·+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OUTER = ".,:;?\"'()[]{}%&#*|-_~`<>/\\=^"
#: Characters of an obfuscated word of several parts, repetition aside; longer tokens are searched for words.
LONGEST = 40
#: Costs in nats: a letter for another character; a separator or a third equal letter, a separator that may stand for a
#: letter, and a second equal letter dropped.
SWAP, DROP, DROP_SIGN, UNDOUBLE = 0.7, 0.5, 4.0, 3.0
V_FOR_U = 4.0


class CharModel:
    """Log probabilities of a letter or the edge after two others, interpolated with those after one."""

    def __init__(self, counts: np.ndarray) -> None:
        n = counts.reshape(27, 27, 27).astype(float)
        one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + 27)
        pairs = n.sum(axis=0)
        two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
        three = (n + 5 * two) / (n.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(three)).tolist()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Over all texts; at most 27 x 27 x 27 sums reach the driver."""
    codes = np.full(256, EDGE, np.int64)
    for i, c in enumerate(LETTERS):
        codes[ord(c)] = codes[ord(c.upper())] = i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                data = codes[np.frombuffer(b"  " + text.as_py().encode("utf-8", "replace") + b"  ", np.uint8)]
                total += np.bincount((data[:-2] * 27 + data[1:-1]) * 27 + data[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "gram int, n bigint")
    counts = np.zeros(27**3, np.int64)
    for gram, n in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[gram] = n
    return counts


def decode(token: str, model: CharModel) -> str:
    """The letters that an obfuscated word most likely stands for."""
    cost = model.cost
    #: by the last two letters: what the cheapest path spent, and its letters from the last one back
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    before = ""
    for i, x in enumerate(token):
        choices = []
        if x in LETTERS:
            choices.append((ord(x) - 97, 0.0))
        for c in STANDS_FOR.get(x, ""):
            choices.append((ord(c) - 97, V_FOR_U if x == "v" else SWAP))
        follows = token[i + 1 : i + 2] == x
        again = x == before
        triple = again and (follows or token[i - 2 : i] == x + x)
        drop = (DROP_SIGN if choices else DROP) if x in SEPARATORS or not choices else DROP if triple else UNDOUBLE if again else None
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (spent, made) in states.items():
            row = cost[a][b]
            for c, channel in choices:
                total = spent + channel + row[c]
                if (b, c) not in reached or total < reached[b, c][0]:
                    reached[b, c] = (total, (made, c))
            if drop is not None and (x in SEPARATORS or not choices or made):
                total = spent + drop
                # a dropped letter saves what a letter costs on the whole, so that short words aren't preferred
                if x not in SEPARATORS and choices:
                    total += 1.0
                if (a, b) not in reached or total < reached[a, b][0]:
                    reached[a, b] = (total, made)
        states, before = reached, x
    made = min(((spent + cost[a][b][EDGE], n, made) for n, ((a, b), (spent, made)) in enumerate(states.items())), default=(0.0, 0, None))[2]
    letters = []
    while made:
        made, c = made
        letters.append(LETTERS[c])
    return "".join(reversed(letters))


_TRIPLE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){3,}(?!\S)")
_JUNK_END = re.compile(r"[$!]{2,}$|!$")
_PART = re.compile("[^" + re.escape("".join(sorted(SEPARATORS))) + "]+")
_ONLY_SEPARATE = "".join(sorted(SEPARATORS - set(STANDS_FOR)))
_WITHOUT_THOSE = str.maketrans("", "", _ONLY_SEPARATE)
_REPEATED = re.compile(r"(.)\1{3,}|([" + re.escape(_ONLY_SEPARATE) + "]){2,}")
#: Parts of one character in a row that spell words; letters of a word that is searched for in what they spell.
SPELLED, HIDDEN = 4, 4


def core_of(token: str) -> str:
    """A lower-case token without the signs around it; without what repetition adds if it is longer than a word."""
    core = _JUNK_END.sub("", token.strip(OUTER)).strip(OUTER)
    return core if len(core) <= LONGEST else _REPEATED.sub(lambda m: m[2] or m[1] * 3, core)


def restore(core: str, model: CharModel) -> str:
    """The word that the core of a token stands for; empty if it holds no letter."""
    if core.isalpha() and not _TRIPLE.search(core):
        if core.isascii() or not any("а" <= c <= "ѕ" for c in core) or len(core) > 2 * sum(c in LETTERS for c in core):
            return core
    elif not any(map(str.isalpha, core)):
        return ""
    return decode(core, model)


def words_in(token: str, model: CharModel) -> tuple[list[tuple[str, bool]], list[str]]:
    """Of a lower-case token: (word, whether its first letters count, too) for the words that runs of its parts stand for,
    short runs first and the whole last, and what its runs of single characters and its overlong parts decode to."""
    core = core_of(token)
    if core.isalpha() and len(core) <= LONGEST:
        return [(restore(core, model), True)], []
    parts = [m.span() for m in _PART.finditer(core)]
    whole = restore(core, model)
    if len(parts) < 2 and len(core) <= LONGEST:
        return [(whole, True)], []
    words: dict[tuple[str, bool], None] = {}
    runs = [whole] if len(core) > LONGEST else []
    spelled = [False] * len(parts)
    first = 0
    while first < len(parts):
        last = first
        while last < len(parts) and parts[last][1] - parts[last][0] == 1:
            last += 1
        if last - first >= SPELLED:
            spelled[first:last] = [True] * (last - first)
            # with the parts beside it, which may hold a word's first or last letters
            run = core[parts[max(first - 1, 0)][0] : parts[min(last, len(parts) - 1)][1]]
            runs.append(decode(run.translate(_WITHOUT_THOSE), model))
        first = max(last, first + 1)
    for n in range(len(parts)):
        some = False
        for i in range(len(parts) - n):
            start, end = parts[i][0], parts[i + n][1]
            if end - start > LONGEST:
                if not n and len(parts) > 1:
                    runs.append(restore(core[start:end], model))
                continue
            some = True
            if n and (spelled[i] or spelled[i + n]):
                continue
            word = restore(core_of(core[start:end]), model)
            beside = core[max(start - 1, 0) : start] + core[end : end + 1]
            if len(word) >= 4 or len(word) > 1 and not any(c in STANDS_FOR for c in beside):
                words[word, True] = None
        if not some and n:
            break
    return [*words, (whole, True)], runs


def spaced_runs(text: str, model: CharModel) -> list[str]:
    """What the runs of single characters with spaces between them decode to."""
    return [decode("".join(m[0].split()), model) for m in _SPACED.finditer(text)]


def hidden_words(run: str, lexicon: dict[str, float]) -> set[str]:
    """The whole words of the lexicon that a decoded run holds, double letters aside."""
    plain = _DOUBLE.sub(r"\1", run)
    lengths = {len(w) for w in lexicon if len(w) >= HIDDEN and not w.endswith("-")}
    return {plain[i : i + k] for k in lengths for i in range(len(plain) - k + 1) if plain[i : i + k] in lexicon}


_FOLD = str.maketrans({k: v for k, v in STANDS_FOR.items() if len(v) == 1 and k.isalpha() and not k.isascii()})
_DOUBLE = re.compile(r"(.)\1+")


def features_of(word: str) -> list[str]:
    """A restored word and its first letters, without accents and double letters."""
    plain = _DOUBLE.sub(r"\1", word if word.isascii() else word.translate(_FOLD))
    return [plain, *(plain[:k] + "-" for k in STEMS if len(plain) >= k)] if plain else []


def token_features(token: str, model: CharModel) -> list[list[str]]:
    """The features of each word that a lower-case token holds, as a whole last."""
    return [features_of(w)[: None if stems else 1] for w, stems in words_in(token, model)[0]]


#: Tokens whose words a task keeps.
KNOWN_TOKENS = 200_000


def _text_words(text: str, model: CharModel, known: dict[str, set[str]]) -> set[str]:
    """The features of the restored words of a whole text."""
    found = set()
    for t in set(text.lower().split()):
        r = known.get(t)
        if r is None:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            r = known[t] = {f for features in token_features(t, model) for f in features}
        found.update(r)
    return found


def train_rows(labels: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, toxic) of at most TRAIN_ROWS labelled rows that aren't held out, in the order of a hash of the doc_id."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return [(r[0], int(r[1])) for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect()]


def _sample_words(docs: DataFrame, rows: list[tuple[int, int]], model: CharModel) -> DataFrame:
    """doc_id, mark (of the text), toxic, words and keys (eight least hashes of runs of three words) of the sample, of a
    bounded number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        hashes = WordHashes()
        for batch in batches:
            words, keys = [], []
            for text in batch.column(3).to_pylist():
                words.append(sorted(_text_words(text, model, known)))
                runs = rolling(hashes.of_text(text.encode("utf-8", "surrogatepass")), 3)
                with np.errstate(over="ignore"):
                    keys.append([int((runs * np.uint64(2 * k + 1) >> np.uint64(1)).min()) for k in range(1, 9)] if len(runs) else [])
            yield pa.record_batch([*batch.columns[:3], pa.array(words, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "toxic", "words", "keys"])

    sample = docs.sparkSession.createDataFrame(rows, "sample_id bigint, toxic int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    joined = own.join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id")).select("doc_id", "mark", "toxic", "text")
    return joined.mapInArrow(read, "doc_id bigint, mark bigint, toxic int, words array<string>, keys array<bigint>")


def _evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The log likelihood ratio of a word's share of toxic documents against that of all."""
    p, q = toxic / (toxic + clean), all_toxic / (all_toxic + all_clean)
    return toxic * math.log(p / q) + (clean * math.log((1 - p) / (1 - q)) if clean else 0.0)


def _explained(feature: str, found: dict[str, tuple[int, int]], order: list[str]) -> bool:
    """Whether first letters of words add too few toxic documents to those of the most frequent feature that goes on.
    `order` is `found` in order, so those that go on stand together."""
    if not feature.endswith("-"):
        return False
    first, end = bisect_left(order, feature[:-1]), bisect_left(order, feature[:-1] + chr(0x10FFFF))
    longer = [found[w] for w in order[first:end] if w != feature]
    if not longer:
        return False
    t, n = max(longer)
    more, rows = found[feature][0] - t, found[feature][1] - n
    return more <= 0 or more < LEAST_MORE * rows


def fit(docs: DataFrame, labels: DataFrame, model: CharModel) -> tuple[dict[str, float], float]:
    """The lexicon with each word's share of toxic documents, and the share among the rows without a lexicon word."""
    rows = train_rows(labels)
    if not any(toxic for _, toxic in rows) or all(toxic for _, toxic in rows):
        return {}, (sum(t for _, t in rows) + 0.5) / (len(rows) + 1)
    sample = cut(_sample_words(docs, rows, model))
    one_text = sample.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("toxic").alias("toxic"), F.min_by("keys", "mark").alias("keys"))
    seen: set[tuple[int, int]] = set()
    kept = []
    for doc_id, mark, toxic, keys in one_text.orderBy("doc_id").collect():
        own = set(enumerate(keys))
        if not own & seen:
            kept.append((doc_id, mark, toxic))
        seen |= own
    all_toxic = sum(t for *_, t in kept)
    all_clean = len(kept) - all_toxic
    if not all_toxic or not all_clean:
        return {}, (all_toxic + 0.5) / (len(kept) + 1)
    ids = docs.sparkSession.createDataFrame([k[:2] for k in kept], "kept_id bigint, kept_mark bigint")
    same = (F.col("doc_id") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    once = sample.join(F.broadcast(ids), same).dropDuplicates(["doc_id", "mark"]).select("toxic", "words")
    counts = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    prior = all_toxic / len(kept)
    # what passes is a part of the sample's toxic words, the sample being bounded
    likely = counts.where((F.col("t") >= LEAST_DOCS) & (F.col("t") / F.col("n") >= LEAST_SHARE) & (F.col("t") * F.log(F.col("t") / F.col("n") / F.lit(prior)) >= LEAST_EVIDENCE))
    found = {w: (t, n) for w, t, n in likely.collect() if _evidence(t, n - t, all_toxic, all_clean) >= LEAST_EVIDENCE}
    order = sorted(found)
    lexicon = {w: (found[w][0] + prior) / (found[w][1] + 1) for w in order if not _explained(w, found, order)}
    listed = F.array(*map(F.lit, sorted(lexicon))) if lexicon else F.array().cast("array<string>")
    rest = once.where(~F.arrays_overlap("words", listed)).agg(F.sum("toxic"), F.count("*")).first()
    return lexicon, ((rest[0] or 0) + 0.5) / (rest[1] + 1)


def score(docs: DataFrame, model: CharModel, lexicon: dict[str, float], base: float) -> DataFrame:
    """doc_id, held_out, score, predicted and words (features in the lexicon) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("words", pa.list_(pa.string()))])
    sent = docs.sparkSession.sparkContext.broadcast((model, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = sent.value
        hit: dict[str, list[str]] = {}

        def best(features: list[str]) -> str:
            return max((f for f in features if f in lexicon), key=lambda f: (lexicon[f], f), default="")

        def hits(token: str) -> list[str]:
            """The best of each word's features, without those that go on or begin like one found already, and hidden words."""
            words, runs = words_in(token, model)
            taken: list[str] = []
            for f in filter(None, (best(features_of(w)[: None if stems else 1]) for w, stems in words)):
                if not any(f.rstrip("-").startswith(g.rstrip("-")) or g.startswith(f.rstrip("-")) for g in taken):
                    taken.append(f)
            return [*taken, *(h for run in runs for h in hidden_words(run, lexicon) if not any(h.startswith(g.rstrip("-")) for g in taken))]

        for batch in batches:
            scores, found = [], []
            for text in batch.column(2):
                lower = text.as_py().lower()
                words = set()
                for t in set(lower.split()):
                    r = hit.get(t)
                    if r is None:
                        if len(hit) > KNOWN_TOKENS:
                            hit.clear()
                        r = hit[t] = hits(t)
                    words.update(r)
                for run in spaced_runs(lower, model):
                    words |= hidden_words(run, lexicon)
                words.discard("")
                clean = 1 - base
                for w in sorted(words):
                    clean *= 1 - lexicon[w]
                scores.append(1 - clean)
                found.append(sorted(words))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(found, pa.list_(pa.string()))], schema=schema)

    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, words array<string>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = CharModel(trigram_counts(docs))
    return score(docs, model, *fit(docs, labels, model))
