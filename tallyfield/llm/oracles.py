"""SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

import string

from tallyfield.llm.common import SPACE
from tallyfield.llm.line_dedup import MIN_CHARS, MIN_DOCS
from tallyfield.llm.licences import COPYRIGHT, GAPS, LINES, MARKS, NOTICE, RULES, SENTENCES, WORDS
from tallyfield.llm.mixing import MOST, NEXT, SEED
from tallyfield.llm import urls
from tallyfield.llm.quality import CHAR_LIMIT, CLASSES, COMMON_WORDS, MIN_LIST_WORDS, MIN_WORDS, WORD_LIMIT

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(text) + list_sum(list_transform(['<</ROLE>>', '<</TURN>>', '<<ROLE>>', '<</SYS>>', '<<ANS>>', '<<SYS>>', '[/INST]', '[INST]', '</s>', '<s>'],
      lambda c: (length(text) - length(replace(text, c, ''))) // length(c) * (2 - length(c)))) + length(text) - length(replace(text, '\', '')) AS chars,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 11 ELSE 26 + length(role) END AS around,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars + around) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)*u?') AS valid_order,
  CASE WHEN regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)*u?')
       THEN regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') ELSE NULL END AS ends_well
FROM escaped GROUP BY conv_id
"""

OP8 = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_LISTS = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in COMMON_WORDS.items()}
_CLASS_COUNTS = ", ".join(f"length(r{k}) - length(r{k + 1})" for k in range(len(CLASSES)))
_STRIPPED = "".join(f", s{k + 1} AS (SELECT *, regexp_replace(r{k}, '{p}', '', 'g') AS r{k + 1} FROM s{k})" for k, p in enumerate(CLASSES.values()))


def _near(k: str) -> str:
    parts = "list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END))"
    chars = parts.format(p="list_transform(chars, lambda c: c / list_sum(chars))", q=f"(SELECT list_transform(chars_{k}, lambda c: c / list_sum(chars_{k})) FROM refs)")
    words = parts.format(
        p=f"list_transform(list_append(common_{k}, n_words - list_sum(common_{k})), lambda c: c / n_words)",
        q=f"(SELECT list_transform(list_append(words_{k}, n_{k} - list_sum(words_{k})), lambda c: c / n_{k}) FROM refs)",
    )
    return f"((SELECT n_{k} FROM refs) > 0 AND sqrt(greatest(0, {chars} / 2)) <= {CHAR_LIMIT} AND (n_words < {MIN_LIST_WORDS} OR sqrt(greatest(0, {words} / 2)) <= {WORD_LIMIT}))"


_SUMS = ", ".join(
    f"[{', '.join(f'coalesce(sum(chars[{i + 1}]) FILTER ({own}), 0)' for i in range(len(CLASSES) + 2))}] AS chars_{k}, "
    f"[{', '.join(f'coalesce(sum(common_{k}[{i + 1}]) FILTER ({own}), 0)' for i in range(len(ws)))}] AS words_{k}, coalesce(sum(n_words) FILTER ({own}), 0) AS n_{k}"
    for k, ws in COMMON_WORDS.items()
    for own in [f"lang = '{k}' AND n_words >= {MIN_WORDS}"]
)
OP2 = rf"""
WITH s0 AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[{SPACE}]+', '', 'g') AS r0,
    list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
  FROM documents
){_STRIPPED}, tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s0)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY rid
), f AS (
  SELECT doc_id, lang, len(w) AS n_words, length(r0) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    [length(t) - length(r0), {_CLASS_COUNTS}, length(r{len(CLASSES)})] AS chars, length(r4) - length(r5) AS n_symbols,
    {", ".join(f"list_transform({ws}, lambda c: len(list_filter(w, lambda x: x = c))) AS common_{k}" for k, ws in _LISTS.items())}
  FROM s{len(CLASSES)} LEFT JOIN covered USING (rid)
), refs AS (SELECT {_SUMS} FROM f), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < {MIN_WORDS} OR {" OR ".join(map(_near, COMMON_WORDS))} OR {" AND ".join(f"(SELECT n_{k} FROM refs) = 0" for k in COMMON_WORDS)}
      OR lang IS NOT NULL AND NOT ({" OR ".join(f"lang = '{k}' AND (SELECT n_{k} FROM refs) > 0" for k in COMMON_WORDS)}) AS near
  FROM f
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND near AS kept
FROM judged
"""

OP3 = rf"""
WITH s AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
s2 AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws, coalesce(sum(source_size * {MOST}) OVER f, 0) AS filled, coalesce(sum(w) OVER f, 0) AS passed FROM s2
  WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) * {MOST} / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, source_size * {MOST} * (ws - passed) <= (total - filled) * w AS full_ FROM s3),
t AS (SELECT source, source_size, CASE WHEN full_ THEN CAST(source_size * {MOST} AS DOUBLE) ELSE CAST(total - sum(CASE WHEN full_ THEN source_size * {MOST} ELSE 0 END) OVER () AS DOUBLE) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target FROM s4),
c1 AS (SELECT source, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) - 1 END AS k, sum(size) AS words FROM s GROUP BY 1, 2),
c2 AS (SELECT c1.*, t.target, CAST(floor(1048576e0 / (k + 16)) AS BIGINT) AS factor FROM c1 JOIN t ON t.source IS NOT DISTINCT FROM c1.source),
c3 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {MOST} AS filled, sum(words * factor) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS moved FROM c2),
c4 AS (SELECT *, words = 0 OR CAST(moved AS DOUBLE) * {MOST} <= (target - filled) * factor AS full_ FROM c3),
c5 AS (SELECT *, sum(CASE WHEN full_ THEN words * {MOST} ELSE 0 END) OVER (PARTITION BY source) AS taken, sum(CASE WHEN full_ THEN 0 ELSE words * factor END) OVER (PARTITION BY source) AS open_ FROM c4),
c AS (SELECT source, k, words, target, CASE WHEN words = 0 THEN 0e0 WHEN full_ THEN {MOST}e0 ELSE least({MOST}e0, greatest(0e0, target - taken) * factor / open_) END AS e FROM c5),
d AS (SELECT source AS ds, max(target) - sum(CAST(floor(e) AS BIGINT) * words) AS due FROM c GROUP BY 1),
u AS (SELECT s.*, floor(e) AS whole, e - floor(e) AS p, (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM s JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.k = CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) - 1 END),
o AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS reached FROM o WHERE odds IS NOT NULL),
x AS (SELECT r.*, CASE WHEN reached <= due THEN -1 ELSE 1 END AS change, due, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) - 1 END AS k FROM r JOIN d ON ds IS NOT DISTINCT FROM source),
y AS (SELECT *, due - coalesce(sum(CASE WHEN change < 0 THEN size END) OVER (PARTITION BY source), 0) AS gap,
  row_number() OVER (PARTITION BY source, k, change ORDER BY -change * odds DESC, -change * doc_id DESC NULLS LAST, -change * size DESC, -change * rid DESC) AS turn FROM x),
z AS (SELECT source AS zs, gap, list({{'gap': 0e0, 'picked': CAST([] AS BIGINT[]), 'step': CAST(change * size AS BIGINT), 'rid': rid}} ORDER BY k DESC, change DESC, turn) AS next FROM y WHERE turn <= {NEXT} GROUP BY 1, 2),
g AS (SELECT list_reduce(next, lambda a, b: CASE WHEN abs(a.gap - b.step) < abs(a.gap) THEN {{'gap': a.gap - b.step, 'picked': list_append(a.picked, b.rid), 'step': a.step, 'rid': a.rid}} ELSE a END,
  {{'gap': gap, 'picked': CAST([] AS BIGINT[]), 'step': CAST(0 AS BIGINT), 'rid': CAST(0 AS BIGINT)}}) AS a FROM z),
v AS (SELECT unnest(a.picked) AS rid FROM g),
e AS (SELECT rid FROM x WHERE (change < 0) <> (rid IN (SELECT rid FROM v)))
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN rid IN (SELECT rid FROM e) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o JOIN t ON t.source IS NOT DISTINCT FROM o.source
"""

_PLAIN = "array_to_string(list_filter(list_transform(regexp_extract_all({x}, '" + WORDS + "'), lambda w: trim(w, '.')), lambda w: w <> ''), ' ')"
_ONE_LINE = "NOT contains(trim(piece, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), chr(10))"
_NOTICED = f"CASE WHEN {_ONE_LINE} AND regexp_matches(plain, '^{NOTICE}') THEN '{COPYRIGHT}' END"
_SEQUENCES = {"".join(f"{n}," for n in names): licence for licence, names in RULES}
OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(replace(coalesce(text, ''), chr(1), chr(2)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
known AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{k}')" for k, texts in SENTENCES.items() for t in texts)}) v(sentence, name)),
p AS (SELECT rid, string_split(regexp_replace(regexp_replace(t, '{MARKS}([ \t-\r]|$)', chr(1) || '\1', 'g'), '{GAPS}', chr(1), 'g'), chr(1)) AS pieces FROM d),
s AS (SELECT rid, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM p),
s1 AS (SELECT *, {_PLAIN.format(x="piece")} AS plain FROM s),
s2 AS (SELECT rid, i, piece, coalesce(name, {_NOTICED}) AS name FROM s1 LEFT JOIN known ON plain = sentence),
l AS (SELECT rid, i, unnest(lines) AS piece, unnest(range(len(lines))) AS k FROM (SELECT rid, i, string_split_regex(piece, '{LINES}') AS lines FROM s2 WHERE name IS NULL AND regexp_matches(piece, '{LINES}'))),
l1 AS (SELECT *, {_PLAIN.format(x="piece")} AS plain FROM l),
a AS (SELECT rid, i, 0 AS k, name FROM s2 UNION ALL SELECT rid, i, k, coalesce(name, {_NOTICED}) AS name FROM l1 LEFT JOIN known ON plain = sentence),
n AS (SELECT rid, list(name ORDER BY i, k) AS names FROM a WHERE name IS NOT NULL GROUP BY rid),
m AS (SELECT rid, names, regexp_extract_all(array_to_string(list_transform(list_filter(names, lambda x: x <> '{COPYRIGHT}'), lambda x: x || ','), ''), '{"|".join(_SEQUENCES)}|[^,]+,') AS found FROM n),
f AS (SELECT *, list_transform(found, lambda x: CASE x {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEQUENCES.items())} END) AS licences FROM m)
SELECT doc_id, coalesce(array_to_string(names, ','), '') AS identifiers, coalesce(array_to_string(list_sort(list_distinct(list_filter(licences, lambda x: x IS NOT NULL))), ','), '') AS licences,
  CAST(coalesce(len(names), 0) AS BIGINT) AS n_sentences, CAST(coalesce(len(list_filter(licences, lambda x: x IS NULL)), 0) AS BIGINT) AS n_loose
FROM d LEFT JOIN f USING (rid)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""

_VARIABLE = f"regexp_matches(stem, '^[0-9]+$|^[0-9a-fA-F-]{{8,}}$|[0-9].*[0-9].*[0-9]') OR length(stem) > {urls.LONG} OR stem = '*'"
_ENDED = r"regexp_extract(s, '^(.*?)(\.[A-Za-z]{1,5})?$', "
_GENERAL = "CASE WHEN " + _VARIABLE.replace("stem", _ENDED + "1)") + " THEN '*' || " + _ENDED + "2) ELSE s END"
#: Levels of a path that the SQL follows; the given tables have two.
LEVELS = 4


def _level(k: int) -> str:
    share = "(x.b + a.g[-1].b) / (x.m + a.g[-1].m)"
    apart = f"abs(x.b / x.m - a.g[-1].b / a.g[-1].m) > {urls.MOST_Z} * sqrt({share} * (1 - {share}) * (1 / x.m + 1 / a.g[-1].m))"
    group = "STRUCT(m BIGINT, b BIGINT, names VARCHAR[])[]"
    return f"""n{k} AS (SELECT *, count(*) OVER w AS children, sum(pages) OVER w AS all_pages, (bad + {urls.STRENGTH} * prior) / (labelled + {urls.STRENGTH}) AS rate
  FROM (SELECT host, prefix, parts[{k + 1}] AS seg, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(bad) AS BIGINT) AS bad FROM r{k} WHERE len(parts) > {k} GROUP BY ALL) CROSS JOIN pr WINDOW w AS (PARTITION BY host, prefix)),
w{k} AS (SELECT *, starts_with(seg, '*') OR children > {urls.FANOUT} AND pages < {urls.FREQUENT} * all_pages AS wild FROM n{k}),
l{k} AS (SELECT host, prefix, list({{'g': CAST([] AS {group}), 'm': labelled, 'b': bad, 'seg': seg}} ORDER BY rate, seg) AS children FROM w{k} WHERE NOT wild AND labelled >= {urls.MIN_LABELS} GROUP BY 1, 2),
g{k} AS (SELECT host, prefix, unnest(list_reduce(children, lambda a, x: {{'g': CASE WHEN len(a.g) = 0 THEN [{{'m': x.m, 'b': x.b, 'names': [x.seg]}}] WHEN {apart} THEN list_append(a.g, {{'m': x.m, 'b': x.b, 'names': [x.seg]}})
  ELSE list_append(a.g[:-2], {{'m': a.g[-1].m + x.m, 'b': a.g[-1].b + x.b, 'names': list_append(a.g[-1].names, x.seg)}}) END, 'm': x.m, 'b': x.b, 'seg': x.seg}}, {{'g': CAST([] AS {group}), 'm': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'seg': ''}}).g) AS g FROM l{k}),
b{k} AS (SELECT host, prefix, unnest(g.names) AS seg, array_to_string(list_sort(g.names), '|') AS name FROM g{k} UNION ALL SELECT host, prefix, seg, CASE WHEN wild THEN '*' ELSE seg END FROM w{k} WHERE wild OR labelled < {urls.MIN_LABELS}),
r{k + 1} AS (SELECT r{k}.* REPLACE (CASE WHEN name IS NULL THEN r{k}.prefix ELSE r{k}.prefix || '/' || name END AS prefix) FROM r{k} LEFT JOIN b{k} ON b{k}.host = r{k}.host AND b{k}.prefix = r{k}.prefix AND b{k}.seg = r{k}.parts[{k + 1}])"""


_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
_BEST = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
OP10 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, array_to_string(parts, '/') AS route FROM (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda s: {_GENERAL}) AS parts FROM h)),
q AS (SELECT page_id AS k, min(quality) = 0 AS bad FROM (SELECT page_id, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1), '') AS BIGINT) AS doc_id FROM h) JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) GROUP BY 1),
r0 AS (SELECT host, route, any_value(parts) AS parts, '' AS prefix, count(*) AS pages, count(bad) AS labelled, count(*) FILTER (bad) AS bad FROM p LEFT JOIN q ON k = page_id GROUP BY 1, 2),
pr AS (SELECT sum(bad) / greatest(sum(labelled), 1) AS prior FROM r0),
{", ".join(map(_level, range(LEVELS)))},
t AS (SELECT host, prefix, (sum(bad) + {urls.STRENGTH} * any_value(prior)) / (sum(labelled) + {urls.STRENGTH}) AS share FROM r{LEVELS} CROSS JOIN pr GROUP BY 1, 2),
f AS (SELECT r{LEVELS}.host AS fh, route AS fr, r{LEVELS}.prefix AS template, share FROM r{LEVELS} JOIN t USING (host, prefix))
SELECT page_id, host, path, CASE {" ".join(f"{c}'{h}{x}'" for c, (_, h, x) in zip(_FITS, _BEST))} END AS rule,
  CASE {" ".join(f"{c}'{says}'" for c, (says, _, _) in zip(_FITS, _BEST))} WHEN share >= {urls.REJECT} THEN 'block' ELSE 'allow' END AS verdict, template
FROM p JOIN f ON fh = host AND fr = route
"""

_NEAREST = """(SELECT vec_id, p.part, any_value(p.q) AS q,
    min(list_sum(list_transform(list_zip(p.q, b.q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) * 64 + b.entry) AS best
  FROM p JOIN b{k} b ON b.part = p.part GROUP BY vec_id, p.part)"""
_MEAN = "[" + ", ".join(f"CAST(floor(sum(q[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5)) + "]"
_ROUND = f"""n{{k}} AS {_NEAREST},
m{{k}} AS (SELECT part, best % 64 AS entry, {_MEAN} AS q FROM n{{k}} GROUP BY 1, 2),
b{{j}} AS (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{{k}} b LEFT JOIN m{{k}} m ON m.part = b.part AND m.entry = b.entry)"""
OP11 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, q[4 * part + 1:4 * part + 4] AS q FROM v CROSS JOIN range(16) AS t(part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
b0 AS (SELECT part, entry, q FROM p JOIN s USING (vec_id)),
{_ROUND.format(k=0, j=1)},
{_ROUND.format(k=1, j=2)},
n2 AS {_NEAREST.format(k=2)},
e AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM n2 GROUP BY 1),
c AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id) CROSS JOIN c
"""

OP12 = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || g.c || h.c AS filter_order FROM x a, x b, x d, x g, x h WHERE len(list_distinct([a.c, b.c, d.c, g.c, h.c])) = 5),
y AS (SELECT *, list_position(list_transform(string_split(filter_order, ''), lambda c: fails[ascii(c) - 64]), true) AS hit FROM m CROSS JOIN o),
z AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, fails, n, good, toxic, coalesce(nullif(hit, 0), 9) AS hit FROM y CROSS JOIN range(1, 6) AS s(step)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (hit > step), 0) AS kept, coalesce(sum(n) FILTER (hit = step), 0) AS removed,
    coalesce(sum(n) FILTER (fails[ascii(letter) - 64] AND hit < step), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[ascii(letter) - 64] AND len(list_filter(fails, lambda b: b)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit = step), 0) AS toxic_lost FROM z GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS mark, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, mark, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
f AS (SELECT key AS long_key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT doc_id, mark, line, place, long_key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN f ON key = long_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id, mark
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1, "op2_quality_divergence": OP2, "op3_pareto_mixing": OP3, "op4_licence_scan": OP4, "op5_substring_dedup": OP5, "op7_near_dedup": OP7, "op8_exact_dedup": OP8, "op10_url_templates": OP10, "op11_vector_codes": OP11, "op12_filter_audit": OP12, "op13_line_dedup": OP13}
