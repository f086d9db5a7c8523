"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from shelf.llm.divergence import CLASSES, COMMON_WORDS

# lines come as kind 0 and their pieces as 1; a piece ends behind a word whose hash is least among four on either side
REPEATED_UNITS = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM cut),
placed AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(line) - 1)::BIGINT AS off FROM line),
token AS (SELECT *, regexp_extract_all(line, '(?:^\s+)?\S+\s*') AS t FROM placed),
hashed AS (SELECT *, list_transform(t, lambda x: ('0x' || substr(md5(lower(regexp_extract(x, '\S+'))), 1, 8))::BIGINT) AS h FROM token),
bound AS (SELECT *, list_filter(range(5, len(h) - 3), lambda i: h[i] < list_min(h[i - 4:i - 1]) AND h[i] <= list_min(h[i + 1:i + 4])) AS b FROM hashed),
edge AS (SELECT *, unnest([0] || b) AS x, unnest(b || [len(h)]) AS y FROM bound WHERE len(h) > 0),
pieces AS (SELECT doc_id, place, 1 AS kind, off + length(array_to_string(t[:x], '')) AS start, array_to_string(t[x + 1:y], '') AS body, y - x AS n FROM edge),
unit AS (SELECT doc_id, place, 0 AS kind, off AS start, line AS body, len(t) AS n FROM token WHERE len(t) > 0 UNION ALL SELECT * FROM pieces),
normal AS (SELECT *, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS norm FROM unit),
first AS (SELECT norm, min({'d': doc_id, 's': start}) AS f FROM normal GROUP BY norm),
judged AS (SELECT normal.*, f, (doc_id, start) <> (f.d, f.s) AS repeated FROM normal JOIN first USING (norm)),
whole AS (SELECT * FROM judged WHERE kind = 0),
part AS (SELECT p.*, w.repeated AS unit_repeated, p.repeated OR w.repeated AS gone FROM judged p JOIN whole w USING (doc_id, place) WHERE p.kind = 1),
island AS (SELECT *, sum((NOT gone)::INT) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM part),
goes AS (SELECT *, gone AND sum(CASE WHEN gone THEN n ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 16 AS goes FROM island),
rest AS (SELECT doc_id, place, string_agg(body, '' ORDER BY start) FILTER (NOT goes) AS body, bool_or(goes) AS cut, bool_and(goes) AS all_goes,
  bool_or(unit_repeated) AS unit_repeated FROM goes GROUP BY 1, 2),
kept AS (SELECT p.doc_id, p.place, CASE WHEN r.cut THEN regexp_replace(r.body, '\s+$', '') ELSE p.line END AS body
  FROM placed p LEFT JOIN rest r USING (doc_id, place) WHERE NOT coalesce(r.all_goes, false)),
joined AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY place) AS text FROM kept GROUP BY doc_id),
span AS (SELECT w.doc_id, w.start, w.body, w.f FROM whole w JOIN rest r USING (doc_id, place) WHERE r.all_goes AND w.repeated
  UNION ALL SELECT g.doc_id, g.start, g.body, g.f FROM goes g JOIN rest r USING (doc_id, place) WHERE g.goes AND NOT (r.all_goes AND r.unit_repeated)),
removed AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(':', start, start + length(body), f.d, f.s), ',' ORDER BY start) AS removed FROM span GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text,
  coalesce(n, 0)::INT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN joined j USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""


def _divide(nodes: str, parent: str, name: str) -> str:
    """One level of the mixing tree: ``nodes`` has (parent columns, name, holds, weight, budget)."""
    by = f"PARTITION BY {parent} ORDER BY holds / weight::DOUBLE, {name}"
    return f"""
SELECT {parent}, {name}, CASE WHEN full_part THEN holds
  ELSE (rest * upto) // open_weight - (rest * (upto - weight)) // open_weight END::BIGINT AS budget
FROM (SELECT *, budget - sum(CASE WHEN full_part THEN holds ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
    sum(CASE WHEN full_part THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_weight,
    sum(CASE WHEN full_part THEN 0 ELSE weight END) OVER ({by} ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, holds::HUGEINT * sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
      (budget - coalesce(sum(holds) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS full_part
    FROM {nodes}))"""


MIXING = rf"""
WITH counted AS (
  SELECT doc_id, CASE try_cast(regexp_extract(source, '(\d{{1,9}})$', 1) AS BIGINT) % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'forums' ELSE 'web' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
n1 AS (SELECT 0 AS root, domain, 2 * sum(tokens) AS holds, CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END AS weight,
    (SELECT floor(sum(tokens) * 0.6::DOUBLE)::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain),
b1 AS ({_divide("n1", "root", "domain")}),
n2 AS (SELECT root, domain, lang, holds, weight, budget FROM (SELECT domain, lang, 2 * sum(tokens) AS holds,
    CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY domain, lang) JOIN b1 USING (domain)),
b2 AS ({_divide("n2", "root, domain", "lang")}),
n3 AS (SELECT root, domain, lang, source, 2 * tokens AS holds, 1 AS weight, budget FROM leaves JOIN b2 USING (domain, lang)),
b3 AS ({_divide("n3", "root, domain, lang", "source")}),
spend AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole,
    CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM leaves JOIN b3 USING (domain, lang, source)),
placed AS (SELECT *, md5('7:' || whole || ':' || doc_id) AS rank FROM counted JOIN spend USING (domain, lang, source)),
started AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
SELECT doc_id, domain, lang, source, e::INT AS epoch, tokens, tokens AS take FROM placed, range(whole) t(e)
UNION ALL
SELECT doc_id, domain, lang, source, whole::INT AS epoch, tokens, least(tokens, rest - start)::BIGINT AS take FROM started WHERE start < rest
"""


_LISTED = ", ".join(f"'{w}'" for known in COMMON_WORDS.values() for w in known)
_LANGUAGES = ", ".join(f"'{x}'" for x in COMMON_WORDS)
_CLASSES = ", ".join(
    f"{{'bin': 'c{n}', 'n': length(marks) - length(regexp_replace(marks, '{p}', '', 'g'))}}"
    for n, p in enumerate((p.replace("'", "''") for p in CLASSES.values()), 2)
)

DIVERGENCE = rf"""
WITH doc AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    regexp_replace(coalesce(text, ''), '[\p{{Ll}}\s\x0B]+', '', 'g') AS marks, regexp_extract_all(coalesce(text, ''), '\p{{L}}+') AS plain FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM doc),
twice AS (SELECT doc_id, list(p) AS ps FROM (SELECT doc_id, p, list_aggregate(w[p:p + 7], 'string_agg', ' ') AS win FROM place)
  GROUP BY doc_id, win HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM (SELECT doc_id, unnest(ps) AS p FROM twice), range(8) r(j) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, lang, t, w, marks, plain, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM doc LEFT JOIN line USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
class_count AS (SELECT doc_id, unnest([{{'bin': 'c0', 'n': word_chars - length(marks)}}, {{'bin': 'c1', 'n': length(t) - word_chars}}, {_CLASSES}], recursive := true) FROM judged),
word_count AS (SELECT doc_id, lower(x) AS bin, count(*) AS n FROM (SELECT doc_id, unnest(plain) AS x FROM judged) WHERE lower(x) IN ({_LISTED}) GROUP BY 1, 2),
counts AS (SELECT 'c' AS kind, * FROM class_count UNION ALL SELECT 'w', * FROM word_count),
total AS (SELECT doc_id, 'c' AS kind, length(t) AS n FROM judged UNION ALL SELECT doc_id, 'w', len(plain) FROM judged),
filled AS (SELECT * FROM counts UNION ALL
  SELECT kind, doc_id, 'rest', any_value(total.n) - coalesce(sum(counts.n), 0) FROM total LEFT JOIN counts USING (doc_id, kind) GROUP BY kind, doc_id),
named AS (SELECT doc_id, lang, CASE WHEN lang IN ({_LANGUAGES}) THEN lang END AS language, base_failed FROM judged),
good AS (SELECT doc_id, unnest([language, '*']) AS ref FROM named WHERE NOT base_failed AND language IS NOT NULL),
sums AS (SELECT ref, kind, bin, sum(n) AS n FROM good JOIN filled USING (doc_id) GROUP BY 1, 2, 3),
reference AS (SELECT ref, kind, bin, n / greatest(sum(n) OVER (PARTITION BY ref, kind), 1) AS q FROM sums),
own AS (SELECT named.doc_id, ref, reference.kind, reference.bin, q, coalesce(filled.n, 0) / greatest(total.n, 1) AS p
  FROM named JOIN reference ON ref = coalesce(CASE WHEN language IN (SELECT ref FROM sums) THEN language END, '*')
  JOIN total ON total.doc_id = named.doc_id AND total.kind = reference.kind
  LEFT JOIN filled ON filled.doc_id = named.doc_id AND filled.kind = reference.kind AND filled.bin = reference.bin),
extra AS (SELECT filled.doc_id, kind, filled.n / greatest(total.n, 1) AS p FROM filled JOIN total USING (doc_id, kind)
  WHERE (doc_id, kind, bin) NOT IN (SELECT (doc_id, kind, bin) FROM own)),
summed AS (SELECT doc_id, kind, sum(x) AS x FROM (
    SELECT doc_id, kind, CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END AS x FROM own
    UNION ALL SELECT doc_id, kind, p FROM extra) GROUP BY 1, 2),
distance AS (SELECT doc_id, kind, round(sqrt(greatest(x, 0) / 2), 6) AS d FROM summed),
measured AS (SELECT judged.*, CASE WHEN length(t) >= 100 THEN c.d END AS class_distance, CASE WHEN len(plain) >= 30 THEN w.d END AS word_distance
  FROM judged LEFT JOIN distance c ON c.doc_id = judged.doc_id AND c.kind = 'c' LEFT JOIN distance w ON w.doc_id = judged.doc_id AND w.kind = 'w')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_distance > 0.25, false) AND NOT coalesce(word_distance > 0.42, false) AS kept, class_distance, word_distance
FROM measured
"""

SHARDING = """
WITH RECURSIVE shard AS (SELECT n, 'shard-' || lpad(n::VARCHAR, 2, '0') AS shard FROM range(64) t(n)),
wish AS (SELECT list(('0x' || substr(md5(shard), 1, 15))::BIGINT % 6553 ORDER BY n) AS first,
    list(('0x' || substr(md5(shard), 16, 15))::BIGINT % 6552 + 1 ORDER BY n) AS step FROM shard),
turns(turn, tried, owner) AS (
  SELECT 0, list_transform(range(64), lambda x: 0), list_transform(range(6553), lambda x: -1) FROM wish
  UNION ALL
  SELECT turn + 1, list_transform(tried, lambda x, k: CASE WHEN k = who THEN j + 1 ELSE x END),
    list_concat(owner[:slot], [who - 1], owner[slot + 2:])
  FROM (SELECT *, (first[who] + j * step[who]) % 6553 AS slot FROM (
    SELECT turn, tried, owner, first, step, turn % 64 + 1 AS who,
      list_filter(range(tried[turn % 64 + 1], 6553), lambda x: owner[(first[turn % 64 + 1] + x * step[turn % 64 + 1]) % 6553 + 1] < 0)[1] AS j
    FROM turns, wish WHERE turn < 6553))),
slots AS (SELECT unnest(range(6553)) AS slot, unnest(owner) AS n FROM turns WHERE turn = 6553)
SELECT doc_id, slot::INT AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 6553 AS slot FROM documents)
JOIN slots USING (slot) JOIN shard USING (n)
"""


# crc32 bit by bit over the decimal digits
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)),
    4294967295::BIGINT)"""

CONVERSATION_TRIE = f"""
WITH turn AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM turn)),
rebuilt AS (SELECT conv.c, 0 AS half, p, role, text FROM conv JOIN turn t ON t.c = conv.c - conv.c % 5 AND p <= h
  UNION ALL SELECT c, 1, p, role, text FROM turn JOIN conv USING (c) WHERE p > h),
path AS (SELECT conv.c, coalesce(list({{'r': role, 't': text}} ORDER BY half, p) FILTER (half IS NOT NULL), []) AS turns
  FROM conv LEFT JOIN rebuilt USING (c) GROUP BY conv.c),
member AS (SELECT c, d, turns[:d] AS prefix, turns[:d - 1] AS parent, d = len(turns) AS is_end, coalesce(strlen(turns[d].t), 0) AS bytes
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM path)),
node AS (SELECT d, prefix, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    array_to_string(list(c ORDER BY c) FILTER (is_end), ',') AS ends FROM member GROUP BY d, prefix),
child AS (SELECT d - 1 AS d, parent AS prefix, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
counted AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (d, prefix)),
below AS (SELECT m.d, m.prefix, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved_tokens
  FROM counted v JOIN member m ON m.c = v.conv_id AND m.d <= v.d GROUP BY m.d, m.prefix)
SELECT n.conv_id, n.d::BIGINT AS depth, CASE WHEN n.d > 0 THEN up.conv_id END AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN below USING (d, prefix) LEFT JOIN node up ON up.d = n.d - 1 AND up.prefix = n.parent
"""

FILTER_AUDIT = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS doc_id FROM doc GROUP BY t),
label AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT doc.doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc.doc_id > least.doc_id, false)::INT AS mask
  FROM doc JOIN least USING (t)),
counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN label USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
sorted AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
bits AS (SELECT o, list_transform(o, lambda x: (1 << (ascii(x) - 65))::INT) AS b, unnest(range(1, 6)) AS step FROM sorted),
step AS (SELECT array_to_string(o, '') AS filter_order, step::INT AS step, b[step] AS own, coalesce(list_sum(b[:step - 1]), 0)::INT AS before FROM bits)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own > 0), 0)::BIGINT AS shapley
FROM step, counted GROUP BY part, filter_order, step
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_divergence": DIVERGENCE,
        "op2_repeated_units": REPEATED_UNITS,
        "op3_sharding": SHARDING,
        "op8_mixing": MIXING,
        "op11_conversation_trie": CONVERSATION_TRIE,
        "op13_filter_audit": FILTER_AUDIT,
    }
