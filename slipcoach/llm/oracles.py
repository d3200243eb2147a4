"""DuckDB SQL for the rows of queries that SQL can express.

Limits and word lists come from the operators; everything computed from them is written out anew.
"""

from slipcoach.llm import licenses as m
from slipcoach.llm import quality as q

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals),
-- filled in the order in which sources reach their cap
ordered AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM ranked),
sums AS (
  SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS shares,
         coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_size,
         coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_weight FROM ordered),
capped AS (SELECT *, weight * (words - 3 * before_size) > 3 * source_size * (shares - before_weight) AS over FROM sums),
rest AS (SELECT max(words) - 3 * coalesce(sum(source_size) FILTER (over), 0) AS left_words, max(shares) - coalesce(sum(weight) FILTER (over), 0) AS left_shares FROM capped),
targets AS (
  SELECT source, source_size, CASE WHEN over THEN CAST(source_size AS DOUBLE) * 3.0
         ELSE CAST(weight AS DOUBLE) * CAST(left_words AS DOUBLE) / CAST(left_shares AS DOUBLE) END AS target FROM capped, rest),
drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM drawn
"""

URL_RULES = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM parts JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""


def _op2() -> str:
    text = lambda x: x.replace("'", "''")
    cut, steps = "t", []
    for kind in q.CLASSES:
        after = f"regexp_replace({cut}, '{text(kind)}', '', 'g')"
        steps.append(f"length({cut}) - length({after})")
        cut = after
    counts = ", ".join([*steps, f"length({cut})"])
    spelled = ", ".join(f"('{x}', {k + 1})" for k, c in enumerate(q.COMMON) for x in dict.fromkeys((c, c.capitalize(), c.upper())))
    distance = "sqrt(greatest(0, list_sum(list_transform({p}, lambda x, i: (CASE WHEN x > 0 THEN x * log2(2 * x / (x + {r}[i])) ELSE 0 END) + (CASE WHEN {r}[i] > 0 THEN {r}[i] * log2(2 * {r}[i] / (x + {r}[i])) ELSE 0 END))) / 2))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, [{counts}] AS chars FROM docs),
windows AS (SELECT r, unnest(range(1, len(w) - {q.WINDOW - 2})) AS p, w FROM split WHERE len(w) >= {q.WINDOW}),
named AS (SELECT r, p, array_to_string(w[p:p + {q.WINDOW - 1}], ' ') AS x FROM windows),
twice AS (SELECT r, p FROM named QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, range({q.WINDOW}) AS s(k) GROUP BY r),
base AS (
  SELECT s.r, doc_id, lang, chars, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM split s LEFT JOIN covered c ON s.r = c.r),
spelled(x, k) AS (VALUES {spelled}),
hits AS (SELECT r, k, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM split) JOIN spelled USING (x) GROUP BY r, k),
common AS (
  SELECT b.r, list(coalesce(h.n, 0) ORDER BY g.k) AS known, any_value(b.n_words) - sum(coalesce(h.n, 0)) AS rest
  FROM base b CROSS JOIN (SELECT unnest(range(1, {len(q.COMMON) + 1})) AS k) g LEFT JOIN hits h ON h.r = b.r AND h.k = g.k GROUP BY b.r),
counted AS (SELECT b.*, list_append(known, rest) AS words FROM base b JOIN common c ON b.r = c.r),
sums AS (
  SELECT lang, (SELECT list(x ORDER BY i) FROM (SELECT i, sum(y) AS x FROM (SELECT generate_subscripts(chars, 1) AS i, unnest(chars) AS y FROM counted k WHERE k.lang IS NOT DISTINCT FROM l.lang) GROUP BY i)) AS c,
         (SELECT list(x ORDER BY i) FROM (SELECT i, sum(y) AS x FROM (SELECT generate_subscripts(words, 1) AS i, unnest(words) AS y FROM counted k WHERE k.lang IS NOT DISTINCT FROM l.lang) GROUP BY i)) AS d
  FROM (SELECT DISTINCT lang FROM counted) l),
shares AS (SELECT lang, list_transform(c, lambda x: CAST(x AS DOUBLE) / greatest(CAST(list_sum(c) AS DOUBLE), 1)) AS c, list_transform(d, lambda x: CAST(x AS DOUBLE) / greatest(CAST(list_sum(d) AS DOUBLE), 1)) AS d FROM sums),
parts AS (
  SELECT k.*, s.c AS rc, s.d AS rd, list_transform(chars, lambda x: CAST(x AS DOUBLE) / nullif(CAST(list_sum(chars) AS DOUBLE), 0)) AS pc, list_transform(words, lambda x: CAST(x AS DOUBLE) / nullif(CAST(list_sum(words) AS DOUBLE), 0)) AS pd
  FROM counted k JOIN shares s ON k.lang IS NOT DISTINCT FROM s.lang),
far AS (SELECT *, coalesce({distance.format(p='pc', r='rc')}, 0) AS char_distance, coalesce({distance.format(p='pd', r='rd')}, 0) AS word_distance, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEATED_PERCENT} * n_words AS base_failed FROM parts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {q.SURE_WORDS} OR (char_distance <= {q.CHAR_LIMIT} AND word_distance <= {q.WORD_LIMIT} + {q.WORD_NOISE} / sqrt(n_words))) AS kept FROM far
"""


def _op3() -> str:
    word = lambda c, x: f"(CASE WHEN {c} >= 1 THEN w[{c}] END IS NOT DISTINCT FROM '{x}')"
    places = lambda ws: f"list_filter(range(len(w)), lambda i: {' AND '.join(word(f'i + {k + 1}', x) for k, x in enumerate(ws))})"
    base = ", ".join(f"{places(phrase.split())} AS b{k}" for k, (phrase, _) in enumerate(m.PHRASES))
    scores = []
    for k, (_, passage, key) in enumerate(m.TEMPLATES):
        body, key = passage.split(), key.split()
        at = next(j for j in range(len(body)) if body[j : j + len(key)] == key)
        same = " + ".join(f"CAST({word(f'i + {j - at + 1}', x)} AS INT)" for j, x in enumerate(body))
        scores.append(f"list_max(list_transform({places(key)}, lambda i: ({same}) / CAST({len(body)} AS DOUBLE))) AS s{k}")
    labels = ", ".join(f"CASE WHEN s{k} >= {m.IN_PLACE} THEN '{label}' END" for k, (label, _, _) in enumerate(m.TEMPLATES))
    best = ", ".join(f"CASE WHEN s{k} >= {m.IN_PLACE} THEN s{k} END" for k in range(len(m.TEMPLATES)))
    bases = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(m.PHRASES))
    every = " || ".join(f"b{k}" for k in range(len(m.PHRASES)))
    return rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
met AS (SELECT doc_id, w, {base}, {', '.join(scores)} FROM split),
named AS (SELECT *, {every} AS places, list_filter([{bases}], lambda x: x IS NOT NULL) AS own, list_filter([{labels}], lambda x: x IS NOT NULL) AS more, greatest(0, CASE WHEN len({every}) > 0 THEN 1 END, {best}) AS top FROM met)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(own)), ',') AS base_labels, array_to_string(list_sort(list_distinct(own || more)), ',') AS labels, CAST(top AS DOUBLE) AS score FROM named
"""


SHARDING = """
WITH RECURSIVE
-- the table of the checksum's reversed polynomial, a bit at a time
bits(b, c, k) AS (SELECT b, b, 0 FROM range(256) AS s(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS table_ FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
bytes AS (SELECT r, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM docs),
sums AS (SELECT r, xor(list_reduce(b, lambda c, x: xor(c >> 8, table_[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc),
drawn AS (
  SELECT r, doc_id, octet_length(encode(t)) + 16 AS size,
         list_transform(range(41), lambda k: -ln((CAST(CAST('0x' || substr(md5('shard:' || k || ':' || coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)) AS s FROM docs),
held AS (SELECT r, doc_id, size, list_position(s[1:40], list_min(s[1:40])) - 1 AS shard, list_position(s, list_min(s)) - 1 AS grown_shard FROM drawn)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM held JOIN sums USING (r)
"""

WARC = """
WITH sent AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
-- five hexadecimal digits are four letters of base 32
named AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS d FROM sent),
first AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM named)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM first
"""

JACCARD = r"""
WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
rows AS (SELECT row_number() OVER () AS r, doc_id, w FROM split),
tokens AS (SELECT r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM rows),
four AS (SELECT r, x || ' ' || lead(x, 1) OVER u || ' ' || lead(x, 2) OVER u || ' ' || lead(x, 3) OVER u AS x FROM tokens WHERE n >= 4 WINDOW u AS (PARTITION BY r ORDER BY i)),
shingles AS (SELECT DISTINCT r, x FROM four WHERE x IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM rows WHERE len(w) BETWEEN 1 AND 3),
sets AS (SELECT r, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS name FROM shingles GROUP BY r),
named AS (SELECT doc_id, coalesce(n, 0) AS n, name, rows.r FROM rows LEFT JOIN sets ON rows.r = sets.r),
nodes AS (SELECT name, min(doc_id) AS node, any_value(n) AS n, min(r) AS r FROM named WHERE n > 0 GROUP BY name),
entries AS (SELECT node, n, hash(x) AS x FROM nodes JOIN shingles ON nodes.r = shingles.r),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS met, any_value(a.n) AS na, any_value(b.n) AS nb FROM entries a JOIN entries b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node),
links AS (SELECT a, b FROM shared WHERE 100 * met >= 85 * (na + nb - met)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM named d LEFT JOIN nodes ON d.name = nodes.name LEFT JOIN least ON nodes.node = least.node
"""

QUALITY, LICENSES = _op2(), _op3()

BLOCK_NAMES = r"""
WITH bared AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
ranked AS (
  SELECT doc_id, bare, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept FROM bared
  WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, sha256(bare) AS text_sha256 FROM ranked
"""

PREFIX_TRIE = r"""
WITH RECURSIVE
bits(b, c, k) AS (SELECT b, b, 0 FROM range(256) AS s(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS table_ FROM bits WHERE k = 8),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS own FROM own GROUP BY c),
plan AS (
  SELECT c, own, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: xor(s >> 8, table_[xor(s & 255, x) + 1])), 4294967295) % 9 AS h
  FROM convs, crc),
rebuilt AS (
  SELECT p.c, pos, role, text FROM plan p JOIN own o ON o.c = p.base AND o.pos < p.h
  UNION ALL SELECT p.c, least(p.h, coalesce(b.own, 0)) + o.pos - p.h, role, text FROM plan p JOIN own o ON o.c = p.c AND o.pos >= p.h LEFT JOIN convs b ON b.c = p.base),
turns AS (SELECT c, pos + 1 AS depth, octet_length(encode(text)) AS bytes, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos) AS path FROM rebuilt),
keyed AS (SELECT c, depth, bytes, md5(path) AS k FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
lens AS (SELECT c, max(depth) AS len FROM keyed GROUP BY c),
nodes AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n, min(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = len), '')) AS ends
  FROM keyed JOIN lens USING (c) GROUP BY depth, k),
up AS (SELECT n.depth, n.k, p.k AS pk FROM nodes n JOIN keyed p ON p.c = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n FROM up GROUP BY depth, pk),
below AS (
  SELECT a.depth, a.k, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM nodes n JOIN keyed a ON a.c = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k GROUP BY a.depth, a.k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN up ON up.depth = n.depth AND up.k = n.k LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = up.pk
"""
