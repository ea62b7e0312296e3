r"""The registered queries in DuckDB SQL, where SQL can express them."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TOKENS}) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_TOKENS}) AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(x) AS n FROM iw),
hit AS (
  SELECT DISTINCT doc_id, s, len(x) AS n, item_id
  FROM (SELECT doc_id, s, w[s:s + n - 1] AS x
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths))
  JOIN iw USING (x)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = r"""
WITH c AS (
  SELECT page_id, (page_id % 365)::INT AS day,
    coalesce(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.'), '') AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM pages
), h AS (
  SELECT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS m FROM (SELECT DISTINCT host FROM c WHERE host <> '')
), e AS (
  SELECT *, ['ads', 'adult', 'malware'][m % 3 + 1] AS category, (m % 200)::INT AS d,
    regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS parent FROM h
), changes AS (
  SELECT host AS key, category, d AS day, 0 AS removed FROM e WHERE m % 5 = 0
  UNION ALL SELECT host, category, d + 60, 1 FROM e WHERE m % 15 = 0
  UNION ALL SELECT parent, category, d + 30, 0 FROM e WHERE m % 11 = 0
  UNION ALL SELECT parent, category, d + 40, 1 FROM e WHERE m % 11 = 0
  UNION ALL SELECT host || '/fr', category, d, 0 FROM e WHERE m % 7 = 0
), daily AS (
  SELECT key, category, day, max(removed) AS removed FROM changes GROUP BY ALL
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS until FROM daily
), hits AS (
  SELECT DISTINCT page_id, category FROM c JOIN spans s ON removed = 0
    AND (host = key OR ends_with(host, '.' || key) OR starts_with(host || path || '/', key || '/'))
    AND s.day <= c.day AND (until IS NULL OR c.day < until)
  WHERE host <> '' AND (strpos(key, '.') > 0 OR host = key)
)
SELECT c.page_id, host, c.day, coalesce(array_to_string(list_sort(cats), ','), '') AS categories,
  cats IS NOT NULL AS blocked
FROM c LEFT JOIN (SELECT page_id, list(category) AS cats FROM hits GROUP BY 1) USING (page_id)
"""

_LINE_END = r"""[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$"""
_NAVIGATION = r"^[^.!?]{0,40}([|»›>•·/][^.!?|»›>•·/]{1,30}){2,}$"
_BOILERPLATE = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)"
    r"|accept (all )?cookies|subscribe to our|sign up for our|javascript is (disabled|required)"
    r"|click here to|lorem ipsum"
)

OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, x) AS n
  FROM (SELECT doc_id, s, w[s:s + 7] AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d))
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat
  FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, lines,
    list_filter(lines, lambda x: regexp_matches(x, '{_LINE_END}')
      AND (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100 <= length(x) * 10
      AND NOT regexp_matches(x, '{_NAVIGATION}') AND NOT regexp_matches(x, '{_BOILERPLATE}')) AS good
  FROM d LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  len(good)::BIGINT AS n_good_lines,
  n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND NOT
  ((length(array_to_string(lines, '')) - length(array_to_string(good, ''))) * 100
    > length(array_to_string(lines, '')) * 50) AS kept
FROM m
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"

#: CRC-32 of a string of ASCII letters: one byte after the other, eight shifts a byte.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''),"
    " lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b),"
    " [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))))"
)

OP12 = rf"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_LEAF.format(_FIELD.format("text"))} AS leaf,
    {_LEAF.format(_FIELD.format(_LOWER.format("text")))} AS lowered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER () AS k, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaf
), nodes AS (
  SELECT lang, 0 AS l, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, l + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, l, pos // 8, n
), subs AS (
  SELECT lang, h, count(*) OVER () AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS l, pos, n, h FROM subs
  UNION ALL
  SELECT l + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY l, pos // 8, n
), siblings AS (
  SELECT k, l, s.pos, s.h FROM placed p JOIN nodes s ON s.n > 1
    AND s.lang IS NOT DISTINCT FROM p.lang AND s.pos // 8 = p.pos // (8 ** (s.l + 1))::BIGINT
    AND s.pos <> p.pos // (8 ** s.l)::BIGINT
  UNION ALL
  SELECT k, 100 + l, s.pos, s.h FROM placed p JOIN subs b ON b.lang IS NOT DISTINCT FROM p.lang
    JOIN tops s ON s.n > 1 AND s.pos // 8 = b.pos // (8 ** (s.l + 1))::BIGINT
    AND s.pos <> b.pos // (8 ** s.l)::BIGINT
), proofs AS (
  SELECT k, sha256(string_agg(h, '' ORDER BY l, pos)) AS proof FROM siblings GROUP BY k
), folded AS (
  SELECT k, lang, 0 AS l, pos, n,
    CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN lowered ELSE leaf END AS cur FROM placed
  UNION ALL
  SELECT f.k, f.lang, f.l + 1, f.pos // 8, (f.n + 7) // 8,
    sha256(string_agg(CASE WHEN s.pos = f.pos THEN cur ELSE h END, '' ORDER BY s.pos))
  FROM folded f JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.l = f.l AND s.pos // 8 = f.pos // 8
  WHERE f.n > 1 GROUP BY f.k, f.lang, f.l, f.pos, f.n
), folded_top AS (
  SELECT k, 0 AS l, b.pos, b.n, cur FROM folded f JOIN subs b ON b.lang IS NOT DISTINCT FROM f.lang
  WHERE f.n = 1
  UNION ALL
  SELECT f.k, f.l + 1, f.pos // 8, (f.n + 7) // 8,
    sha256(string_agg(CASE WHEN s.pos = f.pos THEN cur ELSE h END, '' ORDER BY s.pos))
  FROM folded_top f JOIN tops s ON s.l = f.l AND s.pos // 8 = f.pos // 8
  WHERE f.n > 1 GROUP BY f.k, f.l, f.pos, f.n
)
SELECT doc_id, leaf, subs.h AS subroot, tops.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
  cur AS folded_root, cur = tops.h AS verified
FROM placed JOIN subs ON subs.lang IS NOT DISTINCT FROM placed.lang
JOIN tops ON tops.n = 1 JOIN folded_top t ON t.k = placed.k AND t.n = 1
LEFT JOIN proofs ON proofs.k = placed.k
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), x AS (
  SELECT doc_id, text, u, len(u) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS p,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS q,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT doc_id, text, n, form,
    array_to_string(u[1:least(p, q)], '') AS prefix,
    array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS middle,
    array_to_string(u[greatest(p, q) + 1:], '') AS suffix
  FROM x
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY x) AS n
  FROM (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM windows WHERE n > 1
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, c + s AS s, substr(part, 2 * s + 1, 100) AS x
  FROM (SELECT doc_id, c, part, unnest(range(0, least(500, length(part) // 2 - 49))) AS s
        FROM (SELECT doc_id, c, substr(h, 2 * c + 1, 1098) AS part
              FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS c FROM d)))
), firsts AS (
  SELECT x, min(doc_id) AS first FROM strings GROUP BY x HAVING count(*) > 1
), starts AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before
  FROM strings JOIN firsts USING (x) WHERE first < doc_id
), runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT *, sum((before IS NULL OR s > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM starts)
  GROUP BY doc_id, run
), cuts AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM runs
), kept AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS rest,
    string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
  coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _groups(k: int, num: int) -> str:
    """Components of documents whose sets of k-word shingles have a similarity of num / 100."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + {k - 1}], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS s FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= {num} * (x.n + y.n - s.n)
), reached AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT b, a FROM links
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
  FROM reached r JOIN links l ON r.other IN (l.a, l.b)
), least AS (
  SELECT doc_id, min(other) AS first FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


OP5 = _groups(4, 85)
OP11 = f"SELECT *, doc_id = component_id AS kept FROM ({_groups(5, 85)})"

ORACLES = {
    "op1_decontamination": OP1,
    "op2_url_filters": OP2,
    "op4_quality_rules": OP4,
    "op5_jaccard_join": OP5,
    "op6_substring_dedup": OP6,
    "op10_suffix_arrays": OP10,
    "op11_minhash": OP11,
    "op12_merkle_manifest": OP12,
    "op13_infilling": OP13,
}
