"""SQL that gives the rows of the registered queries, by plain definitions instead of the methods."""

from __future__ import annotations

from tidemark.llm import line_rules

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# what Python calls white space, in a pattern where \s is ASCII only
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace(r"\s", _SPACE) + "'"


def _run(n: int) -> str:
    """The `n` words from a word on, fewer at the end of a text."""
    return "concat_ws(' ', word, " + ", ".join(f"lead(word, {i}) OVER w" for i in range(1, n)) + ")"


def _words(pattern: str, text: str, table: str, key: str) -> str:
    return f"""SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table})"""


WARC = """WITH r AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_page FROM r)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN last_page > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last_page > page_id THEN last_page END AS refers_to FROM o"""

JACCARD = f"""WITH RECURSIVE w AS ({_words(_WORD, f"translate(text, {_AZ})", "documents", "doc_id")}),
  n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY 1),
  runs AS (SELECT doc_id, pos, {_run(5)} AS run FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  s AS (SELECT DISTINCT doc_id, hash(run) AS h1, md5_number(run) AS h2 FROM runs JOIN n USING (doc_id) WHERE pos <= greatest(n_words - 4, 1)),
  c AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY 1),
  met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.h1 = b.h1 AND a.h2 = b.h2 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM met JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n_shingles + y.n_shingles - both_have)),
  reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other),
  least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN least_of USING (doc_id)"""

LINE_DEDUP = rf"""WITH raw AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM raw),
  t AS (SELECT *, regexp_replace(line, '^{_BLANK}|{_BLANK}$', '', 'g') AS trimmed, len(regexp_extract_all(line, '{_WORD}')) AS n_words FROM l),
  b AS (SELECT trimmed, min(doc_id) AS first_doc FROM t WHERE n_words >= 1 GROUP BY 1 HAVING count(DISTINCT site) >= CASE WHEN max(n_words) >= 3 THEN 3 ELSE 6 END),
  j AS (SELECT t.*, coalesce(first_doc <> doc_id AND n_words >= 1, false) AS gone FROM t LEFT JOIN b USING (trimmed)),
  d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN d USING (doc_id)"""

LINE_RULES = f"""WITH w AS ({_words(_WORD, "text", "documents", "doc_id")}),
  runs AS (SELECT doc_id, pos, word, {_run(5)} AS run, lead(word, 4) OVER w IS NOT NULL AS whole FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs WHERE whole) WHERE n > 1),
  again AS (SELECT doc_id, count(DISTINCT pos + i) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS i) GROUP BY 1),
  counts AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w GROUP BY 1),
  raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT * FROM (SELECT doc_id, line, pos, regexp_extract_all(line, '{_WORD}') AS ws FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM raw)) WHERE len(ws) > 0),
  f AS (SELECT doc_id, length(array_to_string(ws, '')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
      len(ws) <= {line_rules.BOILERPLATE_WORDS} AND regexp_matches(line, {_quoted(line_rules.BOILERPLATE)})
      OR len(ws) >= 3 AND len(regexp_extract_all(line, {_quoted(line_rules.SEPARATORS)})) >= {line_rules.SEPARATOR_SHARE} * len(ws)
      OR NOT regexp_matches(line, {_quoted(line_rules.SENTENCE_END)})
      OR len(ws) >= 5 AND (len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > {line_rules.SYMBOL_SHARE} * len(ws)
        OR len(list_filter(ws, lambda x: x LIKE '%!' AND upper(x) = x)) > {line_rules.SHOUTED_SHARE} * len(ws)) AS fails FROM l),
  d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lines_removed,
      coalesce(sum(chars) FILTER (WHERE NOT fails), 0)::BIGINT AS kept_word_chars FROM f GROUP BY 1),
  whole AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(kept_word_chars, 0) AS kept_word_chars
    FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN again USING (doc_id)),
  base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM whole)
SELECT *, NOT base_failed AND 2 * (word_chars - kept_word_chars) <= word_chars AS kept FROM base"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""WITH w AS ({_words(_ALNUM, f"translate(text, {_AZ})", "documents", "doc_id")}),
  n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY 1),
  runs AS (SELECT doc_id, pos, word, {_run(13)} AS run FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  i AS (SELECT item_id::VARCHAR AS item_id, word, pos FROM ({_words(_ALNUM, f"translate(text, {_AZ})", "benchmark", "item_id")})),
  sized AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
  iw AS (SELECT item_id, least(n, 13) AS n, word, run FROM (SELECT item_id, pos, word, {_run(13)} AS run FROM i WINDOW w AS (PARTITION BY item_id ORDER BY pos)) JOIN sized USING (item_id)
    WHERE pos <= greatest(n - 12, 1)),
  met AS (SELECT doc_id, pos, n, item_id FROM runs JOIN iw ON runs.run = iw.run AND n = 13
    UNION ALL SELECT doc_id, pos, n, item_id FROM runs JOIN iw ON runs.word = iw.word AND n < 13 AND starts_with(runs.run || ' ', iw.run || ' ')),
  hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM (SELECT DISTINCT doc_id, pos, n FROM met)) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= n_words, false) AS contaminated
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

# seed 7, as the query's default
MIXING = f"""WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
  by_source AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * sqrt(size::DOUBLE)) AS moment FROM z GROUP BY 1),
  weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM by_source),
  filled AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS everything, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open, coalesce(sum(cap) OVER before, 0) AS filled
    FROM weighed WINDOW before AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  level AS (SELECT arg_min(l, cap / weight) AS l FROM (SELECT *, (everything - filled) / open AS l FROM filled) WHERE l * weight <= cap),
  targets AS (SELECT source, source_size, moment, least(cap, coalesce((SELECT l FROM level) * weight, cap))::DOUBLE AS target FROM filled),
  t AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12::DOUBLE), 2)::BIGINT ELSE 0 END AS sure FROM targets),
  r AS (SELECT *, greatest(target - sure * source_size, 0.0::DOUBLE) AS rest FROM t),
  drawn AS (SELECT doc_id, size, z.source, source_size, target, sure, rest,
      (('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, z.source)), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u,
      least(greatest(rest * sqrt(size::DOUBLE) / moment, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p
    FROM z JOIN r ON z.source IS NOT DISTINCT FROM r.source),
  ranked AS (SELECT *, CASE WHEN rest > 0 AND size > 0 AND sure < 2 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM drawn),
  summed AS (SELECT *, sum(size) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM ranked)
SELECT doc_id, size, source_size, target, (sure + CASE WHEN rank IS NOT NULL AND (upto <= rest OR (rest > upto - size AND upto - rest <= rest - (upto - size))) THEN 1 ELSE 0 END) * size AS taken FROM summed"""

_HEX8 = "('0x' || substr(h, {}, 8))::BIGINT"
FILL_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  c AS (SELECT *, {_HEX8.format(1)} % (n + 1) AS x, {_HEX8.format(9)} % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_HEX8.format(17)} % 100 >= 90 THEN 'plain'
      WHEN {_HEX8.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT *, t[1:least(x, y)] AS prefix, t[least(x, y) + 1:greatest(x, y)] AS middle, t[greatest(x, y) + 1:] AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

# crc32 by its table of 256 remainders; pairs of words meet by what is left of them without one letter
SPELLING = rf"""WITH RECURSIVE bits AS (SELECT i AS slot, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
    UNION ALL SELECT slot, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
  crc AS (SELECT list(c ORDER BY slot) AS t FROM bits WHERE k = 8),
  runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
  coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
  hashed AS (SELECT run, times, xor(4294967295::BIGINT, list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM coded, crc),
  kept AS (SELECT times, CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
  v AS (SELECT word, sum(times)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
  cut AS (SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS rest, i FROM v, unnest(range(1, length(word) + 1)) u(i)),
  met AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT v.word, cut.word, cut.n FROM v JOIN cut ON v.word = cut.rest
    UNION SELECT cut.word, v.word, v.n FROM v JOIN cut ON v.word = cut.rest),
  best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, encode(near))) AS first FROM met GROUP BY 1),
  forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN first END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
  chain AS (SELECT word, coalesce(form, word) AS spot, form IS NULL AS done FROM forms
    UNION ALL SELECT c.word, coalesce(f.form, c.spot), f.form IS NULL FROM chain c JOIN forms f ON f.word = c.spot WHERE NOT c.done)
SELECT word, form, spot AS root, n, n_near, form_n FROM forms JOIN (SELECT word, spot FROM chain WHERE done) USING (word)"""

ORACLES = {
    "op1_warc": WARC,
    "op2_jaccard": JACCARD,
    "op4_line_dedup": LINE_DEDUP,
    "op6_line_rules": LINE_RULES,
    "op7_decontaminate": DECONTAMINATE,
    "op10_mixing": MIXING,
    "op11_spelling": SPELLING,
    "op13_fill_middle": FILL_MIDDLE,
}
