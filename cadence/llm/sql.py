"""DuckDB SQL of the operators that SQL can express, on the tables of the driver."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
WORD7 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i - 1 AS line_no, list_extract(l, i) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), used AS (
  SELECT *, dense_rank() OVER (ORDER BY line) AS id FROM lines WHERE regexp_matches(line, '{WORD}')
), texts AS (
  SELECT DISTINCT id, line, length(line) AS n FROM used WHERE length(line) >= 10
), links AS (
  SELECT a.id AS a, b.id AS b FROM texts a JOIN texts b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.id < b.id AND levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 10)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, r) AS (
  SELECT DISTINCT a, a FROM both_ways UNION SELECT reach.id, b FROM reach JOIN both_ways ON reach.r = both_ways.a
), class AS (
  SELECT id, min(r) AS c FROM reach GROUP BY id
), placed AS (
  SELECT used.doc_id, used.line_no, coalesce(class.c, used.id) AS c FROM used LEFT JOIN class USING (id)
), firsts AS (
  SELECT c, min(doc_id) AS first_doc, arg_min(line_no, doc_id * 1000000 + line_no) AS first_line FROM placed GROUP BY c
)
SELECT p.doc_id, p.line_no, f.first_doc, f.first_line, (p.doc_id = f.first_doc AND p.line_no = f.first_line) AS kept
FROM placed p JOIN firsts f USING (c)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{WORD7}'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {AZ}), '{WORD7}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item, 10 AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM items, unnest(range(1, len(w) - 8)) AS u(i) WHERE len(w) >= 10
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 9
), grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, greatest(1, len(w) - n + 2))) AS u(i)
), hits AS (
  SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, g)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY 1
), met AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN met USING (doc_id)
"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM sized GROUP BY source
), capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / w AS ratio FROM src
), tried AS (
  SELECT *, row_number() OVER o AS rn, (1.5::DOUBLE * sum(source_size) OVER () - (sum(lim) OVER o - lim)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM capped WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), target AS (
  SELECT source, source_size, least(w * (SELECT arg_min(level, rn) FROM tried WHERE level <= ratio), lim) AS target FROM capped
), plan AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS extra FROM target
), mass AS (
  SELECT source, h, sum(size) AS m FROM sized WHERE size > 0 GROUP BY 1, 2
), run AS (
  SELECT *, sum(m) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS r FROM mass
), ends AS (
  SELECT run.source, arg_min(CASE WHEN r + r - m < 2 * extra THEN h ELSE h - 1 END, h) AS t FROM run JOIN plan ON run.source IS NOT DISTINCT FROM plan.source WHERE r > extra AND extra > 0 GROUP BY 1
), cut AS (
  SELECT plan.*, coalesce(t, CASE WHEN extra > 0 THEN 1152921504606846975 ELSE -1 END) AS t FROM plan LEFT JOIN ends ON ends.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CAST(h <= t AS INTEGER)) AS BIGINT) AS taken
FROM sized JOIN cut ON sized.source IS NOT DISTINCT FROM cut.source
"""


def quality_rules(cutoffs: dict[str, tuple[float, ...]], alpha: float, delta: float) -> str:
    """Base counts, and the cutoffs by the exact binomial tail."""
    tests = "UNION ALL ".join(f"SELECT stratum, '{rule}' AS rule, {c} AS cutoff, count(*) AS n, count(*) FILTER ({rule} > {c}) AS k FROM good GROUP BY 1 " for rule, cs in cutoffs.items() for c in cs)
    n_tests = sum(map(len, cutoffs.values()))
    hit = " OR ".join(f"coalesce(m.{rule} > (SELECT min(cutoff) FROM safe WHERE safe.rule = '{rule}' AND safe.stratum = m.stratum), false)" for rule in cutoffs)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))))"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM base
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + 4), ' ')) AS n FROM base, unnest(range(1, greatest(1, len(w) - 3))) AS u(i)
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM grams, unnest(range(i, i + 5)) AS u(p) WHERE n > 1 GROUP BY 1
), counted AS (
  SELECT b.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    len(regexp_extract_all(text, '!')) AS bangs, len(regexp_extract_all(text, '[A-Z]')) AS uppers, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS bare
  FROM base b JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), m AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(bangs / nullif(word_chars, 0), 0) AS bang_share, coalesce(uppers / nullif(word_chars, 0), 0) AS upper_share,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(bare / nullif(n_words, 0), 0) AS bare_word_share
  FROM counted
), good AS (
  SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1)
), tests AS (
  {tests}
), safe AS (
  SELECT * FROM tests WHERE k <= n * {alpha} AND {tail} <= {delta} / ({n_tests} * (SELECT count(DISTINCT stratum) FROM good))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({hit}) AS kept FROM m
"""

TERM13 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {AZ}), '{TERM13}')) AS term FROM documents WHERE text IS NOT NULL
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), stats AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {AZ}), '{TERM13}')) AS term FROM benchmark WHERE text IS NOT NULL
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats
), placed AS (
  SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM lengths, stats
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN placed USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

#: CRC-32 of a string of ASCII characters, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))), 4294967295::UBIGINT)"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS h,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS words FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list(h ORDER BY p) AS hs, list(words ORDER BY p) AS ws FROM turns GROUP BY conv_id
), heads AS (
  SELECT c.conv_id, c.hs, c.ws, CAST({CRC32.format("c.conv_id")} % 4 AS BIGINT) AS h, b.hs AS bhs, b.ws AS bws FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), built AS (
  SELECT conv_id, list_concat(coalesce(list_slice(bhs, 1, h), []), list_slice(hs, h + 1, len(hs))) AS hs, list_concat(coalesce(list_slice(bws, 1, h), []), list_slice(ws, h + 1, len(ws))) AS ws FROM heads
), places AS (
  SELECT conv_id, d, len(hs) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words, md5(array_to_string(list_slice(hs, 1, d), ',')) || '-' || d AS node,
         CASE WHEN d > 0 THEN md5(array_to_string(list_slice(hs, 1, d - 1), ',')) || '-' || (d - 1) END AS up FROM built, unnest(range(0, len(hs) + 1)) AS u(d)
), nodes AS (
  SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM places GROUP BY node
), kids AS (
  SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT DISTINCT a.node, b.node AS inner_node FROM places a JOIN places b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT below.node, count(*) FILTER (kids.node IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens FROM below JOIN nodes n ON n.node = below.inner_node LEFT JOIN kids ON kids.node = below.inner_node GROUP BY below.node
)
SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves, sums.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes parent ON parent.node = n.up LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node
"""
