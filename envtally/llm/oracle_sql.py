"""DuckDB SQL for the rows of queries that SQL can express."""

URL_FILTER = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM r
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END
    WHEN host LIKE '%spam-____.%' AND path LIKE '/%' OR host LIKE '%cheap-%.example.%' OR host LIKE 'ads-%' AND path LIKE '/__/%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM j
"""

FIXITY = r"""
WITH t AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id,
    '>', chr(13), chr(10), 'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Target-URI: ',
    replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, '')) AS text FROM pages
), r AS (
  SELECT *, CASE WHEN page_id % 101 = 7 THEN concat(left(text, length(text) - 1), '~')
    WHEN page_id % 103 = 9 THEN left(text, length(text) // 2) ELSE text END AS rotten FROM t
), d AS (
  SELECT page_id, strlen(text) + 4 AS length, sha256(concat(text, chr(13), chr(10), chr(13), chr(10))) AS expected,
    sha256(concat(rotten, chr(13), chr(10), chr(13), chr(10))) AS found FROM r
), o AS (
  SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, expected) - 1 AS i FROM d
), f AS (
  SELECT *, i // 256 AS file, CAST(i % 256 AS INTEGER) AS ordinal,
    CAST(coalesce(sum(length) OVER (PARTITION BY i // 256 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM o
), g AS (SELECT *, file % 5 = 3 AND ordinal >= 200 AS lost FROM f)
SELECT page_id, file, ordinal, "offset", length, expected, CASE WHEN lost THEN NULL ELSE found END AS found,
  CASE WHEN lost THEN 'missing' ELSE 'altered' END AS damage
FROM g WHERE lost OR expected <> found
"""

# Those of the operator's module, as literals of SQL.
QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), c AS (
  SELECT *, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, length(text) AS chars,
    length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS upper_,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS symbol_,
    length(text) - length(regexp_replace(text, '[^\p{L}\p{Nd}\x20\x09-\x0D#*$%&|<>]+', '', 'g')) AS mark_,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), k AS (SELECT *, lang AS ref FROM c),
sums AS (SELECT ref, sum(n_words) AS reference_words FROM k GROUP BY ref HAVING sum(n_words) > 0),
med AS (
  SELECT ref, quantile_cont(upper_ * 1000 // chars, 0.5) / 1000 AS u, quantile_cont(symbol_ * 1000 // chars, 0.5) / 1000 AS s,
    quantile_cont(mark_ * 1000 // chars, 0.5) / 1000 AS m, quantile_cont((chars - word_chars) * 1000 // chars, 0.5) / 1000 AS b
  FROM k WHERE chars > 0 GROUP BY ref
), w AS (SELECT rid, ref, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM k),
freq AS (
  SELECT w.ref, word, count(*) AS n FROM w WHERE length(word) <= 6 AND regexp_full_match(word, '\p{L}+') GROUP BY w.ref, word
), top AS (
  SELECT f.ref, word, n, row_number() OVER (PARTITION BY f.ref ORDER BY n DESC, encode(word)) AS rank
  FROM freq f JOIN sums s ON f.ref IS NOT DISTINCT FROM s.ref WHERE n * 1000 >= reference_words
), common AS (
  SELECT t.*, CAST(n AS DOUBLE) / reference_words AS share FROM top t JOIN sums s ON t.ref IS NOT DISTINCT FROM s.ref WHERE rank <= 16
), refs AS (
  SELECT s.*, r.known FROM sums s LEFT JOIN (SELECT ref, sum(n) AS known FROM common GROUP BY ref) r ON s.ref IS NOT DISTINCT FROM r.ref
), windows AS (
  SELECT rid, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
), again AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM again WHERE n > 1) GROUP BY rid
), hits AS (
  SELECT w.rid, w.ref, w.word, count(*) AS n FROM w JOIN common c ON w.word = c.word AND w.ref IS NOT DISTINCT FROM c.ref GROUP BY ALL
), pairs AS (
  SELECT k.rid, c.rank AS bucket, coalesce(h.n, 0) / CAST(k.n_words AS DOUBLE) AS p, c.share AS q
  FROM k JOIN common c ON k.ref IS NOT DISTINCT FROM c.ref LEFT JOIN hits h ON h.rid = k.rid AND h.word = c.word
  WHERE k.n_words > 0
  UNION ALL
  SELECT k.rid, 99, (k.n_words - coalesce(h.n, 0)) / CAST(k.n_words AS DOUBLE), (r.reference_words - r.known) / CAST(r.reference_words AS DOUBLE)
  FROM k JOIN refs r ON k.ref IS NOT DISTINCT FROM r.ref LEFT JOIN (SELECT rid, sum(n) AS n FROM hits GROUP BY rid) h ON h.rid = k.rid
  WHERE k.n_words > 0 AND r.known IS NOT NULL
), wd AS (
  SELECT rid, sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS d
  FROM pairs GROUP BY rid
), classes AS (
  SELECT k.rid, unnest([upper_ / CAST(chars AS DOUBLE), symbol_ / CAST(chars AS DOUBLE), mark_ / CAST(chars AS DOUBLE),
      (chars - word_chars) / CAST(chars AS DOUBLE),
      greatest(0, 1 - upper_ / CAST(chars AS DOUBLE) - symbol_ / CAST(chars AS DOUBLE) - mark_ / CAST(chars AS DOUBLE) - (chars - word_chars) / CAST(chars AS DOUBLE))]) AS p,
    unnest([u, s, m, b, greatest(0, 1 - u - s - m - b)]) AS q
  FROM k JOIN med ON k.ref IS NOT DISTINCT FROM med.ref WHERE chars > 0
), cd AS (
  SELECT rid, sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS d
  FROM classes GROUP BY rid
), z AS (
  SELECT k.doc_id, k.n_words, k.word_chars, k.symbol_ AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, k.chars, r.reference_words, cd.d AS cdist, wd.d AS wdist
  FROM k LEFT JOIN refs r ON k.ref IS NOT DISTINCT FROM r.ref LEFT JOIN rep USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (coalesce(reference_words, 0) >= 1000 AND chars >= 200 AND coalesce(cdist > 0.16, false))
  AND NOT (coalesce(reference_words, 0) >= 1000 AND n_words >= 50 AND coalesce(wdist > 0.4, false)) AS kept
FROM b
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents),
g AS (SELECT doc_id, normal, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY normal))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM g
"""
