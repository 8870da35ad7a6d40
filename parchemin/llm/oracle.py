"""DuckDB statements equal to the queries that SQL can express."""

WORD = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LINES = r"""
lines AS (
  SELECT chunk_id, document_path, split_part(document_path, '/', 2) AS site, k AS line_no,
    regexp_replace(lower(trim(regexp_replace(parts[k], '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT DISTINCT chunk_id, document_path, string_split(text, chr(10)) AS parts FROM chunks WHERE document_path IS NOT NULL))),
support AS (SELECT site, line, count(DISTINCT document_path) AS n FROM lines WHERE line <> '' GROUP BY ALL),
totals AS (SELECT split_part(document_path, '/', 2) AS site, count(DISTINCT document_path) AS total FROM chunks WHERE document_path IS NOT NULL GROUP BY ALL)"""

_FORMS = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}\x{2011}\x{FB00}-\x{FB06}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{1D400}-\x{1D7FF}\x{AD}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
_RECORDS = "(SELECT 'chunk' AS record_type, chunk_id AS record_id, text FROM chunks UNION SELECT 'answer', query_id, answer FROM rag_responses)"

ORACLE = {
    "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '{WORD}')) > 600",
    "p2_found": r"""
WITH texts AS (SELECT DISTINCT chunk_id, text FROM (SELECT chunk_id, text FROM chunks UNION ALL SELECT chunk_id, text FROM ranked_chunks) WHERE text IS NOT NULL),
words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts),
shingles AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) AS s FROM words),
sizes AS (SELECT chunk_id, count(*) AS n FROM shingles GROUP BY ALL),
common AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_id_a, chunk_id_b FROM common c JOIN sizes x ON x.chunk_id = chunk_id_a JOIN sizes y ON y.chunk_id = chunk_id_b WHERE c.n >= 0.6 * (x.n + y.n - c.n)
UNION SELECT a.chunk_id, b.chunk_id FROM texts a JOIN texts b ON a.text = b.text AND a.chunk_id < b.chunk_id""",
    "p6_found": rf"""
SELECT DISTINCT record_type, record_id FROM {_RECORDS} WHERE regexp_matches(text, '{_FORMS}') OR nfc_normalize(text) <> text
OR len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '[\p{{Cyrillic}}\p{{Greek}}]'))) > 0""",
    "p5_found": f"""WITH {_LINES}
SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN support USING (site, line) JOIN totals USING (site) WHERE n >= 4 AND n >= 0.05 * total""",
}
