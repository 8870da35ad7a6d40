"""Fragments shared by the DuckDB statements."""

from .. import vocab


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def tokens(column: str, stop=vocab.STOP_WORDS) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), {text(vocab.TOKEN)}), lambda t: length(t) > 1 AND NOT list_contains({listed(sorted(set(stop)))}, t))"


SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{SPACE}+'), lambda w: w <> '')"


def occurrences(column: str, phrase: str) -> str:
    return f"CAST((length({column}) - length(replace({column}, {text(phrase)}, ''))) / {len(phrase)} AS INTEGER)"


def any_of(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in phrases) + ")"


def present(column: str, phrases) -> str:
    return "(" + " + ".join(f"contains({column}, {text(p)})::INTEGER" for p in phrases) + ")"


#: Distinct rows of the tables that repeat rows, and the query set of searches (ids divisible by 20).
CHUNKS = "(SELECT DISTINCT * FROM chunks)"
RANKED = "(SELECT DISTINCT * FROM ranked_chunks)"
RESPONSES = "(SELECT DISTINCT * FROM rag_responses)"
QUESTIONS = "(SELECT DISTINCT query_id, question AS text FROM rag_responses WHERE question IS NOT NULL AND CAST(substr(query_id, 2) AS BIGINT) % 20 = 0)"


def bm25(docs: str, queries: str, k: int, key: str = "key", allowed: str = "") -> str:
    """Statement equal to ``operators.bm25.search``."""
    return f"""
WITH indexed AS (SELECT key, tok FROM (SELECT key, {tokens("text")} AS tok FROM {docs}) WHERE len(tok) > 0),
size AS (SELECT count(*) AS n_docs, avg(len(tok)) AS avg_len FROM indexed),
freq AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tok)) AS term FROM indexed) GROUP BY ALL),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM freq, size),
weights AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM {queries}) GROUP BY ALL),
tf AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(tok) AS dl, unnest(tok) AS term FROM indexed) GROUP BY ALL),
scored AS (SELECT query_id, key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
  FROM tf JOIN asked USING (term) JOIN weights USING (term) {allowed} CROSS JOIN size GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT query_id, key AS {key}, score, rank FROM ranked WHERE rank <= {k}"""
