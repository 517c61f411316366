"""SQL fragments that several oracle queries share."""

from .text import IES_WORDS, STOPWORDS


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def stem_sql(t: str) -> str:
    """The stem of a token, as a CASE over two rounds."""
    first = (
        f"CASE WHEN {t} LIKE '%sses' THEN left({t}, -2)"
        f" WHEN regexp_matches({t}, '(ches|shes|xes)$') AND length({t}) > 4 THEN left({t}, -2)"
        f" WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN left({t}, -3) || 'y'"
        f" WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is|as)$') AND length({t}) > 3 THEN left({t}, -1)"
        f" ELSE {t} END"
    )
    bare = lambda w: (
        f"CASE WHEN length({w}) >= 2 AND right({w}, 1) = substr({w}, length({w}) - 1, 1)"
        f" AND NOT contains('aeioulsz', right({w}, 1)) THEN left({w}, -1) ELSE {w} END"
    )
    w = f"({first})"
    second = (
        f"CASE WHEN {w} LIKE '%ing' AND length({w}) > 6 AND regexp_matches(left({w}, -3), '[aeiou]')"
        f" THEN {bare(f'left({w}, -3)')}"
        f" WHEN {w} LIKE '%ed' AND length({w}) > 5 AND regexp_matches(left({w}, -2), '[aeiou]')"
        f" THEN {bare(f'left({w}, -2)')} ELSE {w} END"
    )
    return f"CASE WHEN {t} IN ({quoted(IES_WORDS)}) THEN {t} ELSE {second} END"


def tokens_sql(key: str, table: str, text: str = "text") -> str:
    """SELECT of (key, pos, token) for every content token."""
    return (
        f"SELECT {key}, pos, token FROM (SELECT {key}, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM"
        f" (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {table}))"
        f" WHERE length(token) >= 2 AND token NOT IN ({quoted(STOPWORDS)})"
    )


def terms_sql(key: str, table: str, text: str = "text") -> str:
    return f"SELECT {key}, pos, {stem_sql('token')} AS term FROM ({tokens_sql(key, table, text)})"


def bm25_sql(k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> str:
    """CTEs that end in scored(item_id, doc_id, score): every document that shares a term with a query."""
    return f"""
    dterms AS ({terms_sql('doc_id', 'documents')}),
    post AS (SELECT doc_id, term, count(*) AS tf FROM dterms GROUP BY ALL),
    lens AS (SELECT d.doc_id, count(t.doc_id) AS len FROM documents d LEFT JOIN dterms t USING (doc_id) GROUP BY 1),
    tot AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, tot GROUP BY term, n),
    mean AS (SELECT avg(idf) AS m FROM raw),
    idfs AS (SELECT term, CASE WHEN idf < 0 THEN {eps} * m ELSE idf END AS idf FROM raw, mean),
    qterms AS (SELECT item_id, term, count(*) AS times FROM ({terms_sql('item_id', 'benchmark')}) GROUP BY ALL),
    scored AS (SELECT item_id, doc_id,
        sum(times * idf * (tf * ({k1} + 1)) / (tf + {k1} * (1 - {b} + {b} * len / avgdl))) AS score
      FROM qterms JOIN post USING (term) JOIN idfs USING (term) JOIN lens USING (doc_id), tot GROUP BY 1, 2)"""
