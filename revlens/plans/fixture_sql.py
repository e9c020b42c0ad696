"""DuckDB text of the derived fixtures, prepended as CTEs to oracle queries.

Independent of the Spark code in ``revlens.sources.fixtures``; both follow
FIXTURES.md.  ``with_fixtures`` adds only the CTEs a query mentions (and
their dependencies).
"""

from __future__ import annotations

import re

TOKEN_RE = r"[\p{L}\p{N}_''-]+|[^\p{L}\p{N}_\s''-]+"
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

FIXTURES: dict[str, str] = {}

FIXTURES["fx_reviews"] = """
SELECT doc_id AS review_id, text AS review,
       CASE WHEN doc_id % 97 = 5 THEN '#ERROR!'
            WHEN doc_id % 2 = 0 THEN text
            ELSE replace(text, chr(10), ' ') END AS review_translate,
       CASE WHEN doc_id % 53 = 7 THEN NULL ELSE CAST(1 + doc_id % 5 AS DOUBLE) END AS rating,
       source AS entity_name,
       CASE WHEN CAST(floor(doc_id / 5) AS BIGINT) % 10 < 6 THEN 'market'
            WHEN CAST(floor(doc_id / 5) AS BIGINT) % 10 < 7 THEN 'hotels'
            ELSE 'restaurants' END AS dataset_name,
       lang
FROM documents"""

# unified table = fx_reviews + title_translate (restaurants only) as the three
# raw sources produce it
FIXTURES["fx_unified"] = """
SELECT review_id, review, review_translate, rating, entity_name, dataset_name,
       CASE WHEN dataset_name = 'restaurants'
            THEN (CASE WHEN review_id % 4 = 0 THEN NULL ELSE substr(review, 1, 12) END)
            ELSE NULL END AS title_translate
FROM fx_reviews"""

FIXTURES["fx_clean0"] = """
SELECT review_id, review, review_translate, rating, entity_name, dataset_name,
       coalesce(title_translate, '') AS title_translate,
       NOT (review IS NOT DISTINCT FROM review_translate) AS translated
FROM fx_unified WHERE rating IS NOT NULL AND review IS NOT NULL"""

FIXTURES["fx_clean1"] = """
SELECT * FROM fx_clean0
WHERE length(review_translate) > (SELECT quantile_cont(length(review_translate), 0.002) FROM fx_clean0)
  AND review_translate <> '#ERROR!'
  AND abs(length(review) - length(review_translate)) < 200"""

FIXTURES["fx_clean"] = f"""
SELECT review_id, review,
       regexp_replace(
         regexp_replace(regexp_replace(
           regexp_replace(replace(regexp_replace(review_translate, '^{WS}+|{WS}+$', '', 'g'), chr(10), ''),
                          '^{WS}+|{WS}+$', '', 'g'),
           '([^\\p{{L}}\\p{{N}}'' ])', ' \\1 ', 'g'), '^{WS}+|{WS}+$', '', 'g'),
         '{WS}+', ' ', 'g') AS review_translate,
       rating, entity_name, dataset_name, title_translate, translated
FROM fx_clean1
WHERE length(regexp_replace(review_translate, '^{WS}+|{WS}+$', '', 'g')) > 0"""

FIXTURES["fx_dedup"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY review_translate, entity_name ORDER BY review_id) AS rn
  FROM fx_clean) WHERE rn = 1"""

FIXTURES["fx_tokens"] = f"""
SELECT review_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token
FROM (SELECT review_id, regexp_extract_all(review, '{TOKEN_RE}') AS toks FROM fx_reviews)"""

FIXTURES["fx_scored"] = """
SELECT review_id, pos, token, CAST((review_id * 7 + pos * 13) % 100 AS DOUBLE) / 100.0 AS score
FROM fx_tokens"""

FIXTURES["fx_lexicon"] = """
SELECT word, ['NOUN','VERB','INFN','PREP','CONJ','NPRO'][length(word) % 6 + 1] AS pos,
       substr(word, 1, 4) AS lemma
FROM (SELECT DISTINCT lower(token) AS word FROM fx_tokens) WHERE length(word) > 1"""

FIXTURES["fx_predictions"] = """
SELECT id, m, y_true,
       CAST(CASE WHEN id % 13 = 0 THEN (y_true + 2) % 5
            WHEN id % 17 = 0 THEN (y_true + 1) % 5
            WHEN (id + m) % 7 = 0 THEN (y_true + 1) % 5
            ELSE y_true END AS INTEGER) AS y_pred
FROM (SELECT doc_id AS id, CAST(doc_id % 5 AS INTEGER) AS y_true, unnest(range(0, 9)) AS m
      FROM documents) d"""

FIXTURES["fx_crawl"] = """
SELECT page_id, url AS link, page_id % 3 = 0 AS parsed, page_id % 40 AS num_overall,
       page_id % 37 AS num_parsed FROM pages"""

FIXTURES["fx_split"] = """
SELECT review_id, dataset_name, rating,
       CASE WHEN pos < n - (n + 4) // 5 THEN 'train'
            WHEN pos < n - (n + 4) // 5 + ((n + 4) // 5 - ((n + 4) // 5 + 1) // 2) THEN 'val'
            ELSE 'test' END AS split
FROM (SELECT review_id, dataset_name, rating,
             row_number() OVER (PARTITION BY dataset_name, rating
                                ORDER BY (review_id * 7919 + 13) % 10007, review_id) - 1 AS pos,
             count(*) OVER (PARTITION BY dataset_name, rating) AS n
      FROM fx_clean)"""


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it (transitively) references."""
    needed: set[str] = set()
    _DEPS_ORDER = list(FIXTURES)

    def visit(text: str) -> None:
        for name in _DEPS_ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(FIXTURES[name])

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in _DEPS_ORDER if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
