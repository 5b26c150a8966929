"""Independent DuckDB SQL for every named result (the correctness oracle).

The views of FIXTURES.md section 3 are rebuilt here from the raw test tables in
flat form (no nested arrays), so the oracle shares no code path with the Spark
plans.  Counts are cast to BIGINT and calendar parts to INTEGER to match the
Spark result types.
"""

from __future__ import annotations

# The stop words and the word pattern, stated apart from the engine's.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at",
    "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from",
    "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "just", "me", "more", "most", "my", "no", "not", "of", "on", "only",
    "or", "other", "our", "out", "over", "she", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "too", "under", "up", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "why", "will", "with", "would", "you", "your",
)

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_'']*"

VIEWS: dict[str, str] = {
    "art_lines": """
art_lines AS (
  SELECT l_orderkey AS k, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey)""",
    "articles": r"""
articles0 AS (
  SELECT o.o_orderkey AS k, CAST(o.o_orderkey AS VARCHAR) AS doi,
         'Article ' || o.o_orderkey AS article_title,
         CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
              WHEN o.o_orderkey % 27 = 26 THEN 'Unlisted ' || l.first_part
              ELSE 'Journal ' || l.first_part END AS journal_name,
         CASE o.o_orderkey % 8
              WHEN 0 THEN strftime(o.o_orderdate, '%-d %B %Y')
              WHEN 1 THEN strftime(o.o_orderdate, '%d %B %Y')
              WHEN 2 THEN 'Volume ' || (o.o_orderkey % 200) || ', ' || strftime(o.o_orderdate, '%B %Y')
              WHEN 3 THEN strftime(o.o_orderdate, '%Y')
              WHEN 4 THEN strftime(o.o_orderdate, '%B %Y')
              WHEN 5 THEN strftime(o.o_orderdate, '%-d %b %Y')
              WHEN 6 THEN 'in press' END AS publication_date,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
              WHEN o.o_orderkey % 13 = 0 THEN ''
              ELSE 'Kw' || (o.o_orderkey % 7) || ', topic ' || (o.o_orderkey % 11)
                   || ',KW' || (o.o_orderkey % 7) END AS keywords
  FROM orders o LEFT JOIN art_lines l ON o.o_orderkey = l.k),
articles AS (
  SELECT doi, article_title, journal_name, publication_date, keywords FROM articles0
  UNION ALL
  SELECT doi, article_title, journal_name, 'Available online ' || publication_date, keywords FROM articles0
  WHERE k % 41 = 16 AND k % 97 <> 0 AND publication_date IS NOT NULL)""",
    "dated": r"""
dated0 AS (
  SELECT *,
         CASE WHEN regexp_matches(publication_date, '\d{1,2} \w+ \d{4}')
                   THEN regexp_extract(publication_date, '\d{1,2} \w+ \d{4}', 0)
              WHEN regexp_matches(publication_date, 'Volume \d+,\s?\w+ \d{4}')
                   THEN regexp_extract(publication_date, '\w+ \d{4}', 0)
              WHEN regexp_matches(publication_date, '\d{4}')
                   THEN regexp_extract(publication_date, '\d{4}', 0) END AS extracted_date
  FROM articles),
dated1 AS (
  SELECT *, CAST(coalesce(try_strptime(extracted_date, '%d %B %Y'),
                          try_strptime(extracted_date, '%B %Y'),
                          try_strptime(extracted_date, '%Y')) AS DATE) AS pd0
  FROM dated0),
dated AS (
  SELECT *, CASE WHEN year(pd0) >= 1 THEN pd0 END AS pdate FROM dated1)""",
    "article_authors": """
article_authors AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doi, s_name AS name, l_suppkey AS sk
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
author_lab_rows AS (
  SELECT doi, name, 'LAB-' || (sk % 45) AS lab FROM article_authors
  UNION ALL
  SELECT doi, name, CASE WHEN sk % 10 <> 8 THEN 'LAB-' || ((sk + 1) % 45) END AS lab
  FROM article_authors WHERE sk % 2 = 0)""",
    "author_text": """
author_text AS (
  SELECT doi, string_agg(name || ' [LAB-' || (sk % 45)
                         || CASE WHEN sk % 2 = 0 AND sk % 10 <> 8 THEN ', LAB-' || ((sk + 1) % 45) ELSE '' END
                         || ']', '; ' ORDER BY name) AS authors
  FROM article_authors GROUP BY doi)""",
    "authors_labs": """
authors_labs AS (
  SELECT DISTINCT c_name AS name, CASE WHEN c_custkey % 37 <> 36 THEN 'LAB-' || (c_custkey % 40) END AS lab,
         CASE WHEN c_custkey % 40 = 39 THEN NULL ELSE n_name END AS country
  FROM customer LEFT JOIN nation ON n_nationkey = (c_custkey % 40) % 25),
lab_countries AS (SELECT DISTINCT lab, country FROM authors_labs)""",
    "doi_countries": """
doi_countries AS (
  SELECT DISTINCT x.doi, c.country
  FROM author_lab_rows x JOIN lab_countries c ON x.lab = c.lab
  WHERE x.doi IS NOT NULL AND c.country IS NOT NULL)""",
    "journals": """
journal_rows AS (
  SELECT p_partkey AS p, p_name, p_type, p_size, c.copy
  FROM part CROSS JOIN (VALUES (0), (1)) c(copy)
  WHERE c.copy = 0 OR p_partkey % 100 = 1),
journals AS (
  SELECT 'Journal ' || p AS journal_name, 'ISSN-' || p AS issn,
         CASE WHEN p % 50 = 49 THEN NULL ELSE n_name END AS country,
         p, p_name, p_type, p_size
  FROM journal_rows LEFT JOIN nation ON n_nationkey = (p + copy) % 25)""",
    "journals_flat": """
journal_entries AS (
  SELECT *, unnest(range(0, p_size % 4 + 1)) AS i FROM journals WHERE p % 60 <> 59),
journals_flat AS (
  SELECT journal_name, issn, country,
         p_type || ' ' || string_split(p_name, ' ')[-1] AS category,
         CASE WHEN (p + i) % 31 <> 3 THEN CAST(2000 + (p_size + i) % 10 AS INTEGER) END AS year,
         CASE WHEN (p + i) % 23 = 5 THEN '-'
              WHEN (p + i) % 29 <> 7 THEN 'Q' || (1 + ((p_size + i) % 10 + p % 2 + i) % 4) END AS quartile
  FROM journal_entries)""",
    "country_wide": """
country_wide AS (
  SELECT country,
         CAST(count_if(quartile = 'Q1') AS BIGINT) AS Q1,
         CAST(count_if(quartile = 'Q2') AS BIGINT) AS Q2,
         CAST(count_if(quartile = 'Q3') AS BIGINT) AS Q3,
         CAST(count_if(quartile = 'Q4') AS BIGINT) AS Q4
  FROM journals_flat WHERE country IS NOT NULL GROUP BY country),
country_long AS (
  SELECT country, 'Q1' AS quartile, Q1 AS n FROM country_wide
  UNION ALL SELECT country, 'Q2', Q2 FROM country_wide
  UNION ALL SELECT country, 'Q3', Q3 FROM country_wide
  UNION ALL SELECT country, 'Q4', Q4 FROM country_wide)""",
    "pairs": """
pairs AS (
  SELECT a.country AS country_a, b.country AS country_b,
         CAST(count(*) AS BIGINT) AS collaboration_count
  FROM doi_countries a JOIN doi_countries b ON a.doi = b.doi AND a.country < b.country
  GROUP BY 1, 2)""",
}

# Views each view needs, in definition order.
_DEPENDS = {
    "articles": ["art_lines"],
    "dated": ["articles"],
    "author_text": ["article_authors"],
    "doi_countries": ["article_authors", "authors_labs"],
    "journals_flat": ["journals"],
    "country_wide": ["journals_flat"],
    "pairs": ["doi_countries"],
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",".join(VIEWS[n] for n in order) + "\n"


_KEYWORDS = """(SELECT DISTINCT trim(lower(unnest(string_split(keywords, ',')))) AS keyword
             FROM articles WHERE keywords IS NOT NULL)"""
# Distinct over the whole derived row (the raw date text is not part of it); the
# authors follow from the doi.
_KEYWORD_COUNTS = """
SELECT keyword, CAST(count(*) AS BIGINT) AS keyword_count
FROM (SELECT DISTINCT doi, article_title, journal_name, extracted_date, pdate, keyword FROM (
        SELECT *, trim(lower(unnest(string_split(keywords, ',')))) AS keyword
        FROM dated WHERE keywords IS NOT NULL))"""
_CATEGORIES = "(SELECT category FROM journals_flat WHERE category IS NOT NULL)"
_CLOUD = "ORDER BY n DESC, word LIMIT 200"


def _words(source: str, column: str, cut: str = "") -> str:
    return f"""
SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(regexp_extract_all(lower({column}), '{_WORD}')) AS word FROM {source})
WHERE word NOT IN ({_STOP})
GROUP BY word {cut}"""


ORACLE_SQL: dict[str, str] = {
    "cleaning_report": _with("articles", "authors_labs", "journals") + """
SELECT 'Authors Labs' AS collection,
       CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS BIGINT) AS rows_before,
       CAST((SELECT count(*) FROM authors_labs) AS BIGINT) AS rows_after
UNION ALL
SELECT 'Journaux',
       CAST((SELECT count(*) FROM journals) AS BIGINT),
       CAST((SELECT count(*) FROM (SELECT DISTINCT journal_name, issn, country, p FROM journals)) AS BIGINT)
UNION ALL
SELECT 'Articles',
       CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 41 = 16) AS BIGINT),
       CAST((SELECT count(*) FROM (SELECT DISTINCT doi, article_title, journal_name, publication_date, keywords FROM articles)) AS BIGINT)""",
    "articles_dated": _with("dated", "author_text") + """
SELECT article_title, d.doi, d.publication_date AS publication_date_raw, keywords, journal_name, authors,
       extracted_date, pdate AS publication_date
FROM dated d LEFT JOIN author_text x ON d.doi = x.doi""",
    "journals_flat": _with("journals_flat") + """
SELECT journal_name, issn, country, category, year, quartile FROM journals_flat""",
    "author_labs": _with("authors_labs") + """
SELECT name, lab, country FROM authors_labs""",
    "keyword_counts": _with("dated") + _KEYWORD_COUNTS + """
GROUP BY keyword""",
    "top_keywords": _with("dated") + _KEYWORD_COUNTS + """
GROUP BY keyword ORDER BY keyword_count DESC, keyword LIMIT 10""",
    "keyword_word_counts": _with("articles") + _words(_KEYWORDS, "keyword"),
    "keyword_words": _with("articles") + _words(_KEYWORDS, "keyword", _CLOUD),
    "category_word_counts": _with("journals_flat") + _words(_CATEGORIES, "category"),
    "category_words": _with("journals_flat") + _words(_CATEGORIES, "category", _CLOUD),
    "document_words": _words("documents", "text"),
    "article_affiliations": _with("article_authors", "authors_labs") + """
SELECT DISTINCT x.doi, x.name AS author, x.lab, c.country
FROM author_lab_rows x LEFT JOIN lab_countries c ON x.lab = c.lab""",
    "country_pairs": _with("pairs") + """
SELECT country_a, country_b, collaboration_count FROM pairs""",
    "country_triples": _with("doi_countries") + """
SELECT a.country AS country_a, b.country AS country_b, c.country AS country_c,
       CAST(count(*) AS BIGINT) AS collaboration_count
FROM doi_countries a
JOIN doi_countries b ON a.doi = b.doi AND a.country < b.country
JOIN doi_countries c ON a.doi = c.doi AND b.country < c.country
GROUP BY 1, 2, 3""",
    "collaboration_edges": _with("pairs") + """
SELECT country_a AS src, country_b AS dst, collaboration_count AS weight FROM pairs""",
    "collaboration_nodes": _with("pairs") + """
SELECT node, CAST(count(*) AS BIGINT) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree
FROM (SELECT country_a AS node, collaboration_count AS weight FROM pairs
      UNION ALL SELECT country_b, collaboration_count FROM pairs)
GROUP BY node""",
    "quartile_by_category": _with("journals_flat") + """
SELECT category, quartile, CAST(count(*) AS BIGINT) AS n FROM journals_flat
WHERE category IS NOT NULL AND quartile IS NOT NULL GROUP BY 1, 2""",
    "quartile_by_year": _with("journals_flat") + """
SELECT year, quartile, CAST(count(*) AS BIGINT) AS n FROM journals_flat
WHERE year IS NOT NULL AND quartile IS NOT NULL GROUP BY 1, 2""",
    "best_quartile_heatmap": _with("journals_flat") + """
, base AS (SELECT * FROM journals_flat WHERE category IS NOT NULL AND year IS NOT NULL),
cells AS (SELECT category, year,
                 min(CASE quartile WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 2 WHEN 'Q3' THEN 3
                                   WHEN 'Q4' THEN 4 END) AS best
          FROM base GROUP BY 1, 2)
SELECT c.category, y.year, CAST(coalesce(cells.best, 0) AS INTEGER) AS best_quartile
FROM (SELECT DISTINCT category FROM base) c
CROSS JOIN (SELECT DISTINCT year FROM base) y
LEFT JOIN cells ON cells.category = c.category AND cells.year = y.year""",
    "countries_per_quartile": _with("journals_flat") + """
SELECT quartile, CAST(count(DISTINCT country) AS BIGINT) AS n FROM journals_flat
WHERE country IS NOT NULL AND quartile IS NOT NULL GROUP BY quartile""",
    "quartile_by_country_wide": _with("country_wide") + """
SELECT country, Q1, Q2, Q3, Q4 FROM country_wide""",
    "quartile_by_country_long": _with("country_wide") + """
SELECT country, quartile, n FROM country_long""",
    "quartile_share_by_country": _with("journals_flat") + """
, labelled AS (SELECT country, quartile FROM journals_flat
               WHERE country IS NOT NULL AND quartile IS NOT NULL),
totals AS (SELECT country, count(*) AS total FROM labelled GROUP BY country),
cells AS (SELECT country, quartile, count(*) AS n FROM labelled GROUP BY 1, 2)
SELECT t.country, q.quartile, round(coalesce(c.n, 0) / CAST(t.total AS DOUBLE), 6) AS share
FROM totals t CROSS JOIN (SELECT DISTINCT quartile FROM labelled) q
LEFT JOIN cells c ON c.country = t.country AND c.quartile = q.quartile""",
    "quartile_count_histogram": _with("country_wide") + """
, rng AS (SELECT min(n) AS lo, max(n) AS hi FROM country_long),
binned AS (
  SELECT l.quartile,
         CAST(CASE WHEN hi = lo THEN 10 ELSE least(((l.n - lo) * 20) // (hi - lo), 19) END AS INTEGER) AS bin,
         CASE WHEN hi = lo THEN lo - 0.5 ELSE CAST(lo AS DOUBLE) END AS lo_d,
         CASE WHEN hi = lo THEN 1.0 ELSE CAST(hi - lo AS DOUBLE) END AS width
  FROM country_long l CROSS JOIN rng),
cells AS (SELECT quartile, bin, lo_d, width, CAST(count(*) AS BIGINT) AS n
          FROM binned GROUP BY 1, 2, 3, 4)
SELECT quartile, bin,
       round(lo_d + bin * width / 20, 6) AS bin_start,
       round(lo_d + (bin + 1) * width / 20, 6) AS bin_end,
       n,
       CAST(sum(n) OVER (PARTITION BY bin ORDER BY quartile
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stack_top
FROM cells""",
    "quartile_count_density": _with("country_wide") + """
, rng AS (SELECT CAST(min(n) AS DOUBLE) AS lo, CAST(max(n) AS DOUBLE) AS hi FROM country_long),
stats AS (
  SELECT quartile, count(*) AS cnt, stddev_samp(n) AS sd
  FROM country_long GROUP BY quartile HAVING count(*) >= 2 AND stddev_samp(n) > 0),
bws AS (SELECT *, sd * pow(CAST(cnt AS DOUBLE), -0.2) AS bw FROM stats),
grid AS (SELECT CAST(range AS INTEGER) AS point FROM range(0, 200)),
pts AS (
  SELECT s.quartile, g.point, r.lo + (g.point * (r.hi - r.lo)) / 199 AS x, l.n, s.bw, s.cnt,
         (r.hi - r.lo) / 20 AS bin_width
  FROM bws s JOIN country_long l ON l.quartile = s.quartile CROSS JOIN grid g CROSS JOIN rng r),
curves AS (
  SELECT quartile, point, x, cnt, bin_width,
         sum(exp(-0.5 * ((x - n) / bw) * ((x - n) / bw)) / (cnt * bw * sqrt(2 * pi()))) AS density
  FROM pts GROUP BY quartile, point, x, cnt, bin_width),
scaled AS (SELECT *, density * cnt * bin_width AS count_density FROM curves)
SELECT quartile, point, round(x, 6) AS x, round(density, 6) AS density,
       round(count_density, 6) AS count_density,
       round(sum(count_density) OVER (PARTITION BY point ORDER BY quartile
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS stack_top
FROM scaled""",
    "authors_by_country_top20": _with("authors_labs") + """
SELECT country, CAST(count(*) AS BIGINT) AS author_count FROM authors_labs
WHERE country IS NOT NULL GROUP BY country ORDER BY author_count DESC, country LIMIT 20""",
    "labs_top20": _with("authors_labs") + """
SELECT lab, CAST(count(*) AS BIGINT) AS author_count FROM authors_labs
WHERE lab IS NOT NULL GROUP BY lab ORDER BY author_count DESC, lab LIMIT 20""",
    "articles_by_year": _with("dated") + """
SELECT year, CAST(count(*) AS BIGINT) AS article_count
FROM (SELECT regexp_extract(extracted_date, '\\d{4}', 0) AS year FROM dated)
WHERE year IS NOT NULL AND year <> '' GROUP BY year""",
    "articles_by_date": _with("dated") + """
SELECT pdate AS publication_date, CAST(count(*) AS BIGINT) AS article_count
FROM dated GROUP BY pdate""",
    "articles_by_date_frames": _with("dated") + """
SELECT publication_date, article_count,
       CAST(row_number() OVER (ORDER BY publication_date NULLS FIRST) - 1 AS BIGINT) AS first_frame
FROM (SELECT pdate AS publication_date, CAST(count(*) AS BIGINT) AS article_count
      FROM dated GROUP BY pdate)""",
    "articles_by_year_month": _with("dated") + """
SELECT CAST(year(pdate) AS INTEGER) AS year, CAST(month(pdate) AS INTEGER) AS month,
       CAST(count(*) AS BIGINT) AS article_count
FROM dated GROUP BY 1, 2""",
    "articles_by_year_month_wide": _with("dated") + """
SELECT CAST(year(pdate) AS INTEGER) AS year, """ + ", ".join(
        f"CAST(count_if(month(pdate) = {m}) AS BIGINT) AS m{m:02d}" for m in range(1, 13)) + """
FROM dated WHERE pdate IS NOT NULL GROUP BY 1""",
    "articles_by_journal": _with("articles") + """
SELECT journal_name, CAST(count(*) AS BIGINT) AS article_count,
       round(count(*) / (SELECT count(*) FROM articles), 6) AS share
FROM articles GROUP BY journal_name""",
    "articles_by_journal_country": _with("articles", "journals") + """
SELECT j.country, CAST(count(a.doi) AS BIGINT) AS article_count
FROM articles a JOIN journals j ON a.journal_name = j.journal_name
WHERE j.country IS NOT NULL GROUP BY j.country""",
    "top_authors": _with("article_authors", "articles") + """
SELECT name, CAST(count(*) AS BIGINT) AS article_count
FROM article_authors x JOIN articles a ON a.doi = x.doi
GROUP BY name ORDER BY article_count DESC, name LIMIT 10""",
    "distinct_authors": _with("article_authors") + """
SELECT DISTINCT name FROM article_authors""",
}

# Labels of any spelling, as rows.
ORACLE_SQL["label_table_by_country"] = _with("journals_flat") + """
, labelled AS (SELECT country, quartile FROM journals_flat WHERE country IS NOT NULL AND quartile IS NOT NULL)
SELECT c.country, q.quartile, CAST(count(l.country) AS BIGINT) AS n
FROM (SELECT DISTINCT country FROM labelled) c CROSS JOIN (SELECT DISTINCT quartile FROM labelled) q
LEFT JOIN labelled l ON l.country = c.country AND l.quartile = q.quartile
GROUP BY 1, 2"""
ORACLE_SQL["unranked_by_country"] = _with("journals_flat") + """
SELECT country, CAST(count(*) AS BIGINT) AS labelled,
       CAST(count_if(quartile NOT IN ('Q1', 'Q2', 'Q3', 'Q4')) AS BIGINT) AS other,
       round(count_if(quartile NOT IN ('Q1', 'Q2', 'Q3', 'Q4')) / CAST(count(*) AS DOUBLE), 6) AS share
FROM journals_flat WHERE country IS NOT NULL AND quartile IS NOT NULL GROUP BY country"""

# The exported copy: documents of every 53rd key (rest 7) are damaged, so their rows are missing.
_SOUND = "% 53 <> 7"
_LANDED_PAIRS = f"""
, sound_labs AS (
  SELECT DISTINCT 'LAB-' || (c_custkey % 40) AS lab, n_name AS country
  FROM customer JOIN nation ON n_nationkey = (c_custkey % 40) % 25
  WHERE c_custkey % 37 <> 36 AND c_custkey % 40 <> 39 AND c_custkey {_SOUND}),
sound_countries AS (
  SELECT DISTINCT x.doi, c.country FROM author_lab_rows x JOIN sound_labs c ON x.lab = c.lab
  WHERE CAST(x.doi AS BIGINT) {_SOUND})
SELECT a.country AS country_a, b.country AS country_b, CAST(count(*) AS BIGINT) AS collaboration_count
FROM sound_countries a JOIN sound_countries b ON a.doi = b.doi AND a.country < b.country GROUP BY 1, 2"""
_COPIED = "(k % 97 = 0 OR k % 41 = 16)"
ORACLE_SQL["landing_report"] = _with("articles", "authors_labs", "journals") + f"""
, labs AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0),
arts AS (SELECT k FROM articles0 UNION ALL SELECT k FROM articles0 WHERE {_COPIED}),
clean_labs AS (SELECT DISTINCT c_name AS name FROM customer WHERE c_custkey {_SOUND}),
clean_journals AS (SELECT DISTINCT journal_name, issn, country, p FROM journals WHERE p {_SOUND}),
clean_articles AS (SELECT DISTINCT doi, article_title, journal_name, publication_date, keywords FROM articles
                   WHERE CAST(doi AS BIGINT) {_SOUND})
SELECT 'Authors Labs' AS collection, CAST(count(*) AS BIGINT) AS rows_landed, CAST(count_if(k % 53 = 7) AS BIGINT) AS rows_quarantined,
       CAST(count_if(k {_SOUND}) AS BIGINT) AS rows_before, CAST((SELECT count(*) FROM clean_labs) AS BIGINT) AS rows_after FROM labs
UNION ALL
SELECT 'Journaux', count(*), count_if(p % 53 = 7), count_if(p {_SOUND}), (SELECT count(*) FROM clean_journals) FROM journals
UNION ALL
SELECT 'Articles', count(*), count_if(k % 53 = 7), count_if(k {_SOUND}), (SELECT count(*) FROM clean_articles) FROM arts"""
ORACLE_SQL["landing_quarantine"] = f"""
WITH labs AS (SELECT 'c' AS copy, c_custkey AS k, c_name FROM customer
              UNION ALL SELECT 'd', c_custkey, c_name FROM customer WHERE c_custkey % 10 = 0),
arts AS (SELECT 'a' AS copy, o_orderkey AS k FROM orders
         UNION ALL SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'b' ELSE 'v' END, o_orderkey FROM orders
         WHERE o_orderkey % 97 = 0 OR o_orderkey % 41 = 16),
journals AS (SELECT p_partkey AS p, 0 AS copy FROM part UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey % 100 = 1)
SELECT 'Authors Labs' AS collection, substr('{{"_id":"' || copy || k || '","name":"' || c_name || '","', 1, 24) AS record
FROM labs WHERE k % 53 = 7
UNION ALL
SELECT 'Journaux', '{{"_id":"j' || p || '-' || copy || '","Data":"lost"}}' FROM journals WHERE p % 53 = 7
UNION ALL
SELECT 'Articles', substr('{{"_id":"' || copy || k || '","article_title":"Article ' || k, 1, 24) FROM arts WHERE k % 53 = 7"""
ORACLE_SQL["landed_articles"] = ORACLE_SQL["articles_dated"] + f"""
WHERE CAST(d.doi AS BIGINT) {_SOUND}"""
ORACLE_SQL["landed_journals_flat"] = ORACLE_SQL["journals_flat"] + f"""
WHERE CAST(replace(issn, 'ISSN-', '') AS BIGINT) {_SOUND}"""
ORACLE_SQL["landed_author_labs"] = _with("authors_labs") + f"""
SELECT name, lab, country FROM authors_labs
WHERE name IN (SELECT c_name FROM customer WHERE c_custkey {_SOUND})"""
ORACLE_SQL["landed_country_pairs"] = _with("doi_countries") + _LANDED_PAIRS


def _collocations(source: str, column: str) -> str:
    term = "CASE WHEN {k} > 0 THEN {k} * ln({k} / ({e})) ELSE 0 END"
    a, b, n, t = (f"CAST({c} AS DOUBLE)" for c in ("n_a", "n_b", "n", "total"))
    score = " + ".join(term.format(k=f"({k})", e=e) for k, e in (
        (n, f"{a} * {b} / {t}"), (f"{a} - {n}", f"{a} * ({t} - {b}) / {t}"),
        (f"{b} - {n}", f"({t} - {a}) * {b} / {t}"), (f"{t} - {a} - {b} + {n}", f"({t} - {a}) * ({t} - {b}) / {t}")))
    return f"""
, toks AS (SELECT regexp_extract_all(lower({column}), '{_WORD}') AS t FROM {source}),
adjacent AS (SELECT t[i] AS word_a, t[i + 1] AS word_b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM toks)),
counted AS (SELECT word_a, word_b, count(*) AS n FROM adjacent
            WHERE word_a NOT IN ({_STOP}) AND word_b NOT IN ({_STOP}) GROUP BY 1, 2),
tables AS (SELECT *, sum(n) OVER (PARTITION BY word_a) AS n_a, sum(n) OVER (PARTITION BY word_b) AS n_b, sum(n) OVER () AS total
           FROM counted),
scored AS (SELECT *, round(2 * ({score}), 6) AS score FROM tables)
SELECT word_a, word_b, CAST(n AS BIGINT) AS n, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, score,
       {n} * {t} > {a} * {b} AND score > 30 AS collocation
FROM scored"""


ORACLE_SQL["keyword_collocations"] = _with("articles") + _collocations(_KEYWORDS, "keyword")
ORACLE_SQL["category_collocations"] = _with("journals_flat") + _collocations(_CATEGORIES, "category")
ORACLE_SQL["document_words_folded"] = f"""
WITH v AS ({_words("documents", "text")}),
folded AS (SELECT coalesce(s.word, v.word) AS word, v.n
           FROM v LEFT JOIN v s ON v.word LIKE '%s' AND v.word NOT LIKE '%ss' AND s.word = left(v.word, length(v.word) - 1))
SELECT word, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS forms FROM folded GROUP BY word"""
ORACLE_SQL["quartile_strings"] = _with("journals_flat") + """
SELECT category, year, string_agg(quartile, ' ' ORDER BY quartile) AS quartiles
FROM journals_flat WHERE category IS NOT NULL AND year IS NOT NULL AND quartile IS NOT NULL GROUP BY 1, 2"""
ORACLE_SQL["articles_by_date_expanded"] = f"""
WITH points AS ({ORACLE_SQL["articles_by_date_frames"]})
SELECT CAST(f.frame AS BIGINT) AS frame, publication_date, article_count
FROM points JOIN (SELECT unnest(range(0, 100)) AS frame) f ON first_frame <= f.frame"""
