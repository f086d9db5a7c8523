"""The workload in plain SQL over the same tables, for comparison."""

from __future__ import annotations

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_WS = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_KEPT = r"[^\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}.,!?''\"]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '{WS}+'), lambda x: x <> '')"


def clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, into in (
        ("<[^>]+>", ""), (f"http[s]?://{NOT_WS}+", ""), (NOT_KEPT, " "), ("[\"'']{2,}", '"'),
        (f"{WS}+([.!?])", "\\1"), (f"{WS}+", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return strip(out)


def shorten(c: str) -> str:
    return f"CASE WHEN length({c}) > 20 THEN substr({c}, 1, 20) || '...' ELSE {c} END"


def day_of(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast({c} AS DATE)"
        f" WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}$') THEN try_cast({c} || '-01' AS DATE)"
        f" WHEN regexp_matches({c}, '^\\d{{4}}$') THEN try_cast({c} || '-01-01' AS DATE) END"
    )


def year_of(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN year(try_cast({c} AS DATE))"
        f" WHEN regexp_matches({c}, '^\\d{{4}}(-\\d{{2}})?$') THEN try_cast(substr({c}, 1, 4) AS INTEGER) END"
    )


TITLE = "regexp_extract(text, '^[^.\\n]+')"

# documents with the derived book fields, NULL where the source has nothing
VOLUMES = f"""volumes AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, lang, text, n_chars, {TITLE} AS title,
    CASE WHEN lang <> 'en' THEN lang END AS subtitle,
    CASE WHEN lang = 'es' THEN source || '|' || lang ELSE source END AS authors,
    CASE WHEN lang <> 'fr' THEN 'Publishing house ' || source END AS publisher,
    CAST(1900 + n_chars % 125 AS VARCHAR) || CASE lang
      WHEN 'en' THEN '-' || lpad(CAST(1 + n_chars % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + n_chars % 31 AS VARCHAR), 2, '0')
      WHEN 'fr' THEN '-' || lpad(CAST(1 + n_chars % 13 AS VARCHAR), 2, '0')
      WHEN 'de' THEN '' ELSE '-5' END AS published,
    CASE WHEN lang <> 'de' THEN lang END AS language,
    '2024-01-' || lpad(CAST(1 + n_chars % 28 AS VARCHAR), 2, '0') AS date,
    lpad(CAST(n_chars % 3 * 8 AS VARCHAR), 2, '0') AS hour
  FROM documents)"""

STAGED = f"""{VOLUMES}, staged AS (
  SELECT DISTINCT id, title, coalesce(subtitle, '') AS subtitle, source AS primary_author, authors AS all_authors,
    coalesce(publisher, 'Unknown Publisher') AS publisher, {day_of('published')} AS published_date,
    text AS description, CAST(floor(n_chars / 1800) AS INTEGER) AS page_count,
    CASE WHEN lang = 'fr' THEN 'Uncategorized' ELSE lang END AS primary_category,
    CASE WHEN lang <> 'fr' THEN lang || '|' || source END AS all_categories,
    n_chars % 51 / 10 AS avg_rating, CAST(n_chars % 7 AS INTEGER) AS ratings_count,
    CASE WHEN lang = 'de' THEN '' ELSE 'https://covers.example/' || id END AS thumbnail_url,
    coalesce(language, 'en') AS language, 'https://books.example/' || id AS preview_link,
    CASE WHEN lang = 'es' THEN 'US' ELSE 'GB' END AS sale_country,
    CASE WHEN n_chars % 2 = 0 THEN 'FOR_SALE' ELSE 'NOT_FOR_SALE' END AS saleability,
    CASE WHEN n_chars % 2 = 0 THEN n_chars / 100 ELSE 0.0 END AS list_price,
    CASE WHEN n_chars % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE WHEN n_chars % 2 = 0 THEN 'https://shop.example/' ELSE '' END AS buy_link,
    {year_of('published')} AS publication_year, date AS processing_date
  FROM volumes WHERE length(text) > 100)"""

BOOKS = f"""{STAGED}, books AS (
  SELECT title, primary_author, {shorten('publisher')} AS publisher, publication_year, avg_rating, ratings_count,
    {shorten('lower(primary_category)')} AS primary_category, list_price, currency FROM staged)"""

CARDS = """SELECT count(*) AS total_books, sum(ratings_count) AS ratings_count, round(avg(avg_rating), 6) AS avg_rating,
  least(max(publication_year), 2010) AS latest_year,
  format('{:,}', count(*)) AS total_books_text, format('{:,.1f}', avg(avg_rating)) AS avg_rating_text FROM """

SOLD = """sold AS (SELECT year(l_shipdate) AS publication_year, l_discount * 50 AS avg_rating,
  l_linenumber AS ratings_count FROM lineitem)"""


def title_rule(rows: str, group: str, order: str, title: str, out: str) -> str:
    return f"""t AS (SELECT *, lower({strip(f"coalesce({title}, '')")}) AS t FROM {rows}),
kept AS (SELECT {out} FROM t b WHERE NOT EXISTS (SELECT 1 FROM t a WHERE a.{group} = b.{group} AND a.{order} <> b.{order}
  AND ((length(a.t) > 3 AND length(a.t) < length(b.t) AND contains(b.t, a.t)) OR (a.t = b.t AND a.{order} < b.{order}))))"""


def overlaps(rows: str, group: str, order: str, text: str) -> str:
    """hits(i, j): similar pairs of rows of a group, i < j; copies included."""
    return f"""compared AS (SELECT {group} AS g, {order} AS k, {words(text)} AS w FROM {rows}
  WHERE length({strip(f"coalesce({text}, '')")}) >= 50),
spaced AS MATERIALIZED (SELECT *, array_to_string(w, ' ') AS s, len(w) AS n FROM compared),
texts AS MATERIALIZED (SELECT g, s, any_value(w) AS w, any_value(n) AS n, min(k) AS first, count(*) AS copies FROM spaced GROUP BY g, s),
inner_words AS MATERIALIZED (SELECT DISTINCT g, first, array_to_string(w[i:i + 2], ' ') AS key
  FROM texts, unnest(range(1, n - 1)) r(i)),
windows AS MATERIALIZED (SELECT g, first, n, p, array_to_string(w[p:p + 4], ' ') AS run, array_to_string(w[p + 1:p + 3], ' ') AS key
  FROM texts, unnest(range(1, n - 3)) r(p)),
starts AS (SELECT a.g, a.first AS i, b.first AS j, any_value(a.n) AS n, list(a.p ORDER BY a.p) AS ats
  FROM windows a JOIN inner_words b ON a.g = b.g AND a.key = b.key JOIN texts t ON t.g = b.g AND t.first = b.first
  WHERE contains(t.s, a.run) GROUP BY a.g, a.first, b.first),
taken AS (SELECT g, i, j, n, list_reduce(ats, lambda m, p: CASE WHEN p >= m // 1000000 THEN (p + 5) * 1000000 + m % 1000000 + 1 ELSE m END,
  CAST(0 AS BIGINT)) % 1000000 AS m FROM starts),
directed AS (SELECT g, i, j, least(5.0 * m / n, 1.0) AS overlap FROM taken WHERE CAST(5 * m AS DOUBLE) / n >= 0.8),
alike AS MATERIALIZED (SELECT g, least(i, j) AS i, greatest(i, j) AS j, max(overlap) AS overlap FROM directed GROUP BY 1, 2, 3),
hits AS (SELECT h.g, least(a.k, b.k) AS i, greatest(a.k, b.k) AS j FROM alike h
  JOIN texts ta ON ta.g = h.g AND ta.first = h.i JOIN spaced a ON a.g = ta.g AND a.s = ta.s
  JOIN texts tb ON tb.g = h.g AND tb.first = h.j JOIN spaced b ON b.g = tb.g AND b.s = tb.s
  WHERE h.i <> h.j OR a.k < b.k)"""


def gone(hits: str = "hits") -> str:
    """gone(g, k): both ends of the pairs taken in order."""
    return f"""walk AS (SELECT g, list_reduce(list(CAST([i, j] AS BIGINT[]) ORDER BY i, j),
  lambda acc, e: CASE WHEN list_contains(acc, e[1]) OR list_contains(acc, e[2]) THEN acc ELSE list_concat(acc, e) END,
  CAST([] AS BIGINT[])) AS ks FROM {hits} GROUP BY g),
gone AS (SELECT g, unnest(ks) AS k FROM walk)"""


VECTORS = f"""%s AS (
  SELECT key, cell, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS FLOAT) AS weight FROM (
    SELECT key, CAST('0x' || substr(h, 1, 8) AS BIGINT) %% 64 AS cell,
      sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1.0 ELSE -1.0 END) AS x
    FROM (SELECT %s AS key, md5(unnest({words('text')})) AS h FROM %s) GROUP BY 1, 2)
  WHERE x <> 0)"""


def knn(score: str) -> str:
    return f"""WITH parts AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
centres AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS c FROM parts GROUP BY 1, 2),
scored AS (SELECT q.label AS qid, v.vec_id AS id, {score} AS distance
  FROM centres q JOIN parts v ON v.p = q.p GROUP BY 1, 2),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, id, distance FROM scored)
SELECT qid, rank, id, round(distance, 6) AS distance FROM ranked WHERE rank <= 5"""


L2 = "sqrt(sum((x - c) * (x - c)))"
COSINE = "1 - sum(x * c) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(c * c)))"

SPELLED = """spelled AS (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1)
  WHEN '1' THEN d WHEN '2' THEN substr(d, 1, 7) WHEN '3' THEN substr(d, 1, 4) WHEN '4' THEN substr(d, 1, 6)
  ELSE substr(d, 1, 5) || substr(d, 9, 2) END AS spelled
  FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))"""

EVENTS = "events_by_day AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS date FROM events)"
MARK = "(SELECT max('2024-01-' || lpad(CAST(1 + n_chars % 28 AS VARCHAR), 2, '0')) FROM documents)"


def oracle_sql() -> dict[str, str]:
    sql = {
        "volume_filter": f"""WITH {VOLUMES} SELECT id, source AS author, title, length(text) AS description_length FROM volumes
            WHERE language = 'en' AND title <> '' AND length(text) > 100""",
        "volume_filter_market": f"""WITH {VOLUMES} SELECT id, source AS author, 'GB' AS country FROM volumes
            WHERE language = 'fr' AND title <> '' AND length(text) > 100""",
        "page_stop": f"""SELECT conv_id, turn, role FROM (
              SELECT *, sum(CASE WHEN len({words('text')}) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS short_before
              FROM conversations WHERE turn < 5) WHERE coalesce(short_before, 0) = 0""",
        "response_items": """SELECT CAST(conv_id AS VARCHAR) AS author, turn * 40 + i - 1 AS ord,
              conv_id || '.' || turn || '.' || (i - 1) AS id, line AS title, role AS language
            FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)""",
        "json_fields": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
            '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS encoded FROM events""",
        "landed_partitions": f"""WITH {VOLUMES} SELECT date, hour, count(*) AS books, sum(length(text)) AS characters
            FROM volumes WHERE date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY date, hour""",
        "raw_table": f"""WITH {VOLUMES} SELECT id, title, CASE WHEN n_chars % 2 = 0 THEN n_chars / 100 END AS amount, date, hour
            FROM volumes""",
        "author_lines": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS processing_order, c_name AS author_name FROM customer",
        "json_round_trip": "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events",
        "csv_export": f"WITH {BOOKS} SELECT * FROM books",
        "title_dedup": f"""WITH docs AS (SELECT doc_id, source, {TITLE} AS title FROM documents),
            {title_rule('docs', 'source', 'doc_id', 'title', 'doc_id, source, title')} SELECT * FROM kept""",
        "title_dedup_parts": f"""WITH
            {title_rule('part', 'p_brand', 'p_partkey', 'p_name', 'p_partkey, p_brand, p_name')} SELECT * FROM kept""",
        "description_pairs": f"""WITH {overlaps('documents', 'source', 'doc_id', 'text')}
            SELECT h.g AS source, h.i AS first_a, h.j AS first_b, a.copies AS copies_a, b.copies AS copies_b,
              round(h.overlap, 6) AS overlap
            FROM alike h JOIN texts a ON a.g = h.g AND a.first = h.i JOIN texts b ON b.g = h.g AND b.first = h.j
            WHERE h.i <> h.j""",
        "description_dedup": f"""WITH {overlaps('documents', 'source', 'doc_id', 'text')}, {gone()}
            SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.g = d.source AND x.k = d.doc_id)""",
        "deduplicated_books": f"""WITH {VOLUMES},
            raw AS (SELECT * FROM volumes WHERE language = 'en' AND title <> '' AND length(text) > 100),
            {title_rule('raw', 'source', 'doc_id', 'title', '*')},
            {overlaps('kept', 'source', 'doc_id', 'text')}, {gone()}
            SELECT source AS author, id FROM kept d
            WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.g = d.source AND x.k = d.doc_id)""",
        "ledger_upsert": """SELECT processing_order, state, amount FROM (
              SELECT *, row_number() OVER (PARTITION BY processing_order ORDER BY seq DESC) AS r FROM (
                SELECT c_custkey AS processing_order, c_mktsegment AS state, c_acctbal AS amount, -1 AS seq FROM customer
                UNION ALL SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey FROM orders)) WHERE r = 1""",
        "ledger_counts": """SELECT CAST(c_custkey AS INTEGER) AS processing_order, CAST(c_custkey AS VARCHAR) AS author_name,
              CAST(coalesce(r.n, 0) AS INTEGER) AS raw_books_count, CAST(coalesce(r.f, 0) AS INTEGER) AS deduplicated_books_count,
              CAST(coalesce(r.f, 0) > 0 AS INTEGER) AS books_found
            FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f
              FROM orders GROUP BY 1) r ON o_custkey = c_custkey""",
        "count_mismatch": """SELECT coalesce(c_custkey, o_custkey) AS processing_order, c_custkey IS NOT NULL AS in_raw,
              o_custkey IS NOT NULL AS in_kept
            FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey
            WHERE c_custkey IS NULL OR o_custkey IS NULL""",
        "resume_slice": """SELECT c_custkey AS processing_order, c_name FROM customer, (SELECT max(s_suppkey) + 1 AS s FROM supplier)
            WHERE c_custkey >= s AND c_custkey < s + 5""",
        "last_processed": "SELECT max(o_custkey) AS last FROM orders",
        "ledger_table": """SELECT coalesce(c_custkey, s_suppkey) AS processing_order, coalesce(s_name, c_name) AS author_name,
              CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE 0 END AS raw_books_count, 0 AS deduplicated_books_count, 0 AS books_found
            FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""",
        "kept_ids": "SELECT source, doc_id FROM documents",
        "flatten_nested": f"WITH {STAGED} SELECT * REPLACE (CAST(published_date AS VARCHAR) AS published_date) FROM staged",
        "ragged_staging": f"""WITH {VOLUMES} SELECT id, source AS primary_author, authors AS all_authors,
              CASE WHEN doc_id % 7 = 1 THEN 0 ELSE CAST(floor(n_chars / 1800) AS INTEGER) END AS page_count,
              CASE WHEN lang = 'fr' OR doc_id % 7 = 5 THEN 'Uncategorized' ELSE lang END AS primary_category,
              CASE WHEN doc_id % 7 = 5 THEN '' WHEN lang <> 'fr' THEN lang || '|' || source END AS all_categories,
              CASE WHEN doc_id % 7 = 2 THEN 0.0 ELSE n_chars % 51 / 10 END AS avg_rating,
              CASE WHEN doc_id % 7 = 3 THEN 0 ELSE CAST(n_chars % 7 AS INTEGER) END AS ratings_count,
              CASE WHEN doc_id % 7 = 4 THEN '' ELSE 'https://books.example/' || id END AS preview_link, date AS processing_date
            FROM volumes WHERE length(text) > 100 AND doc_id % 101 <> 0 AND doc_id % 23 NOT BETWEEN 1 AND 6""",
        "staged_range": f"""WITH {STAGED} SELECT id, publisher, CAST(published_date AS VARCHAR) AS published_date, processing_date
            FROM staged WHERE processing_date BETWEEN '2024-01-05' AND '2024-01-20'""",
        "parse_dates": f"WITH {SPELLED} SELECT o_orderkey, spelled, CAST({day_of('spelled')} AS VARCHAR) AS published_date FROM spelled",
        "year_of_date": f"WITH {SPELLED} SELECT o_orderkey, {year_of('spelled')} AS publication_year FROM spelled",
        "distinct_rows": "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem",
        "incremental_new": f"WITH {EVENTS} SELECT * FROM events_by_day WHERE date > {MARK}",
        "incremental_reprocess": f"WITH {EVENTS} SELECT * FROM events_by_day WHERE date >= {MARK}",
        "latest_rows": """SELECT user_id, event_id, event_type, value FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
        "partition_overwrite": f"""WITH {EVENTS} SELECT event_id, user_id, event_type, date AS processing_date FROM events_by_day
            WHERE date BETWEEN '2024-01-08' AND '2024-01-15'
              AND (date NOT BETWEEN '2024-01-10' AND '2024-01-12' OR event_type = 'view')""",
        "staged_by_stream": f"WITH {EVENTS} SELECT DISTINCT user_id, event_type, date AS processing_date FROM events_by_day",
        "append_frames": """SELECT doc_id AS id, lang, NULL AS url, length(text) AS characters FROM documents
            UNION ALL SELECT page_id, NULL, url, length(html) FROM pages""",
        "null_sentinels": f"""WITH {STAGED} SELECT id, nullif(publisher, '') AS publisher, nullif(page_count, 0) AS page_count,
              CASE WHEN ratings_count <> 0 THEN avg_rating END AS avg_rating, ratings_count,
              nullif(thumbnail_url, '') AS thumbnail_url, nullif(list_price, 0) AS list_price, nullif(buy_link, '') AS buy_link,
              nullif(subtitle, '') AS subtitle FROM staged""",
        "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
        "clean_pages": f"SELECT page_id, {clean('html')} AS cleaned, {clean('url')} AS cleaned_url FROM pages",
        "clean_books": f"""WITH {STAGED}, cleaned AS (
              SELECT id, title, primary_author, {clean('description')} AS description, nullif(publisher, '') AS publisher,
                CAST(published_date AS VARCHAR) AS published_date, nullif(page_count, 0) AS page_count, primary_category,
                CASE WHEN ratings_count <> 0 THEN avg_rating END AS avg_rating, ratings_count,
                nullif(thumbnail_url, '') AS thumbnail_url, preview_link, nullif(list_price, 0) AS list_price,
                nullif(buy_link, '') AS buy_link FROM staged)
            SELECT *, description AS processed_text FROM cleaned WHERE description <> ''""",
        "text_measures": f"""SELECT doc_id, length({strip('text')}) AS bare_length, len({words('text')}) AS n_words,
            length(array_to_string({words('text')}, ' ')) AS spaced_length, lower({strip(TITLE)}) AS title,
            substr(text, 1, 150) || '...' AS preview FROM documents""",
        "text_counts": f"SELECT count(*) AS texts, 1 AS files FROM documents WHERE {strip('text')} <> ''",
        "truncate_labels": f"""SELECT p_partkey, {shorten("label")} AS label
            FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS label FROM part)""",
        "summary_cards": f"WITH {BOOKS} {CARDS} books",
        "summary_cards_large": f"WITH {SOLD} {CARDS} sold",
        "top_publishers": f"""WITH {BOOKS} SELECT publisher AS label, count(*) AS count FROM books GROUP BY 1
            ORDER BY 2 DESC, 1 LIMIT 8""",
        "top_labels": "SELECT p_brand AS label, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
        "category_share": f"""WITH {BOOKS} SELECT primary_category AS label, count(*) AS count FROM books GROUP BY 1
            HAVING count(*) >= 0.02 * (SELECT count(*) FROM books)""",
        "share_filter": """SELECT CAST(p_size AS VARCHAR) AS label, count(*) AS count FROM part GROUP BY 1
            HAVING count(*) >= 0.02 * (SELECT count(*) FROM part)""",
        "share_with_other": """SELECT CASE WHEN n >= 0.02 * (SELECT count(*) FROM part) THEN CAST(p_size AS VARCHAR) ELSE 'Other' END AS label,
            CAST(sum(n) AS BIGINT) AS count FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) GROUP BY 1""",
        "per_year": f"WITH {SOLD} SELECT publication_year, count(*) AS count FROM sold GROUP BY 1",
        "books_per_year": f"""WITH {BOOKS} SELECT publication_year, count(*) AS count FROM books
            WHERE publication_year IS NOT NULL GROUP BY 1""",
        "rating_histogram": f"""WITH {SOLD} SELECT CAST(least(floor(avg_rating / 0.5), 9) AS INTEGER) AS bin,
            CAST(least(floor(avg_rating / 0.5), 9) AS INTEGER) * CAST(0.5 AS DOUBLE) AS bin_start, count(*) AS count FROM sold GROUP BY 1, 2""",
        "newest_rows": """SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year FROM orders
            ORDER BY year DESC, o_orderpriority, o_orderkey LIMIT 5""",
        "highlight": f"""WITH {STAGED} SELECT id, title, avg_rating, avg_rating > 4 AS highlight,
            format('{{:.1f}}', avg_rating) AS rating_text FROM staged""",
        "knn_l2": knn(L2),
        "knn_cosine": knn(COSINE),
        "knn_dot": knn("-sum(x * c)"),
        "result_cards": f"""WITH {STAGED}, found AS ({knn(L2)})
            SELECT s.id, qid, rank, thumbnail_url, title, primary_author, description, CAST(published_date AS VARCHAR) AS published_date,
              page_count, primary_category, avg_rating, ratings_count, preview_link,
              substr(description, 1, 150) || '...' AS preview, length(description) > 150 AS has_more,
              CASE WHEN avg_rating <> 0 THEN '⭐ ' || regexp_replace(CAST(avg_rating AS VARCHAR), '\\.0$', '')
                || CASE WHEN ratings_count <> 0 THEN ' (' || ratings_count || ' ratings)' ELSE '' END END AS rating_text
            FROM found JOIN staged s ON s.id = CAST(found.id AS VARCHAR)""",
        "embed_rows": f"""WITH {VECTORS % ('v', 'doc_id', 'documents')}
            SELECT key AS doc_id, cell, round(CAST(weight AS DOUBLE), 5) AS weight FROM v""",
        "search_texts": f"""WITH {VECTORS % ('d', 'doc_id', 'documents')}, {VECTORS % ('q', 'item_id', 'benchmark')},
            scored AS (SELECT b.item_id AS qid, s.key AS id, 1 - coalesce(dot, 0) / (qn * dn) AS distance
              FROM benchmark b JOIN (SELECT key AS qk, sqrt(sum(CAST(weight AS DOUBLE) * weight)) AS qn FROM q GROUP BY 1) ON qk = b.item_id
              CROSS JOIN (SELECT key, sqrt(sum(CAST(weight AS DOUBLE) * weight)) AS dn FROM d GROUP BY 1) s
              LEFT JOIN (SELECT q.key AS a, d.key AS b, sum(CAST(q.weight AS DOUBLE) * d.weight) AS dot
                FROM q JOIN d ON q.cell = d.cell GROUP BY 1, 2) x ON x.a = b.item_id AND x.b = s.key),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM scored)
            SELECT qid, rank, id, round(distance, 4) AS distance FROM ranked WHERE rank <= 5""",
        "vector_rows": f"""WITH {STAGED}, cleaned AS (SELECT id, title, published_date, {clean('description')} AS text FROM staged),
            {VECTORS % ('v', 'id', "cleaned WHERE text <> ''")}, filled AS (SELECT key, count(*) AS cells FROM v GROUP BY 1)
            SELECT id, title, CAST(published_date AS VARCHAR) AS published_date, length(text) AS characters, 64 AS dims,
              CAST(coalesce(cells, 0) AS INTEGER) AS cells
            FROM cleaned LEFT JOIN filled ON key = id WHERE text <> ''""",
        "vector_table": "SELECT vec_id AS id, 2 AS rows, len(embedding) AS dims FROM embeddings",
        "staging_job": f"""WITH {STAGED} SELECT id, title, publisher, CAST(published_date AS VARCHAR) AS published_date, list_price,
            processing_date FROM staged""",
        "ingest_job": f"""WITH {VOLUMES},
            raw AS (SELECT * FROM volumes WHERE language = 'en' AND title <> '' AND length(text) > 100),
            {title_rule('raw', 'source', 'doc_id', 'title', '*')},
            {overlaps('kept', 'source', 'doc_id', 'text')}, {gone()},
            left_over AS (SELECT source, count(*) AS n FROM kept d
              WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.g = d.source AND x.k = d.doc_id) GROUP BY 1),
            found AS (SELECT source, count(*) AS n FROM raw GROUP BY 1),
            listed AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS o FROM (SELECT DISTINCT source FROM documents))
            SELECT CAST(o AS INTEGER) AS processing_order, l.source AS author_name, '2024-03-05 07:08:09' AS processed_date,
              CAST(coalesce(f.n, 0) AS INTEGER) AS raw_books_count, CAST(coalesce(k.n, 0) AS INTEGER) AS deduplicated_books_count,
              CAST(coalesce(k.n, 0) > 0 AS INTEGER) AS books_found, coalesce(k.n, 0) AS landed
            FROM listed l LEFT JOIN found f ON f.source = l.source LEFT JOIN left_over k ON k.source = l.source""",
        "vector_job": f"""WITH {STAGED}, t AS (SELECT processing_date AS d FROM staged WHERE {clean('description')} <> '')
            SELECT '2024-01-01 to 2024-01-10' AS step, count(*) AS rows FROM t WHERE d <= '2024-01-10'
            UNION ALL SELECT '2024-01-11 to 2024-01-28', count(*) FROM t WHERE d > '2024-01-10'
            UNION ALL SELECT '2025-01-01 to 2025-12-31', 0 UNION ALL SELECT 'no description', 0
            UNION ALL SELECT 'stored', count(*) FROM t""",
        "recommend_job": f"""WITH {STAGED}, cleaned AS (SELECT id, title, {clean('description')} AS text FROM staged),
            {VECTORS % ('d', 'id', "cleaned WHERE text <> ''")}, {VECTORS % ('q', 'item_id', 'benchmark')},
            scored AS (SELECT b.item_id AS qid, s.key AS id, coalesce(dot, 0) AS dot, qn, dn
              FROM benchmark b JOIN (SELECT key AS qk, sum(CAST(weight AS DOUBLE) * weight) AS qn FROM q GROUP BY 1) ON qk = b.item_id
              CROSS JOIN (SELECT key, sum(CAST(weight AS DOUBLE) * weight) AS dn FROM d GROUP BY 1) s
              LEFT JOIN (SELECT q.key AS a, d.key AS b, sum(CAST(q.weight AS DOUBLE) * d.weight) AS dot
                FROM q JOIN d ON q.cell = d.cell GROUP BY 1, 2) x ON x.a = b.item_id AND x.b = s.key),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(qn + dn - 2 * dot, 9), id) AS rank FROM scored)
            SELECT qid, rank, id, title, least(length(text), 150) + 3 AS preview_length
            FROM ranked JOIN cleaned USING (id) WHERE rank <= 5""",
        "dashboard_job": f"""WITH {BOOKS}
            SELECT 'summary' AS panel, 'books' AS label, count(*) AS value FROM books
            UNION ALL SELECT 'per_year', CAST(publication_year AS VARCHAR), count(*) FROM books WHERE publication_year IS NOT NULL GROUP BY 2
            UNION ALL (SELECT 'publishers', publisher, count(*) FROM books GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)
            UNION ALL SELECT 'categories', primary_category, count(*) FROM books GROUP BY 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM books)
            UNION ALL SELECT 'ratings', CAST(CAST(least(floor(avg_rating / 0.5), 9) AS INTEGER) AS VARCHAR), count(*) FROM books GROUP BY 2
            UNION ALL (SELECT 'newest', title, publication_year FROM books ORDER BY publication_year DESC NULLS LAST, title LIMIT 5)""",
        "differing_files": """SELECT doc_id AS id, lang, n_chars, NULL AS url FROM documents
            UNION ALL SELECT page_id, NULL, NULL, url FROM pages""",
        "clashing_files": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::INT::VARCHAR WHEN 1 THEN (p_partkey * 1000000007)::BIGINT::VARCHAR
              WHEN 2 THEN p_retailprice::DOUBLE::VARCHAR ELSE p_brand END AS label,
              CASE p_partkey % 4 WHEN 1 THEN p_partkey WHEN 2 THEN p_retailprice ELSE p_size END::DOUBLE AS amount FROM part""",
        "files_by_path": f"""WITH {EVENTS} SELECT date, 1::BIGINT AS files, count(*) AS rows, sum(user_id)::BIGINT AS users FROM events_by_day
            WHERE date BETWEEN '2024-01-05' AND '2024-01-08' GROUP BY date
            UNION ALL SELECT '2024-01-09', 1, 0, 0""",
        "late_files_job": f"""WITH {STAGED} SELECT id, title, publisher, CAST(published_date AS VARCHAR) AS published_date, list_price,
            processing_date FROM staged WHERE id::BIGINT % 10 <> 3 OR processing_date < '2024-01-15'""",
        "late_hours_by_stream": f"""WITH {STAGED} SELECT id, title, publisher, CAST(published_date AS VARCHAR) AS published_date, list_price,
            processing_date FROM staged WHERE id::BIGINT % 10 <> 3 OR processing_date < '2024-01-15'""",
        "staging_limit": f"WITH {STAGED} SELECT least(count(*), 150) AS rows FROM staged",
        "catalogue_report": f"""WITH docs AS (SELECT doc_id, source, text, {TITLE} AS title FROM documents
              WHERE lang = 'en' AND length(text) > 100),
            {title_rule('docs', 'source', 'doc_id', 'title', '*')}
            SELECT source, count(*) AS books, round(avg(length({clean('text')})), 3) AS mean_length FROM kept
            GROUP BY source ORDER BY books DESC, source LIMIT 8""",
    }
    return sql
