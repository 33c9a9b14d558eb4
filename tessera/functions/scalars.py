"""Scalar functions as named SQL: a query that both engines understand, or a pair (Spark, DuckDB)."""

SCALARS: dict[str, str | tuple[str, str]] = {
    "string_functions": ("SELECT doc_id, lower(substring(text, 1, 20)) AS head, trim(substring(text, 5, 9)) AS mid, split_part(text, ' ', 2) AS second, length(text) AS n FROM documents", "SELECT doc_id, lower(substring(text, 1, 20)) AS head, trim(substring(text, 5, 9)) AS mid, split_part(text, ' ', 2) AS second, length(text) AS n FROM documents"),
    "regex_functions": ("SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 2) AS w, md5(regexp_replace(text, '[aeiou]+', '-')) AS r, size(regexp_extract_all(text, '[0-9]+', 0)) AS n FROM documents", "SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 2) AS w, md5(regexp_replace(text, '[aeiou]+', '-', 'g')) AS r, len(regexp_extract_all(text, '[0-9]+'))::INT AS n FROM documents"),
    "hash_functions": ("SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents"),
    "date_functions": ("SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS m, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS due, year(o_orderdate) AS y, quarter(o_orderdate) AS q, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders", "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS m, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS STRING) AS due, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INT) AS age FROM orders"),
    "math_functions": "SELECT p_partkey, p_size % 7 AS m, abs(p_size - 25) AS a, floor(p_retailprice / 100) * 1.0 AS f, round(sqrt(p_size), 6) AS s, greatest(p_size, 10) AS g FROM part",
    "array_functions": ("SELECT vec_id, label, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 4) AS norm2, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings"),
    "explode_words": ("SELECT lang, w, count(*) AS n FROM (SELECT lang, explode(split(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '' GROUP BY lang, w HAVING count(*) >= 20", "SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '' GROUP BY lang, w HAVING count(*) >= 20"),
    "map_functions": ("SELECT n_nationkey, m['name'] AS name, size(map_keys(m)) AS k FROM (SELECT n_nationkey, map_from_arrays(array('name', 'region'), array(n_name, CAST(n_regionkey AS STRING))) AS m FROM nation)", "SELECT n_nationkey, m['name'] AS name, len(map_keys(m))::INT AS k FROM (SELECT n_nationkey, map(['name', 'region'], [n_name, CAST(n_regionkey AS VARCHAR)]) AS m FROM nation)"),
    "json_functions": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, variant_get(parse_json(props), '$.k', 'bigint') AS v FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events"),
    "json_struct": ("SELECT event_id, from_json(props, 'k BIGINT').k AS k, to_json(named_struct('id', event_id)) AS j FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || '}' AS j FROM events"),
    "zip_arrays": ("SELECT vec_id, round(aggregate(zip_with(embedding, reverse(embedding), (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS folded FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS folded FROM embeddings"),
    "positions": ("SELECT conv_id, turn, pos, w FROM conversations LATERAL VIEW posexplode(split(role, '')) AS pos, w", "SELECT conv_id, turn, unnest(range(len(role)))::INT AS pos, unnest(string_split(role, '')) AS w FROM conversations"),
    "sequences": ("SELECT n_nationkey, explode(sequence(0, n_regionkey)) AS k FROM nation", "SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INT AS k FROM nation"),
    "redacted": ("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '<email>'), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', '<ip>')) AS redacted, text RLIKE '(password|secret|token|api_key) ?[=:]' AS secret FROM documents", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '<email>', 'g'), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', '<ip>', 'g')) AS redacted, regexp_matches(text, '(password|secret|token|api_key) ?[=:]') AS secret FROM documents"),
    "repeated_lines": ("SELECT doc_id, size(l) AS n, size(l) - size(array_distinct(l)) AS again FROM (SELECT doc_id, filter(split(text, '\n'), x -> x <> '') AS l FROM documents)", "SELECT doc_id, len(l)::INT AS n, (len(l) - len(list_distinct(l)))::INT AS again FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)"),
    "edit_distance": ("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS d FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1", "SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS d FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"),
    "url_parts": ("SELECT page_id, parse_url(url, 'HOST') AS host, parse_url(url, 'PATH') AS path FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages"),
    "event_windows": ("SELECT window.start AS day, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 day'), event_type", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "normalised_text": ("SELECT md5(regexp_replace(lower(text), '[^a-z0-9]+', ' ')) AS h, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1", "SELECT md5(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS h, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1"),
    "conversation_rows": ("SELECT conv_id, count(*) AS turns, concat_ws('\\n', transform(array_sort(collect_list(struct(turn, role, text))), x -> concat(x.role, ': ', x.text))) AS chat FROM conversations GROUP BY conv_id", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id"),
}
