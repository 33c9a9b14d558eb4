"""Projection, filter, join, aggregation, window, sort and set operators as named SQL.

An entry is a query that both engines understand, or a pair (Spark, DuckDB). Sums of money are taken on
decimals, so that they do not depend on the order of addition.
"""

M = "CAST({} AS DECIMAL(18,2))"

RELATIONAL: dict[str, str | tuple[str, str]] = {
    "project_cast": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, TRY_CAST(substring(o_orderpriority, 1, 1) AS INT) AS level, TRY_CAST(o_orderpriority AS INT) AS none, upper(o_orderstatus) AS status FROM orders",
    "filter_three_valued": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (nullif(l_returnflag, 'A') = 'R') AND l_quantity > 25",
    "case_coalesce": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment FROM customer",
    "like_regex": ("SELECT doc_id FROM documents WHERE text LIKE '%the %' AND text RLIKE '[0-9]{3}'", "SELECT doc_id FROM documents WHERE text LIKE '%the %' AND regexp_matches(text, '[0-9]{3}')"),
    "in_between": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 14) OR p_retailprice BETWEEN 1000 AND 1200",
    "sample_by_hash": "SELECT doc_id, md5(CAST(doc_id AS STRING)) AS h FROM documents WHERE md5(CAST(doc_id AS STRING)) < '2'",
    "inline_rows": "SELECT v.k, n.n_name FROM (VALUES (1, 'a'), (2, 'b')) AS v(k, s) JOIN nation n ON n.n_nationkey = v.k",
    "join_inner": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "join_left": "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_right": "SELECT l.doc_id, d.lang FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en'",
    "join_full": "SELECT a.c_custkey AS left_key, b.s_suppkey AS right_key FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey + 50",
    "join_semi": ("SELECT c_custkey, c_name FROM customer c LEFT SEMI JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)"),
    "join_anti": ("SELECT c_custkey, c_name FROM customer c LEFT ANTI JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_merge_hint": ("SELECT /*+ MERGE(o) */ o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o_orderkey", "SELECT o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o_orderkey"),
    "join_shuffle_hash_hint": ("SELECT /*+ SHUFFLE_HASH(c) */ o_orderpriority, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o_orderpriority"),
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_broadcast_hint": ("SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT c_custkey, n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    "join_lateral": "SELECT o.o_orderkey, x.n, x.q FROM orders o, LATERAL (SELECT count(*) AS n, max(l_quantity) AS q FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) x",
    "join_self": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id + 1 = b.event_id",
    # a correlated maximum over what came before is a running maximum: one sort by user, no join of a user's events with each other
    "asof_correlated_max": (
        "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'",
        "SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id < e.event_id) AS last_purchase FROM events e WHERE e.event_type = 'error'",
    ),
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, CAST(sum({M.format('l_quantity')}) AS DOUBLE) AS sum_qty, CAST(sum({M.format('l_extendedprice')}) AS DOUBLE) AS sum_price, count(*) AS n, min(l_discount) AS least, max(l_tax) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus",
    "aggregate_all": f"SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, min(c_acctbal) AS least, max(c_acctbal) AS most, round(CAST(sum({M.format('c_acctbal')}) AS DOUBLE) / count(*), 4) AS mean FROM customer",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "cube": "SELECT n_regionkey, n_nationkey % 2 AS odd, count(*) AS n FROM nation GROUP BY CUBE (n_regionkey, n_nationkey % 2)",
    "rollup_grouping": ("SELECT o_orderpriority, o_orderstatus, CAST(grouping_id() AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)", "SELECT o_orderpriority, o_orderstatus, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"),
    "grouping_sets": "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "filter_clause": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id",
    "ordered_list": ("SELECT conv_id, listagg(role, '>') WITHIN GROUP (ORDER BY turn) AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id"),
    "pivot": ("SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('click' AS click, 'view' AS view, 'error' AS error))", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id"),
    "unpivot": ("SELECT doc_id, name, v FROM labels UNPIVOT (v FOR name IN (quality, toxic))", "SELECT doc_id, 'quality' AS name, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"),
    "decimal_sum": f"SELECT o_orderpriority, CAST(sum({M.format('o_totalprice')}) AS STRING) AS total FROM orders GROUP BY o_orderpriority",
    "statistics": "SELECT event_type, round(corr(value, event_id), 6) AS r, round(regr_slope(value, event_id), 8) AS slope, round(stddev(value), 6) AS sd FROM events GROUP BY event_type",
    "row_number": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem",
    "lag_lead": "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "asof_last_purchase": ("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS second FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS second FROM events"),
    "moving_sums": f"SELECT event_id, CAST(sum({M.format('value')}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS so_far FROM events",
    # DuckDB casts to the nearest whole number, halves to the even one, which is rint; Spark's cast cuts
    "range_frame": (
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(rint(o_totalprice) AS BIGINT) RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS alike FROM orders",
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS BIGINT) RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS alike FROM orders",
    ),
    "sessions_batch": ("SELECT user_id, s, count(*) AS n, min(event_id) AS first FROM (SELECT user_id, event_id, sum(CASE WHEN gap > 1800 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, ts, CAST(unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1000000 AS gap FROM events)) GROUP BY user_id, s", "SELECT user_id, CAST(s AS BIGINT) AS s, count(*) AS n, min(event_id) AS first FROM (SELECT user_id, event_id, sum(CASE WHEN gap > 1800 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS gap FROM events)) GROUP BY user_id, s"),
    "top_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "top_k_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "union_all": "SELECT 'c' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "distinct_rows": "SELECT DISTINCT lang, source FROM documents",
    # turns that follow each other without a gap from a conversation's first on; the recursion ends when no turn follows
    "recursive_cte": (
        "WITH RECURSIVE t(conv_id, turn, hops, path) AS (SELECT conv_id, turn, 0, role FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least FROM conversations) WHERE turn = least UNION ALL SELECT c.conv_id, c.turn, t.hops + 1, concat(t.path, '>', c.role) FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, hops, path FROM t",
        "WITH RECURSIVE t(conv_id, turn, hops, path) AS (SELECT conv_id, turn, 0, role FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least FROM conversations) WHERE turn = least UNION ALL SELECT c.conv_id, c.turn, t.hops + 1, t.path || '>' || c.role FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, hops, path FROM t",
    ),
    "pipe_syntax": ("FROM orders |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus"),
    "approx_within_bound": (  # the estimate of many distinct values is within three standard errors; beside count(DISTINCT) in one aggregation, each order would hold a sketch
        "SELECT e.l_returnflag, e.orders, abs(a.told - e.orders) <= 0.06 * e.orders AS near FROM (SELECT l_returnflag, count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS orders FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) GROUP BY l_returnflag) e JOIN (SELECT l_returnflag, approx_count_distinct(l_orderkey, 0.02) AS told FROM lineitem GROUP BY l_returnflag) a ON e.l_returnflag <=> a.l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS near FROM lineitem GROUP BY l_returnflag",
    ),
    "first_value": "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events",
    "mode": ("SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_custkey % 7) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, m FROM (SELECT o_orderstatus, o_custkey % 7 AS m, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_custkey % 7) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1"),
}
