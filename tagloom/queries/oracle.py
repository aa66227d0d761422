"""SQL whose results the registered queries must equal."""

from __future__ import annotations

_BASE = """
(SELECT c.c_custkey AS cust_id, coalesce(a.n, 0) AS n_orders, coalesce(b.r, 0) AS n_open, coalesce(a.t, 0.0) AS total
 FROM customer c
 LEFT JOIN (SELECT o_custkey k, count(*) n, max(o_totalprice) t FROM orders GROUP BY 1) a ON a.k = c.c_custkey
 LEFT JOIN (SELECT o_custkey k, count(*) r FROM orders
            WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1) b
   ON b.k = c.c_custkey) t
"""

_TREE = """
WITH tree AS (
  SELECT 'r' || r_regionkey AS id, 0 AS depth, r_regionkey AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, r_name AS path
  FROM region
  UNION ALL
  SELECT 'n' || n_nationkey, 1, r_regionkey, n_nationkey, NULL, r_name || '/' || n_name
  FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL
  SELECT 'c' || c_custkey, 2, r_regionkey, n_nationkey, c_custkey, r_name || '/' || n_name || '/' || c_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""

_SPOILED = """
(SELECT user_id, CASE event_type WHEN 'error' THEN 'NaN' WHEN 'view' THEN '' WHEN 'click' THEN NULL
                                 ELSE event_type END AS v FROM events) t
"""

_RETURNED = """
(SELECT o.o_custkey k, sum(l.l_quantity) q FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
 WHERE l.l_returnflag = 'R' GROUP BY 1) r
"""

_ORACLE = {
    "key_basic": "SELECT DISTINCT c_custkey AS cust_id FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT NULL",
    "key_sql": "SELECT DISTINCT o_custkey AS cust_id FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT NULL",
    "key_incremental": """
        SELECT DISTINCT o_custkey AS cust_id FROM orders WHERE o_orderdate > TIMESTAMP '2001-07-01 00:00:00'""",
    "basic_item_distinct": """
        SELECT DISTINCT o_custkey AS cust_id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'""",
    "basic_item_max": """
        SELECT o_custkey AS cust_id, max(o_totalprice) AS top_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
    "basic_item_latest": """
        SELECT cust_id, last_price FROM (
          SELECT o_custkey AS cust_id, o_totalprice AS last_price,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) rn
          FROM orders) WHERE rn = 1""",
    "basic_item_incremental": """
        SELECT o_custkey AS cust_id, max(o_totalprice) AS new_top FROM orders
        WHERE o_orderdate > TIMESTAMP '2001-01-01 00:00:00' GROUP BY 1""",
    "basic_items_shared_scan": """
        SELECT c_custkey AS cust_id, coalesce(max(o_totalprice), 0.0) AS top_price,
               coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 0.0) AS top_urgent,
               coalesce(arg_max(o_orderstatus, (o_orderdate, o_orderstatus)), 'none') AS last_status
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "basic_item_aggregates": """
        SELECT s_suppkey AS supp_id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_returned, coalesce(nullif(o, 0), -1) AS n_odd,
               coalesce(q, 0.0) AS quantity, coalesce(late, -1) AS late, coalesce(dearest, 0.0) AS dearest
        FROM supplier LEFT JOIN (
          SELECT l_suppkey, count(*) AS n, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS r,
                 count(*) FILTER (l_linenumber <> 2) AS o, sum(l_quantity) AS q, max(l_extendedprice) AS dearest,
                 CAST(sum(l_linenumber) FILTER (l_shipdate > TIMESTAMP '2001-10-01 00:00:00') AS BIGINT) AS late
          FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""",
    "sql_item": """
        SELECT o.o_custkey AS cust_id, count(*) AS n_returned
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY 1""",
    "sql_item_latest": """
        SELECT o_custkey AS cust_id, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last_price FROM orders GROUP BY 1""",
    "sql_item_rollup": """
        SELECT o_custkey AS cust_id, count(*) AS most FROM orders GROUP BY 1""",
    "staging_scope": """
        SELECT 'a' AS tag, o_custkey AS cust_id, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 2
        UNION ALL SELECT 'b', o_custkey, CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""",
    "sql_item_params": """
        SELECT o_custkey AS cust_id, count(*) AS n_big FROM orders
        WHERE o_totalprice > 200000 AND o_orderstatus = 'O' GROUP BY 1""",
    "sql_item_incremental": """
        SELECT o_custkey AS cust_id, count(*) AS n_orders FROM orders GROUP BY 1
        HAVING max(o_orderdate) > TIMESTAMP '2001-07-01 00:00:00'""",
    "method_dataframe": "SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1",
    "method_grouped": "SELECT user_id, max(value) - min(value) AS value_range FROM events GROUP BY 1",
    "exclude_invalid": f"""
        SELECT DISTINCT user_id, v AS tag_value FROM {_SPOILED}
        WHERE v IS NOT NULL AND v NOT IN ('', 'NaN', 'Infinity', 'null', 'Null', 'NULL')""",
    "exclude_invalid_compat": f"SELECT DISTINCT user_id, v AS tag_value FROM {_SPOILED} WHERE v IS NOT NULL",
    "staging_item": """
        SELECT o.o_custkey AS cust_id, sum(l.l_quantity) AS revenue
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_linestatus = 'O' GROUP BY 1""",
    "staging_shared": """
        SELECT c_custkey AS cust_id, coalesce(r, 0.0) AS revenue, coalesce(n, 0) AS n_lines FROM customer LEFT JOIN (
          SELECT o.o_custkey AS k, sum(l.l_quantity) AS r, count(*) AS n
          FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_linestatus = 'O' GROUP BY 1)
        ON k = c_custkey""",
    "formula_expr": f"SELECT cust_id, CAST(n_open AS DOUBLE) / CAST(n_orders AS DOUBLE) * 100.0 AS open_pct FROM {_BASE}",
    "formula_div_zero_double": f"""
        SELECT cust_id, CASE WHEN n_open = 0 THEN 0.0 ELSE CAST(n_orders AS DOUBLE) / n_open END AS ratio FROM {_BASE}""",
    "formula_div_zero_int": f"SELECT cust_id, n_orders // n_open AS ratio_i FROM {_BASE} WHERE n_open <> 0",
    "formula_sum": f"SELECT cust_id, CAST(floor(n_orders + n_open + total + 0.5) AS BIGINT) AS s FROM {_BASE}",
    "formula_chain": f"SELECT cust_id, (CAST(n_open AS DOUBLE) / n_orders) * 2.0 + 1.0 AS score2 FROM {_BASE}",
    "formula_constant": f"SELECT cust_id, total / 5.0 AS fifth FROM {_BASE}",
    "formula_callable": f"SELECT cust_id, n_orders - n_open AS gap FROM {_BASE}",
    "formula_string": f"SELECT cust_id, CAST(n_orders AS VARCHAR) AS s FROM {_BASE}",
    "formula_sum_mixed": """
        SELECT o_custkey AS cust_id, CAST(count(*) AS DOUBLE) + 12.5 + CAST(epoch_ms(max(o_orderdate)) AS DOUBLE) AS s
        FROM orders GROUP BY 1""",
    "formula_coerce_prefix": """
        SELECT p_partkey, CAST(regexp_extract(substr(p_brand, 7) || 'x', '^[0-9]+') AS BIGINT) AS brand_no FROM part""",
    "formula_coerce_negative_compat": """
        SELECT c_custkey AS cust_id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS bal FROM customer""",
    "post_weight_positive": """
        SELECT c_custkey AS cust_id, c_acctbal AS bal_ctr, c_acctbal / 5000.0 * 0.3 * 100.0 AS bal FROM customer""",
    "post_weight_negative": """
        SELECT c_custkey AS cust_id, c_acctbal AS bal_ctr,
               CASE WHEN c_acctbal = 0 THEN 0.0 ELSE 5000.0 / c_acctbal END * 0.3 * 100.0 AS bal FROM customer""",
    "post_number_clamp": """
        SELECT c_custkey AS cust_id, c_acctbal AS bal_ctr, least(greatest(c_acctbal, 0.0), 8000.0) AS bal FROM customer""",
    "post_long_round": """
        SELECT o_custkey AS cust_id, count(*) AS n_ctr, CAST(floor(count(*) / 7.0 * 100.0 + 0.5) AS BIGINT) AS n
        FROM orders GROUP BY 1""",
    "init_defaults": """
        SELECT c_custkey AS cust_id, CAST(0 AS BIGINT) AS n_orders, CAST(1.5 AS DOUBLE) AS score, 'unknown' AS segment
        FROM customer""",
    "init_new_keys": """
        SELECT c_custkey AS cust_id, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'unknown' END AS segment
        FROM customer""",
    "new_keys_only": """
        SELECT c_custkey AS cust_id FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    "add_missing_columns": """
        SELECT c_custkey AS cust_id, c_acctbal AS bal, CAST(0.0 AS DOUBLE) AS risk, 'n/a' AS grade FROM customer""",
    "modify_column_type": "SELECT c_custkey AS cust_id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "backfill_blank": """
        SELECT c_custkey AS cust_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS segment
        FROM customer""",
    "cell_storage": """
        SELECT c_custkey AS cust_id,
               CASE WHEN c_acctbal > 9000 THEN c_mktsegment
                    WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment
                    WHEN c_acctbal > 0 THEN 'unknown' ELSE '' END AS segment,
               (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS top_price
        FROM customer""",
    "save_update_existing": """
        SELECT c.c_custkey AS cust_id, coalesce(u.v, -1.0) AS top_price FROM customer c
        LEFT JOIN (SELECT o_custkey, max(o_totalprice) v FROM orders WHERE o_totalprice > 400000 GROUP BY 1) u
          ON u.o_custkey = c.c_custkey
        WHERE c.c_acctbal > 0""",
    "reload_column": """
        SELECT c.c_custkey AS cust_id, coalesce(u.v, 0.0) AS top_price FROM customer c
        LEFT JOIN (SELECT o_custkey, max(o_totalprice) v FROM orders
                   WHERE o_orderstatus = 'F' AND o_totalprice > 400000 GROUP BY 1) u ON u.o_custkey = c.c_custkey""",
    "drop_column": "SELECT c_custkey AS cust_id, c_name FROM customer",
    "two_pass_incremental": """
        SELECT c.c_custkey AS cust_id,
               coalesce(max(CASE WHEN o_orderdate > TIMESTAMP '2001-01-01 00:00:00' THEN o_totalprice END),
                        max(CASE WHEN o_orderdate <= TIMESTAMP '2001-01-01 00:00:00' THEN o_totalprice END), 0.0) AS price
        FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""",
    "update_few_buckets": """
        SELECT count(*) AS n_rows, count(*) FILTER (coalesce(late, early, 0.0) <> coalesce(early, 0.0)) AS n_changed,
               CAST(0 AS BIGINT) AS n_changed_outside
        FROM (SELECT c_custkey, max(CASE WHEN o_orderdate > TIMESTAMP '2001-07-25 00:00:00' THEN o_totalprice END) AS late,
                max(CASE WHEN o_orderdate <= TIMESTAMP '2001-07-25 00:00:00' THEN o_totalprice END) AS early
              FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""",
    "error_isolation": f"SELECT cust_id, n_orders, CAST(-1.0 AS DOUBLE) AS broken FROM {_BASE}",
    "error_isolation_default": f"SELECT cust_id, n_orders, CAST(0 AS BIGINT) AS broken FROM {_BASE}",
    "truncate_result": """
        SELECT 'before' AS step, count(*) AS n_rows, 4 AS n_columns FROM customer
        UNION ALL SELECT 'after', 0, 4""",
    "lenient_dates": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 0 THEN o_orderdate
          ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS d FROM orders""",
    "normalize_types": """
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate
        FROM lineitem""",
    "date_encode": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
               CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(epoch_ms(o_orderdate) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""",
    "cell_decode": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
               CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey END AS o_custkey,
               CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_orderdate
        FROM orders""",
    "lenient_parse": """
        SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k FROM events""",
    "trim_token": "SELECT DISTINCT p_type, regexp_replace(p_type, '(Y)+$', '') AS trimmed FROM part",
    "date_format": "SELECT DISTINCT o_orderdate AS d, strftime(o_orderdate, '%Y%m%d') AS s FROM orders",
    "code_map": """
        SELECT CAST(s_suppkey AS VARCHAR) AS itemvalue, s_name AS itemtext FROM supplier
        WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_9')""",
    "code_decode": """
        SELECT c.c_custkey AS cust_id, n.n_name AS nation FROM customer c
        LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "code_decode_lines": """
        SELECT l_orderkey, l_linenumber, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS supplier FROM lineitem
        LEFT JOIN (SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
                   WHERE n_name = 'NATION_9') ON s_suppkey = l_suppkey""",
    "page_with_tiebreak": """
        SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 20 OFFSET 40""",
    "page_with_condition": """
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 30""",
    "row_positions": """
        SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""",
    "key_page": "SELECT CAST(c_custkey AS VARCHAR) AS row_key FROM customer ORDER BY row_key LIMIT 10 OFFSET 100",
    "key_page_from": """
        SELECT row_key FROM (SELECT CAST(c_custkey AS VARCHAR) AS row_key FROM customer) WHERE row_key >= '109'
        ORDER BY row_key LIMIT 10""",
    "count_where": "SELECT count(1) AS n FROM orders WHERE o_orderstatus = 'F'",
    "multi_get": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (1, 5, 7, 999999)",
    "multi_get_frame": """
        SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""",
    "watermark_latest": "SELECT event_type AS model, max(ts) AS last_ok FROM events WHERE value < 100 GROUP BY 1",
    "runlog_messages": """
        SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
               CAST(event_id AS VARCHAR) AS msg FROM events""",
    "category_preorder": f"""
        {_TREE} SELECT id, depth,
          row_number() OVER (ORDER BY a DESC, b DESC NULLS FIRST, c DESC NULLS FIRST) AS pos FROM tree""",
    "category_ancestors": f"{_TREE} SELECT id, path FROM tree",
    "deep_pages": """
        WITH placed AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders)
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM placed
        WHERE p BETWEEN 501 AND 540 OR p BETWEEN 1201 AND 1230""",
    "category_ancestors_of": f"""
        {_TREE} SELECT id, path FROM tree WHERE id IN (
          SELECT concat('c', c_custkey) FROM customer WHERE c_acctbal < 0
          UNION ALL SELECT concat('n', c_nationkey) FROM customer WHERE c_acctbal < 0)""",
    "item_order": f"""
        {_TREE} SELECT pos AS category_pos, s_suppkey AS orderno, s_name AS itemanothername FROM supplier JOIN (
          SELECT id, row_number() OVER (ORDER BY a DESC, b DESC NULLS FIRST, c DESC NULLS FIRST) AS pos FROM tree
        ) ON id = concat('n', s_nationkey) WHERE s_acctbal > 0""",
    "model_two_sources": """
        SELECT 'sales' AS tag, o_custkey AS id, max(o_totalprice) AS top FROM orders GROUP BY 2
        UNION ALL SELECT 'stock', s_suppkey, max(s_acctbal) FROM supplier GROUP BY 2""",
    "run_counts": """
        WITH o AS (SELECT o_custkey AS k, count(*) AS n, nullif(count(*) FILTER (
            o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1999-01-01 00:00:00'), 0) AS open FROM orders GROUP BY 1),
        r AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
        c AS (SELECT * FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN (SELECT k AS rk FROM r) ON rk = c_custkey)
        SELECT 'customer_profile' AS tag, unnest(['(rows)', 'nation', 'n_orders', 'n_open', 'total', 'returned_qty']) AS item,
          unnest([count(*), count(*) FILTER (c_nationkey IN (SELECT n_nationkey FROM nation)), count(n), count(open), count(n), count(rk)])
            AS n_rows FROM c""",
    "runlog_append": """
        SELECT 'm' AS model, 'failed' AS status, '["first", "' || count(*) || ' errors", "third", "last"]' AS messages
        FROM events WHERE event_type = 'error'""",
    "user_profile": """
        SELECT user_id, n_events, n_errors, CAST(n_errors AS DOUBLE) / n_events AS error_rate,
               CAST(n_errors AS DOUBLE) / n_events AS health_ctr,
               CASE WHEN n_errors = 0 THEN 0.0 ELSE 0.2 / (CAST(n_errors AS DOUBLE) / n_events) END * 100.0 AS health,
               last_type
        FROM (SELECT user_id, count(*) AS n_events, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors,
                     arg_max(event_type, (ts, event_type)) AS last_type FROM events GROUP BY 1)""",
    "customer_profile": f"""
        SELECT t.cust_id, n.n_name AS nation, t.n_orders, t.n_open,
               CASE WHEN t.n_orders = 0 THEN 0.0 ELSE CAST(t.n_open AS DOUBLE) / t.n_orders END AS open_ratio,
               t.total AS total_ctr, least(greatest(t.total, 0.0), 450000.0) AS total, coalesce(r.q, 0.0) AS returned_qty
        FROM {_BASE} JOIN customer c ON c.c_custkey = t.cust_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN {_RETURNED} ON r.k = t.cust_id""",
    "model_run": """
        SELECT c_custkey AS cust_id, coalesce(n, 0) AS n_closed,
               CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1.0 END AS bal_ctr,
               CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000.0 * 100.0 ELSE -1.0 END AS bal,
               CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000.0 * 100.0 ELSE -1.0 END + coalesce(n, 0) AS score
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
          ON o_custkey = c_custkey""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
