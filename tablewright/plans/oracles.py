"""For each registered query, standard SQL over the test tables with the same rows."""

ORACLES = {
    "q_scan_orders": """
        SELECT o_orderkey AS order_id, c_name AS customer, o_totalprice AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "q_scan_documents": """
        SELECT doc_id AS document_id, lang AS source_language, text AS translated_text FROM documents""",
    "q_select_all": """
        SELECT * FROM conversations""",
    "q_project_rename": """
        SELECT o_orderkey AS order_id, c_name AS customer, o_totalprice * 2 AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "q_native_double": """
        SELECT o_orderkey AS order_id, o_totalprice AS amount, o_totalprice * 2 AS double_amount FROM orders""",
    "q_map_cents": """
        SELECT o_orderkey AS order_id, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
    "q_stamped_orders": """
        SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_day, DATE '2024-01-01' AS loaded_on
        FROM orders""",
    "q_map_lookup": """
        SELECT o_orderkey AS order_id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS owner, 'orders' AS source
        FROM orders""",
    "q_resource_paths": """
        WITH levels AS (
            SELECT 'local' AS w, r_name AS r, n_name AS n, CAST(c_custkey AS VARCHAR) AS c
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT w AS resource_path, CAST(NULL AS VARCHAR) AS parent_path, w AS name, COUNT(*) AS tables_covered
        FROM levels GROUP BY w
        UNION ALL
        SELECT w || '.' || r, w, r, COUNT(*) FROM levels GROUP BY w, r
        UNION ALL
        SELECT w || '.' || r || '.' || n, w || '.' || r, n, COUNT(*) FROM levels GROUP BY w, r, n
        UNION ALL
        SELECT w || '.' || r || '.' || n || '.' || c, w || '.' || r || '.' || n, c, COUNT(*)
        FROM levels GROUP BY w, r, n, c""",
    "q_anti_amount": """
        SELECT o.o_totalprice AS amount, o.o_orderkey AS order_id FROM orders o
        WHERE NOT EXISTS (
            SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_totalprice = o.o_totalprice)""",
    "q_totals": """
        SELECT l_orderkey AS order_id,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS total_amount
        FROM lineitem GROUP BY l_orderkey""",
    "q_totals_double": """
        SELECT l_orderkey AS order_id, ROUND(SUM(l_extendedprice), 2) AS total_amount
        FROM lineitem GROUP BY l_orderkey""",
    # the values have no bit below 2^-43: as whole numbers of that the sums are exact, and cut
    # in two that a double holds, so that one addition rounds, once
    "q_exact_totals": """
        WITH sums AS (
            SELECT l_orderkey, SUM(CAST(l_extendedprice * 8796093022208 AS HUGEINT)) AS units
            FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey AS order_id,
               (CAST(CAST(units // 4294967296 AS BIGINT) AS DOUBLE) * 4294967296
                + CAST(CAST(units % 4294967296 AS BIGINT) AS DOUBLE)) / 8796093022208 AS total_amount
        FROM sums""",
    "q_exact_total": """
        WITH sums AS (
            SELECT l_linestatus, SUM(CAST(l_extendedprice * (1 - l_discount) * 8796093022208 AS HUGEINT)) AS units
            FROM lineitem GROUP BY l_linestatus)
        SELECT l_linestatus,
               (CAST(CAST(units // 4294967296 AS BIGINT) AS DOUBLE) * 4294967296
                + CAST(CAST(units % 4294967296 AS BIGINT) AS DOUBLE)) / 8796093022208 AS total_paid
        FROM sums""",
    "q_row_count": """
        SELECT COUNT(*) AS row_count FROM lineitem""",
    "q_total_order": """
        SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders ORDER BY o_orderkey""",
    "q_top_orders": """
        SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders ORDER BY o_orderkey LIMIT 2""",
    "q_contract_columns": """
        WITH lines AS (
            SELECT o_orderkey, c_name, CAST(o_totalprice AS DECIMAL(10,2)) AS price
            FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT 'order_id' AS column_name, 'bigint' AS data_type, FALSE AS nullable,
               'Primary key' AS comment, COUNT(o_orderkey) AS filled_rows FROM lines
        UNION ALL SELECT 'customer', 'string', FALSE, NULL, COUNT(c_name) FROM lines
        UNION ALL SELECT 'amount', 'decimal(10,2)', FALSE, NULL, COUNT(price) FROM lines""",
    "q_violations": """
        WITH candidate AS (
            SELECT o_orderkey + COALESCE(l_discount, 0) AS order_id, l_extendedprice, l_shipdate
            FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
        SELECT 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS null_rows,
               COUNT(*) FILTER (WHERE order_id <> FLOOR(order_id)) AS unfit_rows
        FROM candidate
        UNION ALL SELECT 'amount', COUNT(*) - COUNT(l_extendedprice), 0 FROM candidate
        UNION ALL SELECT 'order_ts', COUNT(*) - COUNT(l_shipdate), 0 FROM candidate""",
    "q_write_counts": """
        WITH candidate AS (
            SELECT o_orderkey + COALESCE(l_discount, 0) AS order_id, l_extendedprice, l_shipdate
            FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
        SELECT 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS null_rows,
               COUNT(*) FILTER (WHERE order_id <> FLOOR(order_id)) AS unfit_rows
        FROM candidate
        UNION ALL SELECT 'amount', COUNT(*) - COUNT(l_extendedprice), 0 FROM candidate
        UNION ALL SELECT 'order_ts', COUNT(*) - COUNT(l_shipdate), 0 FROM candidate""",
    "q_kept_lines": """
        SELECT o_orderkey AS order_id, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS order_day
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount = 0""",
    "q_refused_lines": """
        SELECT CASE WHEN l_orderkey IS NULL THEN 'amount: missing' ELSE 'order_id: unfit' END AS refused_reason,
               o_orderkey + COALESCE(l_discount, 0) AS order_id, l_extendedprice AS amount,
               CAST(l_shipdate AS DATE) AS order_day
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL OR l_discount <> 0""",
    "q_namespaces": """
        SELECT TRUE AS namespace_listed, TRUE AS created_first, FALSE AS created_again, TRUE AS table_exists,
               TRUE AS shape_matches, COUNT(*) AS row_count
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "q_append_by_name": """
        SELECT o_orderkey AS order_id, c_name AS customer, CAST(o_totalprice AS DECIMAL(10,2)) AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "q_create_from_query": """
        SELECT o_orderkey AS order_id, o_totalprice AS amount, o_totalprice * 2 AS double_amount FROM orders""",
    "q_seed_if_empty": """
        SELECT o_orderkey AS order_id, c_name AS customer, o_totalprice AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "q_day_partitions": """
        SELECT CAST(l_shipdate AS DATE) AS order_day, COUNT(*) AS row_count FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-02-01 00:00:00'
        GROUP BY CAST(l_shipdate AS DATE)""",
    "q_listed_days": """
        WITH busy AS (
            SELECT CAST(o_orderdate AS DATE) AS order_day FROM orders WHERE o_orderpriority = '1-URGENT'
            GROUP BY CAST(o_orderdate AS DATE) HAVING COUNT(*) > 1)
        SELECT l_orderkey AS order_id, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS order_day
        FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT order_day FROM busy)""",
    "q_adhoc_relations": """
        SELECT 'customer' AS table_name, COUNT(*) AS row_count FROM customer
        UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
        UNION ALL SELECT 'orders', COUNT(*) FROM orders""",
    "q_adhoc_authorised": """
        SELECT c_mktsegment AS segment, COUNT(*) AS big_orders
        FROM customer JOIN orders ON c_custkey = o_custkey
        WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)
          AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
        GROUP BY c_mktsegment""",
    "q_file_inventory": "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, TRUE AS all_sized, COUNT(*) AS record_count FROM {table}"
        for table in (
            "region nation customer supplier part orders lineitem events "
            "documents embeddings pages benchmark labels conversations"
        ).split()
    ),
    "q_empty_files": """
        WITH files AS (
            SELECT CAST(0 AS BIGINT) AS record_count
            UNION ALL SELECT COUNT(*) FROM lineitem GROUP BY l_linenumber)
        SELECT record_count, COUNT(*) AS files FROM files GROUP BY record_count""",
    "q_compact_proof": """
        SELECT o_orderstatus, COUNT(*) AS row_count, TRUE AS unchanged FROM orders GROUP BY o_orderstatus""",
    "q_changed_rows": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(-1 AS BIGINT) AS surplus FROM orders
        WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
        UNION ALL
        SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice + 1, 1 FROM orders WHERE o_orderstatus = 'P'""",
    "q_compact_rows": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""",
    "q_compact_stats": """
        SELECT 'fewer files' AS measure, CAST(1 AS BIGINT) AS value
        UNION ALL SELECT 'rows', COUNT(*) FROM orders
        UNION ALL SELECT 'changed rows', CAST(0 AS BIGINT)""",
    "q_compact_partitions": """
        SELECT o_orderstatus, COUNT(*) AS before_rows, COUNT(*) AS after_rows, TRUE AS fewer_files
        FROM orders GROUP BY o_orderstatus""",
    "q_history": """
        WITH batches AS (
            SELECT o_orderpriority AS priority, COUNT(*) AS orders FROM orders GROUP BY o_orderpriority),
        appends AS (
            SELECT ROW_NUMBER() OVER (ORDER BY priority) AS run_id,
                   SUM(orders) OVER (ORDER BY priority) AS total FROM batches)
        SELECT run_id, 'append' AS operation, TRUE AS more_files, CAST(total AS BIGINT) AS total_records
        FROM appends
        UNION ALL
        SELECT MAX(run_id) + 1, 'replace', FALSE, CAST(MAX(total) AS BIGINT) FROM appends""",
    "q_earlier_state": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "q_memberships": """
        SELECT n_name AS group_name,
               CASE WHEN c_acctbal < 0 THEN 'service_account' ELSE 'email' END AS kind,
               CASE WHEN c_acctbal < 0 THEN c_name ELSE LOWER(c_name) || '@company.com' END AS principal
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "q_declared_memberships": """
        SELECT n_name AS group_name, CASE WHEN c_acctbal < 0 THEN 'service_account' ELSE 'email' END AS kind,
               c_name AS principal
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "q_reconciliation": """
        WITH declared AS (
            SELECT n_name, r_name, c_name, CASE WHEN c_acctbal < 0 THEN 'service_account' ELSE 'email' END AS kind,
                   CASE WHEN c_mktsegment = 'BUILDING' THEN 'warehouse' ELSE 'namespace' END AS resource_type,
                   'local.' || r_name AS resource_path,
                   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'write' ELSE 'select' END AS permission
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT DISTINCT 1 AS step, 'create_group' AS action, n_name AS group_name, CAST(NULL AS VARCHAR) AS kind,
               CAST(NULL AS VARCHAR) AS principal, CAST(NULL AS VARCHAR) AS resource_type,
               CAST(NULL AS VARCHAR) AS resource_path, CAST(NULL AS VARCHAR) AS permission, CAST(NULL AS VARCHAR) AS reason
        FROM declared WHERE r_name <> 'ASIA'
        UNION ALL
        SELECT 2, 'add_member', n_name, kind, c_name, NULL, NULL, NULL, NULL FROM declared WHERE r_name <> 'ASIA'
        UNION ALL
        SELECT DISTINCT 3, 'grant', n_name, NULL, NULL, resource_type, resource_path, permission, NULL FROM declared
        WHERE r_name <> 'ASIA' AND resource_type = 'namespace' AND permission = 'select'
        UNION ALL
        SELECT DISTINCT 4, 'reject', n_name, NULL, NULL, resource_type, resource_path, permission,
               CASE WHEN permission = 'write' THEN 'unknown permission' ELSE 'path does not fit the type' END
        FROM declared WHERE resource_type = 'warehouse' OR permission = 'write'""",
    "q_resolved_memberships": """
        SELECT 'email' AS kind, c_custkey AS principal, n_name AS group_name, n_nationkey AS role_id, c_name AS subject_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "q_unresolved_members": """
        SELECT o_orderkey AS principal, o_orderstatus AS group_name FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "q_rejected_grants": """
        WITH grants AS (
            SELECT o_orderkey AS grant_id, n_name AS group_name,
                   CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'namespace' ELSE 'view' END AS resource_type,
                   'local.' || n_name AS resource_path,
                   CASE o_orderpriority WHEN '1-URGENT' THEN 'modify' WHEN '2-HIGH' THEN 'write' ELSE 'select' END
                       AS permission,
                   r_name <> 'AFRICA' AS declared
            FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        judged AS (
            SELECT *, CASE WHEN NOT declared THEN 'unknown group'
                           WHEN permission = 'write' THEN 'unknown permission'
                           WHEN resource_type = 'view' THEN 'unsupported resource type'
                           WHEN resource_type = 'table' THEN 'path does not fit the type' END AS reason
            FROM grants)
        SELECT grant_id, group_name, resource_type, resource_path, permission, reason
        FROM judged WHERE reason IS NOT NULL""",
    "q_missing_memberships": """
        SELECT n_name AS group_name, 'email' AS kind, c_custkey AS principal
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "q_missing_grants": """
        SELECT 'supplier-' || l_suppkey AS group_name, 'table' AS resource_type,
               'local.parts.' || l_partkey AS resource_path, 'select' AS permission
        FROM lineitem GROUP BY l_suppkey, l_partkey
        HAVING COUNT(CASE WHEN l_linestatus = 'F' THEN 1 END) = 0""",
    "q_effective_access": """
        SELECT DISTINCT c_custkey AS user_id, t.n_name AS table_name,
               CASE WHEN g.n_nationkey % 5 = 0 THEN 'modify' ELSE 'select' END AS permission
        FROM customer JOIN nation g ON c_nationkey = g.n_nationkey
        JOIN nation t ON t.n_regionkey = g.n_regionkey AND (g.n_nationkey % 5 = 0 OR t.n_nationkey = g.n_nationkey)""",
    "q_grant_reach": """
        WITH held AS (
            SELECT c_custkey, t.n_name AS table_name,
                   CASE WHEN g.n_nationkey % 5 = 0 THEN 'modify' ELSE 'select' END AS permission
            FROM customer JOIN nation g ON c_nationkey = g.n_nationkey
            JOIN nation t ON t.n_regionkey = g.n_regionkey AND (g.n_nationkey % 5 = 0 OR t.n_nationkey = g.n_nationkey)
            UNION ALL
            SELECT o_custkey, n_name, 'select' FROM orders, nation WHERE o_orderstatus = 'F')
        SELECT table_name, permission, COUNT(DISTINCT c_custkey) AS principals FROM held GROUP BY table_name, permission""",
    "q_access_check": """
        WITH requests AS (
            SELECT o_orderkey AS request_id,
                   CASE WHEN o_orderpriority = '5-LOW' THEN 'service_account' ELSE 'email' END AS kind,
                   o_custkey AS principal, n_nationkey, n_regionkey,
                   'local.' || r_name || '.' || n_name AS table_path,
                   CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'write' ELSE 'compact' END AS action
            FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 JOIN region ON n_regionkey = r_regionkey)
        SELECT request_id, kind, principal, table_path, action,
               CASE WHEN kind <> 'email' THEN 'not_found'
                    WHEN g.n_nationkey % 5 = 0 AND g.n_regionkey = q.n_regionkey THEN 'allowed'
                    WHEN g.n_nationkey % 5 <> 0 AND g.n_nationkey = q.n_nationkey
                         THEN CASE WHEN action = 'read' THEN 'allowed' ELSE 'denied' END
                    ELSE 'not_found' END AS outcome
        FROM requests q JOIN customer ON principal = c_custkey JOIN nation g ON c_nationkey = g.n_nationkey""",
    "q_orphan_members": """
        SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 10 = 0""",
}
