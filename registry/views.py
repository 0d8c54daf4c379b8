"""Business tables derived from the given star schema, as SQL valid in both engines.

``{name}`` marks a given table; views may also build on earlier views by plain name in
SQL for the oracle, and by ``{name}`` here.
"""

_TRANSACTION = """o_orderkey AS id, concat('T', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS transaction_id,
               o_orderdate AS transaction_date, CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'cash' WHEN '2' THEN 'card'
                    WHEN '3' THEN 'transfer' ELSE 'online' END AS payment_method,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                    ELSE 'cancelled' END AS status"""

VIEWS: dict[str, str] = {
    "monthly_sales": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS revenue,
               CAST(COUNT(*) AS INT) AS transaction_count
        FROM {orders} GROUP BY 1""",
    "sales_transaction": f"SELECT {_TRANSACTION} FROM {{orders}}",
    # With the customer's name, where a list shows it.
    "transaction_named": f"""
        SELECT {_TRANSACTION}, c_name AS customer_name
        FROM {{orders}} LEFT JOIN {{customer}} ON o_custkey = c_custkey""",
    "sales_invoice": """
        SELECT o_orderkey AS id,
               concat('INV', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS invoice_number,
               CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey END AS transaction_id,
               CAST(o_orderdate AS DATE) AS issue_date,
               CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due_date,
               CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'sent' ELSE 'draft' END AS status
        FROM {orders}""",
    "invoice_item": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS invoice_id, l_linenumber AS line,
               concat('Part ', CAST(l_partkey AS STRING)) AS description,
               CAST(l_quantity AS INT) AS quantity,
               CAST(p_retailprice AS DECIMAL(15,2)) AS unit_price,
               CAST(l_discount AS DECIMAL(10,2)) AS discount
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "expense_category": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
               CAST(100 + n_regionkey AS BIGINT) AS parent_category_id,
               n_nationkey % 5 <> 0 AS is_active
        FROM {nation}
        UNION ALL
        SELECT CAST(100 + r_regionkey AS BIGINT), r_name, CAST(NULL AS BIGINT), true FROM {region}""",
    "expense": """
        SELECT l_orderkey * 10 + l_linenumber AS id,
               concat('PO-', CAST(l_orderkey AS STRING)) AS title,
               CASE WHEN l_partkey % 11 = 0 THEN CAST(NULL AS BIGINT)
                    ELSE CAST(s_nationkey AS BIGINT) END AS category_id,
               CAST(l_extendedprice AS DECIMAL(15,2)) AS amount,
               CAST(l_shipdate AS DATE) AS date,
               CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('Goods from ', s_name) END AS description,
               CASE WHEN l_linestatus = 'F' THEN 'approved'
                    WHEN l_linenumber % 2 = 0 THEN 'rejected' ELSE 'pending' END AS status
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
        WHERE l_returnflag = 'R'""",
    "product": """
        SELECT p_partkey AS id,
               concat('P', lpad(CAST(p_partkey AS STRING), 8, '0')) AS product_code,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('BC', CAST(p_partkey AS STRING)) END AS barcode,
               p_name AS name,
               CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' ELSE p_type END AS category,
               CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_size END AS quantity,
               CAST(p_retailprice AS DECIMAL(15,2)) AS unit_price,
               CAST(10 + 5 * (p_partkey % 3) AS INT) AS reorder_level,
               p_brand AS location,
               p_partkey % 10 <> 0 AS is_active
        FROM {part}""",
    "inventory_movement": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id,
               CASE WHEN l_returnflag = 'A' THEN 'out' WHEN l_returnflag = 'N' THEN 'in'
                    WHEN l_linestatus = 'F' THEN 'return' ELSE 'damage' END AS movement_type,
               CAST(l_quantity AS INT) AS quantity,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "product_sales": """
        SELECT CAST(l_shipdate AS DATE) AS sale_date, p_name AS product, n_name AS country,
               CAST(l_extendedprice AS DECIMAL(15,2)) AS sales,
               CAST(l_extendedprice AS DECIMAL(15,2))
                 * (CAST(0.30 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS profit,
               CAST(l_quantity AS INT) AS units_sold
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",

    # The same tables as they might arrive from outside: with cells to refuse or to fill.
    "expense_input": """
        SELECT id,
               CASE WHEN id % 17 = 0 THEN CAST(NULL AS STRING) WHEN id % 19 = 0 THEN repeat(title, 40)
                    ELSE title END AS title,
               category_id,
               CAST(CASE WHEN id % 7 = 0 THEN -amount WHEN id % 11 = 0 THEN amount + 999999999
                         ELSE amount END AS DECIMAL(25,2)) AS amount,
               date, description,
               CASE WHEN id % 13 = 0 THEN 'unknown' WHEN id % 5 = 0 THEN CAST(NULL AS STRING)
                    ELSE status END AS status
        FROM {expense}""",
    "sales_input": """
        SELECT CAST(o_orderdate AS DATE) AS month,
               CAST(CASE WHEN o_orderkey % 7 = 0 THEN -o_totalprice WHEN o_orderkey % 11 = 0 THEN 0
                         WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE)
                         ELSE o_totalprice END AS DECIMAL(25,2)) AS revenue,
               CAST(o_custkey % 9 - 2 AS INT) AS transaction_count
        FROM {orders}""",
    "sales_large": """
        SELECT month, CAST(CASE WHEN transaction_count % 2 = 0 THEN revenue * 100000000 ELSE revenue END AS DECIMAL(25,2)) AS revenue,
               transaction_count
        FROM {sales_input}""",
    "inventory_movement_timed": """
        SELECT id, product_id, movement_type, quantity, created_at + INTERVAL 9 HOUR AS created_at FROM {inventory_movement}""",
    "product_input": """
        SELECT id, product_code,
               CASE WHEN id % 3 = 0 THEN CAST(NULL AS STRING) WHEN id % 7 = 0 THEN 'crate' ELSE 'kg' END AS unit,
               CASE WHEN id % 5 = 0 THEN CAST(NULL AS INT) ELSE quantity END AS quantity,
               CASE WHEN id % 7 = 0 THEN CAST(NULL AS DECIMAL(15,2)) ELSE unit_price END AS unit_price,
               CASE WHEN id % 4 = 0 THEN CAST(NULL AS INT) ELSE reorder_level END AS reorder_level,
               CASE WHEN id % 6 = 0 THEN CAST(NULL AS BOOLEAN) ELSE is_active END AS is_active
        FROM {product}""",
    "raw_product_sales": """
        SELECT CASE WHEN l_partkey % 29 = 0 THEN 'soon'
                    ELSE concat(' ', CAST(CAST(l_shipdate AS DATE) AS STRING)) END AS date_text,
               CASE WHEN l_suppkey % 31 = 0 THEN 'n/a' WHEN l_suppkey % 37 = 0 THEN ''
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS STRING) END AS sales_text,
               CASE WHEN l_orderkey % 41 = 0 THEN CAST(NULL AS STRING)
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(15,2))
                      * (CAST(0.30 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS STRING) END AS profit_text,
               CAST(CAST(l_quantity AS INT) AS STRING) AS units_text,
               p_name AS product, n_name AS country
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "category_changes": """
        SELECT id, concat(name, ' / ', CAST(id % 3 AS STRING)) AS name, parent_category_id, is_active,
               CASE WHEN id % 4 = 0 THEN 'delete' ELSE 'update' END AS op, 1 AS seq FROM {expense_category}
        UNION ALL
        SELECT id + 1000, name, parent_category_id, NOT is_active, 'insert', 2 FROM {expense_category}
        UNION ALL
        SELECT id + 1000, concat(name, ' again'), parent_category_id, is_active, 'update', 3
        FROM {expense_category} WHERE is_active
        UNION ALL
        SELECT id + 5000, name, parent_category_id, is_active, 'update', 4 FROM {expense_category}
        UNION ALL
        SELECT id, concat(name, ' late'), parent_category_id, is_active, 'update', 5 FROM {expense_category} WHERE id % 8 = 0
        UNION ALL
        SELECT id, concat(name, ' back'), parent_category_id, is_active, 'insert', 6 FROM {expense_category} WHERE id % 16 = 0
        UNION ALL
        SELECT id + 1000, name, parent_category_id, is_active, 'delete', 7 FROM {expense_category} WHERE id % 3 = 0
        UNION ALL
        SELECT id + 1000, concat(name, ' after'), parent_category_id, is_active, 'update', 8 FROM {expense_category} WHERE id % 6 = 0""",
    "product_changes": """
        SELECT id, concat(product_code, '-R') AS product_code, concat(name, ' (revised)') AS name,
               CAST(quantity + id % 5 AS INT) AS quantity, unit_price, is_active,
               CASE WHEN id % 6 = 0 THEN 'delete' ELSE 'update' END AS op, id % 9 AS seq
        FROM {product} WHERE category = 'ECONOMY' OR category = 'PROMO'
        UNION ALL
        SELECT id, concat(product_code, '-S'), name, quantity, unit_price, is_active, 'update', 20
        FROM {product} WHERE quantity = 0
        UNION ALL
        SELECT id + 1000000000, concat('N', product_code), name, quantity, unit_price, true, 'insert', 1
        FROM {product} WHERE NOT is_active""",
    # A batch on the ledgers of a few months: changed amounts, rows that move to a later month, deletes, new rows.
    "transaction_changes": """
        SELECT id, transaction_id,
               CASE WHEN id % 4 = 0 THEN transaction_date + INTERVAL 40 DAY ELSE transaction_date END AS transaction_date,
               CAST(amount + id % 100 AS DECIMAL(15,2)) AS amount, payment_method, status,
               CASE WHEN id % 5 = 0 THEN 'delete' ELSE 'update' END AS op, 1 AS seq
        FROM {sales_transaction}
        WHERE transaction_date >= DATE '2001-05-01' AND transaction_date < DATE '2001-08-01' AND id % 3 = 0
        UNION ALL
        SELECT id + 1000000000, concat('N', transaction_id), transaction_date, amount, payment_method, status, 'insert', 2
        FROM {sales_transaction}
        WHERE transaction_date >= DATE '2001-06-01' AND transaction_date < DATE '2001-08-01' AND id % 7 = 0
        UNION ALL
        SELECT id + 1000000000, concat('N', transaction_id), transaction_date, amount, payment_method, status, 'delete', 3
        FROM {sales_transaction}
        WHERE transaction_date >= DATE '2001-06-01' AND transaction_date < DATE '2001-08-01' AND id % 21 = 0""",
    # The given lines repeat some ids; a batch names each once.
    "expense_changes": """
        SELECT id, MIN(title) AS title, MIN(category_id) AS category_id, CAST(MIN(amount) + id % 100 AS DECIMAL(15,2)) AS amount,
               CASE WHEN id % 4 = 0 THEN CAST(MIN(date) + INTERVAL 40 DAY AS DATE) ELSE MIN(date) END AS date,
               MIN(description) AS description, MIN(status) AS status,
               CASE WHEN id % 5 = 0 THEN 'delete' ELSE 'update' END AS op, 1 AS seq
        FROM {expense} WHERE date >= DATE '2001-05-01' AND date < DATE '2001-08-01' AND id % 3 = 0 GROUP BY id
        UNION ALL
        SELECT id + 100000000000, MIN(title), MIN(category_id), MIN(amount), MIN(date), MIN(description), MIN(status), 'insert', 2
        FROM {expense} WHERE date >= DATE '2001-06-01' AND date < DATE '2001-08-01' AND id % 7 = 0 GROUP BY id""",
}

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
