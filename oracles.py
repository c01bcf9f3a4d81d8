"""DuckDB SQL for every query that SQL can express; same columns, same values."""

from __future__ import annotations

AMT = "CAST({} AS DECIMAL(18,4))"


def amt(x: str) -> str:
    return AMT.format(x)


def hash_of(*parts: str) -> str:
    return "md5(concat_ws(chr(31), " + ", ".join(f"COALESCE(CAST({p} AS VARCHAR), chr(0))" for p in parts) + "))"


O_DATE = "CAST(o_orderdate AS DATE)"
O_PRICE = amt("o_totalprice")
CONTENT = hash_of("o_orderkey", "o_custkey", "o_orderstatus", "price", "day", "o_orderpriority")

# Orders as the extract shows them: whole table, typed once.
ORDER_TEXT = f"""orders_text AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, {O_PRICE} AS price, {O_DATE} AS day, o_orderpriority,
           o_orderkey + 1 AS file_row FROM orders)"""

# Every order, urgent ones twice, with unreadable amounts and dates.
MESSY = f"""{ORDER_TEXT}, sent AS (
    SELECT *, 0 AS again FROM orders_text
    UNION ALL SELECT *, 1 FROM orders_text WHERE o_orderpriority = '1-URGENT'
), messy AS (
    SELECT *, o_orderkey * 2 + again + 1 AS source_row,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS price_text,
           CASE WHEN (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
                  OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') THEN 'unknown'
                ELSE CAST(day AS VARCHAR) END AS day_text
    FROM sent
), typed AS (
    SELECT *, TRY_CAST(price_text AS DECIMAL(18,4)) AS read_price, TRY_CAST(day_text AS DATE) AS read_day,
           row_number() OVER (PARTITION BY o_orderkey, price_text, day_text ORDER BY source_row) AS nth
    FROM messy
), tagged AS (
    SELECT *,
           CASE WHEN read_price IS NULL OR read_day IS NULL THEN 'rejected'
                WHEN nth > 1 THEN 'filtered' ELSE 'accepted' END AS status,
           CASE WHEN read_price IS NULL THEN 'UNPARSEABLE_NUMBER'
                WHEN read_day IS NULL THEN 'UNPARSEABLE_DATE'
                WHEN nth > 1 THEN 'EXACT_DUPLICATE' END AS reason
    FROM typed)"""

# History after the first run and the batch of the second.
HISTORY = f"""{ORDER_TEXT}, h AS (
    SELECT o_orderkey, price, day, o_orderstatus, o_orderpriority, {CONTENT} AS content, TRUE AS active
    FROM orders_text WHERE day < DATE '2000-06-01' OR o_orderstatus = 'P'
), batch AS (
    SELECT o_orderkey, day, o_orderstatus, o_orderpriority,
           CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN price + 1 ELSE price END AS DECIMAL(18,4)) AS price,
           o_custkey
    FROM orders_text WHERE o_orderstatus <> 'P'
), c AS (
    SELECT o_orderkey, price, day, o_orderstatus, o_orderpriority, {CONTENT} AS content FROM batch)"""


def merged(retire: str = "FALSE", stored: str = "h", retired_rows: str = "TRUE") -> str:
    """Full outer merge of stored history and batch; ``retire`` says which unseen rows are retired."""
    return f"""merged AS (
    SELECT COALESCE(h.o_orderkey, c.o_orderkey) AS o_orderkey,
           CASE WHEN h.o_orderkey IS NULL OR h.content <> c.content THEN c.price ELSE h.price END AS o_totalprice,
           COALESCE(c.o_orderpriority, h.o_orderpriority) AS o_orderpriority,
           COALESCE(c.day, h.day) AS o_orderdate,
           CASE WHEN c.o_orderkey IS NOT NULL THEN TRUE WHEN h.active AND {retire} THEN FALSE ELSE h.active END AS is_active,
           CASE WHEN h.o_orderkey IS NULL THEN 'R2' ELSE 'R1' END AS first_seen_run_id,
           CASE WHEN c.o_orderkey IS NULL THEN 'R1' ELSE 'R2' END AS last_seen_run_id,
           CASE WHEN h.o_orderkey IS NULL OR h.content <> c.content THEN c.content ELSE h.content END AS row_content_hash,
           CASE WHEN h.o_orderkey IS NULL OR h.content <> c.content THEN 'orders_2.csv' ELSE 'orders_1.csv' END AS _source_file,
           CASE WHEN h.o_orderkey IS NULL THEN 'inserted'
                WHEN c.o_orderkey IS NOT NULL AND h.content <> c.content THEN 'updated'
                WHEN c.o_orderkey IS NOT NULL THEN 'unchanged'
                WHEN h.active AND {retire} THEN 'deactivated' ELSE 'kept' END AS change
    FROM {stored} h FULL OUTER JOIN c ON h.o_orderkey = c.o_orderkey
    WHERE {retired_rows})"""


SHOWN = "o_orderkey, o_totalprice, is_active, first_seen_run_id, last_seen_run_id, row_content_hash, _source_file, change"
IN_LOOKBACK = "h.day >= (SELECT max(day) FROM c) - INTERVAL 90 DAY"
APPENDED = """SELECT o_orderkey, price AS o_totalprice, active AS is_active, 'R1' AS first_seen_run_id,
       'R1' AS last_seen_run_id, content AS row_content_hash, 'orders_1.csv' AS _source_file, 'kept' AS change FROM kept
UNION ALL
SELECT o_orderkey, price, TRUE, 'R2', 'R2', content, 'orders_2.csv', 'inserted' FROM added
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM kept)"""

LINES = f"""lines AS (
    SELECT l_partkey, l_suppkey, l_linestatus, CAST(l_shipdate AS DATE) AS ship_date,
           {amt('l_quantity')} AS quantity, {amt('l_extendedprice')} AS price,
           {amt('l_extendedprice')} * {amt('l_discount')} AS discounted
    FROM lineitem)"""
BRANDS = f"""{LINES}, brands AS (
    SELECT p_brand, CAST(sum(quantity) AS DECIMAL(38,4)) AS quantity
    FROM lines JOIN part ON p_partkey = l_partkey GROUP BY p_brand)"""
PARETO = f"""{BRANDS}, pareto AS (
    SELECT p_brand, quantity,
           CAST(sum(quantity) OVER (ORDER BY quantity DESC, p_brand ROWS UNBOUNDED PRECEDING) AS DOUBLE)
           / CAST(sum(quantity) OVER () AS DOUBLE) * 100 AS cumulative_pct
    FROM brands)"""
EVENTS = f"days AS (SELECT CAST(ts AS DATE) AS event_date, event_type, {amt('value')} AS value FROM events)"
PRICED = f"""{LINES}, priced AS (
    SELECT l_suppkey, p_type, price, CAST(p_retailprice AS DECIMAL(18,4)) * quantity AS at_standard
    FROM lines JOIN part ON p_partkey = l_partkey)"""
TYPES = f"""{PRICED}, types AS (
    SELECT p_type, CAST(sum(price) - sum(at_standard) AS DECIMAL(38,4)) AS variance FROM priced GROUP BY p_type)"""
LEDGER = f"""attempts AS (
    SELECT strftime({O_DATE}, '%Y-%m') AS month, o_orderstatus, count(*) AS n, max({O_DATE}) AS last_day
    FROM orders GROUP BY 1, 2
), newest AS (
    SELECT 'RUN-' || month AS run_id, month, o_orderstatus AS status, CAST(n AS BIGINT) AS rows_extracted,
           row_number() OVER (PARTITION BY month ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END DESC) AS nth
    FROM attempts
), runs AS (
    SELECT run_id, status, rows_extracted, CAST(month || '-01' AS DATE) AS started_on FROM newest WHERE nth = 1)"""


def profile(column: str, text: str) -> str:
    return f"""SELECT '{column}' AS column_name, CAST(count({text}) AS BIGINT) AS non_null,
    CAST(count(*) - count({text}) AS BIGINT) AS nulls,
    CAST(count(*) FILTER (regexp_matches(trim({text}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T].*)?$')) AS BIGINT) AS date_like_text,
    CAST(count(*) FILTER (regexp_matches(trim({text}), '^[+-]?\\d+$')) AS BIGINT) AS integer_like_text,
    CAST(count(*) FILTER (regexp_matches(trim({text}), '^[+-]?\\d+[.,]\\d+$')) AS BIGINT) AS number_like_text,
    CAST(count(*) FILTER (NOT regexp_matches(trim({text}), '^[+-]?\\d+([.,]\\d+)?$')
         AND NOT regexp_matches(trim({text}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T].*)?$')) AS BIGINT) AS text,
    CAST(count(DISTINCT {text}) AS BIGINT) AS distinct_count, count(DISTINCT {text}) = count(*) AS candidate_unique_key
FROM messy"""


def check(check_id: str, scope: str, severity: str, status: str, expected: str, actual: str,
          difference: str = "''", tolerance: str = "''") -> str:
    return (f"SELECT '{check_id}' AS check_id, '{scope}' AS scope, '{severity}' AS severity, {status} AS status, "
            f"{expected} AS expected, {actual} AS actual, {difference} AS difference, {tolerance} AS tolerance FROM facts")


FACTS = f"""{MESSY}, facts AS (
    SELECT count(*) AS n, count(*) FILTER (status = 'accepted') AS a, count(*) FILTER (status = 'rejected') AS r,
           count(*) FILTER (status = 'filtered') AS f,
           count(*) FILTER (status = 'accepted' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS unlisted,
           CAST(COALESCE(sum(read_price), 0) AS DECIMAL(38,4)) AS total,
           CAST(COALESCE(sum(read_price) FILTER (status = 'accepted'), 0)
              + COALESCE(sum(read_price) FILTER (status = 'rejected'), 0)
              + COALESCE(sum(read_price) FILTER (status = 'filtered'), 0) AS DECIMAL(38,4)) AS booked
    FROM tagged)"""
REPORT = " UNION ALL ".join((
    check("source.orders.structural.required_columns", "source:orders:structure", "block", "'PASS'",
          "'o_orderkey, o_totalprice, o_orderdate'",
          "'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority'"),
    check("source.orders.row.business_key_not_blank", "source:orders:row", "block", "'PASS'", "'0'", "'0'"),
    check("source.orders.dataset.duplicate_business_key", "source:orders:dataset", "block", "'PASS'", "'0'", "'0'"),
    check("source.orders.row.invalid_or_negative_measure", "source:orders:row", "warning", "'WARNING'", "''", "''")
    + " WHERE r > 0",
    check("source.orders.row.exact_duplicate", "source:orders:row", "warning", "'WARNING'", "''", "''") + " WHERE f > 0",
    check("source.orders.row.category_allowed.o_orderpriority", "source:orders:row", "warning",
          "CASE WHEN unlisted > 0 THEN 'WARNING' ELSE 'PASS' END", "'1-URGENT, 2-HIGH, 3-MEDIUM'",
          "CAST(unlisted AS VARCHAR)"),
    check("source.orders.population.equation", "source:orders:dataset", "block",
          "CASE WHEN n = a + r + f THEN 'PASS' ELSE 'BLOCK' END", "CAST(n AS VARCHAR)",
          "'accepted=' || a || '; rejected=' || r || '; filtered=' || f || '; reasons=EXACT_DUPLICATE=' || f",
          "CAST(n - a - r - f AS VARCHAR)", "'0'"),
    check("source.orders.control_total.o_totalprice", "source:orders:dataset", "block",
          "CASE WHEN total = booked THEN 'PASS' ELSE 'BLOCK' END", "CAST(total AS VARCHAR)", "CAST(booked AS VARCHAR)",
          "CAST(CAST(total - booked AS DECIMAL(38,4)) AS VARCHAR)", "'0'"),
))
RAW_JSON = ("to_json({o_custkey: CAST(o_custkey AS VARCHAR), o_orderdate: day_text, o_orderkey: CAST(o_orderkey AS VARCHAR), "
            "o_orderpriority: o_orderpriority, o_orderstatus: o_orderstatus, o_totalprice: price_text})")
REASON_TEXT = """CASE reason WHEN 'UNPARSEABLE_NUMBER' THEN 'A value that should be a number could not be read as one.'
    WHEN 'UNPARSEABLE_DATE' THEN 'A value that should be a date could not be read as one.' END"""
STOCKED = "(SELECT p_partkey FROM part WHERE p_size <= 40)"
PAIR = """pair AS (
    SELECT max(CASE WHEN nth = 1 THEN day END) AS d1, max(CASE WHEN nth = 2 THEN day END) AS d2,
           max(CASE WHEN nth = 1 THEN v END) AS v1, max(CASE WHEN nth = 2 THEN v END) AS v2
    FROM (SELECT *, row_number() OVER (ORDER BY day DESC) AS nth FROM daily))"""
CHANGE = """SELECT 'period_change' AS id, 'period_change' AS type, CAST(d1 AS VARCHAR) AS current_period,
    CAST(d2 AS VARCHAR) AS comparison_period, round(CAST(v1 AS DOUBLE), 6) AS current, round(CAST(v2 AS DOUBLE), 6) AS comparison,
    round(CAST(v1 AS DOUBLE) - CAST(v2 AS DOUBLE), 6) AS change_absolute,
    round((CAST(v1 AS DOUBLE) - CAST(v2 AS DOUBLE)) / CAST(v2 AS DOUBLE) * 100, 6) AS change_percent, """

ORACLES: dict[str, str] = {
    "stage_raw_orders": f"""WITH {ORDER_TEXT}
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
               CAST(price AS VARCHAR) AS o_totalprice, CAST(day AS VARCHAR) AS o_orderdate, o_orderpriority,
               'R1' AS _run_id, 'trade' AS _report_id, 'orders' AS _source_id, 'orders.parquet' AS _source_file,
               'Orders' AS _source_sheet, CAST(file_row AS BIGINT) AS _source_row_number,
               '2026-01-01T00:00:00+00:00' AS _extracted_at, '1' AS _schema_version FROM orders_text""",
    "project_by_name": "SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderpriority AS priority FROM orders",
    "typed_clean_orders": f"""WITH {MESSY}
        SELECT o_orderkey, o_custkey, o_orderstatus, read_price AS o_totalprice, read_day AS o_orderdate, o_orderpriority,
               CAST(source_row AS BIGINT) AS _source_row_number FROM tagged WHERE status = 'accepted'""",
    "row_hashes_orders": f"""WITH {ORDER_TEXT}
        SELECT o_orderkey, {hash_of('o_orderkey')} AS business_key_hash, {CONTENT} AS row_content_hash FROM orders_text""",
    "staging_audit": f"""WITH {ORDER_TEXT}, digests AS (
            SELECT file_row, CAST('0x' || substr({CONTENT}, 1, 15) AS BIGINT) AS bits FROM orders_text)
        SELECT 'orders' AS _source_id, 'orders.parquet' AS _source_file, CAST(min(file_row) AS BIGINT) AS first_row,
               CAST(max(file_row) AS BIGINT) AS last_row, CAST(count(*) AS BIGINT) AS rows_staged,
               md5(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(bits AS DECIMAL(38,0))) AS VARCHAR)) AS content_hash
        FROM digests""",
    "clean_numeric_text": f"""SELECT o_orderkey,
            CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN -{O_PRICE}
                      WHEN o_orderpriority = '2-HIGH' THEN {O_PRICE}
                      WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN -{O_PRICE}
                      WHEN o_orderpriority = '3-MEDIUM' THEN {O_PRICE}
                      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                      WHEN o_orderstatus = 'O' THEN o_orderkey + 1000 END AS DECIMAL(18,4)) AS total_number,
            CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
                 THEN CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'blank' ELSE 'failed' END
                 WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'O' THEN 'failed' ELSE 'number' END AS total_outcome
        FROM orders""",
    "serial_dates": f"SELECT o_orderkey, {O_DATE} AS date_1900, CAST({O_DATE} + 1462 AS DATE) AS date_1904 FROM orders",
    "column_profile": f"WITH {MESSY} " + " UNION ALL ".join((
        profile("o_orderkey", "CAST(o_orderkey AS VARCHAR)"), profile("o_custkey", "CAST(o_custkey AS VARCHAR)"),
        profile("o_orderstatus", "o_orderstatus"), profile("o_totalprice", "price_text"),
        profile("o_orderdate", "day_text"), profile("o_orderpriority", "o_orderpriority"))),
    "quarantine_typed_values": f"""WITH {MESSY}
        SELECT 'orders' AS source_id, CAST(source_row AS BIGINT) AS source_row, reason AS reason_code,
               {REASON_TEXT} AS reason_message, CAST({RAW_JSON} AS VARCHAR) AS raw_values, 'OPEN' AS resolution_status
        FROM tagged WHERE status = 'rejected'""",
    "quarantine_summary": f"""WITH {MESSY} SELECT reason AS reason_code, CAST(count(*) AS BIGINT) AS row_count
        FROM tagged WHERE reason IS NOT NULL GROUP BY reason ORDER BY reason""",
    "quarantine_customers": f"""SELECT c_custkey + 1 AS source_row, 'NEGATIVE_MEASURE' AS reason_code,
            CAST(to_json({{c_acctbal: CAST({amt('c_acctbal')} AS VARCHAR), c_custkey: CAST(c_custkey AS VARCHAR),
                           c_mktsegment: c_mktsegment, c_name: c_name}}) AS VARCHAR) AS raw_values
        FROM customer WHERE {amt('c_acctbal')} < 0""",
    "exact_duplicates": f"""WITH {MESSY}
        SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(source_row AS BIGINT) AS source_row, reason AS reason_code
        FROM tagged WHERE status = 'filtered'""",
    "conflicting_keys": f"""WITH contents AS (
            SELECT l_orderkey, l_linenumber, {hash_of('l_orderkey', 'l_linenumber')} AS business_key_hash,
                   {hash_of('l_orderkey', 'l_linenumber', 'l_partkey', amt('l_quantity'), 'CAST(l_shipdate AS DATE)')} AS content
            FROM lineitem)
        SELECT business_key_hash, CAST(count(DISTINCT content) AS BIGINT) AS variants, CAST(count(*) AS BIGINT) AS copies
        FROM contents GROUP BY business_key_hash HAVING count(DISTINCT content) > 1""",
    "check_blank_keys": """SELECT 'source.orders.row.business_key_not_blank' AS check_id,
            CASE WHEN count(*) > 0 THEN 'BLOCK' ELSE 'PASS' END AS status, '0' AS expected, CAST(count(*) AS VARCHAR) AS actual
        FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
        UNION ALL SELECT 'source.orders.dataset.duplicate_business_key', 'PASS', '0', '0'""",
    "check_category_allowed": f"""WITH {FACTS}
        SELECT 'source.orders.row.category_allowed.o_orderpriority' AS check_id, 'warning' AS severity,
               CASE WHEN unlisted > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
               '1-URGENT, 2-HIGH, 3-MEDIUM' AS expected, CAST(unlisted AS VARCHAR) AS actual FROM facts""",
    "population_equation": f"""WITH {FACTS}
        SELECT CAST(n AS BIGINT) AS source_rows, CAST(a AS BIGINT) AS accepted_rows, CAST(r AS BIGINT) AS rejected_rows,
               CAST(f AS BIGINT) AS filtered_rows, CAST(n - a - r - f AS BIGINT) AS difference, n = a + r + f AS balances
        FROM facts""",
    "population_unbalanced": f"""WITH {MESSY}, wrong AS (
            SELECT * FROM tagged WHERE o_orderstatus <> 'P' UNION ALL SELECT * FROM tagged WHERE o_orderpriority = '1-URGENT'),
        n AS (SELECT count(*) AS n, CAST(sum(read_price) AS DECIMAL(38,4)) AS v FROM tagged),
        w AS (SELECT count(*) FILTER (status = 'accepted') AS a, count(*) FILTER (status = 'rejected') AS r,
                     count(*) FILTER (status = 'filtered') AS f, CAST(sum(read_price) AS DECIMAL(38,4)) AS v FROM wrong)
        SELECT n.n AS source_rows, a AS accepted_rows, r AS rejected_rows, f AS filtered_rows, n.n - a - r - f AS difference,
               n.n = a + r + f AS balances, n.v AS source_value, w.v AS database_value,
               CAST(n.v - w.v AS DECIMAL(38,4)) AS value_difference FROM n, w""",
    "control_totals": f"""WITH {FACTS}
        SELECT 'orders.o_totalprice' AS name, total AS source_value, booked AS database_value,
               CAST(total - booked AS DECIMAL(38,4)) AS difference FROM facts""",
    "quality_report_orders": f"WITH {FACTS} {REPORT}",
    "quality_verdict": f"""WITH {FACTS}, report AS ({REPORT})
        SELECT CASE WHEN count(*) FILTER (status = 'BLOCK') > 0 THEN 'BLOCK'
                    WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASS' END AS quality_status,
               CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS passed,
               CAST(count(*) FILTER (status = 'WARNING') AS BIGINT) AS warnings,
               CAST(count(*) FILTER (status = 'BLOCK') AS BIGINT) AS blocked FROM report""",
    "non_negative_measures": f"""SELECT 'source.customer.row.non_negative.c_acctbal' AS check_id,
            CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'PASS' END AS status, '0' AS expected, CAST(count(*) AS VARCHAR) AS actual
        FROM customer WHERE {amt('c_acctbal')} < 0""",
    "relationship_orphans": f"""SELECT 'relationship.lines_to_part.right_cardinality' AS check_id, 'block' AS severity,
            'PASS' AS status, '0' AS expected, CAST(count(*) AS VARCHAR) AS actual
        FROM (SELECT p_partkey FROM part WHERE p_size <= 40 GROUP BY 1 HAVING count(*) > 1)
        UNION ALL
        SELECT 'relationship.lines_to_part.match', 'block', CASE WHEN count(*) > 0 THEN 'BLOCK' ELSE 'PASS' END, '0',
               CAST(count(*) AS VARCHAR)
        FROM lineitem LEFT JOIN {STOCKED} p ON l_partkey = p_partkey WHERE p_partkey IS NULL""",
    "orphan_keys": f"""SELECT l_partkey, CAST(count(*) AS BIGINT) AS key_rows
        FROM lineitem LEFT JOIN {STOCKED} p ON l_partkey = p_partkey WHERE p_partkey IS NULL GROUP BY l_partkey""",
    "relationship_cardinality": """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS key_rows
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "relationship_one_to_one": """WITH l AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)),
        r AS (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)),
        m AS (SELECT count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL),
        facts AS (SELECT 'right_cardinality' AS kind, n FROM r UNION ALL SELECT 'left_cardinality', n FROM l UNION ALL SELECT 'match', n FROM m)
        SELECT 'relationship.order_of_customer.' || kind AS check_id, 'block' AS severity,
               CASE WHEN n > 0 THEN 'BLOCK' ELSE 'PASS' END AS status, '0' AS expected, CAST(n AS VARCHAR) AS actual FROM facts""",
    "flag_text": "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS flag FROM orders",
    "rule_chain": f"""WITH {LINES}, open AS (
            SELECT greatest(sum(CASE WHEN l_linestatus = 'O' THEN quantity ELSE -quantity END), 0) AS q FROM lines GROUP BY l_partkey)
        SELECT CAST(count(*) AS BIGINT) AS open_parts, CAST(COALESCE(sum(q), 0) AS DECIMAL(18,4)) AS open_qty FROM open WHERE q > 0""",
    "published_run": f"""WITH o AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer),
        bad AS (SELECT count(*) AS n FROM customer WHERE {amt('c_acctbal')} < 0)
        SELECT 'history orders' AS part, n FROM o UNION ALL SELECT 'history customer', c.n - bad.n FROM c, bad
        UNION ALL SELECT 'run rows_extracted', o.n + c.n FROM o, c UNION ALL SELECT 'run rows_rejected', n FROM bad
        UNION ALL SELECT 'run rows_filtered', 0 UNION ALL SELECT 'run rows_inserted', o.n + c.n - bad.n FROM o, c, bad
        UNION ALL SELECT 'run rows_updated', 0 UNION ALL SELECT 'blocked checks', 0
        UNION ALL SELECT 'quarantine NEGATIVE_MEASURE', n FROM bad WHERE n > 0""",
    "related_join": "SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "run_ledger_latest": f"WITH {LEDGER} SELECT run_id, status, rows_extracted, started_on FROM runs ORDER BY started_on DESC, run_id LIMIT 200",
    "row_count_movement": f"""WITH {LEDGER}, steps AS (
            SELECT run_id, rows_extracted, lag(rows_extracted) OVER (ORDER BY started_on) AS previous_rows FROM runs)
        SELECT run_id, rows_extracted, previous_rows,
               round(CAST(abs(rows_extracted - previous_rows) AS DOUBLE) / previous_rows * 100, 6) AS change_pct,
               CASE WHEN CAST(abs(rows_extracted - previous_rows) AS DOUBLE) / previous_rows * 100 > 10 THEN 'WARNING'
                    ELSE 'PASS' END AS status FROM steps""",
    "history_append": f"WITH {HISTORY}, kept AS (SELECT * FROM h), added AS (SELECT * FROM c) {APPENDED}",
    "history_upsert": f"WITH {HISTORY}, {merged()} SELECT {SHOWN} FROM merged",
    "history_mark_inactive": f"WITH {HISTORY}, {merged(IN_LOOKBACK)} SELECT {SHOWN} FROM merged",
    "history_physical_delete": f"""WITH {HISTORY}, {merged(retired_rows='c.o_orderkey IS NOT NULL')}
        SELECT {SHOWN} FROM merged""",
    "history_snapshot": f"WITH {HISTORY}, {merged('TRUE')} SELECT {SHOWN} FROM merged",
    "history_reactivate": f"""WITH {HISTORY},
        before AS (SELECT * REPLACE (o_orderstatus <> 'F' AS active) FROM h), {merged(stored='before')}
        SELECT {SHOWN} FROM merged""",
    "history_replace_period": f"""WITH {HISTORY},
        kept AS (SELECT * FROM h WHERE NOT strftime(day, '%Y-%m-%d') LIKE '1998-03%'),
        added AS (SELECT * FROM c WHERE strftime(day, '%Y-%m') = '1998-03') {APPENDED}""",
    "history_rerun": f"""WITH {HISTORY}, {merged(IN_LOOKBACK)}
        SELECT o_orderkey, o_totalprice, is_active, first_seen_run_id,
               CASE WHEN last_seen_run_id = 'R2' THEN 'R3' ELSE 'R1' END AS last_seen_run_id, row_content_hash, _source_file,
               CASE WHEN last_seen_run_id = 'R2' THEN 'unchanged' ELSE 'kept' END AS change FROM merged""",
    "history_add_column": f"""WITH {HISTORY}
        SELECT COALESCE(h.o_orderkey, c.o_orderkey) AS o_orderkey, c.o_orderpriority,
               CASE WHEN c.o_orderkey IS NULL THEN 'R1' ELSE 'R2' END AS last_seen_run_id,
               CASE WHEN h.o_orderkey IS NULL THEN 'inserted' WHEN c.o_orderkey IS NULL THEN 'kept' ELSE 'updated' END AS change
        FROM h FULL OUTER JOIN c ON h.o_orderkey = c.o_orderkey""",
    "history_counts": f"""WITH {HISTORY}, {merged(IN_LOOKBACK)}
        SELECT CAST(count(*) FILTER (change = 'inserted') AS BIGINT) AS inserted,
               CAST(count(*) FILTER (change = 'updated') AS BIGINT) AS updated,
               CAST(count(*) FILTER (change = 'unchanged') AS BIGINT) AS unchanged,
               CAST(count(*) FILTER (change = 'deactivated') AS BIGINT) AS deactivated FROM merged""",
    "archive_roundtrip": f"""WITH {HISTORY}, {merged(IN_LOOKBACK)}
        SELECT o_orderkey, o_totalprice, o_orderdate, is_active, last_seen_run_id FROM merged WHERE is_active""",
    "sum_totals": f"""WITH {LINES} SELECT CAST(COALESCE(sum(quantity), 0) AS DECIMAL(38,4)) AS total_quantity,
            CAST(count(*) AS BIGINT) AS row_count, max(ship_date) AS latest_date FROM lines""",
    "active_totals": f"""WITH {HISTORY}, {merged(IN_LOOKBACK)}
        SELECT CAST(count(*) AS BIGINT) AS active_rows, CAST(COALESCE(sum(o_totalprice), 0) AS DECIMAL(38,4)) AS total_price
        FROM merged WHERE is_active""",
    "average_guarded": f"""WITH {LINES}
        SELECT round(CAST(sum(quantity) AS DOUBLE) / count(quantity), 6) AS average_quantity FROM lines""",
    "weighted_rate": f"""WITH {LINES}
        SELECT round(CAST(sum(discounted) AS DOUBLE) / CAST(sum(price) AS DOUBLE) * 1000000, 6) AS rate FROM lines""",
    "trend_by_date": f"""WITH {LINES}
        SELECT ship_date, CAST(sum(discounted) AS DECIMAL(38,4)) AS discounted, CAST(sum(price) AS DECIMAL(38,4)) AS price,
               round(CAST(sum(discounted) AS DOUBLE) / CAST(sum(price) AS DOUBLE) * 1000000, 6) AS rate
        FROM lines GROUP BY ship_date ORDER BY ship_date""",
    "latest_two_dates": f"""WITH {LINES}
        SELECT ship_date, CAST(sum(discounted) AS DECIMAL(38,4)) AS discounted, CAST(sum(price) AS DECIMAL(38,4)) AS price
        FROM lines GROUP BY ship_date ORDER BY ship_date DESC LIMIT 2""",
    "period_change_rate": f"""WITH {LINES}, daily AS (
            SELECT ship_date AS day, CAST(sum(discounted) AS DOUBLE) / CAST(sum(price) AS DOUBLE) * 1000000 AS v
            FROM lines GROUP BY 1), {PAIR} {CHANGE}
            'Discount rate moved from ' || printf('%.2f', v2) || ' PPM to ' || printf('%.2f', v1) || ' PPM between '
            || d2 || ' and ' || d1 || '.' AS text FROM pair""",
    "period_change_value": f"""WITH {EVENTS}, daily AS (SELECT event_date AS day, sum(value) AS v FROM days GROUP BY 1), {PAIR} {CHANGE}
            'Daily value moved from ' || v2 || ' units to ' || v1 || ' units between ' || d2 || ' and ' || d1 || '.' AS text
            FROM pair""",
    "latest_snapshot_total": f"""WITH {EVENTS} SELECT CAST(COALESCE(sum(value), 0) AS DECIMAL(38,4)) AS total_value
        FROM days WHERE event_date = (SELECT max(event_date) FROM days)""",
    "latest_snapshot_by_group": f"""WITH {EVENTS} SELECT event_type, CAST(sum(value) AS DECIMAL(38,4)) AS total_value
        FROM days WHERE event_date = (SELECT max(event_date) FROM days) GROUP BY event_type ORDER BY event_type""",
    "pareto_by_part": f"""WITH {PARETO}
        SELECT p_brand, quantity, round(cumulative_pct, 6) AS cumulative_pct FROM pareto""",
    "top_contributor": f"WITH {BRANDS} SELECT p_brand, quantity FROM brands ORDER BY quantity DESC, p_brand LIMIT 1",
    "top_contributor_share": f"""WITH {BRANDS}
        SELECT p_brand, quantity, round(CAST(quantity AS DOUBLE) / (SELECT CAST(sum(quantity) AS DOUBLE) FROM brands) * 100, 6)
               AS share_pct FROM brands ORDER BY quantity DESC, p_brand LIMIT 3""",
    "price_variance_total": f"""WITH {PRICED}
        SELECT CAST(sum(price) AS DECIMAL(38,4)) AS spend, CAST(sum(at_standard) AS DECIMAL(38,4)) AS standard_spend,
               CAST(sum(price) - sum(at_standard) AS DECIMAL(38,4)) AS variance,
               round(CAST(sum(price) - sum(at_standard) AS DOUBLE) / CAST(sum(at_standard) AS DOUBLE) * 100, 6) AS variance_pct
        FROM priced""",
    "price_variance_by_supplier": f"""WITH {PRICED}
        SELECT s_name, CAST(sum(price) - sum(at_standard) AS DECIMAL(38,4)) AS variance
        FROM priced JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name ORDER BY variance DESC, s_name""",
    "price_variance_by_type": f"WITH {TYPES} SELECT p_type, variance FROM types ORDER BY variance DESC, p_type",
    "top_contributor_abs_share": f"""WITH {TYPES}, best AS (
            SELECT p_type, variance, abs(CAST(variance AS DOUBLE)) / (SELECT CAST(sum(abs(variance)) AS DOUBLE) FROM types) * 100 AS share
            FROM types ORDER BY variance DESC, p_type LIMIT 1)
        SELECT 'top_type' AS id, 'contributor' AS type, round(CAST(variance AS DOUBLE), 6) AS current,
               p_type || ' is the largest contributor with '
               || rtrim(rtrim(format('{{:,.4f}}', CAST(variance AS DOUBLE)), '0'), '.') || ' USD variance ('
               || printf('%.1f', share) || '% of the total). Treat it as an investigation priority, not a confirmed cause.' AS text
        FROM best""",
    "shortage_by_part": f"""WITH {LINES}, demand AS (SELECT l_partkey, sum(quantity) AS q FROM lines WHERE l_linestatus = 'O' GROUP BY 1),
        stock AS (SELECT l_partkey, sum(quantity) AS q FROM lines WHERE l_linestatus = 'F' GROUP BY 1)
        SELECT p_partkey, p_name, CAST(greatest(COALESCE(demand.q, 0) - COALESCE(stock.q, 0), 0) AS DECIMAL(38,4)) AS shortage_qty
        FROM part LEFT JOIN demand ON demand.l_partkey = p_partkey LEFT JOIN stock ON stock.l_partkey = p_partkey
        ORDER BY shortage_qty DESC, p_name""",
    "lineage_drill_through": f"""WITH {ORDER_TEXT}
        SELECT day AS o_orderdate, o_orderkey, price AS o_totalprice, 'orders.parquet' AS _source_file,
               CAST(file_row AS BIGINT) AS _source_row_number
        FROM orders_text WHERE o_orderpriority = '1-URGENT' ORDER BY day, o_orderkey""",
    "chart_points": f"""WITH {PARETO} SELECT p_brand AS x, CAST(quantity AS DOUBLE) AS y,
            round(cumulative_pct, 6) AS cumulative_pct FROM pareto""",
    "filter_points": f"""WITH {PARETO} SELECT p_brand AS x, CAST(quantity AS DOUBLE) AS y,
            round(cumulative_pct, 6) AS cumulative_pct FROM pareto WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#11')""",
    "filter_options": f"WITH {BRANDS} SELECT DISTINCT 'p_brand' AS dimension, p_brand AS option FROM brands",
    "kpi_package": f"""WITH {HISTORY}, {merged(IN_LOOKBACK)}, live AS (SELECT * FROM merged WHERE is_active), facts AS (
            SELECT count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS v, CAST(max(o_orderdate) AS VARCHAR) AS period,
                   CAST(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / CAST(sum(o_totalprice) AS DOUBLE) * 100 AS s
            FROM live)
        SELECT 'kpi' AS section, 'order_count' AS id, period AS label, CAST(n AS DOUBLE) AS value, format('{{:,}}', n) AS display FROM facts
        UNION ALL SELECT 'kpi', 'order_value', period, round(v, 6), format('{{:,.2f}}', v) FROM facts
        UNION ALL SELECT 'kpi', 'urgent_share', period, round(s, 6), format('{{:,.1f}}', s) || '%' FROM facts
        UNION ALL SELECT 'chart', 'value_by_priority', o_orderpriority, round(CAST(sum(o_totalprice) AS DOUBLE), 6), ''
        FROM live GROUP BY o_orderpriority
        UNION ALL SELECT 'points', 'value_by_priority', '', CAST(count(DISTINCT o_orderpriority) AS DOUBLE), '' FROM live
        UNION ALL SELECT 'quality', 'PASS', '', 0, ''
        UNION ALL SELECT 'lineage', 'rows', period, CAST(n AS DOUBLE), '' FROM facts""",
    "declared_rule": f"""WITH {LINES}
        SELECT l_partkey AS part_key,
               CAST(greatest(sum(CASE WHEN l_linestatus = 'O' THEN quantity ELSE -quantity END), 0) AS DECIMAL(18,4)) AS open_qty
        FROM lines GROUP BY l_partkey""",
    "calendar": f"""WITH days AS (
            SELECT CAST(unnest(generate_series(min({O_DATE}), max({O_DATE}), INTERVAL 1 DAY)) AS DATE) AS day FROM orders)
        SELECT day, strftime(day, '%G-W%V') AS week, strftime(day, '%Y-%m') AS month,
               CAST(year(day) AS VARCHAR) || '-Q' || quarter(day) AS quarter, CAST(year(day) AS INTEGER) AS year,
               day = DATE '2000-01-01' AS is_holiday, isodow(day) < 6 AND day <> DATE '2000-01-01' AS is_working_day,
               CAST(year(day - INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year,
               CAST(month(day - INTERVAL 3 MONTH) AS INTEGER) AS fiscal_period FROM days""",
    "heatmap": f"""WITH {LINES} SELECT CAST(year(ship_date) AS INTEGER) AS ship_year, l_linestatus,
            CAST(sum(quantity) AS DECIMAL(38,4)) AS value FROM lines GROUP BY 1, 2""",
    "rolling_rate": f"""WITH {LINES}, weekly AS (
            SELECT CAST(date_trunc('week', ship_date) AS DATE) AS week, sum(discounted) AS d, sum(price) AS p FROM lines GROUP BY 1)
        SELECT week, round(CAST(sum(d) OVER w AS DOUBLE) / CAST(sum(p) OVER w AS DOUBLE) * 1000000, 6) AS rate
        FROM weekly WINDOW w AS (ORDER BY week RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW)""",
    "growth_rate": f"""WITH {LINES}, monthly AS (SELECT strftime(ship_date, '%Y-%m') AS month, sum(price) AS p FROM lines GROUP BY 1),
        steps AS (SELECT m.month, m.p, b.p AS q FROM monthly m LEFT JOIN monthly b
            ON CAST(m.month || '-01' AS DATE) = CAST(b.month || '-01' AS DATE) + INTERVAL 1 MONTH)
        SELECT month, CAST(p - q AS DECIMAL(38,4)) AS change,
               round(CAST(p - q AS DOUBLE) / CAST(q AS DOUBLE) * 100, 6) AS growth_pct FROM steps""",
    "order_aging": f"""WITH {ORDER_TEXT}, aged AS (SELECT price, (SELECT max(day) FROM orders_text) - day AS age FROM orders_text)
        SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '91+' END AS age_days,
               CAST(count(*) AS BIGINT) AS row_count, CAST(sum(price) AS DECIMAL(38,4)) AS total FROM aged GROUP BY 1""",
    "actual_against_target": f"""WITH {BRANDS}, goals AS (
            SELECT p_brand, CAST(count(*) * 1000 AS DECIMAL(38,4)) AS goal FROM part GROUP BY p_brand)
        SELECT p_brand, quantity, goal, CAST(quantity - goal AS DECIMAL(38,4)) AS gap,
               round(CAST(quantity AS DOUBLE) / CAST(goal AS DOUBLE) * 100, 6) AS attainment_pct
        FROM brands LEFT JOIN goals USING (p_brand)""",
    "partial_period": f"""WITH monthly AS (SELECT strftime({O_DATE}, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1),
        newest AS (SELECT max(month) AS m FROM monthly)
        SELECT month, CAST(n AS BIGINT) AS orders,
               month = (SELECT m FROM newest)
               AND n < 0.5 * (SELECT avg(n) FROM monthly WHERE month <> (SELECT m FROM newest)) AS is_partial FROM monthly""",
    "insight_ranking": f"""WITH {PRICED}, types AS (
            SELECT p_type, CAST(sum(price) - sum(at_standard) AS DOUBLE) AS v, CAST(sum(at_standard) AS DOUBLE) AS s
            FROM priced GROUP BY p_type), scored AS (
            SELECT p_type AS id, abs(v) / (SELECT sum(abs(v)) FROM types) * abs(v / s) AS score FROM types)
        SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 5""",
    "fill_down": """SELECT CAST(o_orderkey + 1 AS BIGINT) AS _source_row_number, CAST(last_value(
            CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END IGNORE NULLS) OVER (ORDER BY o_orderkey) AS VARCHAR) AS o_custkey
        FROM orders""",
    "weekly_rows": f"""WITH {EVENTS}, counted AS (
            SELECT event_type, strftime(event_date, '%G-W%V') AS week, count(*) AS q, count(*) FILTER (value > 20) AS d
            FROM days GROUP BY 1, 2), rates AS (
            SELECT *, CAST(d AS DOUBLE) / q * 1000000 AS calc,
                   round(CAST(d AS DOUBLE) / q * 1000000) + CASE WHEN event_type = 'error' THEN 5000 ELSE 0 END AS said FROM counted)
        SELECT event_type, week, CAST(q AS DECIMAL(38,4)) AS quantity, CAST(d AS DECIMAL(38,4)) AS defects,
               CAST(said AS DECIMAL(38,4)) AS reported, TRUE AS well_formed, round(calc, 6) AS calculated,
               abs(calc - said) <= 1 AS agrees FROM rates""",
    "dimension_versions": f"""WITH {HISTORY}
        SELECT h.o_orderkey, h.price AS o_totalprice, DATE '2000-06-01' AS valid_from,
               CASE WHEN h.content <> c.content THEN DATE '2001-09-01' END AS valid_to,
               COALESCE(h.content = c.content, TRUE) AS is_current
        FROM h LEFT JOIN c ON h.o_orderkey = c.o_orderkey
        UNION ALL
        SELECT c.o_orderkey, c.price, DATE '2001-09-01', NULL, TRUE
        FROM c LEFT JOIN h ON h.o_orderkey = c.o_orderkey WHERE h.o_orderkey IS NULL OR h.content <> c.content""",
    "dataset_drift": f"""WITH {HISTORY}, facts AS (
            SELECT (SELECT count(*) FROM h) AS n0, (SELECT count(*) FROM c) AS n1, (SELECT max(day) FROM h) AS d0,
                   (SELECT max(day) FROM c) AS d1, (SELECT count(DISTINCT o_orderpriority) FROM h) AS k0,
                   (SELECT count(DISTINCT o_orderpriority) FROM c) AS k1)
        SELECT 'row_count' AS measure, CASE WHEN abs(n1 - n0) / n0 * 100 > 5 THEN 'WARNING' ELSE 'PASS' END AS status FROM facts
        UNION ALL SELECT 'first_date', 'PASS'
        UNION ALL SELECT 'last_date', CASE WHEN NOT CAST(d1 AS VARCHAR) LIKE '2001-08%' OR d1 < d0 THEN 'WARNING' ELSE 'PASS' END FROM facts
        UNION ALL SELECT 'category_count.o_orderpriority', CASE WHEN k0 <> k1 THEN 'WARNING' ELSE 'PASS' END FROM facts
        UNION ALL SELECT 'null_rate.' || unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate',
                                                 'o_orderpriority']), 'PASS'""",
    "duplicate_content": f"""WITH {ORDER_TEXT}, digests AS (
            SELECT CAST('0x' || substr({CONTENT}, 1, 15) AS BIGINT) AS bits FROM orders_text)
        SELECT 'copy_of_orders.csv' AS _source_file, CAST(count(*) AS BIGINT) AS rows_staged,
               md5(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(bits AS DECIMAL(38,0))) AS VARCHAR)) AS content_hash
        FROM digests""",
    "reconciled_copy": f"SELECT o_orderkey, {O_PRICE} AS o_totalprice, {O_DATE} AS o_orderdate FROM orders",
}

# The same merges, whatever the layout of the store.
ORACLES |= {"history_months_append": ORACLES["history_append"], "history_months_upsert": ORACLES["history_mark_inactive"],
            "history_months_replace_period": ORACLES["history_replace_period"]}
ORACLES["history_months_touched"] = f"""WITH {HISTORY}, stored AS (
        SELECT o_orderkey, day FROM h UNION
        SELECT o_orderkey, day FROM c WHERE strftime(day, '%Y-%m') = '1998-03')
    SELECT strftime(day, '%Y-%m') AS month, count(*) AS n_rows, strftime(day, '%Y-%m') = '1998-03' AS written FROM stored GROUP BY ALL"""

# Each window of three months counts its customers anew from the orders.
ORACLES["distinct_customers_rolling"] = f"""WITH monthly AS (
        SELECT o_orderpriority, {{month}} AS month, o_custkey FROM orders WHERE o_custkey IS NOT NULL),
    months AS (SELECT DISTINCT o_orderpriority, month FROM monthly)
    SELECT m.o_orderpriority, m.month, count(DISTINCT o_custkey) FILTER (o.month = m.month) AS distinct_customers,
           count(DISTINCT o_custkey) AS rolling_distinct
    FROM months m JOIN monthly o ON o.o_orderpriority = m.o_orderpriority AND o.month <= m.month AND o.month >= m.month - INTERVAL 2 MONTH
    GROUP BY ALL""".replace("{month}", f"CAST(date_trunc('month', {O_DATE}) AS DATE)")
ORACLES["distinct_customers_total"] = f"""SELECT o_orderpriority, count(DISTINCT o_custkey) AS distinct_customers FROM orders GROUP BY ALL
    UNION ALL SELECT 'all', count(DISTINCT o_custkey) FROM orders"""

# Files as they are written: a header line, then the rows of a priority by key.
CSV_LINES = f"""{ORDER_TEXT}, cells AS (
        SELECT o_orderpriority AS file, o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS cust,
               CAST(price AS VARCHAR) AS price, CAST(day AS VARCHAR) AS day_text,
               row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) + 1 AS source_row,
               o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS surplus, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS short
        FROM orders_text),
    lines AS (SELECT *, concat_ws(',', k, cust, o_orderstatus, price) || CASE WHEN short THEN '' ELSE ',' || day_text || ',' || file END
        || CASE WHEN surplus THEN ',surplus' ELSE '' END AS line FROM cells)"""
ORACLES["stage_csv_orders"] = f"""WITH {CSV_LINES},
    files AS (SELECT file, sha256('o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' || chr(10)
        || string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10)) AS file_sha256 FROM lines GROUP BY file)
    SELECT file, source_row, file_sha256, k AS o_orderkey, cust AS o_custkey, o_orderstatus, price AS o_totalprice,
           CASE WHEN NOT short THEN day_text END AS o_orderdate, CASE WHEN NOT short THEN file END AS o_orderpriority,
           CASE WHEN surplus THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN surplus THEN 'SURPLUS_CELLS' END AS reason_code
    FROM lines JOIN files USING (file)"""
ORACLES["quarantine_csv_orders"] = f"WITH {CSV_LINES} SELECT source_row, 'SURPLUS_CELLS' AS reason_code, line FROM lines WHERE surplus"

# A row's text, its digest, and the digest of a range's digests.
ROW_DIGESTS = f"""{ORDER_TEXT}, digests AS (
        SELECT file_row, price, sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(price AS VARCHAR),
            CAST(day AS VARCHAR), o_orderpriority)) AS digest,
            sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(
            price + CASE WHEN price = (SELECT max(price) FROM orders_text) THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS VARCHAR),
            CAST(day AS VARCHAR), o_orderpriority)) AS later FROM orders_text)"""
ORACLES["chunk_audit"] = f"""WITH {ROW_DIGESTS}
    SELECT 'orders.parquet' AS _source_file, (file_row - 1) // 1000 AS chunk, min(file_row) AS first_row, max(file_row) AS last_row,
           count(*) AS rows_staged, sha256(string_agg(digest, ',' ORDER BY file_row)) AS chunk_sha256 FROM digests GROUP BY ALL"""
ORACLES["changed_chunks"] = f"""WITH {ROW_DIGESTS}, chunks AS (
        SELECT (file_row - 1) // 100 AS chunk, sha256(string_agg(digest, ',' ORDER BY file_row)) AS before_sha256,
               sha256(string_agg(later, ',' ORDER BY file_row)) AS after_sha256 FROM digests GROUP BY ALL)
    SELECT * FROM chunks WHERE before_sha256 <> after_sha256"""
ORACLES["partial_replace_blocked"] = f"""WITH {HISTORY},
    stored AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS stored_rows FROM h WHERE strftime(day, '%Y-%m') = '1998-03' GROUP BY 1),
    arriving AS (SELECT batch, strftime(day, '%Y-%m') AS month, count(*) AS arriving_rows
        FROM c, (VALUES ('shipped only'), ('all')) b(batch)
        WHERE strftime(day, '%Y-%m') = '1998-03' AND (batch = 'all' OR o_orderstatus = 'F') GROUP BY 1, 2),
    both_sides AS (SELECT batch, month, stored_rows, arriving_rows, arriving_rows >= stored_rows * 0.9 AS complete FROM arriving JOIN stored USING (month))
    SELECT *, CASE WHEN complete THEN 'PASS' ELSE 'BLOCK' END AS status FROM both_sides"""
ORACLES["related_join_salted"] = """WITH booked AS (
        SELECT CASE WHEN l_linenumber = 1 THEN (SELECT min(l_orderkey) FROM lineitem) ELSE l_orderkey END AS booked_on,
               CAST(l_quantity AS DECIMAL(18,4)) AS quantity FROM lineitem)
    SELECT booked_on, o_orderpriority, o_custkey, count(*) AS n_lines, CAST(sum(quantity) AS DECIMAL(38,4)) AS quantity
    FROM booked LEFT JOIN orders ON booked_on = o_orderkey GROUP BY ALL"""
ORACLES["insight_factors"] = """WITH monthly AS (
        SELECT p_brand AS id, year(l_shipdate) * 12 + month(l_shipdate) AS m, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS q, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    usual AS (SELECT id, avg(q) AS u, max(m) AS newest, count(*) AS seen, sum(n) AS n, arg_max(q, m) AS last FROM monthly GROUP BY id),
    sides AS (SELECT id, m, newest, sign(q - u) AS side FROM monthly JOIN usual USING (id)),
    islands AS (SELECT *, m - row_number() OVER (PARTITION BY id, side ORDER BY m) AS island FROM sides),
    runs AS (SELECT id, count(*) AS run FROM islands GROUP BY id, side, island HAVING max(m) = max(newest)),
    span AS (SELECT max(m) - min(m) + 1 AS periods FROM monthly)
    SELECT id, round(abs(last - u) / (SELECT sum(abs(last - u)) FROM usual), 6) AS impact, round(abs(last - u) / abs(u), 6) AS magnitude,
           round(run / periods, 6) AS persistence, round(n / (SELECT sum(n) FROM usual), 6) AS population, round(seen / periods, 6) AS confidence
    FROM usual JOIN runs USING (id), span"""
ORACLES["dimension_late_change"] = f"""WITH {HISTORY},
    points AS (
        SELECT o_orderkey, price, DATE '2000-06-01' AS since, 1 AS rnk FROM h
        UNION ALL SELECT o_orderkey, price, DATE '2001-09-01', 1 FROM c
        UNION ALL SELECT o_orderkey, NULL, DATE '2001-09-01', 0 FROM h WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)
        UNION ALL SELECT o_orderkey, CAST(price + 2 AS DECIMAL(18,4)), DATE '2000-12-01', 2 FROM orders_text WHERE o_orderpriority = '1-URGENT'),
    by_day AS (SELECT o_orderkey, since, arg_max({{'p': price}}, rnk).p AS price FROM points GROUP BY 1, 2),
    changed AS (SELECT *, lag(price) OVER (PARTITION BY o_orderkey ORDER BY since) AS earlier FROM by_day),
    kept AS (SELECT *, lead(since) OVER (PARTITION BY o_orderkey ORDER BY since) AS until FROM changed WHERE price IS DISTINCT FROM earlier)
    SELECT o_orderkey, price AS o_totalprice, since AS valid_from, until AS valid_to, until IS NULL AS is_current FROM kept WHERE price IS NOT NULL"""

# Surplus rows are staged, counted and rejected; of the second delivery one file is new.
ORACLES["skipped_files"] = """WITH files AS (SELECT DISTINCT o_orderpriority AS file FROM orders)
    SELECT 'R1' AS run_id, file, (SELECT count(*) FROM orders) AS rows_extracted, 0 AS rows_updated, 0 AS rows_unchanged FROM files
    UNION ALL SELECT 'R2', file, (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH'),
                     (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH'), 0 FROM files WHERE file = '2-HIGH'"""

ORACLES["category_drift"] = f"""WITH {HISTORY}, cells AS (
        SELECT 'o_orderstatus' AS column_name, o_orderstatus AS category, 1 AS before, 0 AS now FROM h
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, 1, 0 FROM h
        UNION ALL SELECT 'o_orderstatus', o_orderstatus, 0, 1 FROM c
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, 0, 1 FROM c),
    counted AS (SELECT column_name, category, CAST(sum(before) AS BIGINT) AS rows_before, CAST(sum(now) AS BIGINT) AS rows_now
                FROM cells GROUP BY ALL)
    SELECT *, CASE WHEN rows_before = 0 THEN 'new' WHEN rows_now = 0 THEN 'lost' ELSE 'same' END AS change,
           CASE WHEN rows_before = 0 OR rows_now = 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM counted"""
