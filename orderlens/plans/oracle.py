"""Independent SQL for every named query, run by DuckDB on the star tables.

Used only for checking: nothing here runs on Spark. Each statement is written
on its own terms (FILTER clauses, list functions, correlated minima), not as a
transcript of the DataFrame code it checks.
"""

from __future__ import annotations

from orderlens.operators.repurchase import GAP_EDGES, GAP_LABELS, GAP_LABELS_ZH, TOTAL_LABEL
from orderlens.operators.rfm import DIMENSION_LABELS, SEGMENT_LABELS, SEGMENT_RULES, SHORT_SEGMENT_LABELS
from orderlens.plans import parameters as P
from orderlens.plans.parameters import STAR_PARAMETERS
from orderlens.sources.star import STAR_DELIVERED, TRANSLATED_BRANDS

_PAR = STAR_PARAMETERS


def R(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def PCT(part: str, whole: str, digits: int = 2) -> str:
    return R(f"({part}) * 100.0 / NULLIF({whole}, 0)", digits)


def SPAN(start: str, end: str, unit: str) -> str:
    per = {"hours": "3600e6", "days": "86400e6"}[unit]
    return f"((epoch_us({end}) - epoch_us({start})) / {per})"


# Each block may use the earlier ones; a statement lists the blocks it needs.
BLOCKS: dict[str, str] = {
    "life": """
        SELECT l_orderkey AS k, MIN(l_shipdate) AS approved,
               MIN(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS carrier,
               MAX(l_shipdate) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'R') AS delivered
        FROM lineitem GROUP BY ALL""",
    "ord": """
        SELECT o_orderkey AS order_id, o_custkey AS person, o_orderstatus AS order_status,
               o_orderdate AS purchased, approved, carrier, delivered
        FROM orders LEFT JOIN life ON k = o_orderkey""",
    "home": """
        SELECT c_custkey AS person, n_name AS state
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "done": f"""
        SELECT o_orderkey AS order_id, o_custkey AS person, CAST(o_orderdate AS DATE) AS day
        FROM orders WHERE o_orderstatus = '{STAR_DELIVERED}'""",
    "prod": f"""
        SELECT p_partkey AS product_id,
               CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) <= {TRANSLATED_BRANDS}
                    THEN 'brand_' || lpad(split_part(p_brand, '#', 2), 2, '0') ELSE p_brand END AS category
        FROM part""",
    "cat": """
        SELECT category, COUNT(DISTINCT l_orderkey) AS orders, SUM(l_extendedprice) AS revenue,
               AVG(l_extendedprice) AS price, COUNT(DISTINCT product_id) AS products
        FROM lineitem JOIN prod ON product_id = l_partkey GROUP BY ALL""",
    "rfm": f"""
        SELECT person,
               date_diff('day', MAX(day), (SELECT CAST(MAX(o_orderdate) AS DATE) + 1 FROM orders)) AS recency,
               COUNT(DISTINCT order_id) AS frequency,
               {R("SUM(l_extendedprice)", 2)} AS monetary
        FROM done JOIN lineitem ON l_orderkey = order_id GROUP BY person""",
    "edges": f"""
        SELECT {", ".join(
            f"list_transform(quantile_cont({m}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda v: {R('v', 6)}) AS {m[0]}e"
            for m in ("recency", "frequency", "monetary"))}
        FROM rfm""",
    "score": """
        SELECT rfm.*,
               len(list_distinct(re)) - 1
                 - len(list_distinct(list_filter(re, lambda v: v > re[1] AND v < recency))) AS rs,
               1 + len(list_distinct(list_filter(fe, lambda v: v > fe[1] AND v < frequency))) AS fs,
               1 + len(list_distinct(list_filter(me, lambda v: v > me[1] AND v < monetary))) AS ms
        FROM rfm, edges""",
    "seg": f"""
        SELECT score.*, CASE {" ".join(
            f"WHEN {' AND '.join(c if want else f'NOT {c}' for c, want in zip(('rh', 'fh', 'mh'), flags))} THEN '{code}'"
            for flags, code in SEGMENT_RULES.items())} END AS code
        FROM (SELECT *, rs >= (SELECT median(rs) FROM score) AS rh, fs >= (SELECT median(fs) FROM score) AS fh,
                     ms >= (SELECT median(ms) FROM score) AS mh FROM score) AS score""",
    "summary": f"""
        SELECT code, COUNT(*) AS users, {R("AVG(recency)", 1)} AS ar, {R("AVG(frequency)", 2)} AS af,
               {R("AVG(monetary)", 2)} AS am, SUM(monetary) AS gmv
        FROM seg GROUP BY code""",
    "active": """
        SELECT DISTINCT person, date_trunc('month', day) AS mon,
               (SELECT MIN(date_trunc('month', d.day)) FROM done d WHERE d.person = done.person) AS born FROM done""",
    "coh": """
        SELECT CAST(born AS DATE) AS born,
               (year(mon) - year(born)) * 12 + month(mon) - month(born) AS off, COUNT(*) AS n
        FROM active GROUP BY ALL""",
    "ret": f"""
        SELECT c.born, c.off, c.n, c.n * 100.0 / z.n AS pct
        FROM coh c JOIN coh z ON z.born = c.born AND z.off = 0 AND z.n >= {_PAR.min_cohort}""",
    "gap": """
        SELECT person, date_diff('day', days[1], days[2]) AS d
        FROM (SELECT person, list_sort(list(day)) AS days FROM done GROUP BY person HAVING COUNT(*) >= 2)""",
    "bucket": f"""
        SELECT b, COUNT(*) AS n, AVG(d) AS mean, {PCT("COUNT(*)", "(SELECT COUNT(*) FROM gap)")} AS pct
        FROM (SELECT d, len(list_filter({list(GAP_EDGES)}, lambda e: e < d)) AS b FROM gap) GROUP BY b""",
    "catrep": f"""
        SELECT category, COUNT(*) AS buyers, COUNT(*) FILTER (WHERE n > 1) AS again
        FROM (SELECT person, category, COUNT(DISTINCT order_id) AS n
              FROM done JOIN lineitem ON l_orderkey = order_id JOIN prod ON product_id = l_partkey GROUP BY ALL)
        GROUP BY category HAVING COUNT(*) >= {_PAR.min_buyers}""",
    "percust": "SELECT o_custkey AS person, COUNT(*) AS ids FROM orders GROUP BY ALL",
    "perdone": "SELECT person, COUNT(*) AS n FROM done GROUP BY person",
    "freq": """
        SELECT frequency, COUNT(*) AS n FROM
          (SELECT person, COUNT(*) AS frequency FROM done WHERE order_id IN (SELECT l_orderkey FROM lineitem)
           GROUP BY person) GROUP BY frequency""",
    "states": "SELECT state, COUNT(DISTINCT o_custkey) AS n FROM orders LEFT JOIN home ON person = o_custkey GROUP BY state",
    "baskets": "SELECT l_orderkey AS k, SUM(l_extendedprice) AS total, COUNT(*) AS items FROM lineitem GROUP BY k",
    "mon": """
        SELECT strftime(day, '%Y-%m') AS month, COUNT(*) AS order_cnt FROM done GROUP BY 1""",
    "stage": """
        SELECT COUNT(*) AS rows, COUNT(purchased) AS s1, COUNT(approved) AS s2, COUNT(carrier) AS s3,
               COUNT(delivered) AS s4 FROM ord""",
    "daily": """
        SELECT user_id, CAST(ts AS DATE) AS day,
               MIN(ts) FILTER (WHERE event_type = 'view') AS view,
               MIN(ts) FILTER (WHERE event_type = 'click') AS click,
               MIN(ts) FILTER (WHERE event_type = 'signup') AS signup,
               MIN(ts) FILTER (WHERE event_type = 'purchase') AS purchase
        FROM events GROUP BY 1, 2""",
}

_USES = {
    "ord": ["life"], "cat": ["prod"], "rfm": ["done"], "edges": ["rfm"], "score": ["edges"], "seg": ["score"],
    "summary": ["seg"], "active": ["done"], "coh": ["active"], "ret": ["coh"], "gap": ["done"], "bucket": ["gap"],
    "catrep": ["done", "prod"], "perdone": ["done"], "freq": ["done"], "states": ["home"], "mon": ["done"],
    "stage": ["ord"],
}


def sql(body: str, *needs: str) -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        for other in _USES.get(name, []):
            add(other)
        wanted.add(name)

    for name in needs:
        add(name)
    if not wanted:
        return body
    blocks = ", ".join(f"{name} AS MATERIALIZED ({text})" for name, text in BLOCKS.items() if name in wanted)
    return f"WITH {blocks} {body}"


def _label(code: str, labels: dict[str, str]) -> str:
    return "CASE " + code + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def _gap_label(labels) -> str:
    return "CASE b " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(labels)) + " END"


def _stage_union(labels, count: str, base: str | None = None, source: str = "stage", cols=("s1", "s2", "s3", "s4")) -> str:
    parts = []
    for i, label in enumerate(labels):
        rates = ""
        if base:
            step = PCT(cols[i], cols[i - 1]) if i else "CAST(NULL AS DOUBLE)"
            rates = f", {PCT(cols[i], base)} AS overall_rate, {step} AS step_rate"
        parts.append(f"SELECT '{label}' AS stage, {cols[i]} AS {count}{rates} FROM {source}")
    return " UNION ALL ".join(parts)


_SHORT = {P.PURCHASED: "purchased", P.APPROVED: "approved", P.CARRIER: "carrier", P.DELIVERED: "delivered"}


def _durations(spans, names, units=None) -> str:
    parts = []
    for s in spans:
        x = SPAN(_SHORT.get(s.start, s.start), _SHORT.get(s.end, s.end), s.unit)
        unit = f", '{units[s.unit]}' AS unit" if units else ""
        parts.append(
            f"SELECT '{s.label}' AS stage, {R(f'AVG({x})', 1)} AS {names[0]}, "
            f"{R(f'quantile_cont({x}, 0.5)', 1)} AS {names[1]}, {R(f'quantile_cont({x}, 0.95)', 1)} AS {names[2]}"
            f"{unit} FROM ord"
        )
    return " UNION ALL ".join(parts)


def _table_counts() -> str:
    counts = {
        "orders": "orders", "customers": "orders", "order_items": "lineitem", "order_payments": "orders",
        "order_reviews": "lineitem", "products": "part", "sellers": "supplier", "geolocation": "customer",
    }
    rows = [f"SELECT '{role}' AS table_name, COUNT(*) AS row_cnt FROM {table}" for role, table in counts.items()]
    return " UNION ALL ".join([*rows, f"SELECT 'category_translation', {TRANSLATED_BRANDS}"])


def _overview() -> str:
    columns = {
        "orders": "order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at, "
        "order_delivered_carrier_date, order_delivered_customer_date",
        "customers": "customer_id, customer_unique_id, customer_state",
        "order_items": "order_id, product_id, seller_id, price",
        "order_payments": "order_id, payment_type, payment_value",
        "order_reviews": "order_id, review_score",
        "products": "product_id, product_category_name",
        "sellers": "seller_id",
        "geolocation": "zip_code_prefix",
        "category_translation": "product_category_name, product_category_name_english",
    }
    names = "CASE table_name " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in columns.items()) + " END"
    return (
        f"SELECT table_name, CAST(row_cnt AS BIGINT) AS row_cnt, "
        f"CAST(len(string_split({names}, ',')) AS BIGINT) AS column_cnt, {names} AS key_columns "
        f"FROM ({_table_counts()}) t"
    )


def _category_top(columns: str, k: int, where: str = "TRUE") -> str:
    return f"SELECT {columns} FROM cat WHERE {where} ORDER BY orders DESC, category LIMIT {k}"


_CAT_COLUMNS = (
    f"category, orders AS order_cnt, {R('revenue', 2)} AS total_revenue, {R('price', 2)} AS avg_price, "
    "products AS product_cnt"
)


def _segments(labels, short: bool = False) -> str:
    averages = "" if short else "ar AS avg_recency, af AS avg_frequency, am AS avg_monetary, "
    return (
        f"SELECT {_label('code', labels)} AS segment, users AS user_cnt, {averages}{R('gmv', 2)} AS total_gmv, "
        f"{PCT('users', '(SELECT SUM(users) FROM summary)')} AS user_pct, "
        f"{PCT('gmv', '(SELECT SUM(gmv) FROM summary)')} AS gmv_pct FROM summary"
    )


def _segments_all() -> str:
    codes = ", ".join(f"('{c}')" for c in SEGMENT_LABELS)
    return (
        f"SELECT {_label('d.code', SEGMENT_LABELS)} AS segment, COALESCE(users, 0) AS user_cnt, ar AS avg_recency, "
        f"af AS avg_frequency, am AS avg_monetary, {R('COALESCE(gmv, 0)', 2)} AS total_gmv, "
        f"{PCT('COALESCE(users, 0)', '(SELECT SUM(users) FROM summary)')} AS user_pct, "
        f"{PCT('COALESCE(gmv, 0)', '(SELECT SUM(gmv) FROM summary)')} AS gmv_pct "
        f"FROM (VALUES {codes}) d(code) LEFT JOIN summary s ON s.code = d.code"
    )


def _scaled(x: str) -> str:
    return R(f"({x} - MIN({x}) OVER ()) / (MAX({x}) OVER () - MIN({x}) OVER () + 1e-10)", 6)


def _describe() -> str:
    rows = []
    for stat, text in {
        "count": "CAST(COUNT({c}) AS DOUBLE)", "mean": R("AVG({c})", 4), "std": R("stddev_samp({c})", 4),
        "min": R("MIN({c})", 4), "25%": R("quantile_cont({c}, 0.25)", 4), "50%": R("quantile_cont({c}, 0.5)", 4),
        "75%": R("quantile_cont({c}, 0.75)", 4), "max": R("MAX({c})", 4),
    }.items():
        cells = ", ".join(f"{text.format(c=c)} AS {c}" for c in ("recency", "frequency", "monetary"))
        rows.append(f"SELECT '{stat}' AS stat, {cells} FROM rfm")
    return " UNION ALL ".join(rows)


def _matrix(value: str) -> str:
    cells = ", ".join(f"MAX({value}) FILTER (WHERE off = {i}) AS m{i}" for i in range(12))
    return f"SELECT strftime(born, '%Y-%m') AS cohort_month, {cells} FROM ret GROUP BY 1"


def _box() -> str:
    parts = []
    for s in P.ORDER_SPANS[:3]:
        x = f"(epoch_us({_SHORT[s.end]}) - epoch_us({_SHORT[s.start]}))"
        unit = {"hours": "3600e6", "days": "86400e6"}[s.unit]
        parts.append(f"""
            SELECT '{s.label}' AS stage, n, {R(f'q1 / {unit}', 4)} AS q1, {R(f'med / {unit}', 4)} AS median,
                   {R(f'q3 / {unit}', 4)} AS q3,
                   {R(f'LEAST(q1, MIN(x) FILTER (WHERE x BETWEEN lo AND hi)) / {unit}', 4)} AS whisker_low,
                   {R(f'GREATEST(q3, MAX(x) FILTER (WHERE x BETWEEN lo AND hi)) / {unit}', 4)} AS whisker_high,
                   {R(f'cap / {unit}', 4)} AS cap, COUNT(*) FILTER (WHERE x NOT BETWEEN lo AND hi) AS fliers
            FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
                  FROM (SELECT x, cap, COUNT(*) OVER () AS n, quantile_cont(x, 0.25) OVER () AS q1,
                               quantile_cont(x, 0.5) OVER () AS med, quantile_cont(x, 0.75) OVER () AS q3
                        FROM (SELECT LEAST(v, cap) AS x, cap
                              FROM (SELECT {x} AS v FROM ord WHERE order_status = '{STAR_DELIVERED}') a,
                                   (SELECT quantile_cont({x}, 0.99) AS cap FROM ord
                                    WHERE order_status = '{STAR_DELIVERED}') c
                              WHERE v IS NOT NULL)))
            GROUP BY n, q1, med, q3, cap""")
    return " UNION ALL ".join(parts)


def _insights() -> str:
    one = lambda text: f"(SELECT {text})"
    stage3 = SPAN("carrier", "delivered", "days")
    top_cat = f"""(SELECT category FROM catrep ORDER BY {PCT('again', 'buyers')} DESC, category LIMIT 1)"""
    focus = f"""(SELECT {R('revenue', 2)} / orders FROM cat WHERE category = '{_PAR.focus_category}' AND category IN
                (SELECT category FROM cat WHERE category IS NOT NULL ORDER BY orders DESC, category LIMIT 15))"""
    gmv = "SELECT SUM(l_extendedprice) FROM lineitem JOIN done ON order_id = l_orderkey"
    pct = lambda score: PCT(
        f"(SELECT COUNT(*) FROM lineitem WHERE CAST(l_quantity AS INT) % 5 = {score - 1})", "(SELECT COUNT(*) FROM lineitem)"
    )
    seg = lambda code, expr: f"(SELECT {expr} FROM summary WHERE code = '{code}')"
    share = PCT("gmv", "(SELECT SUM(gmv) FROM summary)")
    return f"""SELECT {R(f"({R(f'({gmv})', 2)}) / 1e6", 2)} AS gmv_millions,
        {PCT('(SELECT COUNT(*) FROM done)', '(SELECT COUNT(*) FROM orders)')} AS delivered_pct,
        {one(f"{PCT('s2', 's1')} FROM stage")} AS step_approved_pct,
        {one(f"{PCT('s3', 's2')} FROM stage")} AS step_carrier_pct,
        {one(f"{PCT('s4', 's1')} FROM stage")} AS overall_delivered_pct,
        (SELECT month FROM mon ORDER BY order_cnt DESC, month LIMIT 1) AS peak_month,
        (SELECT MAX(order_cnt) FROM mon) AS peak_month_orders,
        (SELECT {R('AVG(order_cnt)', 2)} FROM mon WHERE month >= '{_PAR.trend_start}') AS avg_monthly_orders,
        {pct(5)} AS five_star_pct, {pct(1)} AS one_star_pct,
        {one(f"{R(f'AVG({stage3})', 1)} FROM ord")} AS ship_avg_days,
        {one(f"{R(f'quantile_cont({stage3}, 0.5)', 1)} FROM ord")} AS ship_median_days,
        {one(f"{R(f'quantile_cont({stage3}, 0.95)', 1)} FROM ord")} AS ship_p95_days,
        (SELECT pct FROM bucket ORDER BY b LIMIT 1) AS first_window_pct,
        {top_cat} AS top_repeat_category,
        (SELECT MAX({PCT('again', 'buyers')}) FROM catrep) AS top_repeat_rate,
        {seg('champions', 'users')} AS champion_users, {seg('champions', share)} AS champion_gmv_pct,
        {seg('at_risk', 'users')} AS at_risk_users, {seg('at_risk', share)} AS at_risk_gmv_pct,
        {PCT('(SELECT MAX(n) FROM states)', '(SELECT COUNT(*) FROM percust)')} AS top_state_pct,
        {R(f"{focus} / ({R('(SELECT AVG(total) FROM baskets)', 2)})", 2)} AS focus_ticket_ratio"""


def _share(select: str, source: str, key: str, count: str, extra: str = "") -> str:
    return (
        f"SELECT {select} AS {key}, COUNT(*) AS {count}, {PCT('COUNT(*)', f'(SELECT COUNT(*) FROM {source})')} AS pct"
        f"{extra} FROM {source} GROUP BY 1"
    )


_RATE = f"{PCT('COUNT(*) FILTER (WHERE n > 1)', 'COUNT(*)')} AS repurchase_rate"
_SEVEN = "rfm.person AS customer_unique_id"


def oracle_statements() -> dict[str, str]:
    state_pct = PCT("n", "(SELECT SUM(n) FROM states)")
    freq_total = "(SELECT SUM(n) FROM freq)"
    many = "SUM(n) FILTER (WHERE frequency > 1)"
    one = "SUM(n) FILTER (WHERE frequency = 1)"
    rates = f"{PCT('COUNT(delivered)', 'COUNT(purchased)')} AS delivery_rate"
    by_state = (
        "SELECT state AS customer_state, COUNT(*) AS total_orders, {cols} FROM ord JOIN home USING (person) "
        f"GROUP BY state HAVING COUNT(*) >= {_PAR.min_rows} ORDER BY total_orders DESC, state LIMIT 10"
    )
    repeat_rate = PCT("again", "buyers")
    dims = list(DIMENSION_LABELS.values())
    out = {
        "q01_01_table_sizes": sql(_table_counts()),
        "q01_02_status_share": sql(_share("o_orderstatus", "orders", "order_status", "order_cnt")),
        "q01_03_monthly_trend": sql("SELECT month, order_cnt FROM mon", "mon"),
        "q01_04_category_top20": sql(_category_top(_CAT_COLUMNS, 20), "cat"),
        "q01_05_identity_audit": "SELECT COUNT(DISTINCT o_orderkey) AS distinct_customer_ids, COUNT(DISTINCT o_custkey) "
        "AS distinct_unique_ids, COUNT(*) AS total_rows, COUNT(DISTINCT o_orderkey) - COUNT(DISTINCT o_custkey) "
        "AS duplicated_ids FROM orders",
        "q01_06_repeat_distribution": sql(
            f"SELECT COALESCE(CAST(ids AS VARCHAR), '{TOTAL_LABEL}') AS id_count, COUNT(*) AS user_cnt, "
            f"{PCT('COUNT(*)', '(SELECT COUNT(*) FROM percust WHERE ids > 1)')} AS pct "
            "FROM percust WHERE ids > 1 GROUP BY ROLLUP (ids)",
            "percust",
        ),
        "q01_07_state_share": sql(f"SELECT state AS customer_state, n AS customer_cnt, {state_pct} AS pct FROM states", "states"),
        "q01_08_payment_share": sql(
            _share("o_orderpriority", "orders", "payment_type", "pay_cnt", f", {R('AVG(o_totalprice)', 2)} AS avg_value")
        ),
        "q01_09_review_share": sql(_share("CAST(l_quantity AS INT) % 5 + 1", "lineitem", "review_score", "review_cnt")),
        "q01_10_kpi_row": sql(
            "SELECT (SELECT COUNT(*) FROM done) AS delivered_orders, (SELECT COUNT(*) FROM percust) AS unique_customers, "
            f"{R('AVG(total)', 2)} AS avg_order_value, {R('AVG(items)', 2)} AS avg_items_per_order FROM baskets",
            "done", "percust", "baskets",
        ),
        "n1_coverage": "SELECT MIN(o_orderdate) AS first_ts, MAX(o_orderdate) AS last_ts FROM orders",
        "n1_table_overview": _overview(),
        "n1_category_top10_by_revenue": sql(
            f"SELECT * FROM ({_category_top(_CAT_COLUMNS, 20)}) t ORDER BY total_revenue DESC, category LIMIT 10", "cat"
        ),
        "n1_repeat_stats": sql(
            f"SELECT COUNT(*) AS repeat_users, MAX(ids) AS max_ids, {R('AVG(ids)', 2)} AS avg_ids FROM percust WHERE ids > 1",
            "percust",
        ),
        "n1_state_top10": sql(
            f"SELECT state AS customer_state, n AS customer_cnt, {state_pct} AS pct FROM states ORDER BY n DESC, state LIMIT 10",
            "states",
        ),
        "n1_top_state_share": sql(
            f"SELECT state AS customer_state, {state_pct} AS pct FROM states ORDER BY n DESC, state LIMIT 1", "states"
        ),
        "q02_01_order_funnel": sql(_stage_union([s for s, _ in P.ORDER_STAGES], "order_cnt", "s1"), "stage"),
        "q02_02_stage_durations": sql(_durations(P.STAGE_SPANS, ("avg_hours", "median_hours", "p95_hours")), "ord"),
        "q02_03_duration_by_status": sql(
            f"SELECT order_status, COUNT(*) AS order_cnt, {R(f'''AVG({SPAN('purchased', 'approved', 'hours')})''', 1)} "
            f"AS avg_hr_to_approve, {R(f'''AVG({SPAN('approved', 'carrier', 'days')})''', 1)} AS avg_days_to_carrier "
            "FROM ord GROUP BY order_status",
            "ord",
        ),
        "q02_04_funnel_by_state": sql(
            by_state.format(cols=f"{rates}, {PCT('COUNT(carrier)', 'COUNT(approved)')} AS carrier_rate"), "ord", "home"
        ),
        "n2_funnel_rowbase": sql(_stage_union([s for s, _ in P.ORDER_STAGES], "cnt", "rows"), "stage"),
        "n2_order_durations": sql(
            "SELECT order_id, "
            + ", ".join(f"{R(SPAN(_SHORT[s.start], _SHORT[s.end], s.unit), 6)} AS {s.label}" for s in P.ORDER_SPANS)
            + " FROM ord",
            "ord",
        ),
        "n2_box_stats": sql(_box(), "ord"),
        "q03_01_rfm_describe": sql(
            f"SELECT COUNT(*) AS user_cnt, {R('AVG(recency)', 2)} AS avg_recency, {R('median(recency)', 6)} AS median_recency, "
            f"MIN(recency) AS min_recency, MAX(recency) AS max_recency, {R('AVG(frequency)', 2)} AS avg_frequency, "
            f"{R('median(frequency)', 6)} AS median_frequency, MAX(frequency) AS max_frequency, "
            f"{R('AVG(monetary)', 2)} AS avg_monetary, {R('median(monetary)', 6)} AS median_monetary, "
            f"MAX(monetary) AS max_monetary FROM rfm",
            "rfm",
        ),
        "q03_02_quintile_cuts": sql(
            "SELECT " + ", ".join(
                f"{R(f'quantile_cont({m}, 0.{p})', 6)} AS {m[0]}_q{p}"
                for m in ("recency", "frequency", "monetary") for p in (20, 40, 60, 80)
            ) + " FROM rfm",
            "rfm",
        ),
        "q03_03_score_distribution": sql(
            " UNION ALL ".join(
                f"SELECT '{d}' AS dim, CAST({c} AS BIGINT) AS score, COUNT(*) AS user_cnt FROM score GROUP BY 2"
                for d, c in zip(dims, ("rs", "fs", "ms"))
            ),
            "score",
        ),
        "q03_04_segment_summary": sql(_segments(SEGMENT_LABELS), "summary"),
        "q03_05_frequency_distribution": sql(
            f"SELECT frequency, CAST(n AS BIGINT) AS user_cnt, {PCT('n', freq_total)} AS pct FROM freq", "freq"
        ),
        "n3_frequency_first20": sql(
            "SELECT frequency, CAST(n AS BIGINT) AS user_cnt FROM freq ORDER BY frequency LIMIT 20", "freq"
        ),
        "n3_rfm_table": sql(
            "SELECT person AS customer_unique_id, recency, frequency, monetary, CAST(rs AS INT) AS R_score, "
            "CAST(fs AS INT) AS F_score, CAST(ms AS INT) AS M_score, concat(rs, fs, ms) AS RFM_score, "
            f"{_label('code', SEGMENT_LABELS)} AS segment FROM seg",
            "seg",
        ),
        "n3_describe": sql(_describe(), "rfm"),
        "n3_segment_summary_all": sql(_segments_all(), "summary"),
        "n3_segment_heatmap": sql(
            f"SELECT segment, {_scaled('(-avg_recency)')} AS avg_recency, {_scaled('avg_frequency')} AS avg_frequency, "
            f"{_scaled('avg_monetary')} AS avg_monetary FROM ({_segments_all()}) t",
            "summary",
        ),
        "n3_one_vs_many": sql(
            f"SELECT CAST({one} AS BIGINT) AS one_time_users, {PCT(one, 'SUM(n)', 1)} AS one_time_pct, "
            f"CAST({many} AS BIGINT) AS multi_users, {PCT(many, 'SUM(n)', 1)} AS multi_pct FROM freq",
            "freq",
        ),
        "q04_01_repurchase_rate": sql(
            "SELECT COUNT(*) AS total_users, COUNT(*) FILTER (WHERE n > 1) AS repurchase_users, "
            f"COUNT(*) FILTER (WHERE n > 2) AS three_plus_users, {_RATE}, {R('AVG(n)', 2)} AS avg_orders_per_user, "
            "MAX(n) AS max_orders FROM perdone",
            "perdone",
        ),
        "q04_02_cohort_counts": sql("SELECT born AS cohort_month, off AS offset_month, n AS user_cnt FROM coh", "coh"),
        "q04_03_cohort_retention": sql(
            f"SELECT born AS cohort_month, off AS offset_month, n AS user_cnt, {R('pct', 2)} AS retention_pct FROM ret", "ret"
        ),
        "q04_04_retention_matrix": sql(_matrix(R("pct", 1)), "ret"),
        "q04_05_retention_curve": sql(
            f"SELECT off AS offset_month, {R('AVG(pct)', 2)} AS avg_retention_pct FROM ret GROUP BY off", "ret"
        ),
        "q04_06_repurchase_windows": sql(
            f"SELECT {_gap_label(GAP_LABELS)} AS window_group, n AS user_cnt, pct, {R('mean', 1)} AS avg_days FROM bucket",
            "bucket",
        ),
        "q04_07_category_repurchase": sql(
            f"SELECT category, buyers AS total_buyers, again AS repurchase_buyers, {repeat_rate} AS repurchase_rate "
            "FROM catrep ORDER BY repurchase_rate DESC, category LIMIT 15",
            "catrep",
        ),
        "n4_retention_counts_matrix": sql(
            "SELECT strftime(born, '%Y-%m') AS cohort_month, off AS offset_month, n AS user_cnt FROM ret", "ret"
        ),
        "n4_cumulative_windows": sql(
            f"SELECT {_gap_label(GAP_LABELS)} AS window_group, pct, {R('SUM(pct) OVER (ORDER BY b)', 2)} AS cum_pct FROM bucket",
            "bucket",
        ),
        "d_kpis": sql(
            "SELECT (SELECT COUNT(*) FROM orders) AS total_orders, (SELECT COUNT(*) FROM done) AS delivered_orders, "
            "(SELECT COUNT(*) FROM percust) AS unique_customers, "
            f"{R('(SELECT SUM(total) FROM baskets JOIN done ON k = order_id)', 2)} AS total_gmv, "
            f"{R('(SELECT AVG(total) FROM baskets)', 2)} AS avg_order_value, "
            f"(SELECT {R('AVG(CAST(l_quantity AS INT) % 5 + 1)', 2)} FROM lineitem) AS avg_review_score, "
            "(SELECT COUNT(*) FROM supplier) AS sellers, (SELECT COUNT(*) FROM part) AS products",
            "done", "percust", "baskets",
        ),
        "d_repurchase": sql(
            f"SELECT COUNT(*) AS total_users, COUNT(*) FILTER (WHERE n > 1) AS repurchase_users, {_RATE} FROM perdone",
            "perdone",
        ),
        "d_review_dist": sql(
            f"SELECT review_score, pct FROM ({_share('CAST(l_quantity AS INT) % 5 + 1', 'lineitem', 'review_score', 'n')})"
        ),
        "d_cohort_matrix": sql(_matrix(R("pct", 2)), "ret"),
        "d_categories15": sql(
            _category_top(f"category, orders AS order_cnt, {R('revenue', 2)} AS total_revenue", 15, "category IS NOT NULL"),
            "cat",
        ),
        "d_states10": sql(
            "SELECT state AS customer_state, n AS customer_cnt FROM states ORDER BY n DESC, state LIMIT 10", "states"
        ),
        "d_funnel": sql(_stage_union([s for s, _ in P.DASHBOARD_STAGES], "cnt"), "stage"),
        "d_stage_times": sql(_durations(P.DASHBOARD_SPANS, ("avg_v", "median_v", "p95_v"), P.UNIT_LABELS), "ord"),
        "d_funnel_by_state": sql(by_state.format(cols=rates), "ord", "home"),
        "d_rfm": sql(_segments(SHORT_SEGMENT_LABELS, short=True), "summary"),
        "d_cohort": sql(
            f"SELECT strftime(born, '%Y-%m') AS cohort_month, off AS offset_month, n AS user_cnt, {R('pct', 2)} "
            "AS retention_pct FROM ret",
            "ret",
        ),
        "d_avg_retention12": sql(
            f"SELECT off AS offset_month, {R(f'''AVG({R('pct', 2)})''', 2)} AS avg_retention_pct FROM ret "
            "WHERE off <= 12 GROUP BY off",
            "ret",
        ),
        "d_windows": sql(
            f"SELECT {_gap_label(GAP_LABELS_ZH)} AS window_group, n AS user_cnt, pct, "
            f"{R('SUM(pct) OVER (ORDER BY b)', 1)} AS cum_pct FROM bucket",
            "bucket",
        ),
        "d_category_repurchase": sql(
            f"SELECT category, buyers AS total_buyers, {repeat_rate} AS repurchase_rate FROM catrep "
            "ORDER BY repurchase_rate DESC, category LIMIT 15",
            "catrep",
        ),
        "d_insights": sql(
            _insights(), "done", "stage", "mon", "bucket", "catrep", "cat", "summary", "states", "percust", "baskets"
        ),
    }
    return out
