"""Thirty analytical queries: ten pilot (p), ten curriculum (c), ten hard (h).

Each is one text for both dialects. Sums of money are exact decimals, every order is total,
and windows without a partition stand over aggregates only.
"""

from __future__ import annotations

from .dialect import Dialect, Text

NET = "l_extendedprice * (1 - l_discount)"


def p01(d: Dialect) -> str:
    """Brands by revenue: three tables, distinct count, HAVING."""
    return f"""
    SELECT p_brand, COUNT(DISTINCT o_orderkey) AS n_orders, COUNT(DISTINCT o_custkey) AS n_customers, {d.real(f'SUM({d.money(NET)})')} AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    GROUP BY p_brand HAVING COUNT(DISTINCT o_orderkey) >= 5
    ORDER BY revenue DESC, p_brand LIMIT 15"""


def p02(d: Dialect) -> str:
    """Discount share by quarter, with protected ratios."""
    return f"""
    SELECT year(l_shipdate) AS ship_year, quarter(l_shipdate) AS ship_quarter, COUNT(*) AS n_lines,
           {d.real(f'SUM({d.money("l_extendedprice")})')} AS gross, {d.real(f'SUM({d.money("l_extendedprice * l_discount")})')} AS discounts,
           {d.share(f'100 * SUM({d.money("l_extendedprice * l_discount")})', f'SUM({d.money("l_extendedprice")})', 4)} AS discount_pct
    FROM lineitem GROUP BY year(l_shipdate), quarter(l_shipdate)"""


def p03(d: Dialect) -> str:
    """Supplier nations: conditional distinct counts and revenue."""
    return f"""
    SELECT n_name, COUNT(DISTINCT l_orderkey) AS n_orders, COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned_orders,
           COUNT(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS finished_orders, {d.real(f'SUM({d.money(NET)})')} AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"""


def p04(d: Dialect) -> str:
    """Conditional counts by customer segment."""
    return """
    SELECT c_mktsegment, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_o,
           SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_p, COUNT(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""


def p05(d: Dialect) -> str:
    """Return rate of parts with enough lines."""
    return f"""
    SELECT p_partkey, p_name, COUNT(*) AS n_lines, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned,
           {d.share("SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", 'COUNT(*)', 4)} AS return_rate
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name HAVING COUNT(*) >= 20
    ORDER BY return_rate DESC, n_lines DESC, p_partkey LIMIT 20"""


def p06(d: Dialect) -> str:
    """Mean of a JSON number by event type, over all and over those above a bound only."""
    k = f"CAST({d.json('props', 'k')} AS BIGINT)"
    return f"""
    SELECT event_type, COUNT(*) AS n_events, COUNT({k}) AS n_k, {d.share(f'SUM({k})', f'COUNT({k})', 4)} AS mean_k,
           {d.share(f'SUM(CASE WHEN {k} > 50 THEN {k} END)', f'COUNT(CASE WHEN {k} > 50 THEN 1 END)', 4)} AS mean_large_k
    FROM events GROUP BY event_type"""


def p07(d: Dialect) -> str:
    """Share of lines that were returned or late, OR and COALESCE inside an average."""
    flagged = "(l_returnflag = 'R' OR l_linestatus = 'O')"
    return f"""
    SELECT l_linenumber, COUNT(*) AS n_lines, SUM(CASE WHEN {flagged} THEN 1 ELSE 0 END) AS n_flagged,
           {d.share(f'SUM(CASE WHEN {flagged} THEN 1 ELSE 0 END)', 'COUNT(*)')} AS flagged_rate,
           {d.share(f'SUM(COALESCE(CASE WHEN {flagged} THEN CAST(l_quantity AS BIGINT) END, 0))', 'COUNT(*)', 4)} AS mean_flagged_quantity
    FROM lineitem GROUP BY l_linenumber"""


def p08(d: Dialect) -> str:
    """Six tables in a chain: regions by part type."""
    return f"""
    SELECT r_name, p_type, COUNT(*) AS n_lines, {d.real(f'SUM({d.money(NET)})')} AS revenue
    FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
         JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
    GROUP BY r_name, p_type"""


def p09(d: Dialect) -> str:
    """Unit economics on a two-column key: prices by part and year against volume by part and year."""
    return f"""
    WITH sold AS (SELECT l_partkey, year(l_shipdate) AS y, SUM(CAST(l_quantity AS BIGINT)) AS units, SUM({d.money(NET)}) AS net FROM lineitem GROUP BY l_partkey, year(l_shipdate)),
    listed AS (SELECT l_partkey, year(l_shipdate) AS y, MAX({d.money('l_extendedprice')}) AS top_price FROM lineitem GROUP BY l_partkey, year(l_shipdate))
    SELECT p_brand, s.y AS ship_year, SUM(s.units) AS units, {d.real('SUM(s.net)')} AS net, {d.real('SUM(l.top_price)')} AS top_prices,
           {d.share('SUM(s.net)', 'SUM(s.units)', 4)} AS net_a_unit
    FROM sold s JOIN listed l ON s.l_partkey = l.l_partkey AND s.y = l.y JOIN part ON p_partkey = s.l_partkey
    GROUP BY p_brand, s.y"""


def p10(d: Dialect) -> str:
    """Nation scorecard with a converted unit and a rate."""
    return f"""
    SELECT n_name, COUNT(*) AS n_orders, ROUND({d.real(f'SUM({d.money("o_totalprice")})')} / 1000, 6) AS thousands, {d.share("SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS urgent_rate
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


def c01(d: Dialect) -> str:
    """A leaderboard of one table."""
    return f"""
    SELECT c_custkey, c_name, {d.real('c_acctbal')} AS balance FROM customer
    WHERE c_mktsegment IS NOT NULL AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25"""


def c02(d: Dialect) -> str:
    """Workload by nation with a dense rank, ties kept."""
    return f"""
    WITH w AS (SELECT n_name, COUNT(*) AS n_orders, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_finished
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
    r AS (SELECT *, DENSE_RANK() OVER (ORDER BY n_orders DESC) AS workload_rank FROM w)
    SELECT n_name, n_orders, n_finished, {d.share('100 * n_finished', 'n_orders', 4)} AS finished_pct, CAST(workload_rank AS INT) AS workload_rank FROM r WHERE workload_rank <= 10"""


def c03(d: Dialect) -> str:
    """Customers by number of years in which they spent enough: two grains, HAVING, rank."""
    return f"""
    WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, COUNT(*) AS n, SUM({d.money('o_totalprice')}) AS spent FROM orders GROUP BY o_custkey, year(o_orderdate) HAVING COUNT(*) >= 2),
    t AS (SELECT o_custkey, COUNT(*) AS years, SUM(n) AS n_orders, SUM(spent) AS spent FROM y GROUP BY o_custkey HAVING COUNT(*) >= 2)
    SELECT o_custkey, years, CAST(n_orders AS BIGINT) AS n_orders, {d.real('spent')} AS spent, CAST(DENSE_RANK() OVER (ORDER BY years DESC, spent DESC) AS INT) AS place FROM t"""


def c04(d: Dialect) -> str:
    """Part types by nation of supplier: grand-total share, running share, gap to the one before."""
    return f"""
    WITH g AS (SELECT n_name, p_type, SUM({d.money(NET)}) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
               JOIN part ON l_partkey = p_partkey GROUP BY n_name, p_type),
    t AS (SELECT p_type, COUNT(*) AS nations, SUM(revenue) AS revenue FROM g GROUP BY p_type)
    SELECT p_type, nations, {d.real('revenue')} AS revenue, {d.share('revenue', 'SUM(revenue) OVER ()')} AS share,
           {d.share('SUM(revenue) OVER (ORDER BY revenue DESC, p_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'SUM(revenue) OVER ()')} AS running_share,
           {d.real('LAG(revenue) OVER (ORDER BY revenue DESC, p_type) - revenue')} AS gap
    FROM t"""


def c05(d: Dialect) -> str:
    """Summary of one year by priority, a half-open range of dates."""
    return f"""
    SELECT o_orderpriority, COUNT(*) AS n_orders, {d.real(f'SUM({d.money("o_totalprice")})')} AS total, {d.real(f'MIN({d.money("o_totalprice")})')} AS least, {d.real(f'MAX({d.money("o_totalprice")})')} AS most
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_orderpriority"""


def c06(d: Dialect) -> str:
    """Brands within a type against the type's mean."""
    return f"""
    WITH b AS (SELECT p_type, p_brand, COUNT(*) AS n_parts, SUM({d.money('p_retailprice')}) AS total FROM part GROUP BY p_type, p_brand),
    m AS (SELECT *, {d.share('total', 'n_parts', 4)} AS mean_price, ROUND(CAST(SUM(total) OVER (PARTITION BY p_type) AS DOUBLE) / SUM(n_parts) OVER (PARTITION BY p_type), 4) AS type_mean FROM b)
    SELECT p_type, p_brand, n_parts, mean_price, type_mean, CASE WHEN mean_price > type_mean THEN 'above' WHEN mean_price < type_mean THEN 'below' ELSE 'at' END AS against,
           CAST(DENSE_RANK() OVER (PARTITION BY p_type ORDER BY mean_price DESC) AS INT) AS place FROM m"""


def c07(d: Dialect) -> str:
    """Time from order to shipment by nation, and how often it is long."""
    gap = d.days("o_orderdate", "l_shipdate")
    return f"""
    SELECT n_name, COUNT(DISTINCT o_orderkey) AS n_orders, SUM({gap}) AS days, {d.share(f'SUM({gap})', 'COUNT(*)', 4)} AS mean_days,
           {d.share(f'SUM(CASE WHEN {gap} > 60 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS late_rate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


def c08(d: Dialect) -> str:
    """Events by a JSON value's last digit, sentinels left out."""
    k = d.json("props", "k")
    return f"""
    SELECT substr({k}, length({k}), 1) AS last_digit, event_type, COUNT(*) AS n_events, MIN(ts) AS first_ts, MAX(ts) AS last_ts
    FROM events WHERE {k} IS NOT NULL AND {k} <> '\\\\N' AND event_type <> 'error' GROUP BY substr({k}, length({k}), 1), event_type"""


def c09(d: Dialect) -> str:
    """Customers without a finished order, ranked by what they spent."""
    return f"""
    WITH t AS (SELECT o_custkey, COUNT(*) AS n_orders, SUM({d.money('o_totalprice')}) AS spent FROM orders o
               WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F') GROUP BY o_custkey)
    SELECT o_custkey, n_orders, {d.real('spent')} AS spent, CAST(RANK() OVER (ORDER BY spent DESC) AS INT) AS place FROM t"""


def c10(d: Dialect) -> str:
    """All brands, those without large lines too, against the mean of all."""
    return f"""
    WITH b AS (SELECT p_brand, COUNT(l_orderkey) AS n_large, COUNT(DISTINCT p_partkey) AS n_parts
               FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 50 GROUP BY p_brand)
    SELECT p_brand, n_large, n_parts, ROUND(CAST(SUM(n_large) OVER () AS DOUBLE) / COUNT(*) OVER (), 4) AS mean_large,
           CASE WHEN n_large = 0 THEN 'none' WHEN n_large * COUNT(*) OVER () >= SUM(n_large) OVER () THEN 'high' ELSE 'low' END AS level FROM b"""


def h01(d: Dialect) -> str:
    """Month in which a customer's running spend first reaches half of the lifetime total."""
    return f"""
    WITH m AS (SELECT o_custkey, {d.trunc('month', 'o_orderdate')} AS m, SUM({d.money('o_totalprice')}) AS spent FROM orders GROUP BY o_custkey, {d.trunc('month', 'o_orderdate')}),
    r AS (SELECT o_custkey, m, spent, SUM(spent) OVER (PARTITION BY o_custkey ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
                 SUM(spent) OVER (PARTITION BY o_custkey) AS lifetime, MIN(m) OVER (PARTITION BY o_custkey) AS first_m FROM m),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY m) AS rn FROM r WHERE running * 2 >= lifetime)
    SELECT o_custkey, first_m, m AS half_m, {d.real('running')} AS running, {d.real('lifetime')} AS lifetime, CAST({d.months('first_m', 'm')} AS INT) AS months FROM k WHERE rn = 1"""


def h02(d: Dialect) -> str:
    """Dense calendar of regions and months: the largest rise over the mean of the three months before."""
    return f"""
    WITH months AS ({d.months_between('1996-01-01', '1996-12-01')}),
    grid AS (SELECT r_regionkey, r_name, m FROM region JOIN months ON 1 = 1),
    spent AS (SELECT n_regionkey, {d.trunc('month', 'o_orderdate')} AS m, SUM({d.money('o_totalprice')}) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
              WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_regionkey, {d.trunc('month', 'o_orderdate')}),
    g AS (SELECT r_name, grid.m AS m, COALESCE(total, 0) AS total FROM grid LEFT JOIN spent ON r_regionkey = n_regionkey AND grid.m = spent.m),
    w AS (SELECT r_name, m, total, SUM(total) OVER (PARTITION BY r_name ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, COUNT(*) OVER (PARTITION BY r_name ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM g),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r_name ORDER BY total * n - before DESC, m) AS rn FROM w WHERE n = 3)
    SELECT r_name, m, {d.real('total')} AS total, {d.share('before', 'n', 4)} AS mean_before, {d.share('total * n', 'before')} AS ratio FROM k WHERE rn = 1"""


def h03(d: Dialect) -> str:
    """Cohorts by quarter of the first order: who orders again in the same quarter a year later; top two a segment."""
    q = d.trunc("quarter", "o_orderdate")
    return f"""
    WITH active AS (SELECT DISTINCT o_custkey, {q} AS q FROM orders),
    born AS (SELECT o_custkey, MIN(q) AS q FROM active GROUP BY o_custkey),
    kept AS (SELECT b.o_custkey, b.q, CASE WHEN a.o_custkey IS NOT NULL THEN 1 ELSE 0 END AS back FROM born b LEFT JOIN active a ON a.o_custkey = b.o_custkey AND a.q = {d.add_months('b.q', 12)}),
    g AS (SELECT c_mktsegment, q, COUNT(*) AS n, SUM(back) AS n_back FROM kept JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, q HAVING COUNT(*) >= 3),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY n_back * 1000000 / n DESC, n DESC, q) AS place FROM g)
    SELECT c_mktsegment, q, n, CAST(n_back AS BIGINT) AS n_back, {d.share('100 * n_back', 'n', 4)} AS back_pct, CAST(place AS INT) AS place FROM k WHERE place <= 2"""


def h04(d: Dialect) -> str:
    """Longest run of years in which a customer spent more than in the year before."""
    return f"""
    WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, SUM({d.money('o_totalprice')}) AS spent FROM orders GROUP BY o_custkey, year(o_orderdate)),
    l AS (SELECT *, LAG(spent) OVER (PARTITION BY o_custkey ORDER BY y) AS before, LAG(y) OVER (PARTITION BY o_custkey ORDER BY y) AS y_before FROM y),
    f AS (SELECT *, CASE WHEN y = y_before + 1 AND spent > before THEN 1 ELSE 0 END AS up FROM l),
    i AS (SELECT *, SUM(1 - up) OVER (PARTITION BY o_custkey ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
    s AS (SELECT o_custkey, island, SUM(up) AS run, MIN(y) AS from_y, MAX(y) AS to_y, MAX(CASE WHEN up = 0 THEN spent END) AS spent_from, MAX(spent) AS spent_to FROM i GROUP BY o_custkey, island),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY run DESC, from_y) AS rn FROM s WHERE run >= 1)
    SELECT o_custkey, CAST(run AS INT) AS run, from_y, to_y, {d.real('spent_from')} AS spent_from, {d.real('spent_to')} AS spent_to FROM k WHERE rn = 1"""


def h05(d: Dialect) -> str:
    """Longest run of active months of a customer, the longest of each region with what was spent in it."""
    return f"""
    WITH a AS (SELECT DISTINCT o_custkey, {d.trunc('month', 'o_orderdate')} AS m FROM orders),
    n AS (SELECT *, year(m) * 12 + month(m) - ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY m) AS island FROM a),
    s AS (SELECT o_custkey, island, COUNT(*) AS months, MIN(m) AS from_m, MAX(m) AS to_m FROM n GROUP BY o_custkey, island),
    r AS (SELECT s.*, r_name FROM s JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r_name ORDER BY months DESC, from_m, o_custkey) AS rn FROM r)
    SELECT r_name, k.o_custkey, months, from_m, to_m, COUNT(*) AS n_orders, {d.real(f'SUM({d.money("o_totalprice")})')} AS spent
    FROM k JOIN orders o ON o.o_custkey = k.o_custkey AND o_orderdate >= from_m AND o_orderdate < {d.add_months('to_m', 1)}
    WHERE rn = 1 GROUP BY r_name, k.o_custkey, months, from_m, to_m"""


def h06(d: Dialect) -> str:
    """Worst change between consecutive quarters of a supplier, with three lags."""
    q = d.trunc("quarter", "l_shipdate")
    return f"""
    WITH m AS (SELECT l_suppkey, {q} AS q, COUNT(*) AS n, SUM({d.money(NET)}) AS net, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ret FROM lineitem GROUP BY l_suppkey, {q} HAVING COUNT(*) >= 3),
    l AS (SELECT *, LAG(q) OVER w AS q_before, LAG(net) OVER w AS net_before, LAG(ret) OVER w AS ret_before FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY q)),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY net - net_before, q) AS rn FROM l WHERE q = {d.add_months('q_before', 3)})
    SELECT l_suppkey, s_name, q_before, q, {d.real('net_before')} AS net_before, {d.real('net')} AS net, {d.share('net - net_before', 'net_before')} AS change, CAST(ret - ret_before AS BIGINT) AS returns_change
    FROM k JOIN supplier ON l_suppkey = s_suppkey WHERE rn = 1"""


def h07(d: Dialect) -> str:
    """First change of event type of each user, by day, with distinct transitions."""
    return f"""
    WITH l AS (SELECT user_id, event_id, ts, event_type, LAG(event_type) OVER w AS type_before, LAG(ts) OVER w AS ts_before, MIN(ts) OVER (PARTITION BY user_id) AS born FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM l WHERE event_type <> type_before)
    SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n_users, COUNT(DISTINCT type_before || '->' || event_type) AS transitions, MIN({d.days('born', 'ts')}) AS least_days, MAX({d.days('born', 'ts')}) AS most_days
    FROM c WHERE rn = 1 GROUP BY CAST(ts AS DATE)"""


def h08(d: Dialect) -> str:
    """Early and late lines of orders, summed to the order and line before they are joined."""
    return f"""
    WITH q AS (SELECT l_orderkey, l_linenumber, SUM(CAST(l_quantity AS BIGINT)) AS units FROM lineitem GROUP BY l_orderkey, l_linenumber),
    r AS (SELECT l_orderkey, l_linenumber, SUM({d.money(NET)}) AS net, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY l_orderkey, l_linenumber),
    x AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS extra FROM lineitem WHERE l_tax > 0.06 GROUP BY l_orderkey, l_linenumber)
    SELECT o_orderpriority, CASE WHEN q.l_linenumber <= 2 THEN 'early' WHEN q.l_linenumber <= 4 THEN 'middle' ELSE 'late' END AS phase, SUM(q.units) AS units, {d.real('SUM(r.net)')} AS net,
           SUM(r.returned) AS n_returned, SUM(COALESCE(x.extra, 0)) AS n_taxed, {d.share('SUM(r.returned)', 'COUNT(*)')} AS return_rate
    FROM q JOIN r ON q.l_orderkey = r.l_orderkey AND q.l_linenumber = r.l_linenumber LEFT JOIN x ON q.l_orderkey = x.l_orderkey AND q.l_linenumber = x.l_linenumber JOIN orders ON o_orderkey = q.l_orderkey
    GROUP BY o_orderpriority, CASE WHEN q.l_linenumber <= 2 THEN 'early' WHEN q.l_linenumber <= 4 THEN 'middle' ELSE 'late' END"""


def h09(d: Dialect) -> str:
    """Funnel view, click, purchase in that order, in campaigns that are ranges of days, and the uplift against none."""
    return f"""
    WITH campaigns AS (SELECT 'early' AS campaign, '1-10' AS days UNION ALL SELECT 'late', '16-25'),
    ranges AS (SELECT campaign, CAST(substr(days, 1, instr(days, '-') - 1) AS INT) AS lo, CAST(substr(days, instr(days, '-') + 1) AS INT) AS hi FROM campaigns),
    v AS (SELECT user_id, MIN(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id),
    k AS (SELECT v.user_id, v.t AS viewed, MIN(e.ts) AS clicked FROM v LEFT JOIN events e ON e.user_id = v.user_id AND e.event_type = 'click' AND e.ts > v.t GROUP BY v.user_id, v.t),
    p AS (SELECT k.user_id, k.viewed, k.clicked, MIN(e.ts) AS bought FROM k LEFT JOIN events e ON e.user_id = k.user_id AND e.event_type = 'purchase' AND e.ts > k.clicked GROUP BY k.user_id, k.viewed, k.clicked),
    g AS (SELECT COALESCE(campaign, 'none') AS campaign, COUNT(*) AS n_viewed, COUNT(clicked) AS n_clicked, COUNT(bought) AS n_bought FROM p LEFT JOIN ranges ON day(viewed) BETWEEN lo AND hi GROUP BY COALESCE(campaign, 'none'))
    SELECT campaign, n_viewed, n_clicked, n_bought, {d.share('n_bought', 'n_viewed')} AS rate,
           ROUND(CAST(n_bought AS DOUBLE) / NULLIF(n_viewed, 0) - MAX(CASE WHEN campaign = 'none' THEN CAST(n_bought AS DOUBLE) / NULLIF(n_viewed, 0) END) OVER (), 6) AS uplift,
           CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN campaign = 'none' THEN 1 ELSE 0 END, n_bought DESC, campaign) AS INT) AS place FROM g"""


def h10(d: Dialect) -> str:
    """From cumulative to daily counts by event type, and the longest run of days that went down."""
    return f"""
    WITH day_n AS (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE)),
    cum AS (SELECT event_type, day, SUM(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM day_n),
    daily AS (SELECT event_type, day, total - COALESCE(LAG(total) OVER (PARTITION BY event_type ORDER BY day), 0) AS n FROM cum),
    l AS (SELECT *, LAG(n) OVER w AS before, LAG(day) OVER w AS day_before FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)),
    f AS (SELECT *, CASE WHEN n < before AND day = {d.add_days('day_before', 1)} THEN 1 ELSE 0 END AS down FROM l),
    i AS (SELECT *, SUM(1 - down) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
    s AS (SELECT event_type, island, SUM(down) AS run, MIN(day) AS from_day, MAX(day) AS to_day, MAX(n) - MIN(n) AS fall FROM i GROUP BY event_type, island),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY run DESC, fall DESC, from_day) AS rn FROM s)
    SELECT event_type, CAST(run AS INT) AS run, from_day, to_day, CAST(fall AS BIGINT) AS fall FROM k WHERE rn = 1"""


AUTHORED: dict[str, Text] = {f.__name__: f for f in (p01, p02, p03, p04, p05, p06, p07, p08, p09, p10, c01, c02, c03, c04, c05, c06, c07, c08, c09, c10, h01, h02, h03, h04, h05, h06, h07, h08, h09, h10)}
