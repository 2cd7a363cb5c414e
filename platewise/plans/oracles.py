"""The registered queries in DuckDB SQL, written from the definitions and without
the shortcuts of the Spark plans (bit masks, ranges, pre-aggregation)."""

from __future__ import annotations

TS = "'%Y-%m-%d %H:%M:%S.%f'"
END = "DATE '2024-01-20'"

# --- model tables over the sample tables --------------------------------------
FUNNEL_EVENTS = """
funnel_events AS (
    SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
           user_id, ts AS event_ts, event_type AS stage,
           CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END
               AS stage_order,
           value
    FROM events WHERE event_type <> 'error')"""
# Every event; the recorded order is the place in the user's day, which often differs from the stage's.
ALL_EVENTS = """
all_events AS (
    SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_type AS stage,
           CAST(event_id % 4 AS INTEGER) AS stage_order
    FROM events)"""
STAGES = "stages(stage, k) AS (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3))"
USERS = """
users AS (
    SELECT user_id, DATE '2024-01-01' + CAST(user_id % 20 AS INTEGER) AS signup_date
    FROM (SELECT DISTINCT user_id FROM events))"""
EVENT_ORDERS = """
event_orders AS (
    SELECT session_id, user_id, event_ts AS order_ts, value AS order_value
    FROM funnel_events WHERE stage = 'purchase')"""
OPENS = "opens AS (SELECT o_custkey AS user_id, o_orderdate AS event_ts FROM orders)"
SHOP_ORDERS = """
shop_orders AS (
    SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_ts, o_totalprice AS order_value
    FROM orders)"""
DELIVERIES = """
deliveries AS (
    SELECT l_quantity AS time_taken_min, l_quantity <= 30 AS on_time, l_extendedprice / 1000 AS distance_km,
           CAST(l_linenumber AS DOUBLE) AS multiple_deliveries, l_returnflag AS weather, l_linestatus AS festival,
           NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS traffic_density, o_orderstatus AS city_type
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)"""
AB = """
ab AS (
    SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm,
           bool_or(event_type = 'purchase') AS order_placed
    FROM events GROUP BY user_id, CAST(ts AS DATE))"""
# Cleaned straight from the numbers behind the raw text.
CLEANED = """
numbers AS (
    SELECT *, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS line,
           (l_partkey % 24) * 60 + l_suppkey % 60 AS ordered,
           CAST(l_shipdate AS TIMESTAMP) AS day,
           l_orderkey % 101 <> 0 AS dated,
           l_orderkey % 101 <> 0 AND l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AS clocked
    FROM lineitem),
geo AS (
    SELECT *, (ordered + line * 25) % 1440 AS picked,
           radians((1000 + p % 1000) / 100.0) AS lat1,
           radians((1000 + p % 1000 + s % 60) / 100.0) AS lat2,
           radians((o % 3) / 100.0) AS dlon
    FROM numbers),
stamped AS (
    SELECT *,
           CASE WHEN clocked THEN day + to_minutes(ordered) END AS order_datetime,
           CASE WHEN dated THEN day + to_minutes(picked)
               + CASE WHEN clocked AND picked < ordered THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
           END AS pickup_datetime,
           2 * 6371.0 * asin(sqrt(pow(sin((lat2 - lat1) / 2), 2)
               + cos(lat1) * cos(lat2) * pow(sin(dlon / 2), 2))) AS km
    FROM geo),
cleaned AS (
    SELECT CAST(o AS VARCHAR) || '-' || CAST(line AS VARCHAR) AS order_id,
           'DP' || CAST(s AS VARCHAR) AS delivery_person_id,
           CASE WHEN p % 7 <> 0 THEN CAST(18 + p % 40 AS DOUBLE) END AS delivery_person_age,
           CASE WHEN s % 9 <> 0 THEN (s % 50) / 10.0 END AS delivery_person_rating,
           order_datetime, pickup_datetime,
           CASE WHEN line * 25 <= 120 AND clocked THEN CAST(line * 25 AS DOUBLE) END AS prep_time_min,
           CASE WHEN km > 0.05 AND km <= 50 THEN km END AS distance_km,
           CASE WHEN o % 17 <> 0 THEN CASE l_returnflag WHEN 'A' THEN 'Fog' WHEN 'N' THEN 'Sunny' ELSE l_returnflag END
           END AS weather,
           CASE p % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Jam' END
               AS traffic_density,
           CASE WHEN o % 29 <> 0 AND o % 31 <> 0 THEN CAST(line % 4 AS INTEGER) END AS vehicle_condition,
           CASE s % 4 WHEN 0 THEN 'Snack' WHEN 1 THEN 'Meal' WHEN 2 THEN 'Drinks' ELSE 'Buffet' END AS order_type,
           CASE s % 2 WHEN 0 THEN 'motorcycle' ELSE 'scooter' END AS vehicle_type,
           CASE WHEN o % 19 <> 0 THEN CAST(line % 4 AS DOUBLE) END AS multiple_deliveries,
           CASE WHEN o % 50 = 0 THEN 'Yes' WHEN o % 51 = 0 THEN NULL ELSE 'No' END AS festival,
           CASE s % 3 WHEN 0 THEN 'Metropolitian' WHEN 1 THEN 'Urban' ELSE 'Semi-Urban' END AS city_type,
           CASE WHEN o % 23 <> 0 THEN trunc(l_quantity) END AS time_taken_min,
           o % 23 <> 0 AND trunc(l_quantity) <= 30 AS on_time
    FROM stamped)"""


def _round(expression: str, digits: int) -> str:
    """Half-up rounding on the decimal reading of a double, as MySQL and Spark do it."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


def _cents_per(count: str) -> str:
    """The whole cents of a total per head, rounded half up in integers, as money."""
    return f"CAST((2 * cents + {count}) // (2 * {count}) AS DOUBLE) / 100"


PERCENT = _round("100.0 * avg(CAST(on_time AS DOUBLE))", 2)
MINUTES = _round("avg(time_taken_min)", 2)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


# --- funnel ---------------------------------------------------------------------
SESSIONS = """
sessions AS (
    SELECT session_id, min(user_id) AS user_id, min(event_ts) AS start_ts, max(stage_order) AS max_stage_order
    FROM funnel_events GROUP BY session_id),
firsts AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, session_id) AS rn FROM sessions)
    WHERE rn = 1)"""


def _seen_funnel(source: str) -> str:
    return (
        _with(FUNNEL_EVENTS, SESSIONS, STAGES)
        + f"""
, counts AS (
    SELECT stage, k, count(DISTINCT e.session_id) AS sessions
    FROM stages LEFT JOIN (SELECT * FROM funnel_events WHERE session_id IN (SELECT session_id FROM {source})) e
        USING (stage)
    GROUP BY stage, k),
steps AS (
    SELECT stage, k, sessions,
           coalesce(sessions / nullif(lag(sessions) OVER (ORDER BY k), 0), 1.0) AS step,
           sessions / nullif(first_value(sessions) OVER (ORDER BY k), 0) AS top
    FROM counts)
SELECT stage, sessions, step AS conversion_from_prev_stage, 1 - step AS dropoff_from_prev_stage,
       top AS conversion_from_top
FROM steps"""
    )


def _depth_view(view: str, source: str) -> str:
    return f"""
SELECT '{view}' AS funnel_view, stage, CAST(k AS INTEGER) AS stage_order, sessions,
       {_round("sessions / nullif(lag(sessions) OVER (ORDER BY k), 0)", 4)} AS conversion_from_prev_stage,
       {_round("sessions / nullif(first_value(sessions) OVER (ORDER BY k), 0)", 4)} AS conversion_from_top
FROM (SELECT stage, k, count(session_id) AS sessions
      FROM stages LEFT JOIN {source} ON max_stage_order >= k GROUP BY stage, k)"""


# --- retention --------------------------------------------------------------------
DAYS = "days(n) AS (VALUES (1), (7), (14), (30))"
ACTIVE = """
active_days AS (
    SELECT DISTINCT user_id, signup_date, CAST(event_ts AS DATE) - signup_date AS n
    FROM funnel_events JOIN users USING (user_id) WHERE stage = 'view')"""


def _wide(cohort: str) -> str:
    sizes = ", ".join(
        f"nullif(count(*) FILTER (signup_date <= {END} - {n}), 0) AS e{n}" for n in (1, 7, 14, 30)
    )
    active = ", ".join(
        f"count(DISTINCT user_id) FILTER (n = {n} AND signup_date <= {END} - {n}) AS a{n}" for n in (1, 7, 14, 30)
    )
    columns = ", ".join(
        f"coalesce(a{n}, 0) / e{n} AS D{n}_retention, e{n} AS D{n}_eligible_users" for n in (1, 7, 14, 30)
    )
    return (
        _with(FUNNEL_EVENTS, USERS, ACTIVE)
        + f"""
, sizes AS (SELECT {cohort} AS cohort_month, count(*) AS cohort_size, {sizes} FROM users GROUP BY 1),
active AS (SELECT {cohort} AS cohort_month, {active} FROM active_days GROUP BY 1)
SELECT cohort_month, cohort_size, {columns} FROM sizes LEFT JOIN active USING (cohort_month)"""
    )


CURVE = f"""
curve AS (
    SELECT CAST(d AS INTEGER) AS day,
           (SELECT count(DISTINCT user_id) FROM active_days WHERE n = d AND signup_date <= {END} - CAST(d AS INTEGER))
               / (SELECT count(*) FROM users WHERE signup_date <= {END} - CAST(d AS INTEGER)) AS retention,
           (SELECT count(*) FROM users WHERE signup_date <= {END} - CAST(d AS INTEGER)) AS eligible_users
    FROM range(1, 26) AS r(d)
    WHERE (SELECT min(signup_date) FROM users) <= {END} - CAST(d AS INTEGER))"""
POOLED = f"""
pooled AS (
    SELECT n AS day_n,
           (SELECT count(*) FROM users WHERE signup_date <= {END} - n) AS eligible_users,
           (SELECT count(DISTINCT user_id) FROM active_days a WHERE a.n = days.n) AS active_users
    FROM days)"""

# --- growth -----------------------------------------------------------------------
ORDER_MONTHS = """
order_months AS (
    SELECT date_trunc('month', order_ts) AS month, count(*) AS orders, count(DISTINCT user_id) AS ordering_users,
           sum(CAST(order_value AS DECIMAL(18, 4))) AS revenue,
           sum(CAST(round(order_value * 100) AS BIGINT)) AS cents
    FROM shop_orders GROUP BY 1),
repeat_months AS (
    SELECT month, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS repeat_rate
    FROM (SELECT date_trunc('month', order_ts) AS month, user_id, count(*) AS n FROM shop_orders GROUP BY 1, 2)
    GROUP BY 1)"""
ACTIVITY = """
daily AS (SELECT CAST(event_ts AS DATE) AS d, count(DISTINCT user_id) AS dau FROM opens GROUP BY 1),
weekly AS (SELECT date_trunc('week', event_ts) AS w, count(DISTINCT user_id) AS wau FROM opens GROUP BY 1),
monthly AS (SELECT date_trunc('month', event_ts) AS month, count(DISTINCT user_id) AS mau FROM opens GROUP BY 1),
split_weekly AS (
    SELECT date_trunc('month', event_ts) AS month, date_trunc('week', event_ts) AS w, count(DISTINCT user_id) AS wau
    FROM opens GROUP BY 1, 2)"""


# --- delivery ---------------------------------------------------------------------
def _by(key: str) -> str:
    return (
        _with(DELIVERIES)
        + f"""
SELECT {key}, count(*) AS orders, {PERCENT} AS on_time_pct,
       {MINUTES} AS avg_time_taken_min
FROM deliveries WHERE {key} IS NOT NULL GROUP BY {key}"""
    )


LEVEL = """
CASE traffic_density WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END"""
# P(F > f) = 1 - integral of the F density over 0..f, by Simpson's rule on 20000 steps.
F_TAIL = """
density AS (
    SELECT test, i, f / 20000 AS h,
           exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2)
               + (d1 / 2 - 1) * ln(greatest(f * i / 20000, 1e-300))
               - (d1 + d2) / 2 * ln(1 + d1 * f * i / 20000 / d2)) AS y
    FROM f_tests, range(0, 20001) AS r(i)),
-- A two-sided t test: the t density has no pole at 0, unlike F(1, v).
t_density AS (
    SELECT test, i, t / 20000 AS h,
           exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())
               * exp(-(v + 1) / 2 * ln(1 + t * t * i * i / 4e8 / v)) AS y
    FROM t_tests, range(0, 20001) AS r(i)),
tails AS (
    SELECT test, abs(round(1 - sum(h / 3 * y * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END), 6))
               AS p_value
    FROM density GROUP BY test
    UNION ALL
    SELECT test, abs(round(1 - 2 * sum(h / 3 * y * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END), 6))
    FROM t_density GROUP BY test)"""
DELAY_TESTS = f"""
leveled AS (SELECT *, {LEVEL} AS level FROM deliveries),
ranked AS (
    SELECT rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0 AS rx,
           rank() OVER (ORDER BY time_taken_min) + (count(*) OVER (PARTITION BY time_taken_min) - 1) / 2.0 AS ry
    FROM leveled WHERE level IS NOT NULL AND time_taken_min IS NOT NULL),
t_stats AS (
    SELECT 'distance_km vs time_taken_min' AS test, 'Pearson r' AS method,
           corr(distance_km, time_taken_min) AS r, count(*) AS n
    FROM deliveries WHERE distance_km IS NOT NULL AND time_taken_min IS NOT NULL
    UNION ALL
    SELECT 'traffic_density (ordinal) vs time_taken_min', 'Spearman rho', corr(rx, ry), count(*) FROM ranked
    UNION ALL
    SELECT 'multiple_deliveries vs time_taken_min', 'Pearson r', corr(multiple_deliveries, time_taken_min), count(*)
    FROM deliveries WHERE multiple_deliveries IS NOT NULL AND time_taken_min IS NOT NULL),
t_tests AS (
    SELECT test, method, r, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS v FROM t_stats),
weather AS (
    SELECT weather, count(*) AS n, avg(time_taken_min) AS m, var_pop(time_taken_min) AS v
    FROM deliveries WHERE weather IS NOT NULL AND time_taken_min IS NOT NULL GROUP BY weather),
f_tests AS (
    SELECT 'weather vs time_taken_min' AS test, 'One-way ANOVA F' AS method,
           (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f,
           CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2
    FROM weather, (SELECT sum(n * m) / sum(n) AS g FROM weather))"""

# --- experiment -------------------------------------------------------------------
Z_TEST = """
arms AS (
    SELECT CAST(count(*) FILTER (arm = 'control') AS DOUBLE) AS nc,
           CAST(count(*) FILTER (arm = 'control' AND order_placed) AS DOUBLE) AS xc,
           CAST(count(*) FILTER (arm = 'treatment') AS DOUBLE) AS nt,
           CAST(count(*) FILTER (arm = 'treatment' AND order_placed) AS DOUBLE) AS xt
    FROM ab),
rates AS (SELECT *, xc / nc AS pc, xt / nt AS pt, (xc + xt) / (nc + nt) AS pp FROM arms),
tested AS (
    SELECT *, pt - pc AS lift, (pt - pc) / sqrt(pp * (1 - pp) * (1 / nc + 1 / nt)) AS z,
           sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt) AS se
    FROM rates),
chi AS (
    SELECT sum(pow(seen - expected, 2) / expected) AS chi2
    FROM (SELECT unnest([xc, nc - xc, xt, nt - xt]) AS seen,
                 unnest([nc * (xc + xt) / (nc + nt), nc * (nc + nt - xc - xt) / (nc + nt),
                         nt * (xc + xt) / (nc + nt), nt * (nc + nt - xc - xt) / (nc + nt)]) AS expected
          FROM arms))"""


def _zs(x: str, upper: bool) -> str:
    """Zelen & Severo's polynomial tail for a SQL expression."""
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    terms = " + ".join(f"({c}) * pow({t}, {i})" for i, c in enumerate(coefficients, 1))
    tail = f"(exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) * ({terms}))"
    sign = ">=" if upper else "<"
    return f"CASE WHEN {x} {sign} 0 THEN {tail} ELSE 1 - {tail} END"


# Two-sided normal tail: twice the integral of the density over z..z+12, Simpson on 20000 steps.
NORMAL_TAIL = """
normal_tail AS (
    SELECT sum(0.0006 / 3 * 2 * exp(-0.5 * pow(abs(z) + i * 0.0006, 2)) / sqrt(2 * pi())
               * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS p
    FROM tested, range(0, 20001) AS r(i))"""

AB_COUNTS = """CAST(nc AS BIGINT) AS n_control, CAST(nt AS BIGINT) AS n_treatment,
       CAST(xc AS BIGINT) AS conversions_control, CAST(xt AS BIGINT) AS conversions_treatment"""


def _describe(statistic: str, expression: str) -> str:
    columns = ", ".join(
        f"CAST(round({expression.format(c=c)}, 6) AS DOUBLE) AS {c}"
        for c in ("time_taken_min", "distance_km", "prep_time_min")
    )
    return f"SELECT '{statistic}' AS statistic, {columns} FROM cleaned"


ORDER_COLUMNS = (
    "order_id", "delivery_person_id", "delivery_person_age", "delivery_person_rating", "order_datetime",
    "pickup_datetime", "prep_time_min", "distance_km", "weather", "traffic_density", "vehicle_condition",
    "order_type", "vehicle_type", "multiple_deliveries", "festival", "city_type", "time_taken_min", "on_time",
)

ORACLES: dict[str, str] = {
    "session_rollup": _with(FUNNEL_EVENTS, SESSIONS)
    + f"SELECT session_id, user_id, strftime(start_ts, {TS}) AS start_ts, max_stage_order FROM sessions",
    "funnel_first_session": _seen_funnel("firsts"),
    "funnel_blended": _seen_funnel("sessions"),
    "funnel_by_depth": _with(FUNNEL_EVENTS, SESSIONS, STAGES)
    + _depth_view("first_session", "firsts")
    + "\nUNION ALL"
    + _depth_view("blended", "sessions"),
    "cohort_retention_long": _with(FUNNEL_EVENTS, USERS, ACTIVE, DAYS)
    + f"""
, eligible AS (
    SELECT CAST(date_trunc('week', signup_date) AS DATE) AS cohort, n, count(*) AS eligible_users
    FROM users, days WHERE signup_date <= {END} - n GROUP BY 1, 2),
active AS (
    SELECT CAST(date_trunc('week', signup_date) AS DATE) AS cohort, n, count(DISTINCT user_id) AS users
    FROM active_days GROUP BY 1, 2)
SELECT CAST(cohort AS VARCHAR) AS cohort_month, n AS day_n, eligible_users, coalesce(users, 0) AS active_users,
       {_round("coalesce(users, 0) / eligible_users", 4)} AS retention_rate
FROM eligible LEFT JOIN active USING (cohort, n)""",
    "cohort_retention_wide": _wide("CAST(CAST(date_trunc('week', signup_date) AS DATE) AS VARCHAR)"),
    "cohort_retention_by_month": _wide("strftime(signup_date, '%Y-%m')"),
    "retention_curve": _with(FUNNEL_EVENTS, USERS, ACTIVE, CURVE)
    + "SELECT day, retention, eligible_users FROM curve",
    "retention_day_points": _with(FUNNEL_EVENTS, USERS, ACTIVE, CURVE)
    + "SELECT day, retention, eligible_users FROM curve WHERE day IN (1, 7, 14, 30)",
    "retention_powerlaw_fit": _with(FUNNEL_EVENTS, USERS, ACTIVE, CURVE)
    + """
, line AS (
    SELECT regr_slope(ln(retention), ln(day)) AS a, regr_intercept(ln(retention), ln(day)) AS c
    FROM curve WHERE retention > 0)
SELECT day, round(retention, 6) AS retention, eligible_users, round(a, 6) AS slope, round(c, 6) AS intercept,
       round(greatest(exp(c + a * ln(day)), 0.38), 6) AS fitted_retention
FROM curve, line""",
    "pooled_retention": _with(FUNNEL_EVENTS, USERS, ACTIVE, DAYS, POOLED)
    + """SELECT day_n, eligible_users, active_users,
       active_users / nullif(eligible_users, 0) AS retention_rate FROM pooled""",
    "dau": _with(OPENS, ACTIVITY) + "SELECT CAST(d AS VARCHAR) AS activity_date, dau FROM daily",
    "wau": _with(OPENS, ACTIVITY) + "SELECT CAST(CAST(w AS DATE) AS VARCHAR) AS week_start, wau FROM weekly",
    "mau": _with(OPENS, ACTIVITY) + "SELECT CAST(CAST(month AS DATE) AS VARCHAR) AS month, mau FROM monthly",
    "orders_monthly": _with(SHOP_ORDERS, ORDER_MONTHS)
    + f"""SELECT CAST(CAST(month AS DATE) AS VARCHAR) AS month, orders, ordering_users, {_cents_per("orders")} AS aov,
       CAST(revenue AS DOUBLE) AS revenue FROM order_months""",
    "repeat_rate_within_month": _with(SHOP_ORDERS, ORDER_MONTHS)
    + f"""SELECT CAST(CAST(month AS DATE) AS VARCHAR) AS month, {_round("repeat_rate", 4)} AS repeat_order_rate_within_month
FROM repeat_months""",
    "growth_monthly_week_end": _with(OPENS, SHOP_ORDERS, ACTIVITY, ORDER_MONTHS)
    + f"""
, dau_months AS (SELECT date_trunc('month', d) AS month, avg(dau) AS dau FROM daily GROUP BY 1),
wau_months AS (SELECT date_trunc('month', w + INTERVAL 6 DAY) AS month, avg(wau) AS wau FROM weekly GROUP BY 1)
SELECT strftime(month, '%Y-%m') AS month, {_round("dau", 4)} AS DAU_avg, {_round("wau", 4)} AS WAU_avg, mau AS MAU,
       orders, ordering_users, {_round("orders / ordering_users", 4)} AS orders_per_ordering_user,
       {_round("orders / mau", 4)} AS orders_per_MAU, {_round("CAST(revenue AS DOUBLE) / orders", 4)} AS AOV, CAST(revenue AS DOUBLE) AS revenue,
       {_round("CAST(revenue AS DOUBLE) / mau", 4)} AS revenue_per_MAU, {_round("repeat_rate", 4)} AS repeat_order_rate_within_month
FROM monthly LEFT JOIN dau_months USING (month) LEFT JOIN wau_months USING (month)
    LEFT JOIN order_months USING (month) LEFT JOIN repeat_months USING (month)""",
    "growth_monthly_week_split": _with(OPENS, SHOP_ORDERS, ACTIVITY, ORDER_MONTHS)
    + f"""
SELECT CAST(CAST(m.month AS DATE) AS VARCHAR) AS month,
       (SELECT {_round("avg(dau)", 1)} FROM daily WHERE date_trunc('month', d) = m.month) AS dau_avg,
       (SELECT {_round("avg(wau)", 1)} FROM split_weekly s WHERE s.month = m.month) AS wau_avg,
       mau, orders, ordering_users, {_round("orders / ordering_users", 2)} AS orders_per_ordering_user,
       {_round("orders / mau", 2)} AS orders_per_mau, {_cents_per("orders")} AS aov, CAST(revenue AS DOUBLE) AS revenue,
       {_cents_per("mau")} AS revenue_per_mau, {_round("repeat_rate", 4)} AS repeat_order_rate_within_month
FROM monthly m LEFT JOIN order_months o ON o.month = m.month LEFT JOIN repeat_months r ON r.month = m.month""",
    "lifetime_repeat_rate": _with(SHOP_ORDERS)
    + f"""
SELECT {_round("100.0 * avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END)", 2)} AS lifetime_repeat_customer_pct
FROM (SELECT user_id, count(*) AS n FROM shop_orders GROUP BY 1)""",
    "orders_from_events": _with(FUNNEL_EVENTS)
    + f"""
SELECT session_id, user_id, strftime(event_ts, {TS}) AS order_ts,
       round(greatest(least(value * 10, 1400), 120), 2) AS order_value,
       'O' || CAST(99999 + row_number() OVER (
           ORDER BY event_ts, session_id, user_id, greatest(least(value * 10, 1400), 120)) AS VARCHAR) AS order_id
FROM funnel_events WHERE stage = 'purchase'""",
    "delivery_overall": _with(DELIVERIES)
    + f"""
SELECT count(*) AS total_orders, {PERCENT} AS on_time_pct,
       {MINUTES} AS avg_time_taken_min, {_round("median(time_taken_min)", 2)} AS median_time_taken_min
FROM deliveries""",
    "delivery_on_time_share": _with(DELIVERIES)
    + "SELECT avg(CAST(on_time AS DOUBLE)) AS overall_on_time_pct FROM deliveries",
    "delivery_by_traffic": _by("traffic_density"),
    "delivery_by_weather": _by("weather"),
    "delivery_by_city": _by("city_type"),
    "delivery_by_festival": _by("festival"),
    "delivery_by_traffic_fraction": _with(DELIVERIES)
    + """
SELECT traffic_density, count(*) AS orders, avg(CAST(on_time AS DOUBLE)) AS on_time_pct,
       avg(time_taken_min) AS avg_time_taken_min
FROM deliveries WHERE traffic_density IN ('5-LOW', '3-MEDIUM', '2-HIGH') GROUP BY 1""",
    "delay_combos_topk": _with(DELIVERIES)
    + f"""
SELECT traffic_density, weather, count(*) AS orders, {MINUTES} AS avg_time_taken_min,
       {PERCENT} AS on_time_pct
FROM deliveries WHERE traffic_density IS NOT NULL AND weather IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= 30
ORDER BY avg_time_taken_min DESC, traffic_density, weather LIMIT 10""",
    "delay_correlations": _with(DELIVERIES)
    + f"""
, base AS (
    SELECT *, {LEVEL} AS level FROM deliveries
    WHERE distance_km IS NOT NULL AND traffic_density IS NOT NULL AND multiple_deliveries IS NOT NULL)
SELECT round(corr(distance_km, time_taken_min), 4) AS corr_distance_vs_time,
       round(corr(level, time_taken_min), 4) AS corr_traffic_ordinal_vs_time,
       round(corr(multiple_deliveries, time_taken_min), 4) AS corr_multiple_deliveries_vs_time
FROM base""",
    "delay_stats": _with(DELIVERIES, DELAY_TESTS, F_TAIL)
    + """
SELECT test, method, round(r, 6) AS statistic, p_value FROM t_tests JOIN tails USING (test)
UNION ALL
SELECT test, method, round(f, 6), p_value FROM f_tests JOIN tails USING (test)""",
    "ab_ztest": _with(AB, Z_TEST)
    + f"""
, tail AS (SELECT *, 2 * ({_zs("abs(z)", True)}) AS p FROM tested)
SELECT {AB_COUNTS}, round(pc * 100, 2) AS rate_control_pct, round(pt * 100, 2) AS rate_treatment_pct,
       round(lift * 100, 2) AS absolute_lift_pp, round(lift / pc * 100, 2) AS relative_lift_pct,
       round(z, 3) AS z_statistic, round(p, 8) AS p_value_two_sided,
       round((lift - 1.96 * se) * 100, 2) AS ci95_low_pp, round((lift + 1.96 * se) * 100, 2) AS ci95_high_pp,
       CASE WHEN p < 0.05 AND lift - 1.96 * se > 0 THEN 'SHIP' ELSE 'NO-SHIP' END AS decision
FROM tail""",
    "ab_readout": _with(AB, Z_TEST, NORMAL_TAIL)
    + f"""
SELECT {AB_COUNTS}, round(pc, 8) AS rate_control, round(pt, 8) AS rate_treatment,
       round(lift * 100, 8) AS absolute_lift_pp, round(lift / pc * 100, 8) AS relative_lift_pct,
       round(z, 8) AS z_statistic, round(p, 8) AS p_value_ztest, round(chi2, 8) AS chi2_statistic,
       round(p, 8) AS p_value_chi2, round((lift - 1.96 * se) * 100, 8) AS ci95_low_pp,
       round((lift + 1.96 * se) * 100, 8) AS ci95_high_pp,
       CASE WHEN p < 0.05 AND lift - 1.96 * se > 0 THEN 'SHIP' ELSE 'NO-SHIP' END AS decision
FROM tested, chi, normal_tail""",
    "ab_chi2": _with(AB, Z_TEST)
    + """
SELECT round(chi2, 3) AS chi2_statistic,
       CAST(3.841 AS DOUBLE) AS critical_value, chi2 > 3.841 AS significant
FROM chi""",
    "ab_chi2_equals_z2": _with(AB, Z_TEST)
    + """SELECT round(chi2, 6) AS chi2_statistic, round(z * z, 6) AS z_squared, abs(chi2 - z * z) <= 1e-9 * greatest(abs(chi2), z * z, 1) AS agree
FROM tested, chi""",
    "norm_tail_functions": f"""
WITH standard AS (
    SELECT o_orderkey, 3 * (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z
    FROM orders)
SELECT o_orderkey, round({_zs("z", True)}, 8) AS sf, round({_zs("z", False)}, 8) AS cdf FROM standard""",
    "typed_load": f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 37 <> 0 THEN strftime(ts, {TS}) END AS event_ts,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_id % 41 <> 0 THEN value END AS value,
       CASE WHEN event_id % 43 <> 0 AND event_id % 47 <> 0 THEN CAST(event_id % 4 AS INTEGER) END AS stage_order,
       nullif(event_type, 'error') AS stage, event_type = 'purchase' AS purchased
FROM events""",
    "clean_orders": _with(CLEANED)
    + "SELECT "
    + ", ".join(
        f"strftime({c}, {TS}) AS {c}"
        if c.endswith("datetime")
        else f"CAST(round({c}, 6) AS DOUBLE) AS {c}"
        if c == "distance_km"
        else f"CAST({c} AS DOUBLE) AS {c}"
        if c == "delivery_person_rating"
        else c
        for c in ORDER_COLUMNS
    )
    + " FROM cleaned",
    "null_profile": _with(CLEANED)
    + "SELECT column_name, null_rate FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 3) AS null_rate FROM cleaned"
        for c in ORDER_COLUMNS
    )
    + ") ORDER BY null_rate DESC, column_name LIMIT 10",
    "numeric_summary": _with(CLEANED)
    + "\nUNION ALL\n".join(
        _describe(statistic, expression)
        for statistic, expression in (
            ("count", "count({c})"),
            ("mean", "avg({c})"),
            ("std", "stddev_samp({c})"),
            ("min", "min({c})"),
            ("25%", "quantile_cont({c}, 0.25)"),
            ("50%", "quantile_cont({c}, 0.5)"),
            ("75%", "quantile_cont({c}, 0.75)"),
            ("max", "max({c})"),
        )
    ),
    "row_counts": _with(FUNNEL_EVENTS, USERS, EVENT_ORDERS, AB)
    + """
SELECT 'real_orders' AS tbl, count(*) AS rows_loaded FROM lineitem
UNION ALL SELECT 'synthetic_users', count(*) FROM users
UNION ALL SELECT 'synthetic_funnel_events', count(*) FROM funnel_events
UNION ALL SELECT 'synthetic_orders', count(*) FROM event_orders
UNION ALL SELECT 'synthetic_ab_test', count(*) FROM ab""",
    "pk_violations": """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "fk_orphans": """
SELECT o_custkey AS user_id, count(*) AS rows FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) GROUP BY 1""",
    "domain_violations": """
SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value, count(*) AS rows FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY 1, 2
UNION ALL
SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1, 2""",
    "stage_prefix_violations": _with(ALL_EVENTS, STAGES)
    + """
SELECT 'stage_order_mismatch' AS check, count(*) AS violations
FROM all_events LEFT JOIN stages USING (stage) WHERE k IS NULL OR stage_order IS NULL OR k <> stage_order
UNION ALL
SELECT 'incomplete_prefix', count(*)
FROM (SELECT session_id FROM all_events LEFT JOIN stages USING (stage) GROUP BY 1
      HAVING count(DISTINCT k) <> coalesce(max(k) + 1, -1))""",
    "users_without_session": """
SELECT c_custkey AS user_id FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
    "calibration_report": _with(FUNNEL_EVENTS, USERS, EVENT_ORDERS, ACTIVE, DAYS, POOLED, STAGES)
    + f"""
, stage_counts AS (SELECT stage, count(DISTINCT session_id) AS n FROM funnel_events GROUP BY 1),
metrics AS (
    SELECT 'users' AS metric, CAST(count(*) AS DOUBLE) AS value FROM users
    UNION ALL SELECT 'funnel_event_rows', count(*) FROM funnel_events
    UNION ALL SELECT 'orders', count(*) FROM event_orders
    UNION ALL SELECT 'aov_mean', {_cents_per('orders')}
        FROM (SELECT sum(CAST(round(order_value * 100) AS BIGINT)) AS cents, count(*) AS orders FROM event_orders)
    UNION ALL SELECT 'orders_per_ordering_user:' || strftime(order_ts, '%Y-%m'), count(*) / count(DISTINCT user_id)
        FROM event_orders WHERE user_id IN (SELECT user_id FROM users) GROUP BY 1
    UNION ALL SELECT 'sessions:' || stage, coalesce(n, 0) FROM stages LEFT JOIN stage_counts USING (stage)
    UNION ALL SELECT 'overall_conversion', {_round("""
        (SELECT n FROM stage_counts WHERE stage = 'purchase') / (SELECT n FROM stage_counts WHERE stage = 'view')""", 4)}
    UNION ALL SELECT 'D' || CAST(day_n AS VARCHAR) || '_retention', active_users / nullif(eligible_users, 0) FROM pooled)
SELECT metric, value,
       CASE WHEN metric LIKE 'orders_per%' THEN CAST(3.6 AS DOUBLE) END AS low,
       CASE WHEN metric LIKE 'orders_per%' THEN CAST(4.5 AS DOUBLE) END AS high,
       CASE WHEN metric LIKE 'orders_per%' THEN value BETWEEN 3.6 AND 4.5 END AS in_band
FROM metrics""",
    "key_numbers": _with(FUNNEL_EVENTS, SESSIONS, EVENT_ORDERS, AB, Z_TEST, NORMAL_TAIL)
    + """
, first_counts AS (
    SELECT count(DISTINCT session_id) FILTER (stage = 'purchase') AS bought,
           count(DISTINCT session_id) FILTER (stage = 'view') AS opened
    FROM funnel_events WHERE session_id IN (SELECT session_id FROM firsts)),
-- The last month with active users sets the row, even one without orders.
last_month AS (SELECT max(date_trunc('month', event_ts)) AS month FROM funnel_events WHERE stage = 'view')
SELECT (SELECT round(avg(CASE WHEN l_quantity <= 30 THEN 1.0 ELSE 0.0 END) * 100, 1) FROM lineitem) AS on_time_pct,
       (SELECT round(bought / opened * 100, 2) FROM first_counts) AS first_session_conversion_pct,
       (SELECT round(count(*) / nullif(count(DISTINCT user_id), 0), 2)
        FROM event_orders, last_month WHERE date_trunc('month', order_ts) = month)
           AS last_month_orders_per_ordering_user,
       CASE WHEN p < 0.05 AND lift - 1.96 * se > 0 THEN 'SHIP' ELSE 'NO-SHIP' END AS decision,
       round(p, 5) AS p_value
FROM tested, normal_tail""",
}
# the figures from merged states are those of a full run
ORACLES["growth_by_states"] = ORACLES["growth_monthly_week_end"]
ORACLES["approximate_activity"] = _with(OPENS, ACTIVITY) + """
SELECT 'day' AS grain, CAST(d AS VARCHAR) AS period, dau AS exact_users, true AS within_error FROM daily
UNION ALL SELECT 'week', CAST(CAST(w AS DATE) AS VARCHAR), wau, true FROM weekly
UNION ALL SELECT 'month', CAST(CAST(month AS DATE) AS VARCHAR), mau, true FROM monthly"""
ORACLES["constraint_report"] = """
SELECT 'lines' AS tbl, 'primary key (p_key, l_suppkey)' AS "constraint", count(*) AS violations
    FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'primary key (o_orderkey)', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'users', 'primary key (user_id)', 0
UNION ALL SELECT 'orders', 'user_id in users', count(DISTINCT o_custkey) FROM orders
    WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)
UNION ALL SELECT 'orders', 'labels of o_orderpriority, o_orderstatus',
    (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))
    + (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))"""
# what is written and read back is what was there
ORACLES["file_load"] = ORACLES["typed_load"]
ORACLES["scalar_file"] = _with(DELIVERIES) + "SELECT printf('overall_on_time_pct=%.4f', avg(CAST(on_time AS DOUBLE))) AS line FROM deliveries"
ORACLES["months_replaced"] = """
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, count(*) AS orders,
    CASE WHEN year(min(o_orderdate)) = 1995 THEN 0.0::DOUBLE ELSE max(o_totalprice) END AS largest
FROM orders GROUP BY 1"""
