"""DuckDB twins of the registered queries.

They share no code with the operators and use other numeric methods on purpose: composite
Simpson sums for the tails, running sums over a fine grid for the posteriors, window
ranks for the AUC.
"""

from __future__ import annotations

from statistics import NormalDist

from workload.queries import (
    DAYS_RUNNING,
    EXPERIMENTS,
    LOSS_THRESHOLD,
    MDE,
    NUMERIC_FEATURES,
    ORDER_EXPERIMENTS,
)

Z975 = NormalDist().inv_cdf(0.975)


def _z_power(alpha: float = 0.05, power: float = 0.8) -> float:
    """Shift with both tails counted, by fixed-point iteration on the near tail."""
    normal, shift = NormalDist(), 0.0
    critical = normal.inv_cdf(1 - alpha / 2)
    for _ in range(50):
        shift = critical + normal.inv_cdf(power - normal.cdf(-shift - critical))
    return shift


SHIFT = _z_power()


# Numeric building blocks ----------------------------------------------------------------

def simpson(body: str, low: str, high: str, n: int = 2000) -> str:
    """Composite Simpson sum of ``body`` (in x) over [low, high]."""
    terms = (
        f"[(CASE WHEN i = 0 OR i = {n} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
        f" * ({body.replace('<x>', f'(({low}) + (({high}) - ({low})) * i / {n}.0)')})"
        f" FOR i IN range(0, {n + 1})]"
    )
    return f"(list_sum({terms})::DOUBLE * (({high}) - ({low})) / {3 * n}.0)"


def normal_p(z: str) -> str:
    area = simpson(f"exp(-abs({z})::DOUBLE * <x> - <x> * <x> / 2)", "0.0", "14.0")
    return f"(2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {area})"


def student_p(t: str, df: str) -> str:
    body = f"pow(greatest(cos(<x>), 0.0), ({df}) - 1)"
    tail = simpson(body, f"atan(abs({t}) / sqrt({df}))", "pi() / 2")
    whole = simpson(body, "0.0", "pi() / 2")
    return f"({tail} / {whole})"


def student_crit(df: str) -> str:
    """97.5 percent point by its expansion in 1/df (moderate and large df)."""
    z = Z975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = " + ".join(f"{c!r} / pow({df}, {k})" for k, c in enumerate(terms, 1))
    return f"({z!r} + {series})"


def chi2_p(x: str, k: str) -> str:
    """Tail for two or three variants (1 or 2 degrees of freedom)."""
    return (
        f"(CASE WHEN {k} = 1 THEN 1.0 WHEN {k} = 2 THEN {normal_p(f'sqrt({x})')} "
        f"WHEN {k} = 3 THEN exp(-({x}) / 2) END)"
    )


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


# Shared relations -----------------------------------------------------------------------

CLEAN = """
ev AS (
  SELECT ts AS event_time,
         CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
         json_extract_string(props, '$.k') AS product_id,
         'cat_' || (json_extract_string(props, '$.k')::BIGINT % 10)::VARCHAR AS category_code,
         coalesce(value, 0.0) AS price,
         user_id::VARCHAR AS user_id,
         user_id::VARCHAR || '-' || ts::DATE::VARCHAR AS user_session,
         ts::DATE AS date,
         hour(ts)::INTEGER AS hour_of_day
  FROM events
  WHERE event_type IN ('view', 'click', 'cart', 'purchase', 'remove_from_cart')
    AND user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL
)"""

CLEAN_ORDERS = """
ev AS (
  SELECT l_shipdate AS event_time,
         CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'cart' ELSE 'purchase' END AS event_type,
         p_type AS category_code, l_extendedprice AS price, o_custkey::VARCHAR AS user_id,
         l_orderkey::VARCHAR AS user_session, l_shipdate::DATE AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag IN ('N', 'A', 'R')
)"""

def moment(t) -> str:
    return f"TIMESTAMP '{t}'" if t else "NULL::TIMESTAMP"


def exps(experiments) -> str:
    rows = ", ".join(
        f"('{e.experiment_id}', '{e.name}', {e.threshold}, [{', '.join(repr(v) for v in e.variants)}], "
        f"{moment(e.start)}, {moment(e.end)})"
        for e in experiments
    )
    return f"exps AS (SELECT * FROM (VALUES {rows}) AS t(experiment_id, name, threshold, variants, starts, ends))"


EXPS = exps(EXPERIMENTS)


def bucket(user: str, experiment: str) -> str:
    return f"(('0x' || substr(sha256({user} || ':' || {experiment}), 1, 8))::BIGINT % 10000)"


def assign(users: str, name: str = "asg") -> str:
    """``users`` is a query with a user_id column; its other columns are kept."""
    slot = bucket("user_id", "experiment_id")
    return (
        f"{name} AS (SELECT u.*, experiment_id, "
        f"variants[({slot} % len(variants) + 1)::INTEGER] AS variant "
        f"FROM ({users}) u CROSS JOIN exps WHERE {slot} < threshold)"
    )


ASSIGNED = f"{EXPS}, {assign('SELECT DISTINCT user_id FROM ev')}"


INSIDE = "(starts IS NULL OR event_time >= starts) AND (ends IS NULL OR event_time < ends)"


def outcomes(rates: str = INSIDE, money: str = "TRUE") -> str:
    """Per user and experiment; ``rates`` and ``money`` say which events count."""
    return f"""
out AS (
  SELECT user_id, experiment_id,
         count(*) FILTER (WHERE event_type = 'purchase' AND {rates}) AS n_purchases,
         coalesce(sum(price) FILTER (WHERE event_type = 'purchase' AND {money}), 0.0) AS revenue,
         count(*) FILTER (WHERE event_type = 'cart' AND {rates}) AS n_carts
  FROM ev CROSS JOIN exps GROUP BY user_id, experiment_id
)"""


ARM_SELECT = """
  SELECT experiment_id, variant, count(*) AS n_users,
         count(*) FILTER (WHERE n_purchases > 0) AS n_converters,
         count(*) FILTER (WHERE n_carts > 0) AS n_carted,
         avg(revenue) AS mean_revenue, var_samp(revenue) AS var_revenue
  FROM asg JOIN out USING (user_id, experiment_id) GROUP BY experiment_id, variant"""

PAIR_SELECT = """
  SELECT t.experiment_id, c.variant AS control, t.variant,
         c.n_users AS n_c, c.n_converters AS x_c, c.n_carted AS k_c,
         c.mean_revenue AS m_c, c.var_revenue AS v_c,
         t.n_users AS n_t, t.n_converters AS x_t, t.n_carted AS k_t,
         t.mean_revenue AS m_t, t.var_revenue AS v_t
  FROM arms t JOIN arms c ON t.experiment_id = c.experiment_id
  WHERE c.variant = 'control' AND t.variant <> 'control'"""


def arms_ctes(clean: str = CLEAN, rates: str = INSIDE, experiments: str = EXPS) -> str:
    return (
        f"WITH {clean}, {experiments}, {assign('SELECT DISTINCT user_id FROM ev')}, {outcomes(rates)}, "
        f"arms AS ({ARM_SELECT}), pairs AS ({PAIR_SELECT})"
    )


ARMS = arms_ctes()
WHOLE_ARMS = arms_ctes(rates="TRUE")
WHOLE_ORDER_ARMS = arms_ctes(CLEAN_ORDERS, "TRUE")
ORDER_ARMS = arms_ctes(CLEAN_ORDERS, experiments=exps(ORDER_EXPERIMENTS))

DAILY = f"""WITH {CLEAN}, {ASSIGNED},
days AS (SELECT user_id, date, max((event_type = 'purchase')::INTEGER) AS bought
         FROM ev GROUP BY user_id, date),
daily AS (SELECT experiment_id, variant, date, count(*) AS n_active,
                 sum(bought)::BIGINT AS n_purchasers, avg(bought) AS conversion_rate
          FROM days JOIN asg USING (user_id) GROUP BY experiment_id, variant, date)"""


# Queries --------------------------------------------------------------------------------

def features_sql(clean: str, condition: str = "TRUE") -> str:
    """Sessions first: a session of n events counts n times in the event-weighted length, so
    that is the sum of squares over the sum. Days and views are rolled up on their own."""
    when = lambda kind, value: f"sum(CASE WHEN event_type = '{kind}' THEN {value} END)"
    return f"""WITH {clean},
used AS (SELECT * FROM ev WHERE {condition}),
visits AS (SELECT user_id, user_session, count(*) AS n, min(event_time) AS began, max(event_time) AS ended,
                  coalesce({when('view', 1)}, 0) AS views, coalesce({when('cart', 1)}, 0) AS carts,
                  coalesce({when('purchase', 1)}, 0) AS purchases, coalesce({when('purchase', 'price')}, 0) AS paid,
                  {when('view', 'price')} AS seen_price, {when('view', '(price IS NOT NULL)::INTEGER')} AS priced
           FROM used GROUP BY user_id, user_session),
people AS (SELECT user_id, count(user_session) AS total_sessions, sum(views)::BIGINT AS total_views,
                  sum(carts)::BIGINT AS total_carts, sum(purchases)::BIGINT AS total_purchases,
                  sum(paid) AS total_revenue, sum(n) / count(user_session) AS avg_session_length,
                  sum(n * n) / sum(n) AS avg_session_length_event_weighted,
                  coalesce(sum(seen_price) / sum(priced), 0.0) AS avg_price_viewed,
                  min(began) AS first_seen, max(ended) AS last_seen
           FROM visits GROUP BY user_id),
calendar AS (SELECT user_id, count(DISTINCT date) AS days_active FROM used GROUP BY user_id),
liked AS (SELECT user_id, category_code, count(*) AS n FROM used
          WHERE event_type = 'view' AND category_code <> '' GROUP BY user_id, category_code),
most AS (SELECT user_id, max(n) AS n FROM liked GROUP BY user_id),
tastes AS (SELECT user_id, min(category_code) AS favorite_category FROM liked JOIN most USING (user_id, n) GROUP BY user_id),
feat AS (SELECT * FROM people JOIN calendar USING (user_id) LEFT JOIN tastes USING (user_id))"""


FEATURES_SELECT = """
SELECT user_id, total_sessions, total_views, total_carts, total_purchases,
       round(total_revenue, 4) AS total_revenue,
       round(avg_session_length, 6) AS avg_session_length, days_active,
       first_seen, last_seen, favorite_category,
       round(avg_price_viewed + 1e-8, 5) AS avg_price_viewed,
       round(avg_session_length_event_weighted, 6) AS avg_session_length_event_weighted
FROM feat"""


def srm_sql(ctes: str, source: str, counts: str) -> str:
    gap = "(n - e) * (n - e)"
    return f"""{ctes},
counts AS (SELECT experiment_id, variant, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
expected AS (SELECT *, avg(n) OVER (PARTITION BY experiment_id) AS e FROM counts),
stat AS (SELECT experiment_id, count(*) AS k, sum({gap} / (n + e)) AS chi2,
                sum({gap} / e) AS chi2_gof,
                string_agg(variant || '=' || n::BIGINT::VARCHAR, ',' ORDER BY variant) AS actual_counts
         FROM expected GROUP BY experiment_id),
p AS (SELECT *, {chi2_p('chi2', 'k')} AS p_value, {chi2_p('chi2_gof', 'k')} AS p_value_gof FROM stat)
SELECT experiment_id, p_value < 0.01 AS srm_detected, round(p_value, 8) AS p_value,
       round(1.0::DOUBLE / k, 8) AS expected_ratio, {counts}
       round(chi2, 8) AS chi2, p_value_gof < 0.01 AS srm_detected_gof,
       round(p_value_gof, 8) AS p_value_gof, round(chi2_gof, 8) AS chi2_gof
FROM p"""


def z_sql(ctes: str, x: str = "x") -> str:
    return f"""{ctes}, {z_cte(x)}
SELECT experiment_id, control, variant, round(z, 6) AS z_stat, round(p, 8) AS p_value,
       round(CASE WHEN rc > 0 THEN lift / rc ELSE 0.0 END, 8) AS relative_lift,
       round(lift, 8) AS absolute_lift, round(lift - half, 8) AS ci_lower,
       round(lift + half, 8) AS ci_upper, coalesce(p < 0.05, FALSE) AS significant
FROM z{x}"""


def z_cte(x: str) -> str:
    return f"""
rates{x} AS (SELECT *, {x}_c::DOUBLE / n_c AS rc, {x}_t::DOUBLE / n_t AS rt,
                 ({x}_c + {x}_t)::DOUBLE / (n_c + n_t) AS pool FROM pairs),
stat{x} AS (SELECT *, rt - rc AS lift,
         {ratio('rt - rc', 'sqrt(pool * (1 - pool) * (1.0 / n_c + 1.0 / n_t))')} AS z,
         {Z975!r} * sqrt(rc * (1 - rc) / n_c + rt * (1 - rt) / n_t) AS half FROM rates{x}),
z{x} AS (SELECT *, {normal_p('z')} AS p FROM stat{x})"""


T_CTE = f"""
shares AS (SELECT *, v_c / n_c AS s_c, v_t / n_t AS s_t FROM pairs),
tstat AS (SELECT *, m_t - m_c AS diff, sqrt(s_c + s_t) AS se,
                 {ratio('(m_t - m_c)', 'sqrt(s_c + s_t)')} AS t,
                 pow(s_c + s_t, 2) / (s_c * s_c / (n_c - 1) + s_t * s_t / (n_t - 1)) AS df
          FROM shares),
tt AS (SELECT *, {student_p('t', 'df')} AS p,
              {student_crit('(n_c + n_t - 2)')} * se AS half FROM tstat)"""


def t_sql(ctes: str) -> str:
    return f"""{ctes}, {T_CTE}
SELECT experiment_id, control, variant, round(t, 6) AS t_stat, round(p, 6) AS p_value,
       round(diff / sqrt((v_c + v_t) / 2), 6) AS cohens_d, round(diff - half, 4) AS ci_lower,
       round(diff + half, 4) AS ci_upper, p < 0.05 AS significant
FROM tt"""


TESTS = f"""{ARMS}, {z_cte('x')}, {z_cte('k')}, {T_CTE},
tests AS (
  SELECT experiment_id, variant, 'conversion_rate' AS metric, p, lift,
         CASE WHEN rc > 0 THEN lift / rc ELSE 0.0 END AS rel, lift - half AS lo, lift + half AS hi FROM zx
  UNION ALL
  SELECT experiment_id, variant, 'add_to_cart_rate', p, lift,
         CASE WHEN rc > 0 THEN lift / rc ELSE 0.0 END, lift - half, lift + half FROM zk
  UNION ALL
  SELECT experiment_id, variant, 'revenue_per_user', p, NULL, NULL, diff - half, diff + half FROM tt),
ranked AS (SELECT *, count(*) OVER (PARTITION BY experiment_id) AS m,
                  row_number() OVER (PARTITION BY experiment_id
                                     ORDER BY p NULLS LAST, metric, variant) AS r FROM tests),
bh AS (SELECT *, r <= coalesce(max(CASE WHEN p <= r / m * 0.05 THEN r END)
                      OVER (PARTITION BY experiment_id), 0) AS bh,
              coalesce(p <= 0.05 / m, FALSE) AS bonf FROM ranked)"""


def corrections_sql(column: str) -> str:
    return f"""{TESTS}
SELECT experiment_id, variant, metric, round(p, 6) AS p_value,
       coalesce(p < 0.05, FALSE) AS significant, {column} AS significant_corrected FROM bh"""


def required_n(rate: str, mde: str) -> str:
    h = f"(2 * asin(sqrt({rate})) - 2 * asin(sqrt(least({rate} + {mde}, 1.0))))"
    return (
        f"(CASE WHEN {rate} + {mde} <= 1 THEN "
        f"ceil(2 * {SHIFT * SHIFT!r} / ({h} * {h}))::BIGINT END)"
    )


def mde_sql(n_c: str, n_t: str, rate: str) -> str:
    angle = f"(asin(sqrt({rate})) + {SHIFT!r} * sqrt(1.0 / {n_c} + 1.0 / {n_t}) / 2)"
    return f"abs(pow(sin(least({angle}, pi() / 2)), 2) - {rate})", f"({angle} > pi() / 2)"


POWER = f"""{ARMS},
power AS (
  SELECT experiment_id, 'conversion_rate' AS metric, {MDE}::DOUBLE AS mde,
         max(CASE WHEN variant = 'control' THEN n_converters::DOUBLE / n_users END) AS baseline_rate,
         floor(sum(n_users) / count(*))::BIGINT AS current_n_per_variant
  FROM arms GROUP BY experiment_id),
pow AS (SELECT *, {required_n('baseline_rate', str(MDE))} AS required_n_per_variant FROM power)"""

# Posterior densities on one common fine grid per pair, with running sums as cdf.
GRID = 20_000
POSTERIOR = f"""{ARMS},
par AS (SELECT experiment_id, variant, 1.0 + x_c AS a_c, 1.0 + n_c - x_c AS b_c,
               1.0 + x_t AS a_t, 1.0 + n_t - x_t AS b_t FROM pairs),
mom AS (SELECT *, a_c / (a_c + b_c) AS mc, a_t / (a_t + b_t) AS mt,
               sqrt(a_c * b_c / (pow(a_c + b_c, 2) * (a_c + b_c + 1))) AS sc,
               sqrt(a_t * b_t / (pow(a_t + b_t, 2) * (a_t + b_t + 1))) AS st FROM par)"""
POSTERIOR_GRID = f"""{POSTERIOR},
rng AS (SELECT *, greatest(least(mc - 12 * sc, mt - 12 * st), 0.0) AS lo,
               least(greatest(mc + 12 * sc, mt + 12 * st), 1.0) AS hi FROM mom),
grid AS (SELECT *, lo + (hi - lo) * (i + 0.5) / {GRID} AS x, (hi - lo) / {GRID} AS h
         FROM rng CROSS JOIN range(0, {GRID}) AS g(i)),
raw AS (SELECT *,
         exp(a_c * ln(x) - ln(x) + (b_c - 1) * ln(1 - x)
             - (a_c - 1) * ln(mc) - (b_c - 1) * ln(1 - mc)) AS gc,
         exp(a_t * ln(x) - ln(x) + (b_t - 1) * ln(1 - x)
             - (a_t - 1) * ln(mt) - (b_t - 1) * ln(1 - mt)) AS gt FROM grid),
den AS (SELECT *, gc / sum(gc) OVER w AS fc, gt / sum(gt) OVER w AS ft
        FROM raw WINDOW w AS (PARTITION BY experiment_id, variant)),
cdf AS (SELECT *, sum(fc) OVER w - fc / 2 AS cc, sum(ft) OVER w - ft / 2 AS ct
        FROM den WINDOW w AS (PARTITION BY experiment_id, variant ORDER BY i))"""


def density(x: str, a: str, b: str) -> str:
    return (
        f"(CASE WHEN {x} > 0 AND {x} < 1 THEN exp(({a} - 1) * ln(greatest({x}, 1e-300)) "
        f"+ ({b} - 1) * ln(greatest(1 - {x}, 1e-300)) "
        f"+ lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) ELSE 0.0 END)"
    )


WEIGHTED = features_sql(CLEAN) + f""", {ASSIGNED}, {outcomes()},
lab AS (SELECT experiment_id, user_id, (variant <> 'control')::INTEGER AS treatment,
               {', '.join(f'{c}::DOUBLE AS {c}' for c in NUMERIC_FEATURES)},
               coalesce(favorite_category, 'unknown') AS favorite_category
        FROM asg JOIN feat USING (user_id)),
prop AS (SELECT *, (total_carts + 1) / (total_carts + total_views + 2) AS propensity FROM lab),
wu AS (SELECT p.*, least(greatest(1 / CASE WHEN treatment = 1 THEN propensity
                                          ELSE 1 - propensity END, 0.1), 10.0) AS weight,
              (n_purchases > 0)::INTEGER AS converted, revenue
       FROM prop p JOIN out USING (user_id, experiment_id))"""

MOMENTS = f"""{WEIGHTED},
mean AS (SELECT experiment_id, treatment, sum(weight) AS w,
                sum(weight * revenue) / sum(weight) AS mu FROM wu GROUP BY ALL),
ss AS (SELECT experiment_id, treatment, w, mu, sum(weight * pow(revenue - mu, 2)) AS s
       FROM wu JOIN mean USING (experiment_id, treatment) GROUP BY ALL),
mo AS (SELECT t.experiment_id, t.w AS w_t, t.mu AS mu_t, t.s AS s_t, t.s / (t.w - 1) AS v_t,
              c.w AS w_c, c.mu AS mu_c, c.s / (c.w - 1) AS v_c
       FROM ss t JOIN ss c ON t.experiment_id = c.experiment_id
       WHERE t.treatment = 1 AND c.treatment = 0)"""


# Folds in md5 order, and the treated share of each category with and without the fold.
CATEGORY_SCORES = f"""{WEIGHTED},
dealt AS (SELECT *, (row_number() OVER (PARTITION BY experiment_id, treatment
                                        ORDER BY ('0x' || substr(md5(user_id), 1, 15))::BIGINT, user_id) - 1) % 5 AS fold FROM wu),
scored AS (SELECT a.*,
    (SELECT avg(b.treatment) FROM dealt b WHERE b.experiment_id = a.experiment_id
       AND b.favorite_category = a.favorite_category) AS chance,
    coalesce((SELECT avg(b.treatment) FROM dealt b WHERE b.experiment_id = a.experiment_id
                AND b.favorite_category = a.favorite_category AND b.fold <> a.fold),
             (SELECT avg(b.treatment) FROM dealt b WHERE b.experiment_id = a.experiment_id AND b.fold <> a.fold)) AS held_out
    FROM dealt a),
couples AS (SELECT t.experiment_id, t.fold,
    avg(CASE WHEN t.held_out > c.held_out THEN 1.0 WHEN t.held_out = c.held_out THEN 0.5 ELSE 0.0 END) AS auc
    FROM scored t JOIN scored c ON t.experiment_id = c.experiment_id AND t.fold = c.fold
    WHERE t.treatment = 1 AND c.treatment = 0 GROUP BY ALL),
cv AS (SELECT experiment_id, CASE WHEN count(*) = 5 THEN avg(auc) END AS cv_auc FROM couples GROUP BY experiment_id),
shares AS (SELECT *, least(greatest(coalesce(1 / nullif(CASE WHEN treatment = 1 THEN chance ELSE 1 - chance END, 0), 10.0), 0.1), 10.0) AS v
           FROM scored),
lifts AS (SELECT experiment_id,
    sum(v * converted) FILTER (WHERE treatment = 1) / sum(v) FILTER (WHERE treatment = 1)
    - sum(v * converted) FILTER (WHERE treatment = 0) / sum(v) FILTER (WHERE treatment = 0) AS adjusted,
    avg(converted) FILTER (WHERE treatment = 1) - avg(converted) FILTER (WHERE treatment = 0) AS raw
    FROM shares GROUP BY experiment_id)"""


def weighted_t_sql(t: str, df: str) -> str:
    return f"""{MOMENTS},
st AS (SELECT *, mu_t - mu_c AS diff, {t} AS t, {df} AS df,
              {Z975!r} * sqrt(v_t / w_t + v_c / w_c) AS half FROM mo),
pv AS (SELECT *, {student_p('t', 'df')} AS p FROM st)
SELECT experiment_id, round(t, 6) AS t_stat, round(p, 6) AS p_value,
       round(diff / sqrt((v_t + v_c) / 2), 6) AS cohens_d, round(diff - half, 5) AS ci_lower,
       round(diff + half, 5) AS ci_upper, p < 0.05 AS significant FROM pv"""


_MDE_C, _CAP_C = mde_sql("n_c", "n_t", "(x_c::DOUBLE / n_c)")
_BASE = "(CASE WHEN x_c > 0 THEN x_c::DOUBLE / n_c ELSE 0.05 END)"
_MDE_B, _CAP_B = mde_sql("n_c", "n_t", "base")


def all_oracles() -> dict[str, str]:
    cards = """SELECT experiment_id, variant, n_users,
        round(n_converters::DOUBLE / n_users, 8) AS conversion_rate,
        round(mean_revenue, {digits}) AS mean_revenue,
        round(n_carted::DOUBLE / n_users, 8) AS add_to_cart_rate FROM arms"""
    smd = " UNION ALL ".join(
        f"""SELECT experiment_id, '{c}' AS covariate,
            abs(avg({c}) FILTER (WHERE treatment = 1) - avg({c}) FILTER (WHERE treatment = 0)) AS raw,
            abs(sum(weight * {c}) FILTER (WHERE treatment = 1) / sum(weight) FILTER (WHERE treatment = 1)
              - sum(weight * {c}) FILTER (WHERE treatment = 0) / sum(weight) FILTER (WHERE treatment = 0)) AS adj,
            sqrt((var_samp({c}) FILTER (WHERE treatment = 1)
                + var_samp({c}) FILTER (WHERE treatment = 0)) / 2) AS sd
            FROM wu GROUP BY experiment_id"""
        for c in NUMERIC_FEATURES
    )
    variant_rows = "(SELECT experiment_id, name, unnest(variants) AS variant FROM exps)"
    found = {
        "clean_events": f"WITH {CLEAN} SELECT * FROM ev",
        "cleaning_report": """SELECT CASE
              WHEN user_id IS NULL OR json_extract_string(props, '$.k') IS NULL THEN 'missing_key'
              WHEN event_type IN ('view', 'click', 'cart', 'purchase', 'remove_from_cart') THEN 'kept'
              ELSE 'invalid_event_type' END AS reason, count(*) AS n_rows
            FROM events GROUP BY 1""",
        "events_table": f"""WITH {CLEAN} SELECT date, event_type, count(*) AS n_events,
              count(DISTINCT user_id) AS n_users, round(sum(price), 4) AS total_price
            FROM ev GROUP BY date, event_type""",
        "raw_event_files": f"""WITH {CLEAN}, cells AS (
              SELECT * REPLACE (CASE WHEN product_id = '17' THEN NULL ELSE event_time END AS event_time,
                                CASE WHEN product_id = '13' THEN 0.0 ELSE price END AS price,
                                CASE WHEN product_id = '17' THEN NULL ELSE date END AS date,
                                CASE WHEN product_id = '17' THEN NULL ELSE hour_of_day END AS hour_of_day) FROM ev)
            SELECT * FROM cells""",
        "stored_assignments": f"WITH {CLEAN}, {ASSIGNED} SELECT user_id, experiment_id, variant FROM asg",
        "stored_features": features_sql(CLEAN_ORDERS) + FEATURES_SELECT,
        "user_features": features_sql(CLEAN) + FEATURES_SELECT,
        "user_features_orders": features_sql(CLEAN_ORDERS) + FEATURES_SELECT,
        "user_features_as_of": features_sql(CLEAN, "date < DATE '2024-01-16'") + FEATURES_SELECT,
        "favorite_category": f"""WITH {CLEAN}, n AS (
              SELECT user_id, category_code, count(*) AS n_views FROM ev
              WHERE event_type = 'view' GROUP BY ALL)
            SELECT user_id, arg_min(category_code, (-n_views, category_code)) AS favorite_category,
                   max(n_views) AS n_views FROM n GROUP BY user_id""",
        "assign_users": f"WITH {CLEAN}, {ASSIGNED} SELECT user_id, experiment_id, variant FROM asg",
        "assign_variant": f"""WITH b AS (SELECT c_custkey::VARCHAR AS user_id,
              {bucket('c_custkey::VARCHAR', "'exp_C'")} AS c, {bucket('c_custkey::VARCHAR', "'exp_D'")} AS d
            FROM customer)
            SELECT user_id,
              CASE c % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'layout_a' ELSE 'layout_b' END AS exp_c_variant,
              CASE WHEN d >= 5699 THEN NULL WHEN d % 2 = 0 THEN 'control' ELSE 'treatment' END AS exp_d_variant
            FROM b""",
        "resolved_assignments": f"WITH {CLEAN}, {ASSIGNED} SELECT user_id, experiment_id, variant FROM asg",
        "assignment_summary": f"""WITH {CLEAN}, {ASSIGNED}
            SELECT v.experiment_id, v.name, v.variant, count(a.user_id) AS n_users
            FROM {variant_rows} v LEFT JOIN asg a USING (experiment_id, variant) GROUP BY ALL""",
        "experiment_listing": f"""WITH {CLEAN}, {ASSIGNED}
            SELECT e.experiment_id, e.name, 'running' AS status, count(DISTINCT a.user_id) AS n_users
            FROM exps e LEFT JOIN asg a USING (experiment_id) GROUP BY ALL""",
        "stop_experiment": f"""WITH {CLEAN}, {ASSIGNED}
            SELECT e.experiment_id,
                   CASE WHEN e.experiment_id = 'exp_B' THEN 'stopped' ELSE 'running' END AS status,
                   e.experiment_id = 'exp_B' AS has_ended, count(DISTINCT a.user_id) AS n_users
            FROM exps e LEFT JOIN asg a USING (experiment_id) GROUP BY ALL""",
        "srm_check": srm_sql(f"WITH {CLEAN}, {ASSIGNED}", "asg", "actual_counts,"),
        "srm_orders": srm_sql(
            f"""WITH {EXPS}, {assign("SELECT DISTINCT o_custkey::VARCHAR AS user_id, o_orderpriority FROM orders")},
            seg AS (SELECT experiment_id || '/' || o_orderpriority AS experiment_id, variant FROM asg)""",
            "seg", ""),
        "insert_if_absent": f"""WITH {EXPS},
            u AS (SELECT c_custkey::VARCHAR AS user_id, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer
                  UNION SELECT o_custkey::VARCHAR, TRUE FROM orders),
            b AS (SELECT *, {bucket('user_id', 'experiment_id')} AS slot FROM u CROSS JOIN exps)
            SELECT user_id, experiment_id,
                   variants[CASE WHEN known THEN slot % len(variants) + 1 ELSE len(variants) - slot % len(variants) END::INTEGER] AS variant
            FROM b WHERE slot < threshold""",
        "conversion_rate": f"""{ARMS} SELECT experiment_id, variant, n_users, n_converters,
            round(n_converters::DOUBLE / n_users, 8) AS conversion_rate FROM arms""",
        "revenue_per_user": f"""{WHOLE_ARMS} SELECT experiment_id, variant, n_users,
            round(mean_revenue, 6) AS mean_revenue,
            round(coalesce(sqrt(var_revenue), 0.0), 6) AS std_revenue FROM arms""",
        "add_to_cart_rate": f"""{WHOLE_ARMS} SELECT experiment_id, variant, n_users, n_carted,
            round(n_carted::DOUBLE / n_users, 8) AS add_to_cart_rate FROM arms""",
        "windowed_outcomes": f"""WITH {CLEAN}, {ASSIGNED}, {outcomes(money=INSIDE)}
            SELECT user_id, experiment_id, variant, n_purchases, round(revenue, 4) AS revenue, n_carts
            FROM asg JOIN out USING (user_id, experiment_id)""",
        "all_metrics": f"{ARMS} {cards.format(digits=6)}",
        "all_metrics_orders": f"{ORDER_ARMS} {cards.format(digits=4)}",
        "segment_metrics": f"""{ORDER_ARMS}
            SELECT c_mktsegment AS segment, experiment_id, variant, count(*) AS n_users,
                   count(*) FILTER (WHERE n_purchases > 0) AS n_converters,
                   round(avg(revenue), 4) AS mean_revenue
            FROM asg JOIN out USING (user_id, experiment_id) JOIN customer ON c_custkey::VARCHAR = user_id
            GROUP BY ALL""",
        "arm_sufficient_stats": f"""{WHOLE_ARMS} SELECT experiment_id, control, variant,
            n_c AS control_n_users, x_c AS control_n_converters, round(m_c, 6) AS control_mean_revenue,
            round(v_c, 4) AS control_var_revenue, n_t AS treatment_n_users,
            x_t AS treatment_n_converters, round(m_t, 6) AS treatment_mean_revenue,
            round(v_t, 4) AS treatment_var_revenue FROM pairs""",
        "daily_conversion": f"""{DAILY} SELECT experiment_id, variant, date, n_active, n_purchasers,
            round(conversion_rate, 8) AS conversion_rate FROM daily""",
        "z_test": z_sql(ARMS),
        "z_test_orders": z_sql(ORDER_ARMS),
        "welch_t_test": t_sql(WHOLE_ARMS),
        "welch_t_test_orders": t_sql(WHOLE_ORDER_ARMS),
        "novelty": f"""{DAILY},
            num AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, variant ORDER BY date) AS d
                    FROM daily WHERE variant <> 'control'),
            part AS (SELECT experiment_id, variant, count(*) AS n_days,
                7.0 AS n_a, avg(conversion_rate) FILTER (WHERE d <= 7) AS m_a,
                var_samp(conversion_rate) FILTER (WHERE d <= 7) / 7 AS s_a,
                count(*) - 7.0 AS n_b, avg(conversion_rate) FILTER (WHERE d > 7) AS m_b,
                var_samp(conversion_rate) FILTER (WHERE d > 7) / (count(*) - 7) AS s_b
                FROM num GROUP BY ALL),
            st AS (SELECT *, (m_a - m_b) / sqrt(s_a + s_b) AS t,
                pow(s_a + s_b, 2) / (s_a * s_a / 6 + s_b * s_b / (n_b - 1)) AS df FROM part),
            pv AS (SELECT *, CASE WHEN t > 0 THEN {student_p('t', 'df')} / 2 ELSE 1.0 END AS p FROM st)
            SELECT experiment_id, variant, p < 0.05 AS novelty_detected, round(p, 6) AS p_value,
                round(m_a, 8) AS early_mean, round(m_b, 8) AS post_early_mean,
                round(t, 6) AS t_stat, n_days FROM pv""",
        "corrections_bh": corrections_sql("bh"),
        "corrections_bonferroni": corrections_sql("bonf"),
        "corrections_daily": f"""{DAILY},
            z AS (SELECT *, (n_purchasers - n_active / 2.0) / sqrt(n_active / 4.0) AS z FROM daily),
            p AS (SELECT date, experiment_id, variant, {normal_p('z')} AS p FROM z),
            r AS (SELECT *, count(*) OVER (PARTITION BY date) AS m,
                row_number() OVER (PARTITION BY date ORDER BY p, experiment_id, variant) AS r FROM p)
            SELECT date, experiment_id, variant, round(p, 8) AS p_value,
                r <= coalesce(max(CASE WHEN p <= r / m * 0.05 THEN r END)
                              OVER (PARTITION BY date), 0) AS bh,
                p <= 0.05 / m AS bonferroni FROM r""",
        "corrections_summary": f"""{TESTS} SELECT experiment_id,
            count(*) FILTER (WHERE bh) AS n_rejected, count(*) AS n_tests FROM bh GROUP BY 1""",
        "mde": f"""{ARMS} SELECT experiment_id, variant, round({_MDE_C}, 8) AS mde,
            {_CAP_C} AS mde_capped FROM pairs""",
        "required_n": f"""{ARMS}, r AS (SELECT *, n_converters::DOUBLE / n_users AS rate FROM arms)
            SELECT experiment_id, variant, {required_n('rate', str(MDE))} AS required_n FROM r""",
        "power_analysis": f"""{POWER} SELECT experiment_id, metric, mde,
            round(baseline_rate, 8) AS baseline_rate, required_n_per_variant,
            current_n_per_variant FROM pow""",
        "sample_size_block": f"""{ARMS}, b AS (SELECT *, {_BASE} AS base FROM pairs),
            m AS (SELECT *, {_MDE_B} AS effect, {_CAP_B} AS cap FROM b)
            SELECT experiment_id, variant, round(base, 8) AS baseline_rate,
                floor((n_c + n_t) / 2)::BIGINT AS current_n_per_variant,
                round(effect, 8) AS minimum_detectable_effect, cap AS mde_capped,
                {required_n('base', 'greatest(effect, 0.001)')} AS required_n_for_80pct_power FROM m""",
        "mde_curve": f"""{POWER}, c AS (
              SELECT experiment_id, CASE WHEN baseline_rate > 0 THEN baseline_rate ELSE 0.05 END AS base,
                     i::INTEGER AS step, 0.005::DOUBLE + i * 0.005::DOUBLE AS mde
              FROM pow CROSS JOIN range(0, 40) AS g(i))
            SELECT experiment_id, round(base, 8) AS baseline_rate, step, round(mde, 8) AS mde,
                   {required_n('base', 'mde')} AS required_n FROM c""",
        "days_to_significance": f"""{POWER} SELECT experiment_id, metric, mde,
            round(baseline_rate, 8) AS baseline_rate, required_n_per_variant, current_n_per_variant,
            round(least(current_n_per_variant / greatest(required_n_per_variant, 1) * 100, 100.0), 6)
              AS pct_of_required,
            current_n_per_variant >= required_n_per_variant AS has_power,
            ceil(greatest(required_n_per_variant - current_n_per_variant, 0)
                 / (current_n_per_variant / {DAYS_RUNNING}.0::DOUBLE))::BIGINT AS days_left FROM pow""",
        "posterior_params": f"""{POSTERIOR} SELECT experiment_id, variant,
            a_c::DOUBLE AS control_alpha, b_c::DOUBLE AS control_beta,
            a_t::DOUBLE AS treatment_alpha, b_t::DOUBLE AS treatment_beta FROM par""",
        "prob_treatment_better": f"""{POSTERIOR_GRID} SELECT experiment_id, variant,
            round(sum(ft * cc), 6) AS probability_treatment_better FROM cdf GROUP BY ALL""",
        # E[max(c - t, k)] = k + integral of P(c - t > u) over u > k; with u = 0 by parts.
        "expected_loss": f"""{POSTERIOR_GRID},
            shifted AS (SELECT *, least(greatest((x - {LOSS_THRESHOLD} - lo) / h - 0.5, 0.0), {GRID - 1}.0) AS pos
                        FROM cdf),
            low AS (SELECT s.experiment_id, s.variant, s.h, s.cc,
                           g.ct + (s.pos - floor(s.pos)) * (coalesce(g2.ct, g.ct) - g.ct) AS ct_low,
                           s.x - {LOSS_THRESHOLD} > s.lo AS inside
                    FROM shifted s
                    JOIN cdf g ON g.experiment_id = s.experiment_id AND g.variant = s.variant
                              AND g.i = floor(s.pos)::BIGINT
                    LEFT JOIN cdf g2 ON g2.experiment_id = s.experiment_id AND g2.variant = s.variant
                              AND g2.i = floor(s.pos)::BIGINT + 1),
            above AS (SELECT experiment_id, variant,
                             {LOSS_THRESHOLD} + sum(CASE WHEN inside THEN ct_low ELSE 0 END * (1 - cc) * h) AS loss
                      FROM low GROUP BY ALL),
            zero AS (SELECT experiment_id, variant, sum(ct * (1 - cc) * h) AS loss FROM cdf GROUP BY ALL)
            SELECT experiment_id, variant, round(zero.loss, 6) AS expected_loss,
                   round(above.loss, 6) AS expected_loss_above_threshold
            FROM zero JOIN above USING (experiment_id, variant)""",
        "posterior_density": f"""{POSTERIOR},
            g AS (SELECT *, least(mc - 4 * sc, mt - 4 * st) - 0.005 AS x0,
                         greatest(mc + 4 * sc, mt + 4 * st) + 0.005 AS x1 FROM mom),
            pts AS (SELECT *, i::INTEGER AS point, x0 + (x1 - x0) * i / 299.0::DOUBLE AS x
                    FROM g CROSS JOIN range(0, 300) AS r(i))
            SELECT experiment_id, variant, point, round(x, 8) AS x,
                   round({density('x', 'a_c', 'b_c')}, 5) AS control_density,
                   round({density('x', 'a_t', 'b_t')}, 5) AS treatment_density FROM pts""",
        # The difference's density at many points d by a midpoint sum over the control's rate; the
        # interval of equal density at both ends that holds 95 percent, by interpolation.
        "hdi": f"""{POSTERIOR},
            xs AS (SELECT *, mc - 12 * sc + 24 * sc * (i + 0.5) / 400 AS x FROM mom CROSS JOIN range(0, 400) AS g(i)),
            wc AS (SELECT *, {density('x', 'a_c', 'b_c')} AS fc FROM xs),
            ds AS (SELECT *, mt - mc + 16 * sqrt(sc * sc + st * st) * (j / 6000.0::DOUBLE - 0.5) AS d
                   FROM wc CROSS JOIN range(0, 6001) AS g(j)),
            fd AS (SELECT experiment_id, variant, j, any_value(d) AS d, sum(fc * {density('(x + d)', 'a_t', 'b_t')}) AS f
                   FROM ds GROUP BY experiment_id, variant, j),
            cum AS (SELECT *, (sum(f) OVER w - f / 2) / sum(f) OVER (PARTITION BY experiment_id, variant) AS c
                    FROM fd WINDOW w AS (PARTITION BY experiment_id, variant ORDER BY j)),
            ups AS (SELECT *, lead(d) OVER w AS d2, lead(f) OVER w AS f2, lead(c) OVER w AS c2
                    FROM cum WINDOW w AS (PARTITION BY experiment_id, variant ORDER BY j)),
            runs AS (SELECT a.experiment_id, a.variant, a.j, a.d, a.f,
                            b.d + (b.d2 - b.d) * (a.c + 0.95 - b.c) / (b.c2 - b.c) AS up,
                            b.f + (b.f2 - b.f) * (a.c + 0.95 - b.c) / (b.c2 - b.c) AS fu
                     FROM (SELECT * FROM ups WHERE c < 0.05) a JOIN ups b
                       ON a.experiment_id = b.experiment_id AND a.variant = b.variant
                      AND a.c + 0.95 >= b.c AND a.c + 0.95 < b.c2),
            turn AS (SELECT *, f - fu AS g, lead(f - fu) OVER w AS g2, lead(d) OVER w AS d2, lead(up) OVER w AS up2
                     FROM runs WINDOW w AS (PARTITION BY experiment_id, variant ORDER BY j))
            SELECT experiment_id, variant, round(d + (d2 - d) * g / (g - g2), 4) AS credible_interval_lower,
                   round(up + (up2 - up) * g / (g - g2), 4) AS credible_interval_upper
            FROM turn WHERE g < 0 AND g2 >= 0""",
        # Normal scores from a fine table of the normal distribution, one Newton step from its entries.
        "rhat": f"""{WHOLE_ARMS},
            norm AS (SELECT i, -7 + i / 10000.0::DOUBLE AS x, exp(-pow(-7 + i / 10000.0::DOUBLE, 2) / 2) / sqrt(2 * pi()) AS f
                     FROM range(0, 140001) AS g(i)),
            cdf AS (SELECT x, f, (sum(f) OVER (ORDER BY i) - f / 2) / 10000 + 1.279812544e-12 AS c FROM norm),
            users AS (SELECT experiment_id, variant, user_id, revenue FROM asg JOIN out USING (user_id, experiment_id)),
            placed AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, variant
                                   ORDER BY ('0x' || substr(md5(user_id), 1, 15))::BIGINT, user_id) - 1 AS pos,
                              rank() OVER (PARTITION BY experiment_id, variant ORDER BY revenue)
                              + (count(*) OVER (PARTITION BY experiment_id, variant, revenue) - 1) / 2.0::DOUBLE AS rk,
                              count(*) OVER (PARTITION BY experiment_id, variant) AS n FROM users),
            chance AS (SELECT *, (rk - 0.375) / (n + 0.25) AS p, pos % 4 AS chain, pos // 4 AS draw, n // 4 // 2 AS half FROM placed),
            scored AS (SELECT t.*, x + (p - c) / f AS z FROM chance t ASOF JOIN cdf ON t.p >= cdf.c),
            kept AS (SELECT *, draw >= half AS second, draw % half AS place, floor(sqrt(half))::BIGINT AS width
                     FROM scored WHERE draw < 2 * half),
            halves AS (SELECT experiment_id, variant, any_value(half) AS half, avg(z) AS m, var_samp(z) AS v
                       FROM kept GROUP BY experiment_id, variant, chain, second),
            whole AS (SELECT experiment_id, variant, any_value(half) AS half, (any_value(half) * count(*))::BIGINT AS n,
                             avg(v) AS w, (any_value(half) - 1) / any_value(half) * avg(v) + var_samp(m) AS pooled
                      FROM halves GROUP BY experiment_id, variant),
            blocks AS (SELECT experiment_id, variant, avg(z) AS m, count(*) AS k, any_value(width) AS width
                       FROM kept GROUP BY experiment_id, variant, chain, second, place // width),
            spread AS (SELECT experiment_id, variant, var_samp(m) * any_value(width) AS s FROM blocks
                       WHERE k = width GROUP BY experiment_id, variant)
            SELECT experiment_id, variant, n AS n_draws, round(sqrt(pooled / w), 6) AS rhat,
                   round(n * pooled / s, 4) AS effective_size, sqrt(pooled / w) < 1.1 AS converged
            FROM whole JOIN spread USING (experiment_id, variant)""",
        "propensity_training_set": f"""{WEIGHTED} SELECT experiment_id, user_id, treatment,
            total_sessions, round(total_revenue, 4) AS total_revenue, days_active,
            round(avg_price_viewed + 1e-8, 5) AS avg_price_viewed, total_views, total_carts, total_purchases,
            round(avg_session_length, 6) AS avg_session_length, favorite_category FROM lab""",
        "ipw_weights": f"""{WEIGHTED} SELECT experiment_id, user_id, treatment,
            round(propensity, 8) AS propensity, round(weight, 8) AS weight FROM wu""",
        "ipw_conversion": f"""{WEIGHTED}, r AS (SELECT experiment_id,
              sum(weight * converted) FILTER (WHERE treatment = 0) / sum(weight) FILTER (WHERE treatment = 0) AS c,
              sum(weight * converted) FILTER (WHERE treatment = 1) / sum(weight) FILTER (WHERE treatment = 1) AS t,
              avg(converted) FILTER (WHERE treatment = 1) - avg(converted) FILTER (WHERE treatment = 0) AS raw
            FROM wu GROUP BY experiment_id)
            SELECT experiment_id, round(c, 8) AS control, round(t, 8) AS treatment,
                   round(t - c, 8) AS adjusted_lift, round(raw, 8) AS unadjusted_lift,
                   round(abs(t - c - raw), 8) AS adjustment_magnitude,
                   abs(t - c - raw) > 0.01 AS adjustment_warning FROM r""",
        "ipw_t_test": weighted_t_sql("(mu_t - mu_c) / (sqrt(s_t / w_t) / sqrt(w_t - 1))", "w_t - 1"),
        "ipw_two_sample_t_test": weighted_t_sql(
            "(mu_t - mu_c) / sqrt(v_t / w_t + v_c / w_c)",
            "pow(v_t / w_t + v_c / w_c, 2) / (pow(v_t / w_t, 2) / (w_t - 1) + pow(v_c / w_c, 2) / (w_c - 1))",
        ),
        "covariate_balance": f"""{WEIGHTED}, s AS ({smd})
            SELECT experiment_id, covariate,
                   round(CASE WHEN sd = 0 THEN 0.0 ELSE raw / sd END, 6) AS smd_before,
                   round(CASE WHEN sd = 0 THEN 0.0 ELSE adj / sd END, 6) AS smd_after,
                   CASE WHEN sd = 0 THEN 0.0 ELSE adj / sd END < 0.1 AS balanced_after FROM s""",
        "rank_auc": f"""{WEIGHTED},
            r AS (SELECT experiment_id, treatment,
                rank() OVER (PARTITION BY experiment_id ORDER BY propensity)
                + (count(*) OVER (PARTITION BY experiment_id, propensity) - 1) / 2.0 AS rk FROM wu),
            a AS (SELECT experiment_id, sum(treatment)::BIGINT AS n1, (count(*) - sum(treatment))::BIGINT AS n0,
                sum(rk * treatment) AS r1 FROM r GROUP BY experiment_id),
            v AS (SELECT *, ((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0)::DOUBLE)::DOUBLE AS auc FROM a)
            SELECT experiment_id, round(auc, 8) AS auc, n1 AS n_treated, n0 AS n_control,
                   auc > 0.6 AS imbalance_detected FROM v""",
        "stratified_folds": f"""WITH {CLEAN_ORDERS}, {ASSIGNED},
            n AS (SELECT experiment_id, (variant <> 'control')::INTEGER AS treatment, count(*) AS n
                  FROM asg GROUP BY ALL)
            SELECT experiment_id, treatment, f::INTEGER AS fold, ((n + 4 - f) // 5)::BIGINT AS n_rows
            FROM n CROSS JOIN range(0, 5) AS g(f) WHERE (n + 4 - f) // 5 > 0""",
        "ipw_by_category": f"""{CATEGORY_SCORES}
            SELECT experiment_id, round(cv_auc, 8) AS cv_auc, coalesce(cv_auc > 0.6, FALSE) AS imbalance_detected,
                   round(abs(adjusted - raw), 8) AS adjustment_magnitude, round(raw, 8) AS unadjusted_lift,
                   round(adjusted, 8) AS adjusted_lift FROM lifts JOIN cv USING (experiment_id)""",
        "propensity_score_equations": f"""{WEIGHTED}
            SELECT DISTINCT experiment_id, 'category ' || favorite_category AS input, 0.0::DOUBLE AS residual FROM lab
            UNION ALL SELECT DISTINCT experiment_id, unnest([{', '.join(repr(c) for c in NUMERIC_FEATURES)}]), 0.0::DOUBLE FROM lab""",
        "latest_results": f"""{DAILY},
            o AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, variant ORDER BY date DESC) AS rn
                  FROM daily)
            SELECT experiment_id, experiment_id || '_' || variant AS variant_id,
                   'conversion_rate' AS metric_name, round(conversion_rate, 8) AS value,
                   date AS computed_at FROM o WHERE rn = 1""",
        "result_rows": f"""{TESTS},
            vals AS (
              SELECT experiment_id, variant, 'conversion_rate' AS metric_name, n_converters::DOUBLE / n_users AS v FROM arms
              UNION ALL SELECT experiment_id, variant, 'revenue_per_user', mean_revenue FROM arms
              UNION ALL SELECT experiment_id, variant, 'add_to_cart_rate', n_carted::DOUBLE / n_users FROM arms),
            own AS (SELECT experiment_id, variant, metric, lo, hi, p FROM tests
              UNION ALL
              SELECT experiment_id, 'control', metric, arg_min(lo, variant), arg_min(hi, variant),
                     arg_min(p, variant) FROM tests GROUP BY experiment_id, metric)
            SELECT v.experiment_id, v.variant, v.metric_name, round(v.v, 6) AS value,
                   round(lo, 4) AS ci_lower, round(hi, 4) AS ci_upper, round(p, 6) AS p_value
            FROM vals v LEFT JOIN own o ON o.experiment_id = v.experiment_id
                 AND o.variant = v.variant AND o.metric = v.metric_name""",
        "analyze_tests": f"""{TESTS},
            cnt AS (SELECT experiment_id, n_users::DOUBLE AS n,
                           avg(n_users) OVER (PARTITION BY experiment_id) AS e FROM arms),
            stat AS (SELECT experiment_id, count(*) AS k, sum((n - e) * (n - e) / (n + e)) AS chi2
                     FROM cnt GROUP BY experiment_id)
            SELECT experiment_id, exps.name, round({chi2_p('chi2', 'k')}, 8) AS srm_p_value,
                   k::INTEGER AS n_variants, (k - 1)::INTEGER AS n_sizings,
                   (k - 1)::INTEGER AS n_posteriors, metric, variant, round(p, 6) AS p_value,
                   coalesce(p < 0.05, FALSE) AS significant, bh AS significant_corrected,
                   round(lift, 8) AS absolute_lift, round(rel, 8) AS relative_lift,
                   round(lo, 4) AS ci_lower, round(hi, 4) AS ci_upper
            FROM bh JOIN stat USING (experiment_id) JOIN exps USING (experiment_id)""",
        "decision_view": f"""{TESTS},
            cnt AS (SELECT experiment_id, n_users::DOUBLE AS n,
                           avg(n_users) OVER (PARTITION BY experiment_id) AS e FROM arms),
            stat AS (SELECT experiment_id, count(*) AS k, sum((n - e) * (n - e) / (n + e)) AS chi2
                     FROM cnt GROUP BY experiment_id),
            srm AS (SELECT experiment_id, {chi2_p('chi2', 'k')} < 0.01 AS bad FROM stat)
            SELECT experiment_id, variant, metric,
              CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', p) END AS p_value_text,
              coalesce(printf('%+.1f', lift * 100) || '%', 'N/A') AS absolute_lift_text,
              coalesce(printf('%+.1f', rel * 100) || '%', 'N/A') AS relative_lift_text,
              coalesce('[' || printf('%+.4f', lo) || ', ' || printf('%+.4f', hi) || ']', 'N/A') AS ci_text,
              CASE WHEN bh THEN '✅ Significant (BH)' ELSE '❌ Not significant' END AS significance,
              CASE WHEN bad THEN 'red' ELSE 'green' END AS srm_color,
              -- display texts (fixed values)
              CASE WHEN bad THEN '⚠️ Sample Ratio Mismatch detected! Randomization may be broken. Do NOT act on these results.'
                   ELSE '✅ No Sample Ratio Mismatch — randomization looks correct.' END AS srm_message
            FROM bh JOIN srm USING (experiment_id)""",
    }

    def part(name: str, source: str, numbers: list[str], place: str = "variant") -> str:
        rows = ", ".join(f"{{'name': '{n}', 'value': {n}::DOUBLE}}" for n in numbers)
        return (
            f"SELECT experiment_id, '{name}' AS part, place, n.name AS name, n.value AS value "
            f"FROM (SELECT experiment_id, {place} AS place, unnest([{rows}]) AS n FROM ({found[source]}))"
        )

    found["stored_results"] = (
        "SELECT experiment_id, experiment_id || '_' || variant AS variant_id, metric_name, value, ci_lower, ci_upper, p_value "
        f"FROM ({found['result_rows']})"
    )
    found["analyze_parts"] = " UNION ALL ".join([
        part("variants", "all_metrics", ["n_users", "conversion_rate", "mean_revenue", "add_to_cart_rate"]),
        part("frequentist", "analyze_tests", ["p_value"], "metric || ' ' || variant"),
        part("bayesian", "prob_treatment_better", ["probability_treatment_better"]),
        part("bayesian", "expected_loss", ["expected_loss"]),
        part("bayesian", "hdi", ["credible_interval_lower", "credible_interval_upper"]),
        part("sample_size_analysis", "sample_size_block",
             ["baseline_rate", "current_n_per_variant", "minimum_detectable_effect", "required_n_for_80pct_power"]),
        part("novelty_check", "novelty", ["p_value", "early_mean", "post_early_mean"]),
        part("propensity", "ipw_by_category", ["cv_auc", "adjustment_magnitude", "unadjusted_lift", "adjusted_lift"], "''"),
        part("srm_check", "srm_check", ["p_value", "expected_ratio"], "''"),
    ])
    return found
