"""The queries of :mod:`trialkit.plans.queries` as SQL over the same tables, for checking results."""

from __future__ import annotations

from collections.abc import Sequence

# Fixed values, written out here and not taken from the package, so that a wrong one there shows up.
# Hart's rational approximation of the normal tail, as printed by West (2005):
TAIL_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
)
TAIL_SPLIT, TAIL_FAR, TAIL_ROOT_2PI = 7.07106781186547, 37, 2.506628274631
# round breaks: bias towards larger units and towards five, shrinkage without a range, slack on breaks and bins
UNIT_BIAS, UNIT_BIAS_FIVE, SHRINK, BREAK_SLACK, BIN_SLACK = 1.5, 2.75, 0.75, 1e-10, 1e-7
# normal-reference bandwidth, and the cells' reach in bandwidths
BANDWIDTH_FACTOR, BANDWIDTH_IQR, MARGIN = 0.9, 1.34, 4

ITEMS = range(1, 8)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def r(expr: str, name: str | None = None) -> str:
    """Rounded as the queries round; adding zero turns −0 into 0."""
    text = f"round(({expr}) * 1048576) / 1048576 + 0.0"
    return text if name is None else f'{text} AS "{name}"'


SECONDS = """seconds AS (
  SELECT l_suppkey AS condition_idx, l_orderkey AS trial_idx, CAST(l_linenumber AS BIGINT) AS item_idx,
         CAST(l_linenumber AS BIGINT) AS rank_idx, l_extendedprice / 1000 AS rt
  FROM lineitem)"""

STEPS = """steps AS (
  SELECT event_id, user_id, event_type, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS t_us,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type IN ('purchase', 'signup') THEN -1 ELSE 1 END
           AS signed_cents
  FROM events)"""


def aic(y: str, x: str) -> str:
    rss = f"(regr_syy({y}, {x}) - power(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x}))"
    n = f"regr_count({y}, {x})"
    return f"{n} * (ln(2 * pi() * {rss} / {n}) + 1) + 6"


def draw(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _horner(coefficients: Sequence[float]) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * x + {c!r})"
    return text


def _summaries() -> dict[str, str]:
    cell = {
        "rt_mean": "m",
        "rt_quantiles_10%": "q1",
        "rt_quantiles_50%": "q5",
        "rt_quantiles_90%": "q9",
    }
    wide = ",\n  ".join(
        r(f"max(CASE WHEN item_idx = {i} THEN {c} END)", f"{name}_item_idx_{i}") for name, c in cell.items() for i in ITEMS
    )
    quantiles = "quantile_cont(rt, 0.1) AS q1, quantile_cont(rt, 0.5) AS q5, quantile_cont(rt, 0.9) AS q9"
    flagship = f"""WITH {SECONDS},
a AS (SELECT condition_idx, avg(rt) AS m, {quantiles}, regr_intercept(rt, item_idx) AS b0,
        regr_slope(rt, item_idx) AS b1, {aic("rt", "item_idx")} AS aic FROM seconds GROUP BY 1),
b AS (SELECT condition_idx, item_idx, avg(rt) AS m, {quantiles} FROM seconds GROUP BY 1, 2),
w AS (SELECT condition_idx, {wide} FROM b GROUP BY 1)
SELECT condition_idx, {r("m", "rt_mean")}, {r("q1", "rt_quantiles_10%")}, {r("q5", "rt_quantiles_50%")},
  {r("q9", "rt_quantiles_90%")}, {r("b0", "lm_coef_(Intercept)")}, {r("b1", "lm_coef_item_idx")},
  {r("aic", "aic")}, w.* EXCLUDE (condition_idx)
FROM a FULL JOIN w USING (condition_idx)"""
    plain = f"""WITH {SECONDS}
SELECT condition_idx, item_idx, count(*) AS n, {r("avg(rt)", "rt_mean")}, {r("stddev_samp(rt)", "rt_sd")},
  {r("quantile_cont(rt, 0.5)", "rt_median")}, {r("first(rt ORDER BY trial_idx, rt)", "rt_first")}
FROM seconds GROUP BY 1, 2"""
    overall = f"""WITH {SECONDS}
SELECT count(*) AS n, {r("avg(rt)", "rt_mean")}, {r("stddev_samp(rt)", "rt_sd")},
  {r("quantile_cont(rt, 0.025)", "rt_quantiles_2.5%")}, {r("quantile_cont(rt, 0.5)", "rt_quantiles_50%")},
  {r("quantile_cont(rt, 0.975)", "rt_quantiles_97.5%")},
  {", ".join(r(f"max(CASE WHEN item_idx = {i} THEN rt END)", f"item_idx_{i}") for i in ITEMS)}
FROM seconds"""
    single = f"""SELECT user_id, {", ".join(
        r(f"avg(CASE WHEN event_type = '{e}' THEN value END)", f"event_type_{e}") for e in EVENT_TYPES)}
FROM events GROUP BY 1"""
    cells = [(f, t) for f in ("A", "N", "R") for t in (0, 1, 2)]
    def cond(f, t):
        return f"l_returnflag = '{f}' AND round(l_tax * 100 / 4) = {t}"
    two = f"""SELECT l_suppkey, {", ".join(
        f'nullif(count(*) FILTER ({cond(f, t)}), 0) AS "n_l_returnflag_{f}_tax_{t}"' for f, t in cells)},
  {", ".join(r(f"sum(l_quantity) FILTER ({cond(f, t)})", f"quantity_l_returnflag_{f}_tax_{t}") for f, t in cells)}
FROM lineitem GROUP BY 1"""
    vectors = f"""WITH {SECONDS}
SELECT condition_idx, {r("min(rt)", "range_X1")}, {r("max(rt)", "range_X2")}, {r("avg(rt)", "moments_mean")},
  {r("stddev_samp(rt)", "moments_sd")}, count(*) AS "listed_X1", {r("sum(rt)", "alone")}
FROM seconds GROUP BY 1"""
    joined = f"""WITH a AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS cust, avg(o_totalprice / 1000) AS m,
    count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey + 10 END AS cust, avg(c_acctbal) AS m FROM customer GROUP BY 1)
SELECT coalesce(a.cust, b.cust) AS cust, {r("a.m", "mean.x")}, a.n AS n, {r("b.m", "mean.y")}
FROM a FULL JOIN b ON a.cust IS NOT DISTINCT FROM b.cust"""
    complete = f"""WITH c AS (SELECT l_partkey AS condition_idx, l_linenumber AS item_idx,
    avg(l_extendedprice / 1000) AS m, stddev_samp(l_extendedprice / 1000) AS s
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
w AS (SELECT condition_idx, {", ".join(f"max(CASE WHEN item_idx = {i} THEN m END) AS m{i}, max(CASE WHEN item_idx = {i} THEN s END) AS s{i}" for i in ITEMS)}
  FROM c GROUP BY 1)
SELECT condition_idx, {", ".join(r(f"m{i}", f"rt_mean_item_idx_{i}") for i in ITEMS)},
  {", ".join(r(f"s{i}", f"rt_sd_item_idx_{i}") for i in ITEMS)}
FROM w WHERE {" AND ".join(f"m{i} IS NOT NULL AND s{i} IS NOT NULL" for i in ITEMS)}"""
    lm = f"""SELECT l_partkey, {r("regr_intercept(rt, l_quantity)", "lm_coef_(Intercept)")},
  {r("regr_slope(rt, l_quantity)", "lm_coef_l_quantity")}, {r("avg(rt)", "flat_coef_(Intercept)")},
  CAST(NULL AS DOUBLE) AS "flat_coef_flat", {r(aic("rt", "l_quantity"), "aic")}
FROM (SELECT *, l_extendedprice / 1000 AS rt FROM lineitem) GROUP BY 1"""
    strict = f"""WITH v AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS rt
  FROM lineitem)
SELECT l_orderkey, {r("avg(rt)", "loose")}, {r("CASE WHEN count(*) = count(rt) THEN avg(rt) END", "strict")},
  {r("CASE WHEN count(*) = count(rt) THEN stddev_samp(rt) END", "strict_sd")},
  {r("CASE WHEN count(*) = count(rt) THEN quantile_cont(rt, 0.5) END", "strict_median")}
FROM v GROUP BY 1"""
    shares = f"""WITH {STEPS}
SELECT user_id, {r("avg(CASE WHEN signed_cents > 0 THEN 1.0 ELSE 0.0 END)", "upper")},
  {r("avg(CASE WHEN signed_cents > 0 THEN 0.0 ELSE 1.0 END)", "lower")}, {r("1 - count(*) / 1000.0", "omitted")}
FROM steps GROUP BY 1"""
    bind = f"""WITH {SECONDS}
SELECT condition_idx, {r("avg(rt)", "rt_mean")}, CAST(NULL AS DOUBLE) AS rt_sd, CAST(NULL AS BIGINT) AS n
FROM seconds GROUP BY 1
UNION ALL
SELECT condition_idx, CAST(NULL AS DOUBLE), {r("stddev_samp(rt)")}, count(*) FROM seconds GROUP BY 1"""
    custom = f"""WITH {SECONDS}
SELECT condition_idx, {r("avg(rt)", "rt_mean")}, {r("quantile_cont(rt, 0.5)", "rt_median")}, {r("max(rt) - min(rt)", "width")},
  {r("quantile_cont(rt, 0.25)", "low")}, {r("quantile_cont(rt, 0.75)", "high")}, count(*) AS n FROM seconds GROUP BY 1"""
    given = f"""SELECT user_id, {", ".join(r(f"avg(CASE WHEN event_type = '{e}' THEN value END)", f"event_type_{e}") for e in ("view", "click"))}
FROM events GROUP BY 1"""
    streamed = f"""WITH {SECONDS}
SELECT condition_idx, item_idx, count(*) AS n, {r("avg(rt)", "rt_mean")}, {r("stddev_samp(rt)", "rt_sd")} FROM seconds GROUP BY 1, 2"""
    return {
        "summary_custom": custom,
        "summary_pivot_given": given,
        "summary_stream": streamed,
        "summary_stream_kept": streamed,
        "summary_flagship": flagship,
        "summary_plain": plain,
        "summary_global": overall,
        "summary_pivot_single": single,
        "summary_pivot_two_keys": two,
        "summary_vectors": vectors,
        "summary_join": joined,
        "summary_complete": complete,
        "lm_aic_by_group": lm,
        "strict_mean": strict,
        "response_shares": shares,
        "bind_summaries": bind,
    }


def _columns() -> dict[str, str]:
    sums = f"count(*) AS n, {r('sum(rt)', 'rt_sum')}"
    broken = f"""{SECONDS},
broken AS (SELECT condition_idx, trial_idx, item_idx, CASE item_idx WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN -rt
    WHEN 4 THEN 0 WHEN 5 THEN 'inf'::DOUBLE ELSE rt END AS rt FROM seconds)"""
    return {
        "valid_times": f"""WITH {broken}
SELECT condition_idx, trial_idx, item_idx, {r("rt", "rt")} FROM broken WHERE isfinite(rt) AND rt > 0""",
        "finite_values": f"""WITH {broken}
SELECT condition_idx, item_idx, {sums} FROM broken WHERE isfinite(rt) GROUP BY 1, 2""",
        "complete_cases": f"""WITH {broken}
SELECT condition_idx, item_idx, {sums} FROM broken WHERE rt IS NOT NULL AND NOT isnan(rt) GROUP BY 1, 2""",
        "formula_columns": f"""SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS p_size, {r("p_retailprice", "p_retailprice")},
  {r("sqrt(p_retailprice * 0.9) + 3", "a")}, {r("p_retailprice * 0.9 + p_size", "b")},
  {r("(p_retailprice * 0.9 + p_size) / (p_size * 2)", "c")}, CAST(3 AS BIGINT) AS k
FROM part""",
        "recycled_column": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 WHEN 2 THEN 3.5
  ELSE 4.5 END::DOUBLE AS four, 7.0::DOUBLE AS one FROM part""",
        "seeded_draws": f"""SELECT p_partkey, {r("1 + 9 * " + draw("u", "p_partkey"), "u")},
  {r(f"p_size + (100 - p_size) * {draw('v', 'p_partkey', 'p_size')}", "v")},
  {r(f"2 + 0.5 * (sqrt(-2 * ln({draw('n/r', 'p_partkey')})) * cos(2 * pi() * {draw('n/a', 'p_partkey')}))", "n")}
FROM part""",
        "design_table": f"""WITH c AS (SELECT p_partkey + 1 AS condition_idx FROM part),
d AS (SELECT condition_idx, 1 + 4 * {draw("beta_0", "condition_idx")} AS beta_0,
    -0.5 + 0.49 * {draw("beta_1", "condition_idx")} AS beta_1,
    CAST(ceil(condition_idx / 50.0) AS BIGINT) AS chunk_idx FROM c),
t AS (SELECT d.*, trial_idx, {draw("shift", "condition_idx", "trial_idx")} AS shift
  FROM d CROSS JOIN range(1, 4) AS s(trial_idx))
SELECT condition_idx, {r("beta_0", "beta_0")}, {r("beta_1", "beta_1")}, chunk_idx, trial_idx, {r("shift", "shift")},
  item_idx, {r("beta_0 + item_idx * beta_1 + shift", "v")}
FROM t CROSS JOIN range(1, 3) AS i(item_idx)""",
        "scalar_functions": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  {r("ln(l_extendedprice)", "log_p")}, {r("exp(-l_quantity / 10)", "exp_q")}, {r("sqrt(l_extendedprice)", "sqrt_p")},
  {r("abs(l_quantity - 25)", "abs_q")}, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS ceil_p,
  CAST(floor(l_quantity / 7) AS BIGINT) AS int_div, l_orderkey % 7 AS mod_o,
  {r("greatest(l_quantity, l_extendedprice / 1000)", "hi")}, {r("least(l_quantity, l_extendedprice / 1000)", "lo")},
  printf('%.3f', sqrt(l_extendedprice)) AS three, printf('%.4f', ln(l_extendedprice)) AS four,
  'item_' || l_linenumber AS label, lpad(CAST(l_linenumber AS VARCHAR), 5, '0') AS padded,
  CAST(l_linenumber AS BIGINT) AS steps, CAST(1 AS BIGINT) AS distinct_n,
  {r("list_sort([l_quantity, 20.0::DOUBLE, 30.0::DOUBLE])[2]", "middle")},
  CAST(l_linenumber AS DOUBLE) AS as_double
FROM lineitem""",
    }


def _sources() -> dict[str, str]:
    nested = """slots AS (SELECT vec_id, label, i, j, CAST(embedding[CAST(i * 8 + j AS BIGINT)] AS DOUBLE) AS rt
  FROM embeddings CROSS JOIN range(0, 8) AS a(i) CROSS JOIN range(1, 9) AS b(j))"""
    whole = f"""WITH {SECONDS}
SELECT condition_idx + 1 AS condition_idx, trial_idx, item_idx, {r("rt", "rt")},
  CAST(ceil((condition_idx + 1) / 50.0) AS BIGINT) AS chunk_idx FROM seconds"""
    return {
        "results_round_trip": whole,
        "results_resumed": whole,
        "summary_states": f"""WITH {SECONDS},
moved AS (SELECT item_idx, condition_idx + 1 AS condition_idx, rt FROM seconds)
SELECT item_idx, count(*) AS n, {r("avg(rt)", "rt_mean")}, {r("stddev_samp(rt)", "rt_sd")}, {r("min(rt)", "rt_min")},
  {r("max(rt)", "rt_max")}, {r("regr_intercept(rt, condition_idx)", "lm_(Intercept)")},
  {r("regr_slope(rt, condition_idx)", "lm_condition_idx")}, {r(aic("rt", "condition_idx"), "lm_aic")},
  {", ".join(r(f"quantile_cont(rt, {p})", f"rt_quantiles_{n}%") for p, n in ((0.1, 10), (0.5, 50), (0.9, 90)))}
FROM moved GROUP BY 1""",
        "results_by_parameters": f"""{whole}
WHERE condition_idx + 1 BETWEEN 5 AND 60
  AND condition_idx IN (SELECT s_suppkey FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000)""",
        "results_conditions": f"""SELECT s_suppkey + 1 AS condition_idx, {r("s_acctbal", "balance")},
  CAST(ceil((s_suppkey + 1) / 50.0) AS BIGINT) AS chunk_idx FROM supplier""",
        "partition_read": f"""WITH {SECONDS}
SELECT condition_idx + 1 AS condition_idx, trial_idx, item_idx, {r("rt", "rt")} FROM seconds WHERE condition_idx + 1 <= 50""",
        "results_chunks": "SELECT DISTINCT CAST(ceil((l_suppkey + 1) / 50.0) AS BIGINT) AS chunk_idx FROM lineitem",
        "observed_ranks": f"""SELECT l_suppkey AS condition_idx, l_orderkey AS trial_idx,
  CAST(l_linenumber AS BIGINT) AS item_idx, {r("l_extendedprice / 1000", "rt")}, 'observed' AS model,
  row_number() OVER (PARTITION BY l_suppkey, l_orderkey
    ORDER BY l_extendedprice / 1000, l_linenumber, l_partkey, l_quantity) AS rank_idx
FROM lineitem""",
        "observed_codes": """WITH v AS (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority FROM orders),
c AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS code
  FROM (SELECT DISTINCT o_orderpriority FROM v WHERE o_orderpriority IS NOT NULL))
SELECT o_orderkey, o_orderpriority, code FROM v LEFT JOIN c ON o_orderpriority = p""",
        "flatten_nested": f"""WITH {nested}
SELECT 'vectors' AS model, vec_id AS condition_idx, i + 1 AS trial_idx,
  row_number() OVER (PARTITION BY vec_id, i ORDER BY j) AS rank_idx, j AS item_idx, {r("rt", "rt")},
  {r("(i + label) * 0.5", "drift")}, {r("i * 0.25", "ndt")}
FROM slots WHERE rt > 0.1""",
        "flatten_models": f"""WITH {nested}
SELECT CASE WHEN vec_id % 2 = 1 THEN 'gains' ELSE 'vectors' END AS model, vec_id AS condition_idx, i + 1 AS trial_idx,
  row_number() OVER (PARTITION BY vec_id, i ORDER BY j) AS rank_idx, j AS item_idx, {r("rt", "rt")},
  {r("(i + label) * 0.5", "drift")}, CASE WHEN vec_id % 2 = 0 THEN {r("i * 0.25")} END AS ndt,
  CASE WHEN vec_id % 2 = 1 THEN {r("vec_id * 2.0::DOUBLE")} END AS gain,
  CASE WHEN vec_id % 2 = 1 THEN (i + label) * 0.5 > 2 END AS strong
FROM slots WHERE rt > 0.1""",
        "nested_counts": f"""WITH {nested}
SELECT vec_id AS condition_idx, count(*) FILTER (rt > 0.1) AS responses FROM slots GROUP BY 1""",
    }


def _trim() -> dict[str, str]:
    far = "(x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65)))))"
    cells = f"""WITH {SECONDS},
g AS (SELECT condition_idx, rank_idx, count(*) AS n, list(rt ORDER BY rt) AS xs FROM seconds WHERE rt > 0 GROUP BY 1, 2),
h AS (SELECT condition_idx, rank_idx, n, xs, CAST(i AS DOUBLE) / 100 AS trim, (n - 1) * (CAST(100 - i AS DOUBLE) / 100) AS h
  FROM g CROSS JOIN range(0, 21) AS t(i)),
q AS (SELECT condition_idx, rank_idx, trim,
    CASE WHEN h = floor(h) OR xs[CAST(floor(h) AS BIGINT) + 1] = xs[CAST(floor(h) AS BIGINT) + 2]
      THEN xs[CAST(floor(h) AS BIGINT) + 1]
      ELSE (floor(h) + 1 - h) * xs[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) * xs[CAST(floor(h) AS BIGINT) + 2] END AS q
  FROM h),
kept AS (SELECT q.condition_idx, q.rank_idx, trim, q, rt,
    row_number() OVER (PARTITION BY q.condition_idx, q.rank_idx, trim ORDER BY rt) AS i
  FROM q JOIN seconds s ON s.condition_idx = q.condition_idx AND s.rank_idx = q.rank_idx AND rt > 0 AND rt < q),
fit AS (SELECT condition_idx, rank_idx, trim, max(q) AS q_upper, avg(ln(rt)) AS mu, stddev_samp(ln(rt)) AS sd, count(*) AS n
  FROM kept GROUP BY 1, 2, 3 HAVING count(*) >= 2),
z AS (SELECT kept.*, mu, sd, n, q_upper, CASE WHEN sd > 0 THEN (ln(rt) - mu) / sd END AS z
  FROM kept JOIN fit USING (condition_idx, rank_idx, trim)),
e AS (SELECT *, abs(z) AS x, exp(-abs(z) * abs(z) / 2) AS e FROM z),
tail AS (SELECT *, CASE WHEN x > {TAIL_FAR} THEN 0
    WHEN x < {TAIL_SPLIT} THEN e * {_horner(TAIL_NUMERATOR)} / {_horner(TAIL_DENOMINATOR)}
    ELSE e / {far} / {TAIL_ROOT_2PI} END AS tail FROM e),
cells AS (SELECT condition_idx, rank_idx, trim, max(mu) AS mu_hat, max(sd) AS sigma_hat,
    max(greatest(CASE WHEN z > 0 THEN 1 - tail ELSE tail END - (i - 1) / n,
                 i / n - CASE WHEN z > 0 THEN 1 - tail ELSE tail END)) AS ks,
    max(n) AS n_used, max(q_upper) AS q_upper
  FROM tail GROUP BY 1, 2, 3),
scored AS (SELECT *, ks + 0.02 * trim AS score FROM cells),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (
    PARTITION BY condition_idx, rank_idx ORDER BY score NULLS LAST, trim) = 1)"""
    columns = f"""condition_idx, rank_idx, {r("trim", "trim")}, {r("mu_hat", "mu_hat")}, {r("sigma_hat", "sigma_hat")},
  {r("ks", "ks_statistic")}, n_used, {r("0.0", "q_lower")}, {r("q_upper", "q_upper")}, {r("score", "score")}"""
    best = f"{cells}\nSELECT {columns} FROM best"
    applied = f"""{cells}
SELECT condition_idx, rank_idx, trial_idx, {r("rt", "rt")}, {r("trim", "trim")}, {r("0.0", "q_lower")},
  {r("q_upper", "q_upper")}
FROM seconds JOIN best USING (condition_idx, rank_idx) WHERE n_used >= 60 AND rt BETWEEN 0 AND q_upper"""
    return {
        "trim_grid": f"{cells}\nSELECT {columns} FROM scored",
        "trim_thresholds": best,
        "trim_thresholds_in_blocks": best,
        "trim_thresholds_bounded": best.replace("l_suppkey AS condition_idx", "l_linenumber AS condition_idx"),
        "trim_apply": applied,
        "trim_stream": applied,
    }


def _ordered() -> dict[str, str]:
    two_bounds = """sums AS (SELECT user_id, t_us, sum(signed_cents) OVER (PARTITION BY user_id ORDER BY t_us
    ROWS UNBOUNDED PRECEDING) AS s FROM steps)
SELECT user_id, t_us AS t, CAST(CASE WHEN s >= 20000 THEN 1 ELSE -1 END AS BIGINT) AS choice FROM sums
WHERE s >= 20000 OR s <= -10000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t_us) = 1"""
    raced = f"""WITH {STEPS},
sums AS (SELECT user_id, event_type, t_us, sum(cents) OVER (PARTITION BY user_id, event_type ORDER BY t_us
    ROWS UNBOUNDED PRECEDING) AS s FROM steps),
hits AS (SELECT user_id, event_type, min(t_us) AS t FROM sums WHERE s >= 20000 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_type) AS rank_idx
  FROM hits WHERE t < 25 * 24 * 3600 * 1000000::BIGINT)
SELECT user_id, event_type, t, CAST(1 AS BIGINT) AS choice, rank_idx FROM ranked WHERE rank_idx <= 3"""
    return {
        "average_ranks": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r("l_quantity", "l_quantity")},
  {r("rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + "
     "(count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0", "avg_rank")}
FROM lineitem""",
        "quantiles_in_blocks": f"""WITH {SECONDS}
SELECT item_idx, count(*) AS n, {", ".join(r(f"quantile_cont(rt, {p})", f"q{i}") for i, p in enumerate((0.1, 0.5, 0.9)))}
FROM seconds GROUP BY 1""",
        "quantiles_by_selection": f"""WITH a AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag,
    round(l_extendedprice - 50000, 0) * l_discount AS amount FROM lineitem)
SELECT flag, count(*) AS n, {", ".join(
    r(f"quantile_cont(amount, {p})", f"q{i}") for i, p in enumerate((0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0)))}
FROM a GROUP BY 1""",
        "row_numbers_in_blocks": f"""WITH {STEPS}
SELECT event_type, event_id, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents, event_id) AS place
FROM steps""",
        "first_crossing": f"WITH {STEPS},\n{two_bounds}",
        "first_crossing_in_blocks": f"""WITH {STEPS},
sums AS (SELECT event_type, t_us, sum(cents) OVER (PARTITION BY event_type ORDER BY t_us
    ROWS UNBOUNDED PRECEDING) AS s FROM steps)
SELECT event_type, min(t_us) AS t, CAST(1 AS BIGINT) AS choice FROM sums WHERE s >= 2500000 GROUP BY 1""",
        "race_rank": raced,
        "race_rank_stream": raced,
        "map_by_condition": f"""WITH {SECONDS},
c AS (SELECT condition_idx, item_idx, stddev_samp(rt) AS s FROM seconds GROUP BY 1, 2),
w AS (SELECT condition_idx, {", ".join(r(f"max(CASE WHEN item_idx = {i} THEN s END)", f"item_idx_{i}") for i in ITEMS)}
  FROM c GROUP BY 1),
m AS (SELECT condition_idx, {r("avg(rt)", "rt_mean")} FROM seconds GROUP BY 1)
SELECT * FROM m JOIN w USING (condition_idx)""",
        "map_by_condition_frame": f"""WITH {SECONDS}
SELECT condition_idx, count(*) AS n, {r("quantile_cont(rt, 0.5)", "middle")}, {r("max(rt) - min(rt)", "width")}
FROM seconds WHERE item_idx > 1 GROUP BY 1""",
        "map_by_condition_iterator": f"""WITH {SECONDS}
SELECT condition_idx, count(*) AS n, {r("sum(rt)", "total")} FROM seconds GROUP BY 1""",
        "map_by_condition_combined": f"""WITH {SECONDS}
SELECT (SELECT min(condition_idx) FROM seconds) AS condition_idx, item_idx, count(*) AS n, {r("min(rt)", "low")}, {r("max(rt)", "high")}
FROM seconds GROUP BY item_idx""",
        "map_by_condition_python": f"""WITH {SECONDS}
SELECT condition_idx, count(*) AS n, {r("sum(rt)", "total")}, {r("max(rt)", "longest")} FROM seconds GROUP BY 1""",
    }


def _abc(stats: Sequence[str]) -> str:
    """Input, scales and distances over the given statistics."""
    terms = " + ".join(f"power((a.{s} - t.{s}) / d.{s}, 2)" for s in stats)
    return f"""rows AS (SELECT l_partkey AS condition_idx, l_extendedprice / 1000 AS rt, l_returnflag FROM lineitem
  JOIN part ON p_partkey = l_partkey),
stat AS (SELECT condition_idx, avg(rt) AS rt_mean, stddev_samp(rt) AS rt_sd, quantile_cont(rt, 0.5) AS rt_median
  FROM rows GROUP BY 1 HAVING stddev_samp(rt) IS NOT NULL),
t AS (SELECT avg(rt) AS rt_mean, stddev_samp(rt) AS rt_sd, quantile_cont(rt, 0.5) AS rt_median FROM rows
  WHERE l_returnflag = 'R'),
a AS (SELECT condition_idx, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, rt_mean, rt_sd, rt_median
  FROM stat JOIN part ON p_partkey = condition_idx),
m AS (SELECT {", ".join(f"quantile_cont({s}, 0.5) AS {s}" for s in stats)} FROM a),
d AS (SELECT {", ".join(f"1.4826 * quantile_cont(abs(a.{s} - m.{s}), 0.5) AS {s}" for s in stats)} FROM a, m),
dist AS (SELECT a.*, sqrt({terms}) AS distance FROM a, t, d),
placed AS (SELECT *, row_number() OVER (ORDER BY distance, condition_idx) AS place, count(*) OVER () AS total FROM dist)"""


ABC_STATS = ("rt_mean", "rt_sd", "rt_median")
PARAMS = ("size", "price")


def _fit3(name: str, source: str, y: str, by: str = "") -> str:
    """Weighted plane y ~ x1 + x2 + x3, per group if ``by``: a CTE ``<name>`` with b0, b1, b2, b3.

    Sums are centred; the three normal equations are solved by determinants.
    """
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = " AND ".join(f"s.{k} = c.{k}" for k in by.split(", ")) if by else "true"
    own = ", ".join(f"s.{k}" for k in by.split(", ")) + ", " if by else ""
    pairs = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
    products = ", ".join(f"sum(w * (x{i} - m{i}) * (x{j} - m{j})) AS s{i}{j}" for i, j in pairs)
    moments = ", ".join(f"sum(w * (x{i} - m{i}) * ({y} - my)) AS t{i}" for i in (1, 2, 3))

    def determinant(columns: list[list[str]]) -> str:
        (a, d, g), (b, e, h), (c, f, i) = columns
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    matrix = [["s11", "s12", "s13"], ["s12", "s22", "s23"], ["s13", "s23", "s33"]]
    right = ["t1", "t2", "t3"]
    slopes = ", ".join(
        f"{determinant([right if k == j else matrix[k] for k in range(3)])} / {determinant(matrix)} AS b{j + 1}" for j in range(3)
    )
    return f"""{name}_c AS (SELECT {keys}sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * x3) / sum(w) AS m3,
    sum(w * {y}) / sum(w) AS my FROM {source} {group}),
{name}_s AS (SELECT {own}m1, m2, m3, my, {products}, {moments}
  FROM {source} s JOIN {name}_c c ON {on} GROUP BY {own}m1, m2, m3, my),
{name}_b AS (SELECT *, {slopes} FROM {name}_s),
{name} AS (SELECT {keys}my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, b1, b2, b3 FROM {name}_b)"""


def _linear(rescaled: bool) -> str:
    """Local-linear adjustment over the three statistics; price on the log scale."""
    x = ", ".join(f"(p.{c} - t.{c}) / d.{c} AS x{i}" for i, c in enumerate(ABC_STATS, 1))
    plane = lambda f: f"{f}.b0 + {f}.b1 * x1 + {f}.b2 * x2 + {f}.b3 * x3"
    text = f"""WITH {_abc(ABC_STATS)},
k AS (SELECT condition_idx, size AS y1, ln(price) AS y2, distance, {x} FROM placed p, t, d WHERE place <= ceil(total * 0.5)),
kw AS (SELECT *, 1 - power(distance / (SELECT max(distance) FROM k), 2) AS w FROM k),
{_fit3("f1", "kw", "y1")},
{_fit3("f2", "kw", "y2")},
res AS (SELECT kw.*, y1 - ({plane("f1")}) AS r1, y2 - ({plane("f2")}) AS r2 FROM kw, f1, f2),
mean AS (SELECT avg(r1) AS m1, avg(r2) AS m2 FROM res),
cen AS (SELECT res.* EXCLUDE (r1, r2), r1 - m1 AS r1, r2 - m2 AS r2, ln(power(r1 - m1, 2)) AS g1, ln(power(r2 - m2, 2)) AS g2
  FROM res, mean)"""
    if not rescaled:
        return f"""{text}
SELECT condition_idx, {r("f1.b0 + mean.m1 + r1", "adjusted_size")}, {r("exp(f2.b0 + mean.m2 + r2)", "adjusted_price")}
FROM cen, f1, f2, mean"""
    slope = lambda f: f"-{f}.b1 * x1 - {f}.b2 * x2 - {f}.b3 * x3"
    return f"""{text},
{_fit3("g1f", "cen", "g1")},
{_fit3("g2f", "cen", "g2")}
SELECT condition_idx, {r(f"f1.b0 + mean.m1 + r1 * sqrt(exp({slope('g1f')}))", "adjusted_size")},
  {r(f"exp(f2.b0 + mean.m2 + r2 * sqrt(exp({slope('g2f')})))", "adjusted_price")}
FROM cen, f1, f2, mean, g1f, g2f"""


def _cv_linear() -> str:
    """Cross-validation with the values adjusted along a plane fitted per held-out condition and tolerance."""
    x = ", ".join(f"(p.{c} - p.t_{c}) / g.{c} AS x{i}" for i, c in enumerate(ABC_STATS, 1))
    adjusted = "\nUNION ALL ".join(
        f"""SELECT tol, holdout, '{p}' AS parameter, quantile_cont(kw.{p} - f.b1 * x1 - f.b2 * x2 - f.b3 * x3, 0.5) AS estimate
FROM kw JOIN {f} f USING (tol, holdout) GROUP BY 1, 2"""
        for p, f in zip(PARAMS, ("l1", "l2"), strict=True)
    )
    return f"""WITH {_cv()},
far AS (SELECT p.holdout, p.condition_idx, p.size, p.price, {x} FROM p JOIN g ON g.holdout = p.holdout),
lev AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE]) AS tol),
tk AS (SELECT tol, far.*, sqrt(x1 * x1 + x2 * x2 + x3 * x3) AS dist FROM far, lev QUALIFY row_number() OVER (
    PARTITION BY tol, holdout ORDER BY sqrt(x1 * x1 + x2 * x2 + x3 * x3), condition_idx) <= ceil(((SELECT count(*) FROM a) - 1) * tol)),
kw AS (SELECT *, 1 - power(dist / max(dist) OVER (PARTITION BY tol, holdout), 2) AS w FROM tk),
{_fit3("l1", "kw", "size", "tol, holdout")},
{_fit3("l2", "kw", "price", "tol, holdout")},
adj AS ({adjusted})
SELECT {r("tol", "tol")}, holdout, parameter, {r("CASE parameter WHEN 'size' THEN size ELSE price END", "true")}, {r("estimate", "estimate")}
FROM adj JOIN a ON a.condition_idx = holdout"""


def _cv(nval: int = 10, tols: Sequence[float] = (0.05, 0.1)) -> str:
    """Held-out conditions, leave-one-out scales and re-estimates: ends in a CTE ``cv``."""
    s = ABC_STATS
    terms = " + ".join(f"power((p.{c} - p.t_{c}) / g.{c}, 2)" for c in s)
    estimates = "\nUNION ALL ".join(
        f"SELECT {tol} AS tol, holdout, '{p}' AS parameter, quantile_cont({p}, 0.5) AS estimate FROM near "
        f"WHERE place <= ceil((total - 1) * {tol}) GROUP BY 2"
        for tol in [f"{t}::DOUBLE" for t in tols]
        for p in PARAMS
    )
    return f"""{_abc(s)},
held AS (SELECT * FROM a ORDER BY {draw("cv", "condition_idx")}, condition_idx LIMIT {nval}),
p AS (SELECT h.condition_idx AS holdout, {", ".join(f"h.{c} AS t_{c}" for c in s)}, a.* FROM held h
  JOIN a ON a.condition_idx <> h.condition_idx),
pm AS (SELECT holdout, {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in s)} FROM p GROUP BY 1),
g AS (SELECT p.holdout, {", ".join(f"1.4826 * quantile_cont(abs(p.{c} - pm.{c}), 0.5) AS {c}" for c in s)}
  FROM p JOIN pm ON pm.holdout = p.holdout GROUP BY 1),
near AS (SELECT p.holdout, p.condition_idx, p.size, p.price, (SELECT count(*) FROM a) AS total,
    row_number() OVER (PARTITION BY p.holdout ORDER BY sqrt({terms}), p.condition_idx) AS place
  FROM p JOIN g ON g.holdout = p.holdout),
est AS ({estimates}),
cv AS (SELECT tol, holdout, parameter, CASE parameter WHEN 'size' THEN size ELSE price END AS "true", estimate
  FROM est JOIN a ON a.condition_idx = holdout)"""


def _density(source: str, keys: str, panel: str, points: int = 512) -> str:
    """Binned kernel density of ``v`` in ``source`` by ``keys``: the closing CTEs and SELECT."""
    names = keys.split(", ")
    last = points - 1
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    own = lambda a: ", ".join(f"{a}.{k}" for k in names)
    return f"""mom AS (SELECT {keys}, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
    (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / {BANDWIDTH_IQR} AS iqr FROM {source} GROUP BY ALL),
b AS (SELECT {keys}, n, min(lo) OVER (PARTITION BY {panel}) AS g0, max(hi) OVER (PARTITION BY {panel}) AS g1,
    {BANDWIDTH_FACTOR} * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd
      WHEN lo <> 0 THEN abs(lo) ELSE 1 END * power(n, -0.2) AS bw FROM mom),
e AS (SELECT *, g0 - {MARGIN} * bw AS c0, (g1 - g0 + 2 * {MARGIN} * bw) / {last} AS d FROM b WHERE n >= 2),
s AS (SELECT {own("e")}, least(floor((v - c0) / d), {last - 1}) AS i, (v - c0) / d AS spot FROM {source} v JOIN e ON {on("v", "e")}),
cells AS (SELECT {keys}, c, sum(m) AS m FROM (
    SELECT {keys}, i AS c, 1 - (spot - i) AS m FROM s UNION ALL SELECT {keys}, i + 1 AS c, spot - i AS m FROM s) GROUP BY ALL),
curve AS (SELECT {own("e")}, j, sum(m * exp(-0.5 * power((j - c) * e.d / e.bw, 2))) / max(e.n * e.bw * sqrt(2 * pi())) AS y
  FROM e CROSS JOIN range(0, {points}) AS g(j) JOIN cells ON {on("cells", "e")} GROUP BY {own("e")}, j),
grid AS (SELECT e.*, point, g0 + point * ((g1 - g0) / {last}) AS x, (g0 + point * ((g1 - g0) / {last}) - c0) / d AS spot
  FROM e CROSS JOIN range(0, {points}) AS p(point)),
lo AS (SELECT *, least(floor(spot), {last - 1}) AS k FROM grid)
SELECT {", ".join(f"lo.{k}" if k != "tol" else r("lo.tol", "tol") for k in names)}, lo.point, {r("lo.x", "x")},
  {r("a.y * (1 - (lo.spot - lo.k)) + z.y * (lo.spot - lo.k)", "density")}, {r("lo.bw", "bandwidth")}
FROM lo JOIN curve a ON {on("lo", "a")} AND a.j = lo.k JOIN curve z ON {on("lo", "z")} AND z.j = lo.k + 1"""


def _inference() -> dict[str, str]:
    abc = _abc(ABC_STATS)
    cv = _cv()

    def accepted(tol: str) -> str:
        return f"""WITH {abc}
SELECT condition_idx, {", ".join(r(c, c) for c in (*PARAMS, *ABC_STATS, "distance"))}
FROM placed WHERE place <= ceil(total * {tol})"""

    recovery = f"""WITH {cv},
res AS (SELECT *, abs(estimate - "true") AS away FROM cv),
cut AS (SELECT tol, parameter, quantile_cont(away, 0.9) AS cut FROM res GROUP BY 1, 2),
k AS (SELECT res.* FROM res JOIN cut ON cut.tol = res.tol AND cut.parameter = res.parameter WHERE away <= cut)
SELECT {r("tol", "tol")}, parameter, count(*) AS n,
  {r('CASE WHEN regr_sxx(estimate, "true") > 0 AND regr_syy(estimate, "true") > 0 THEN corr(estimate, "true") END', "r")},
  {r('CASE WHEN regr_sxx(estimate, "true") > 0 THEN regr_slope(estimate, "true") END', "slope")},
  {r('CASE WHEN regr_sxx(estimate, "true") > 0 THEN regr_intercept(estimate, "true") ELSE avg(estimate) END', "intercept")}
FROM k GROUP BY 1, 2"""
    recovery = recovery.replace("FROM k GROUP BY 1, 2", "FROM k GROUP BY tol, parameter")
    pair = f"""WITH {cv},
w AS (SELECT tol, holdout, max(CASE WHEN parameter = 'size' THEN estimate END) AS size,
    max(CASE WHEN parameter = 'price' THEN estimate END) AS price FROM cv GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY tol ORDER BY size) + (count(*) OVER (PARTITION BY tol, size) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY tol ORDER BY price) + (count(*) OVER (PARTITION BY tol, price) - 1) / 2.0 AS rp FROM w)
SELECT {r("tol", "tol")}, 'size' AS p1, 'price' AS p2,
  {r("CASE WHEN regr_sxx(rp, rs) > 0 AND regr_syy(rp, rs) > 0 THEN corr(rp, rs) END", "rho")},
  {r("CASE WHEN regr_sxx(price, size) > 0 THEN regr_slope(price, size) END", "slope")},
  {r("CASE WHEN regr_sxx(price, size) > 0 THEN regr_intercept(price, size) ELSE avg(price) END", "intercept")},
  count(*) AS n
FROM k GROUP BY tol"""
    def posterior_row(p: str) -> str:
        return f"""SELECT '{p}' AS parameter, {r(f"avg({p})", "mean")}, {r(f"quantile_cont({p}, 0.5)", "median")},
  {r(f"quantile_cont({p}, 0.025)", "ci_lower_0.025")}, {r(f"quantile_cont({p}, 0.975)", "ci_upper_0.975")},
  {r(f"quantile_cont({p}, 0.1)", "p10")}, {r(f"stddev_samp({p})", "sd")} FROM acc"""

    posterior = f"""WITH {abc},
acc AS (SELECT *, CAST(NULL AS DOUBLE) AS unusable FROM placed WHERE place <= ceil(total * 0.05))
{posterior_row("size")} UNION ALL {posterior_row("price")} UNION ALL {posterior_row("unusable")}"""
    histogram = f"""WITH g AS (SELECT event_type, min(value) AS lo, max(value) AS hi, ceil(log2(count(*)) + 1) AS n
  FROM events GROUP BY 1),
z AS (SELECT *, greatest(abs(lo), abs(hi)) AS size FROM g),
c AS (SELECT *, CASE WHEN hi - lo > size * (1 + 1 / (1 + {UNIT_BIAS})) * n * 3 * power(2, -52) THEN (hi - lo) / n
    WHEN size = 0 THEN {SHRINK} WHEN size > 10 THEN (9 + size / 10) * {SHRINK} ELSE size * {SHRINK} END AS cell FROM z),
b AS (SELECT *, power(10, floor(log10(cell))) AS base FROM c),
u AS (SELECT *, CASE WHEN NOT 2 * base - cell < {UNIT_BIAS} * (cell - base) THEN base
    WHEN NOT 5 * base - cell < {UNIT_BIAS_FIVE} * (cell - 2 * base) THEN 2 * base
    WHEN NOT 10 * base - cell < {UNIT_BIAS} * (cell - 5 * base) THEN 5 * base ELSE 10 * base END AS unit FROM b),
e AS (SELECT event_type, unit, CAST(floor(lo / unit + {BREAK_SLACK}) AS BIGINT) AS first,
    CAST(ceil(hi / unit - {BREAK_SLACK}) AS BIGINT) AS last FROM u),
f AS (SELECT event_type, unit, first, unnest(range(1, last - first + 1)) AS bin FROM e),
n AS (SELECT e.event_type, greatest(CAST(ceil((value - {BIN_SLACK} * unit) / unit - first) AS BIGINT), 1) AS bin, count(*) AS c
  FROM events JOIN e ON e.event_type = events.event_type GROUP BY 1, 2),
j AS (SELECT f.*, coalesce(c, 0) AS c FROM f LEFT JOIN n ON n.event_type = f.event_type AND n.bin = f.bin)
SELECT event_type, bin, {r("(first + bin - 1) * unit", "left")}, {r("(first + bin) * unit", "right")}, c AS count,
  {r("c / max(c) OVER (PARTITION BY event_type)", "scaled")} FROM j"""
    both = f"""WITH {abc},
acc AS (SELECT * FROM placed WHERE place <= ceil(total * 0.05)),
both_t AS ({" UNION ALL ".join(
    f"SELECT '{kind}' AS type, '{p}' AS parameter, {p} AS v FROM {src}"
    for kind, src in (("Posterior", "acc"), ("Prior", "a")) for p in PARAMS)}),
"""
    first = f"""SELECT l_partkey AS condition_idx, {r("first(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount)", "l_quantity")},
  {r("first(l_discount ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount)", "l_discount")}
FROM lineitem GROUP BY 1"""
    one_sided = f"""WITH stat AS (SELECT l_partkey AS condition_idx, avg(l_extendedprice / 1000) AS rt_mean FROM lineitem
  WHERE l_quantity >= 45 GROUP BY 1),
par AS (SELECT l_partkey AS condition_idx, first(l_discount ORDER BY l_orderkey, l_linenumber, l_discount) AS rebate
  FROM lineitem WHERE l_quantity <= 3 GROUP BY 1)
SELECT condition_idx, {r("rebate", "rebate")}, {r("rt_mean", "rt_mean")} FROM par JOIN stat USING (condition_idx)"""
    custom = f"""WITH {abc},
acc AS (SELECT * FROM placed WHERE place <= ceil(total * 0.05))
{" UNION ALL ".join(f"""SELECT '{p}' AS parameter, {r(f"avg({p})", "mean")}, {r(f"quantile_cont({p}, 0.5)", "median")},
  {r(f"quantile_cont({p}, 0.05)", "ci_lower_0.050")}, {r(f"quantile_cont({p}, 0.95)", "ci_upper_0.950")},
  {r(f"max({p}) - min({p})", "width")}, {r(f"stddev_samp({p})", "sd")} FROM acc""" for p in PARAMS)}"""
    return {
        "abc_input_one_sided": one_sided,
        "posterior_custom": custom,
        "abc_cv_loclinear": _cv_linear(),
        "condition_params": first,
        "abc_input": f"""WITH {abc}
SELECT condition_idx, {", ".join(r(f"a.{c}", c) for c in (*PARAMS, *ABC_STATS))},
  {", ".join(r(f"t.{c}", f"target_{c}") for c in ABC_STATS)} FROM a, t""",
        "abc_rejection": accepted("0.05"),
        "abc_rejection_in_blocks": accepted("0.5"),
        "abc_loclinear": _linear(False),
        "abc_loclinear_rescaled": _linear(True),
        "abc_cv": f"""WITH {cv}
SELECT {r("tol", "tol")}, holdout, parameter, {r('"true"', "true")}, {r("estimate", "estimate")} FROM cv""",
        "abc_cv_many": f"""WITH {_cv(100, (0.02, 0.05))}
SELECT {r("tol", "tol")}, holdout, parameter, {r('"true"', "true")}, {r("estimate", "estimate")} FROM cv""",
        "cv_recovery": recovery,
        "cv_residual_density": f"""WITH {cv},
res AS (SELECT tol, parameter, estimate - "true" AS v FROM cv),
{_density("res", "tol, parameter", "tol, parameter")}""",
        "cv_pair_correlation": pair,
        "posterior_summary": posterior,
        "histogram_scaled": histogram,
        "density_curves": "WITH ev AS (SELECT event_type, value AS v FROM events),\n"
        + _density("ev", "event_type", "event_type"),
        "density_prior_posterior": both + _density("both_t", "type, parameter", "parameter"),
    }


def oracles() -> dict[str, str]:
    return {**_summaries(), **_columns(), **_sources(), **_trim(), **_ordered(), **_inference()}
