"""Survival, evaluation and data-quality operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import modeling as mo
from ..operators import profile, quality
from ..operators import survival as sv
from .base import EVENT_CUTOFF, Registry, rounded
from .catalog import ts

R = Registry()
S = "survival_base"


def steps():
    return [
        ("tenure", F.col("duration") >= 180),
        ("solvent", F.col("c_acctbal") > 0),
        ("segment", F.col("c_mktsegment") != "MACHINERY"),
    ]


@R.add(
    "cohort_flow",
    """SELECT step, name, n AS remaining, COALESCE(LAG(n) OVER (ORDER BY step) - n, 0) AS excluded FROM (
      SELECT 0 AS step, 'initial' AS name, COUNT(*) AS n FROM {survival_base}
      UNION ALL SELECT 1, 'tenure', COUNT(*) FROM {survival_base} WHERE duration >= 180
      UNION ALL SELECT 2, 'solvent', COUNT(*) FROM {survival_base} WHERE duration >= 180 AND c_acctbal > 0
      UNION ALL SELECT 3, 'segment', COUNT(*) FROM {survival_base} WHERE duration >= 180 AND c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') x""",
)
def _(t):
    return sv.cohort_flow(t(S), steps())


@R.add(
    "cohort_summary",
    """SELECT COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events, ROUND(100.0 * SUM(event) / COUNT(*), 6) AS events_pct,
      CAST(COUNT(*) - SUM(event) AS BIGINT) AS censored, quantile_cont(duration, 0.5) AS median_followup,
      ROUND(1000.0 * SUM(event) / SUM(duration), 6) AS rate_per_1000
    FROM {survival_base} WHERE duration >= 180 AND c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'""",
)
def _(t):
    return rounded(sv.cohort_summary(sv.cohort(t(S), steps()), "duration", "event"))


@R.add(
    "survival_fields",
    f"""SELECT o_custkey, MIN(o_orderdate) AS first_dt, MAX(o_orderdate) AS last_dt,
      CAST(MAX(o_orderdate) < TIMESTAMP '{EVENT_CUTOFF}' AS INT) AS event, date_diff('day', MIN(o_orderdate), MAX(o_orderdate)) AS duration
    FROM orders GROUP BY o_custkey""",
)
def _(t):
    return sv.survival_fields(t("orders"), entity="o_custkey", time="o_orderdate", cutoff=ts(EVENT_CUTOFF))


@R.add(
    "survival_checks",
    """SELECT COUNT(*) FILTER (WHERE duration < 0) = 0 AS no_negative_durations, COUNT(*) FILTER (WHERE event NOT IN (0, 1)) = 0 AS binary_event,
      COUNT(*) FILTER (WHERE duration < 30) = 0 AS above_min_duration FROM {survival_base}""",
)
def _(t):
    return sv.survival_checks(t(S), "duration", "event", minimum=30)


SHIPPED = "SELECT o_orderkey, o_orderdate, l_shipdate FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"


@R.add(
    "feature_window_violations",
    f"""SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE l_shipdate > o_orderdate) AS after_origin,
      COUNT(*) FILTER (WHERE l_shipdate <= o_orderdate - INTERVAL 180 DAY) AS before_window FROM ({SHIPPED}) x""".replace("{orders}", "orders").replace("{lineitem}", "lineitem"),
)
def _(t):
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return sv.feature_window_violations(rows, "l_shipdate", "o_orderdate", 180)


@R.add(
    "target_leakage",
    """SELECT 'duration' AS feature, ROUND(corr(duration, event), 6) AS r, abs(corr(duration, event)) > 0.5 AS leaks FROM {survival_base}
    UNION ALL SELECT 'risk', ROUND(corr(risk, event), 6), abs(corr(risk, event)) > 0.5 FROM {survival_base}
    UNION ALL SELECT 'leak', ROUND(corr(2 - event * 3, event), 6), true FROM {survival_base}""",
)
def _(t):
    rows = t(S).withColumn("leak", 2 - F.col("event") * 3)
    return rounded(sv.target_leakage(rows, "event", ["duration", "risk", "leak"], threshold=0.5))


@R.add(
    "temporal_split_check",
    """SELECT a AS train_end, b AS test_start, b > a AS in_order FROM (SELECT
      (SELECT MAX(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') AS a,
      (SELECT MIN(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS b) x""",
)
def _(t):
    orders, cut = t("orders"), ts("2000-01-01 00:00:00")
    return sv.temporal_split_check(
        orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), "o_orderdate"
    )


# --- features ---------------------------------------------------------------------------------------


@R.add(
    "lookback_features",
    """SELECT o.user_id, o.ts AS origin, COUNT(*) FILTER (WHERE e.ts > o.ts - INTERVAL 7 DAY) AS events_7d,
      ROUND(COALESCE(SUM(e.value) FILTER (WHERE e.ts > o.ts - INTERVAL 7 DAY), 0), 4) AS value_7d,
      COUNT(e.ts) AS events_14d, ROUND(COALESCE(SUM(e.value), 0), 4) AS value_14d
    FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') o
    LEFT JOIN events e ON e.user_id = o.user_id AND e.ts <= o.ts AND e.ts > o.ts - INTERVAL 14 DAY GROUP BY o.user_id, o.ts""",
)
def _(t):
    origins = t("events").where("event_type = 'error'").select("user_id", F.col("ts").alias("origin"))
    out = fe.lookback_features(
        t("events"), origins, entity="user_id", time="ts", origin="origin", days=[7, 14], value="value"
    )
    return rounded(out, 4)


@R.add(
    "asof_covariate",
    """SELECT b.event_id, b.user_id, b.ts, c.ts AS covariate_time, c.value AS value
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') b
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') c ON b.user_id = c.user_id AND b.ts >= c.ts""",
)
def _(t):
    base = t("events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    known = t("events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen"), "value")
    return fe.asof_covariate(base, known, entity="user_id", at="ts", time="seen", values=["value"])


@R.add(
    "person_period",
    """SELECT c_custkey, CAST(i AS INT) AS interval, CAST(i * 90 AS BIGINT) AS start, LEAST(i * 90 + 90, duration) AS stop,
      CASE WHEN i = duration // 90 THEN event ELSE 0 END AS interval_event
    FROM (SELECT *, unnest(range(0, duration // 90 + 1)) AS i FROM {survival_base} WHERE duration >= 0) x""".replace("AS interval,", 'AS "interval",'),
)
def _(t):
    return fe.person_period(t(S), duration="duration", event="event", width=90).select(
        "c_custkey", "interval", "start", "stop", "interval_event"
    )


@R.add(
    "missingness",
    """SELECT 'l_linenumber' AS column_name, COUNT(*) FILTER (WHERE l_linenumber = 7) AS missing, COUNT(*) AS rows,
      ROUND(100.0 * COUNT(*) FILTER (WHERE l_linenumber = 7) / COUNT(*), 6) AS missing_pct FROM lineitem
    UNION ALL SELECT 'l_discount', COUNT(*) FILTER (WHERE l_discount = 0), COUNT(*), ROUND(100.0 * COUNT(*) FILTER (WHERE l_discount = 0) / COUNT(*), 6) FROM lineitem""",
)
def _(t):
    rows = t("lineitem").select(
        F.nullif("l_linenumber", F.lit(7)).alias("l_linenumber"), F.nullif("l_discount", F.lit(0.0)).alias("l_discount")
    )
    return rounded(profile.missingness(rows, ["l_linenumber", "l_discount"])[0])


@R.add(
    "missing_filled",
    """SELECT l_orderkey, l_linenumber % 7 AS l_linenumber, CAST(l_linenumber = 7 AS INT) AS l_linenumber_missing FROM lineitem""",
)
def _(t):
    rows = t("lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("l_linenumber"))
    return profile.missingness(rows, ["l_linenumber"], {"l_linenumber": 0})[1]


@R.add(
    "winsorize",
    """SELECT c_custkey, ROUND(LEAST(GREATEST(c_acctbal, lo), hi), 6) AS c_acctbal_w FROM customer,
      (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer) q""",
)
def _(t):
    return rounded(fe.winsorize(t("customer"), "c_acctbal", lower=0.05, upper=0.95).select("c_custkey", "c_acctbal_w"))


@R.add(
    "outlier_flags",
    """SELECT l_orderkey, l_extendedprice, l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1) AS l_extendedprice_outlier
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) q""",
)
def _(t):
    flagged = fe.outlier_flags(t("lineitem"), "l_extendedprice", factor=0.5)
    return flagged.select("l_orderkey", "l_extendedprice", "l_extendedprice_outlier")


@R.add(
    "encode_categories",
    """SELECT c_custkey, c_mktsegment, n.name_, DENSE_RANK() OVER (ORDER BY n.name_) AS name__code FROM customer
      JOIN (SELECT n_nationkey, n_name AS name_ FROM nation) n ON n.n_nationkey = c_nationkey""",
)
def _(t):
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name_"))
    named = t("customer").join(nations, "c_nationkey").select("c_custkey", "c_mktsegment", "name_")
    return fe.encode_categories(named, "name_")


@R.add(
    "encode_features",
    """SELECT c_custkey, ROUND(ln(1 + GREATEST(c_acctbal, 0)), 6) AS log_c_acctbal,
      CAST(c_acctbal >= 0 AS INT) + CAST(c_acctbal >= 5000 AS INT) AS c_acctbal_bin,
      CAST(c_mktsegment = 'AUTOMOBILE' AS INT) AS c_mktsegment_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INT) AS c_mktsegment_BUILDING,
      CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 END AS c_mktsegment_rank FROM customer""",
)
def _(t):
    return rounded(
        t("customer").select(
            "c_custkey", fe.log_feature("c_acctbal"), fe.binned("c_acctbal", [0, 5000]),
            *fe.one_hot("c_mktsegment", ["AUTOMOBILE", "BUILDING"]), fe.ordinal("c_mktsegment", ["BUILDING", "HOUSEHOLD"]),
        )
    )


@R.add(
    "temporal_split",
    """SELECT split, COUNT(*) AS n, CAST(SUM(e) AS BIGINT) AS events, MIN(o_orderdate) AS start, MAX(o_orderdate) AS "end" FROM (
      SELECT *, CAST(o_orderstatus = 'F' AS INT) AS e, CASE WHEN o_orderdate <= TIMESTAMP '1999-12-31' THEN 'train'
        WHEN o_orderdate <= TIMESTAMP '1999-12-31' + INTERVAL 30 DAY THEN 'gap' WHEN o_orderdate <= TIMESTAMP '2000-12-31' THEN 'validation'
        WHEN o_orderdate <= TIMESTAMP '2000-12-31' + INTERVAL 30 DAY THEN 'gap' ELSE 'test' END AS split FROM orders) x GROUP BY split""",
)
def _(t):
    orders = t("orders").withColumn("e", (F.col("o_orderstatus") == "F").cast("int"))
    split = fe.temporal_split(
        orders, "o_orderdate", train_end="1999-12-31 00:00:00", valid_end="2000-12-31 00:00:00", gap_days=30
    )
    return fe.split_summary(split, "o_orderdate", "e")


# --- models -----------------------------------------------------------------------------------------


NEWTON_STEPS = 12


def cox_fit_views() -> dict[str, str]:
    """Newton steps of a penalised two-feature Cox model with Efron ties, one view a step, on standardised features."""
    views = {
        "cox_shape": """SELECT AVG(risk) AS ma, AVG(hh) AS mb, stddev(risk) AS sa, stddev(hh) AS sb, 0.1 * COUNT(*) AS pull
          FROM (SELECT risk, CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS hh FROM {survival_base}) u""",
        "cox_design": """SELECT duration, event, (risk - ma) / sa AS a, (CAST(c_mktsegment = 'HOUSEHOLD' AS INT) - mb) / sb AS b, pull
          FROM {survival_base} CROSS JOIN {cox_shape}""",
        "cox_step_0": "SELECT 0.0::DOUBLE AS ba, 0.0::DOUBLE AS bb, NULL::DOUBLE AS haa, NULL::DOUBLE AS hab, NULL::DOUBLE AS hbb",
    }
    powers = {"0": "1", "a": "a", "b": "b", "aa": "a * a", "ab": "a * b", "bb": "b * b"}
    sums = ", ".join(f"SUM(w * {x}) AS s{k}, SUM(w * event * {x}) AS d{k}" for k, x in powers.items())
    upto = ", ".join(f"SUM(s{k}) OVER (ORDER BY duration DESC) AS r{k}" for k in powers)
    left = ", ".join(f"r{k} - i / d * d{k} AS l{k}" for k in powers)

    def curve(k: str) -> str:
        return f"SUM(l{k} / l0 - l{k[0]} * l{k[1]} / l0 / l0)"

    for n in range(1, NEWTON_STEPS + 1):
        views[f"cox_step_{n}"] = f"""SELECT ba + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS ba,
            bb + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS bb, haa, hab, hbb
          FROM (SELECT ANY_VALUE(ba) AS ba, ANY_VALUE(bb) AS bb,
              SUM(CASE WHEN i = 0 THEN ea ELSE 0 END - la / l0) - ANY_VALUE(pull * ba) AS ga,
              SUM(CASE WHEN i = 0 THEN eb ELSE 0 END - lb / l0) - ANY_VALUE(pull * bb) AS gb,
              {curve('aa')} + ANY_VALUE(pull) AS haa, {curve('ab')} AS hab, {curve('bb')} + ANY_VALUE(pull) AS hbb
            FROM (SELECT *, {left} FROM (SELECT *, unnest(range(0, CAST(d AS BIGINT))) AS i FROM (SELECT *, {upto} FROM (
              SELECT duration, SUM(event) AS d, SUM(event * a) AS ea, SUM(event * b) AS eb, ANY_VALUE(ba) AS ba,
                ANY_VALUE(bb) AS bb, ANY_VALUE(pull) AS pull, {sums}
              FROM (SELECT *, exp(ba * a + bb * b) AS w FROM {{cox_design}} CROSS JOIN {{cox_step_{n - 1}}}) q
              GROUP BY duration) p) o WHERE d > 0) m) l) k"""
    return views


COX_FIT = " UNION ALL ".join(
    f"""SELECT '{name}' AS feature, ROUND(c, 5) AS coef, ROUND(exp(c), 5) AS hazard_ratio, ROUND(e, 5) AS se,
      ROUND(exp(c - 1.959963984540054 * e), 5) AS hr_lower, ROUND(exp(c + 1.959963984540054 * e), 5) AS hr_upper
    FROM (SELECT b{k} / s{k} AS c, sqrt(h{other}{other} / (haa * hbb - hab * hab)) / s{k} AS e
      FROM {{cox_step_{NEWTON_STEPS}}} CROSS JOIN {{cox_shape}}) f{k}"""
    for name, k, other in (("risk", "a", "b"), ("household", "b", "a"))
)


@R.add("cox_ph", COX_FIT, cox_fit_views())
def _(t):
    rows = t(S).withColumn("household", (F.col("c_mktsegment") == "HOUSEHOLD").cast("int"))
    model = mo.cox_ph(rows, "duration", "event", ["risk", "household"])
    return rounded(model.summary(rows.sparkSession), 5)


def cox_sql(tie_terms: str, share: str) -> str:
    """Two features (risk, household) at fixed coefficients 0.3 and -0.2."""
    moments = ", ".join(
        f"SUM({w}) AS {p}0, SUM({w} * risk) AS {p}a, SUM({w} * hh) AS {p}b, SUM({w} * risk * hh) AS {p}ab"
        for w, p in (("w", "s"), ("w * event", "d"))
    )
    upto = ", ".join(f"SUM(s{m}) OVER (ORDER BY duration DESC) AS r{m}" for m in ("0", "a", "b", "ab"))
    left = {m: f"(r{m} - {share} * d{m})" for m in ("0", "a", "b", "ab")}
    return f"""SELECT ROUND(SUM(CASE WHEN k = 0 THEN es ELSE 0 END - m * ln({left['0']})), 6) AS ll,
      ROUND(SUM(CASE WHEN k = 0 THEN ea ELSE 0 END - m * {left['a']} / {left['0']}), 6) AS g0,
      ROUND(SUM(CASE WHEN k = 0 THEN eb ELSE 0 END - m * {left['b']} / {left['0']}), 6) AS g1,
      ROUND(SUM(m * ({left['ab']} / {left['0']} - {left['a']} * {left['b']} / {left['0']} / {left['0']})), 6) AS h0_1
    FROM (SELECT *, {tie_terms} FROM (SELECT *, {upto} FROM (
      SELECT duration, SUM(event) AS d, SUM(event * (0.3 * risk - 0.2 * hh)) AS es, SUM(event * risk) AS ea, SUM(event * hh) AS eb, {moments}
      FROM (SELECT *, CAST(exp(0.3 * risk - 0.2 * hh) AS DOUBLE) AS w FROM (SELECT *, CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS hh FROM {{survival_base}}) a) b
      GROUP BY duration) c) x WHERE d > 0) y"""


def cox_score(t, ties):
    rows = t(S).withColumn("household", (F.col("c_mktsegment") == "HOUSEHOLD").cast("int"))
    return rounded(mo.cox_score(rows, "duration", "event", ["risk", "household"], [0.3, -0.2], ties=ties)).select("ll", "g0", "g1", "h0_1")


@R.add("cox_score_efron", cox_sql("1 AS m, unnest(range(0, CAST(d AS BIGINT))) AS k", "k / d"))
def _(t):
    return cox_score(t, "efron")


@R.add("cox_score_breslow", cox_sql("d AS m, 0 AS k", "0"))
def _(t):
    return cox_score(t, "breslow")


def hazard_fit_views() -> dict[str, str]:
    """Reweighted least squares of a logistic hazard (intercept, interval, risk), one view a step, solved by cofactors."""
    views = {
        "hazard_rows": """SELECT i, risk, COUNT(*) AS n, SUM(CASE WHEN i = last THEN event ELSE 0 END) AS y
          FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM (
            SELECT risk, event, CAST(floor(duration / 180) AS BIGINT) AS last FROM {survival_base} WHERE duration >= 0) u) v
          GROUP BY i, risk""",
        "hazard_step_0": "SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2",
    }
    for step in range(1, NEWTON_STEPS + 1):
        views[f"hazard_step_{step}"] = f"""SELECT b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det AS b0,
            b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det AS b1, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det AS b2
          FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (
            SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
              h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22
            FROM (SELECT ANY_VALUE(b0) AS b0, ANY_VALUE(b1) AS b1, ANY_VALUE(b2) AS b2,
                SUM(y - n * p) AS g0, SUM((y - n * p) * i) AS g1, SUM((y - n * p) * risk) AS g2,
                SUM(n * p * (1 - p)) AS h00, SUM(n * p * (1 - p) * i) AS h01, SUM(n * p * (1 - p) * risk) AS h02,
                SUM(n * p * (1 - p) * i * i) AS h11, SUM(n * p * (1 - p) * i * risk) AS h12, SUM(n * p * (1 - p) * risk * risk) AS h22
              FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * i + b2 * risk))) AS p FROM {{hazard_rows}} CROSS JOIN {{hazard_step_{step - 1}}}) w) x) z) s"""
    return views


HAZARD_FIT = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, ROUND({b}, 5) AS coef, ROUND(exp({b}), 5) AS odds_ratio FROM {{hazard_step_{NEWTON_STEPS}}}"
    for name, b in (("intercept", "b0"), ("interval", "b1"), ("risk", "b2"))
)


@R.add("discrete_time_hazard", HAZARD_FIT, hazard_fit_views())
def _(t):
    rows = t(S).select("c_custkey", "duration", "event", "risk")
    return rounded(mo.discrete_time_hazard(rows, "duration", "event", ["risk"], width=180)[0], 5)


def km_sql(by: str = "") -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {key}time, at_risk, events, n - events AS censored, s, v, l FROM (
      SELECT *, CASE WHEN MAX(CAST(events = at_risk AS INT)) OVER w = 1 THEN 0.0 ELSE exp(SUM(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS s,
        SUM(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS v,
        SUM(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w AS l
      FROM (SELECT {key}duration AS time, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events,
          CAST(SUM(COUNT(*)) OVER ({part}ORDER BY duration DESC) AS BIGINT) AS at_risk FROM {{survival_base}} GROUP BY {key}duration) a
      WINDOW w AS ({part}ORDER BY time)) k"""


def km_rows(by: str = "") -> str:
    key = f"{by}, " if by else ""
    z = f"{sv.Z95} * sqrt(v) / l"
    lo = "CASE WHEN s IN (0, 1) THEN s ELSE LEAST(exp(-exp(ln(-l) + %s)), exp(-exp(ln(-l) - %s))) END" % (z, z)
    hi = "CASE WHEN s IN (0, 1) THEN s ELSE GREATEST(exp(-exp(ln(-l) + %s)), exp(-exp(ln(-l) - %s))) END" % (z, z)
    return f"""SELECT {key}time, at_risk, events, censored, ROUND(s, 6) AS survival, ROUND({lo}, 6) AS ci_lower, ROUND({hi}, 6) AS ci_upper
      FROM ({km_sql(by)}) c"""


@R.add("kaplan_meier", km_rows())
def _(t):
    return rounded(sv.kaplan_meier(t(S), "duration", "event"))


@R.add("km_by_segment", km_rows("c_mktsegment"))
def _(t):
    return rounded(sv.kaplan_meier(t(S), "duration", "event", by=["c_mktsegment"]))


@R.add(
    "risk_at_horizon",
    f"""SELECT c_custkey, {', '.join(f'ROUND(1 - pow(s{h}, exp(risk - 0.5)), 6) AS risk_{h}' for h in (90, 180, 365))} FROM {{survival_base}}, (
      SELECT {', '.join(f'arg_min(s, abs(time - {h}) + time / 1e9) AS s{h}' for h in (90, 180, 365))} FROM ({km_sql()}) k) b""",
)
def _(t):
    rows = t(S)
    curve = sv.kaplan_meier(rows, "duration", "event")
    at = mo.horizons(365, [90, 180, 365])
    out = mo.risk_at_horizons(rows, curve, F.col("risk") - 0.5, at)
    return rounded(out.select("c_custkey", *[f"risk_{h}" for h in at]))


@R.add(
    "cumulative_incidence",
    """SELECT time, at_risk, cause, CAST(CASE cause WHEN 1 THEN d1 ELSE d2 END AS BIGINT) AS events,
      ROUND(CASE cause WHEN 1 THEN SUM(before * d1 / at_risk) OVER (PARTITION BY cause ORDER BY time) ELSE SUM(before * d2 / at_risk) OVER (PARTITION BY cause ORDER BY time) END, 6) AS cumulative_incidence
    FROM (SELECT *, COALESCE(CASE WHEN MAX(CAST(d1 + d2 = at_risk AS INT)) OVER w = 1 THEN 0.0 ELSE exp(SUM(CASE WHEN d1 + d2 < at_risk THEN ln(1 - (d1 + d2) / at_risk) ELSE 0 END) OVER w) END, 1.0) AS before
      FROM (SELECT duration AS time, SUM(event * CAST(c_nationkey % 2 = 0 AS INT)) AS d1, SUM(event * CAST(c_nationkey % 2 = 1 AS INT)) AS d2,
          CAST(SUM(COUNT(*)) OVER (ORDER BY duration DESC) AS BIGINT) AS at_risk FROM {survival_base} GROUP BY duration) a
      WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b, (SELECT unnest([1, 2]) AS cause) c""",
)
def _(t):
    rows = t(S).withColumn("cause", F.col("event") * (1 + F.col("c_nationkey") % 2))
    return rounded(sv.cumulative_incidence(rows, "duration", "cause", [1, 2]))


# --- descriptive ------------------------------------------------------------------------------------


@R.add(
    "duration_stats",
    """SELECT event, COUNT(*) AS n, ROUND(AVG(duration), 6) AS mean_duration, MIN(duration) AS min_duration, MAX(duration) AS max_duration,
      quantile_cont(duration, 0.5) AS median_duration FROM {survival_base} GROUP BY event""",
)
def _(t):
    return rounded(sv.duration_stats(t(S), "duration", "event"))


@R.add(
    "duration_ecdf",
    """SELECT DISTINCT event, duration, COUNT(*) OVER (PARTITION BY event, duration) AS n,
      ROUND(cume_dist() OVER (PARTITION BY event ORDER BY duration), 6) AS ecdf FROM {survival_base}""",
)
def _(t):
    return rounded(sv.duration_ecdf(t(S), "duration", "event"))


@R.add(
    "duration_histogram",
    "SELECT event, CAST(duration // 90 * 90 AS BIGINT) AS bin_start, COUNT(*) AS n FROM {survival_base} GROUP BY 1, 2",
)
def _(t):
    return sv.duration_histogram(t(S), "duration", "event", width=90)


@R.add(
    "followup_bands",
    """SELECT band, CAST(SUM(n) OVER (ORDER BY i DESC) AS BIGINT) AS entering, events, n - events AS censored,
      ROUND(100.0 * (n - events) / SUM(n) OVER (ORDER BY i DESC), 6) AS censored_pct FROM (
      SELECT CASE WHEN duration <= 90 THEN 0 WHEN duration <= 180 THEN 1 WHEN duration <= 365 THEN 2 ELSE 3 END AS i,
        CASE WHEN duration <= 90 THEN '0-90' WHEN duration <= 180 THEN '91-180' WHEN duration <= 365 THEN '181-365' ELSE '>365' END AS band,
        COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events FROM {survival_base} GROUP BY 1, 2) x""",
)
def _(t):
    return rounded(sv.followup_bands(t(S), "duration", "event", [90, 180, 365]))


@R.add(
    "person_time",
    """SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events, CAST(SUM(duration) AS BIGINT) AS person_time,
      ROUND(1000.0 * SUM(event) / SUM(duration), 6) AS rate_per_1000 FROM {survival_base} GROUP BY c_mktsegment""",
)
def _(t):
    return rounded(sv.person_time(t(S), "duration", "event", by=["c_mktsegment"]))


@R.add(
    "duplicate_checks",
    """SELECT COUNT(*) AS entities, COUNT(*) FILTER (WHERE n > 1) AS duplicate_entities, COUNT(*) FILTER (WHERE e > 1) AS multiple_event_entities
    FROM (SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS e FROM orders GROUP BY o_custkey) x""",
)
def _(t):
    orders = t("orders").withColumn("e", (F.col("o_orderstatus") == "F").cast("int"))
    return sv.duplicate_checks(orders, "o_custkey", "e")


PERIODS = """SELECT o_custkey, o_orderkey, o_orderdate AS start_dt, MAX(l_shipdate) AS end_dt FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
    GROUP BY o_custkey, o_orderkey, o_orderdate"""


@R.add(
    "overlap_checks",
    f"""SELECT o_custkey, start_dt, end_dt, o_orderkey, previous_end FROM (
      SELECT *, MAX(end_dt) OVER (PARTITION BY o_custkey ORDER BY start_dt, end_dt, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end
      FROM ({PERIODS}) p) x WHERE start_dt < previous_end""",
)
def _(t):
    rows = (
        t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start_dt")).agg(F.max("l_shipdate").alias("end_dt"))
    )
    return sv.overlapping_periods(rows, "o_custkey", "start_dt", "end_dt", "o_orderkey")


# --- evaluation -------------------------------------------------------------------------------------


@R.add(
    "c_index",
    """SELECT CAST(COUNT(*) AS DOUBLE) AS comparable, CAST(COUNT(*) FILTER (WHERE a.risk > b.risk) AS DOUBLE) AS concordant,
      CAST(COUNT(*) FILTER (WHERE a.risk = b.risk) AS DOUBLE) AS tied,
      ROUND((COUNT(*) FILTER (WHERE a.risk > b.risk) + 0.5 * COUNT(*) FILTER (WHERE a.risk = b.risk)) / COUNT(*), 6) AS c_index
    FROM {survival_base} a JOIN {survival_base} b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0))""",
)
def _(t):
    return rounded(ev.c_index(t(S), "duration", "event", "risk"))


LABEL = "CASE WHEN event = 1 AND duration <= 1825 THEN 1 WHEN duration >= 1825 THEN 0 END"


def auc_sql(source: str, label: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}COUNT(*) FILTER (WHERE y = 1) AS positives, COUNT(*) FILTER (WHERE y = 0) AS negatives,
      (SUM(r) FILTER (WHERE y = 1) - COUNT(*) FILTER (WHERE y = 1) * (COUNT(*) FILTER (WHERE y = 1) + 1) / 2)
        / NULLIF(COUNT(*) FILTER (WHERE y = 1) * COUNT(*) FILTER (WHERE y = 0), 0) AS auc
      FROM (SELECT {key}y, rank() OVER ({part}ORDER BY risk) + (COUNT(*) OVER ({part + ', ' if by else 'PARTITION BY '}risk) - 1) / 2 AS r
        FROM (SELECT *, {label} AS y FROM {source}) l WHERE y IS NOT NULL) x {group}"""


@R.add("auc_at_horizon", f"SELECT positives, negatives, ROUND(auc, 6) AS auc, 1825 AS horizon FROM ({auc_sql('{survival_base}', LABEL)}) a")
def _(t):
    return rounded(ev.auc_at_horizon(t(S), "duration", "event", "risk", 1825))


CUTS = "(SELECT quantile_cont(risk, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM {survival_base})"
BINS = f"""SELECT 1 + {' + '.join(f'CAST(risk >= cuts[{i}] AS INT)' for i in range(1, 10))} AS bin, COUNT(*) AS n,
      AVG(risk) AS mean_predicted, AVG(event) AS observed_rate FROM {{survival_base}}, {CUTS} q GROUP BY 1"""


@R.add("calibration_bins", f"SELECT bin, n, ROUND(mean_predicted, 6) AS mean_predicted, ROUND(observed_rate, 6) AS observed_rate FROM ({BINS}) b")
def _(t):
    return rounded(ev.calibration_bins(t(S), "risk", "event"))


@R.add(
    "calibration_slope",
    f"""SELECT ROUND(regr_slope(observed_rate, mean_predicted), 6) AS slope, ROUND(regr_intercept(observed_rate, mean_predicted), 6) AS intercept FROM ({BINS}) b""",
)
def _(t):
    return rounded(ev.calibration_slope(ev.calibration_bins(t(S), "risk", "event")))


def horizon_risks():
    return {730.0: F.col("risk") / 4, 1460.0: F.col("risk") / 2, 2190.0: F.col("risk")}


def brier_sql(h: int, risk: str) -> str:
    y = f"CASE WHEN event = 1 AND duration <= {h} THEN 1 WHEN duration >= {h} THEN 0 END"
    return f"SELECT CAST({h} AS DOUBLE) AS horizon, COUNT({y}) AS n, AVG(pow({risk} - {y}, 2)) AS brier FROM {{survival_base}}"


BRIER = " UNION ALL ".join(brier_sql(h, r) for h, r in ((730, "risk / 4"), (1460, "risk / 2"), (2190, "risk")))


@R.add("brier_score", f"SELECT horizon, n, ROUND(brier, 6) AS brier FROM ({BRIER}) b")
def _(t):
    return rounded(ev.brier_scores(t(S), "duration", "event", horizon_risks()))


@R.add(
    "brier_integrated",
    f"""SELECT ROUND(SUM(area) / (MAX(horizon) - MIN(horizon)), 6) AS integrated_brier FROM (
      SELECT horizon, (horizon - LAG(horizon) OVER w) * (brier + LAG(brier) OVER w) / 2 AS area FROM ({BRIER}) b WINDOW w AS (ORDER BY horizon)) x""",
)
def _(t):
    return rounded(ev.integrated_brier(ev.brier_scores(t(S), "duration", "event", horizon_risks())))


DECILES = """SELECT *, CAST(LEAST(10, (rn - 1) // (total // 10) + 1) AS INT) AS decile FROM (
      SELECT *, ROW_NUMBER() OVER (ORDER BY risk DESC, c_custkey) AS rn, COUNT(*) OVER () AS total FROM {survival_base}) r"""


@R.add(
    "lift_table",
    f"""SELECT decile, n, events, ROUND(events / n, 6) AS event_rate, ROUND(SUM(events) OVER (ORDER BY decile) / SUM(events) OVER (), 6) AS cumulative_capture,
      ROUND((events / n) / (SUM(events) OVER () / SUM(n) OVER ()), 6) AS lift
    FROM (SELECT decile, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events FROM ({DECILES}) d GROUP BY decile) x""",
)
def _(t):
    return rounded(ev.lift_table(t(S), "risk", "event", "c_custkey"))


@R.add(
    "risk_tiers",
    f"""SELECT CASE WHEN decile = 1 THEN 'high' WHEN decile <= 7 THEN 'medium' ELSE 'low' END AS tier, COUNT(*) AS n,
      CAST(SUM(event) AS BIGINT) AS events, ROUND(AVG(event), 6) AS event_rate FROM ({DECILES}) d GROUP BY 1""",
)
def _(t):
    return rounded(ev.risk_tiers(t(S), "risk", "event", "c_custkey"))


@R.add(
    "threshold_tiers",
    """SELECT CASE WHEN risk > 0.3 THEN 'high' WHEN risk >= 0.15 THEN 'medium' ELSE 'low' END AS tier, COUNT(*) AS n,
      CAST(SUM(event) AS BIGINT) AS events, ROUND(AVG(event), 6) AS event_rate FROM {survival_base} GROUP BY 1""",
)
def _(t):
    return rounded(ev.threshold_tiers(t(S), "risk", "event"))


@R.add(
    "capacity_coverage",
    f"""SELECT capacity, COUNT(*) FILTER (WHERE rn <= capacity) AS treated, CAST(COALESCE(SUM(event) FILTER (WHERE rn <= capacity), 0) AS BIGINT) AS events,
      ROUND(100.0 * COALESCE(SUM(event) FILTER (WHERE rn <= capacity), 0) / SUM(event), 6) AS events_pct,
      ROUND(100.0 * COUNT(*) FILTER (WHERE rn <= capacity) / COUNT(*), 6) AS population_pct
    FROM ({DECILES}) d, (SELECT unnest([50, 100, 500, 100000]) AS capacity) c GROUP BY capacity""",
)
def _(t):
    return rounded(ev.capacity_coverage(t(S), "risk", "event", "c_custkey", [50, 100, 500, 100000]))


@R.add(
    "decision_curve",
    """SELECT threshold, COUNT(*) FILTER (WHERE risk >= threshold AND event = 1) AS true_positives, COUNT(*) FILTER (WHERE risk >= threshold AND event = 0) AS false_positives,
      ROUND(COUNT(*) FILTER (WHERE risk >= threshold AND event = 1) / COUNT(*) - COUNT(*) FILTER (WHERE risk >= threshold AND event = 0) / COUNT(*) * threshold / (1 - threshold), 6) AS net_benefit,
      ROUND(AVG(event) - (1 - AVG(event)) * threshold / (1 - threshold), 6) AS treat_all
    FROM {survival_base}, (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS DOUBLE) AS threshold) c GROUP BY threshold""",
)
def _(t):
    return rounded(ev.decision_curve(t(S), "risk", "event", [0.1, 0.25, 0.5, 0.75, 0.9]))


PARITY = """SELECT c_mktsegment, COUNT(*) AS n, COUNT(*) FILTER (WHERE event = 1) AS events, AVG(risk) AS mean_risk,
      COUNT(*) FILTER (WHERE risk >= 0.6 AND event = 0) / NULLIF(COUNT(*) FILTER (WHERE event = 0), 0) AS fpr,
      COUNT(*) FILTER (WHERE risk < 0.6 AND event = 1) / NULLIF(COUNT(*) FILTER (WHERE event = 1), 0) AS fnr FROM {survival_base} GROUP BY c_mktsegment"""


@R.add("subgroup_parity", f"SELECT c_mktsegment, n, events, ROUND(mean_risk, 6) AS mean_risk, ROUND(fpr, 6) AS fpr, ROUND(fnr, 6) AS fnr FROM ({PARITY}) p")
def _(t):
    return rounded(ev.subgroup_parity(t(S), "c_mktsegment", "risk", "event", threshold=0.6))


@R.add(
    "parity_gaps",
    f"""SELECT ROUND(MAX(events / n) - MIN(events / n), 6) AS event_rate_gap, ROUND(MAX(mean_risk) - MIN(mean_risk), 6) AS mean_risk_gap,
      ROUND(MAX(fpr) - MIN(fpr), 6) AS fpr_gap, ROUND(MAX(fnr) - MIN(fnr), 6) AS fnr_gap FROM ({PARITY}) p""",
)
def _(t):
    return rounded(ev.parity_gaps(ev.subgroup_parity(t(S), "c_mktsegment", "risk", "event", threshold=0.6)))


WINDOWED = """SELECT w AS window_no, s.* FROM {survival_base} s, (SELECT unnest(range(0, 6)) AS w) x
    WHERE date_diff('day', DATE '2000-01-01', CAST(last_dt AS DATE)) >= w * 120 AND date_diff('day', DATE '2000-01-01', CAST(last_dt AS DATE)) < w * 120 + 365"""


@R.add(
    "backtest_windows",
    f"""SELECT CAST(p.window_no AS INT) AS "window", n, events, ROUND(event_rate, 6) AS event_rate, ROUND(mean_risk, 6) AS mean_risk, ROUND(auc, 6) AS auc FROM (
      SELECT window_no, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events, AVG(event) AS event_rate, AVG(risk) AS mean_risk FROM ({WINDOWED}) w GROUP BY window_no) p
    JOIN ({auc_sql('(' + WINDOWED + ')', 'event', 'window_no')}) a ON p.window_no = a.window_no""",
)
def _(t):
    return rounded(
        ev.backtest_windows(
            t(S), "last_dt", "risk", "event", start="2000-01-01", length_days=365, step_days=120, windows=6
        )
    )


@R.add(
    "sensitivity_grid",
    """SELECT CAST(tenure AS INT) AS min_tenure, cutoff, COUNT(*) AS n, CAST(SUM(CAST(last_dt < CAST(cutoff AS TIMESTAMP) AS INT)) AS BIGINT) AS events,
      CAST(SUM(duration) AS BIGINT) AS person_time, ROUND(1000.0 * SUM(CAST(last_dt < CAST(cutoff AS TIMESTAMP) AS INT)) / SUM(duration), 6) AS rate_per_1000
    FROM {survival_base}, (SELECT unnest([90, 180, 365]) AS tenure) a, (SELECT unnest(['2000-12-01 00:00:00', '2001-02-02 00:00:00']) AS cutoff) b
    WHERE duration > tenure GROUP BY tenure, cutoff""",
)
def _(t):
    rows = t(S).select("c_custkey", "first_dt", "last_dt")
    return rounded(
        ev.sensitivity_grid(
            rows, first="first_dt", last="last_dt", tenures=[90, 180, 365],
            cutoffs=["2000-12-01 00:00:00", "2001-02-02 00:00:00"],
        )
    )


def poisson_sql(u: str) -> str:
    chance, upto, out = 0.36787944117144233, 0.0, "CASE"
    for k in range(18):
        chance = chance if k == 0 else chance / k
        upto += chance
        out += f" WHEN {u} < CAST({upto!r} AS DOUBLE) THEN {k}"
    return out + " ELSE 18 END"


BOOT = f"""SELECT r, SUM(w * event) / SUM(w) AS rate FROM (SELECT r, event, {poisson_sql("u")} AS w FROM (
      SELECT r, event, CAST('0x' || substr(md5(c_custkey || '-' || r), 1, 8) AS BIGINT) / 4294967296 AS u
      FROM {{survival_base}}, (SELECT unnest(range(1, 101)) AS r) x) y) z GROUP BY r"""


@R.add(
    "bootstrap_ci",
    f"""SELECT (SELECT ROUND(AVG(event), 6) FROM {{survival_base}}) AS estimate, ROUND(quantile_cont(rate, 0.025), 6) AS ci_lower,
      ROUND(quantile_cont(rate, 0.975), 6) AS ci_upper FROM ({BOOT}) b""",
)
def _(t):
    # a hash that the SQL side can repeat; by default the operator uses xxhash64
    uniform = F.conv(F.substring(F.md5(F.concat_ws("-", "c_custkey", "replicate")), 1, 8), 16, 10).cast("double") / 4294967296
    return rounded(ev.bootstrap_ci(t(S), "event", "c_custkey", replicates=100, uniform=uniform))


# --- drift ------------------------------------------------------------------------------------------

SPLIT = "2024-01-16 00:00:00"
EVENT_BIN = " + ".join(f"CAST(value >= cuts[{i}] AS INT)" for i in range(1, 10))


@R.add(
    "psi_drift",
    f"""SELECT bin, ROUND(e, 6) AS expected, ROUND(a, 6) AS actual, ROUND((a - e) * ln(a / e), 6) AS psi FROM (
      SELECT bin, COUNT(*) FILTER (WHERE old) / SUM(COUNT(*) FILTER (WHERE old)) OVER () AS e, COUNT(*) FILTER (WHERE NOT old) / SUM(COUNT(*) FILTER (WHERE NOT old)) OVER () AS a
      FROM (SELECT 1 + {EVENT_BIN} AS bin, ts < TIMESTAMP '{SPLIT}' AS old FROM events,
        (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM events WHERE ts < TIMESTAMP '{SPLIT}') q WHERE value IS NOT NULL) x GROUP BY bin) y""",
)
def _(t):
    events = t("events")
    return rounded(ev.psi_drift(events.where(F.col("ts") < ts(SPLIT)), events.where(F.col("ts") >= ts(SPLIT)), "value"))


@R.add(
    "rate_shift",
    """SELECT period, n, ROUND(rate, 6) AS rate, ROUND(100 * (rate - LAG(rate) OVER (ORDER BY period)) / LAG(rate) OVER (ORDER BY period), 6) AS change_pct FROM (
      SELECT CAST(year(o_orderdate) AS INT) AS period, COUNT(*) AS n, AVG(CAST(o_orderstatus = 'F' AS INT)) AS rate FROM orders GROUP BY 1) x""",
)
def _(t):
    return rounded(ev.rate_shift(t("orders"), F.year("o_orderdate"), (F.col("o_orderstatus") == "F").cast("int")))


@R.add(
    "volume_anomalies",
    """SELECT day, n, ROUND((n - AVG(n) OVER ()) / stddev(n) OVER (), 6) AS sigmas FROM (
      SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1) x""",
)
def _(t):
    return rounded(ev.volume_anomalies(t("events"), "ts"))


# --- data quality -----------------------------------------------------------------------------------


def validation_sql(label: str, left: str, right: str, lk: str, rk: str) -> str:
    return f"""SELECT '{label}' AS "join", CAST(SUM(COALESCE(l, 0)) AS BIGINT) AS left_rows, CAST(SUM(COALESCE(r, 0)) AS BIGINT) AS right_rows,
      CAST(SUM(CASE WHEN l > 0 AND r > 0 THEN l ELSE 0 END) AS BIGINT) AS matched_left_rows, CAST(SUM(CASE WHEN r IS NULL THEN l ELSE 0 END) AS BIGINT) AS orphan_left_rows,
      COUNT(*) FILTER (WHERE l IS NULL) AS unused_right_keys, CAST(0 AS BIGINT) AS null_left_keys, MAX(CASE WHEN l > 0 THEN COALESCE(r, 0) END) AS max_fan_out,
      CAST(SUM(COALESCE(l, 0) * COALESCE(r, 0)) AS DOUBLE) AS joined_rows, ROUND(SUM(CASE WHEN l > 0 AND r > 0 THEN l ELSE 0 END) / SUM(COALESCE(l, 0)), 6) AS match_rate
    FROM (SELECT {lk} AS k, COUNT(*) AS l FROM {left} GROUP BY 1) a FULL JOIN (SELECT {rk} AS k, COUNT(*) AS r FROM {right} GROUP BY 1) b ON a.k = b.k"""


@R.add(
    "join_validation",
    validation_sql("lineitem-part", "lineitem", "part", "l_partkey", "p_partkey") + " UNION ALL "
    + validation_sql("part-lineitem", "part", "lineitem", "p_partkey", "l_partkey") + " UNION ALL "
    + validation_sql("documents-labels", "documents", "labels", "doc_id", "doc_id"),
)
def _(t):
    parts = {
        "lineitem-part": quality.join_validation(t("lineitem"), t("part"), "l_partkey", "p_partkey"),
        "part-lineitem": quality.join_validation(t("part"), t("lineitem"), "p_partkey", "l_partkey"),
        "documents-labels": quality.join_validation(t("documents"), t("labels"), "doc_id", "doc_id"),
    }
    return rounded(ev.metric_by(parts, "join"))


@R.add("join_orphans", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return quality.orphans(t("documents").select("doc_id", "lang"), t("labels"), "doc_id", "doc_id")


@R.add(
    "quality_rules",
    """SELECT *, violations = 0 AS passed FROM (
      SELECT 'l_quantity not null' AS rule, COUNT(*) FILTER (WHERE l_quantity IS NULL) AS violations FROM lineitem
      UNION ALL SELECT 'l_discount in [0.01, 0.05]', COUNT(*) FILTER (WHERE l_discount NOT BETWEEN 0.01 AND 0.05) FROM lineitem
      UNION ALL SELECT 'l_returnflag in list', COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
      UNION ALL SELECT 'l_orderkey, l_linenumber unique', COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) u
      UNION ALL SELECT 'l_orderkey references o_orderkey', COUNT(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
      UNION ALL SELECT 'doc_id references doc_id', COUNT(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) x""",
)
def _(t):
    lines = t("lineitem")
    rules = [
        quality.not_null("l_quantity"), quality.in_range("l_discount", 0.01, 0.05), quality.one_of("l_returnflag", ["A", "N"]),
    ]
    return quality.quality_report(
        [
            quality.row_rules(lines, rules),
            quality.unique_rule(lines, ["l_orderkey", "l_linenumber"]),
            quality.reference_rule(lines, t("orders"), "l_orderkey", "o_orderkey"),
            quality.reference_rule(t("documents"), t("labels"), "doc_id", "doc_id"),
        ]
    )
