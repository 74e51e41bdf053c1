"""Survival operators against brute force, on one task and over several blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.operators import evaluation as ev
from catalens.operators import features as fe
from catalens.operators import modeling as mo
from catalens.operators import quality
from catalens.operators import survival as sv

SPEC = "id long, t double, e int, r double, a double, b double, g string"


def make(n=150, seed=1):
    rng = random.Random(seed)
    return [
        (i, float(rng.choice([1, 2, 3, 5, 8, 13, 21])), rng.randint(0, 1), rng.choice([0.1, 0.2, 0.2, 0.2, 0.5, rng.random()]),
         rng.gauss(0, 1), rng.gauss(2, 3), rng.choice("xxxyz"))
        for i in range(n)
    ]


@pytest.fixture(params=["one task", "blocks"])
def mode(request):
    return request.getfixturevalue("many_blocks") if request.param == "blocks" else None


@pytest.fixture()
def data(spark, mode):
    rows = make()
    return rows, spark.createDataFrame(rows, SPEC).repartition(4)


def test_c_index_counts_every_pair(data):
    rows, df = data
    comparable = concordant = tied = 0
    for _, t, e, r, *_ in rows:
        for _, t2, e2, r2, *_ in rows:
            if e and (t2 > t or (t2 == t and not e2)):
                comparable += 1
                concordant += r > r2
                tied += r == r2
    got = ev.c_index(df, "t", "e", "r").first()
    assert (got.comparable, got.concordant, got.tied) == (comparable, concordant, tied)
    assert got.c_index == pytest.approx((concordant + tied / 2) / comparable)


def test_c_index_ties_between_event_and_censoring(spark):
    df = spark.createDataFrame([(5.0, 1, 0.9), (5.0, 0, 0.1), (5.0, 1, 0.5)], "t double, e int, r double")
    got = ev.c_index(df, "t", "e", "r").first()
    # each event against the censored row, not against the other event
    assert (got.comparable, got.concordant) == (2, 2)
    alone = ev.c_index(df.where("e = 0"), "t", "e", "r").first()
    assert alone.comparable == 0 and alone.c_index is None


def km(rows):
    s, out = 1.0, {}
    for t in sorted({r[1] for r in rows}):
        n = sum(r[1] >= t for r in rows)
        d = sum(r[1] == t and r[2] == 1 for r in rows)
        s *= 1 - d / n
        out[t] = (n, d, s)
    return out


def test_kaplan_meier_per_group(data):
    rows, df = data
    got = sv.kaplan_meier(df, "t", "e", by=["g"]).collect()
    for g in "xyz":
        want = km([r for r in rows if r[6] == g])
        assert {r.time: (r.at_risk, r.events, pytest.approx(r.survival)) for r in got if r.g == g} == want
    assert all(r.ci_lower <= r.survival + 1e-12 and r.survival <= r.ci_upper + 1e-12 for r in got)


def test_kaplan_meier_reaches_zero_and_stays(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 1)], "t double, e int")
    rows = sv.kaplan_meier(df, "t", "e").orderBy("time").collect()
    assert [(r.survival, r.ci_lower, r.ci_upper) for r in rows][1] == (0.0, 0.0, 0.0)


def test_greenwood_limits(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(1, 9)], "t double, e int")
    first = sv.kaplan_meier(df, "t", "e").orderBy("time").first()
    s, v = 7 / 8, 1 / (8 * 7)
    width = sv.Z95 * math.sqrt(v) / math.log(s)
    limits = sorted(math.exp(-math.exp(math.log(-math.log(s)) + k * width)) for k in (1, -1))
    assert [first.ci_lower, first.ci_upper] == pytest.approx(limits)


def test_cumulative_incidence_adds_up(data):
    rows, df = data
    caused = df.withColumn("cause", F.col("e") * (1 + F.col("id") % 2))
    curve = km(rows)
    sums: dict[float, float] = {}
    for r in sv.cumulative_incidence(caused, "t", "cause", [1, 2]).collect():
        sums[r.time] = sums.get(r.time, 0) + r.cumulative_incidence
    assert sums == {t: pytest.approx(1 - s) for t, (_, _, s) in curve.items()}


def neg_log_partial(beta, rows, mean, scale, penalizer, ties):
    x = (np.array([[r[4], r[5]] for r in rows]) - mean) / scale
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.exp(x @ beta)
    total = 0.0
    for time in sorted(set(t[e == 1])):
        risk, dead = w[t >= time].sum(), (t == time) & (e == 1)
        d = int(dead.sum())
        total += (x[dead] @ beta).sum()
        for k in range(d):
            total -= math.log(risk - (k / d if ties == "efron" else 0) * w[dead].sum())
    return -(total - 0.5 * len(rows) * penalizer * beta @ beta)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_is_at_the_optimum(data, ties):
    rows, df = data
    model = mo.cox_ph(df, "t", "e", ["a", "b"], penalizer=0.01, ties=ties)
    x = np.array([[r[4], r[5]] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0, ddof=1)
    best = np.array(model.coefficients) * scale
    value = neg_log_partial(best, rows, mean, scale, 0.01, ties)
    assert model.log_likelihood == pytest.approx(-value)
    for i in range(2):
        for step in (1e-3, -1e-3):
            moved = best.copy()
            moved[i] += step
            assert neg_log_partial(moved, rows, mean, scale, 0.01, ties) > value


def test_cox_long_ties_are_split(spark, monkeypatch):
    rows = make(60)
    df = spark.createDataFrame(rows, SPEC)
    whole = mo.cox_ph(df, "t", "e", ["a"]).coefficients
    monkeypatch.setattr(mo, "_TIED_EVENTS_PER_ROW", 2)
    assert mo.cox_ph(df, "t", "e", ["a"]).coefficients == pytest.approx(whole)


def test_baseline_and_risk_at_horizon(spark, data):
    rows, df = data
    model = mo.cox_ph(df, "t", "e", ["a"])
    baseline = {r.time: r.survival for r in model.baseline.collect()}
    assert mo.baseline_at(model.baseline, [4, 100]) == {4: baseline[3.0], 100: baseline[21.0]}  # 3 and 5 equally near
    assert mo.horizons(365, [90, 365, 180]) == [90, 180, 365]
    scored = mo.risk_at_horizons(df, model.baseline, model.log_partial_hazard(), [4]).first()
    xb = (scored.a - model.means[0]) * model.coefficients[0]
    assert scored.risk_4 == pytest.approx(1 - baseline[3.0] ** math.exp(xb))


def test_discrete_time_hazard(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 400), rng.randint(0, 1), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t int, e int, a double")
    coefficients, periods = mo.discrete_time_hazard(df, "t", "e", ["a"], width=100)
    assert [r.feature for r in coefficients.collect()] == ["intercept", "interval", "a"]
    fitted = periods.agg(F.sum("hazard"), F.sum("interval_event")).first()
    assert fitted[0] == pytest.approx(fitted[1], rel=1e-4)  # logistic fits match the event total
    risk = mo.risk_from_hazards(periods, "id", upto=2).agg(F.min("risk"), F.max("risk")).first()
    assert 0 < risk[0] < risk[1] < 1


def test_lift_sizes_and_guards(data):
    rows, df = data
    table = ev.lift_table(df, "r", "e", "id", groups=7).orderBy("decile").collect()
    assert [r.n for r in table] == [21] * 6 + [24]
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert [r.events for r in table] == [sum(x[2] for x in order[i * 21 : (i + 1) * 21 if i < 6 else None]) for i in range(7)]
    assert table[-1].cumulative_capture == pytest.approx(1.0)
    few = ev.lift_table(df.where("id < 3").withColumn("e", F.lit(0)), "r", "e", "id").collect()
    assert [(r.decile, r.n, r.lift, r.cumulative_capture) for r in few] == [(10, 3, None, None)]


def test_auc_matches_pairs(data):
    rows, df = data
    pairs = [(p[3] > n[3]) + 0.5 * (p[3] == n[3]) for p in rows if p[2] for n in rows if not n[2]]
    assert ev.auc(df, "e", "r").first().auc == pytest.approx(sum(pairs) / len(pairs))


def test_horizon_label_leaves_out_early_censoring(spark):
    df = spark.createDataFrame([(5, 1), (5, 0), (20, 0), (20, 1), (10, 1), (10, 0)], "t int, e int")
    assert [r.y for r in df.select(ev.horizon_label("t", "e", 10).alias("y")).collect()] == [1, None, 0, 0, 1, 0]


def test_calibration_bins_match_digitize(data):
    rows, df = data
    r = np.array([x[3] for x in rows])
    cuts = np.percentile(r, np.linspace(0, 100, 11))
    index = np.digitize(r, cuts[1:-1])
    want = {int(i) + 1: (int((index == i).sum()), pytest.approx(r[index == i].mean())) for i in set(index)}
    assert {b.bin: (b.n, b.mean_predicted) for b in ev.calibration_bins(df, "r", "e").collect()} == want


def test_capacity_and_decision_curve(data):
    rows, df = data
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    got = {r.capacity: r.events for r in ev.capacity_coverage(df, "r", "e", "id", [10, 40, 1000]).collect()}
    assert got == {c: sum(x[2] for x in order[:c]) for c in (10, 40, 1000)}
    curve = {r.threshold: (r.true_positives, r.false_positives) for r in ev.decision_curve(df, "r", "e", [0.2, 0.5]).collect()}
    assert curve == {c: (sum(x[3] >= c and x[2] for x in rows), sum(x[3] >= c and not x[2] for x in rows)) for c in (0.2, 0.5)}


def test_bootstrap_interval_covers_the_rate(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    row = ev.bootstrap_ci(df, "y", "id", replicates=200).first()
    assert row.ci_lower < row.estimate == 0.25 < row.ci_upper
    assert row.ci_upper - row.ci_lower == pytest.approx(4 * math.sqrt(0.25 * 0.75 / 2000), rel=0.3)
    weights = spark.range(100_000).select(ev.poisson_weight(ev.hashed_uniform("id")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert weights[0] == pytest.approx(1, abs=0.02) and weights[1] == pytest.approx(1, abs=0.03)


def test_lookback_edges_and_hot_entity(spark, many_blocks):
    day = "2024-01-{:02d} 00:00:00"
    events = [("hot", day.format(d), 1.0) for d in range(1, 29)] + [("cold", day.format(5), 7.0)]
    df = spark.createDataFrame(events, "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    origins = spark.createDataFrame([("hot", day.format(10)), ("hot", day.format(20)), ("cold", day.format(4)), ("none", day.format(4))], "k string, at string")
    origins = origins.withColumn("at", F.col("at").cast("timestamp"))
    got = {
        (r.k, r["at"].day): (r.events_3d, r.v_3d, r.events_30d)
        for r in fe.lookback_features(df, origins, entity="k", time="ts", origin="at", days=[3, 30], value="v").collect()
    }
    # the event at the origin counts, the one exactly three days before does not
    assert got == {("hot", 10): (3, 3.0, 10), ("hot", 20): (3, 3.0, 20), ("cold", 4): (0, 0.0, 0), ("none", 4): (0, 0.0, 0)}


def test_asof_takes_the_latest_at_or_before(spark, many_blocks):
    base = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 5)], "id int, k string, at int")
    known = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 6, 60.0), ("c", 1, 1.0)], "k string, seen int, v double")
    out = fe.asof_covariate(base, known, entity="k", at="at", time="seen", values=["v"])
    assert {r.id: (r.covariate_time, r.v) for r in out.collect()} == {1: (5, 50.0), 2: (None, None), 3: (None, None), 4: (5, 50.0)}


def test_overlaps_look_past_the_previous_row(spark, many_blocks):
    rows = [("a", 1, 100, 1), ("a", 5, 8, 2), ("a", 50, 60, 3), ("a", 100, 101, 4), ("b", 50, 60, 5)]
    df = spark.createDataFrame(rows, "k string, s int, f int, id int")
    got = sv.overlapping_periods(df, "k", "s", "f", "id")
    assert sorted(r.id for r in got.collect()) == [2, 3]
    assert sv.overlap_summary(got, "k").first().overlaps == 2


def test_cohort_flow_treats_null_as_failed(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (None, 7)], "x int, y int")
    flow = sv.cohort_flow(df, [("x", F.col("x") > 0), ("y", F.col("y") > 0)]).orderBy("step").collect()
    assert [(r.name, r.remaining, r.excluded) for r in flow] == [("initial", 3, 0), ("x", 2, 1), ("y", 1, 1)]


def test_survival_checks(spark):
    good = spark.createDataFrame([(1, 0), (2, 1)], "t int, e int")
    bad = spark.createDataFrame([(-1, 0), (2, 2), (3, None)], "t int, e int")
    assert tuple(sv.survival_checks(good, "t", "e").first()) == (True, True, True)
    assert tuple(sv.survival_checks(bad, "t", "e", minimum=0).first()) == (False, False, False)


def test_feature_helpers(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (100.0, None), (2.0, "z")], "x double, c string")
    low, high = np.percentile([1.0, 2.0, 100.0], [5, 95])
    assert [r.x_w for r in fe.winsorize(df, "x", lower=0.05, upper=0.95).collect()] == [pytest.approx(low), None, pytest.approx(high), 2.0]
    codes = fe.encode_categories(df.unionByName(df), "c").collect()
    assert sorted((r.c or "", r.c_code or 0) for r in codes) == sorted([("a", 1), ("b", 2), ("", 0), ("z", 3)] * 2)
    row = df.select(*fe.one_hot("c", ["a", "b"]), fe.ordinal("c", ["z", "a"]), fe.binned("x", [1, 50])).collect()
    assert [tuple(r) for r in row] == [(1, 0, 2, 1), (0, 1, None, None), (0, 0, None, 2), (0, 0, 1, 1)]


def test_join_validation_and_rules(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    row = quality.join_validation(left, right, "k", "k").first()
    assert (row.left_rows, row.matched_left_rows, row.orphan_left_rows, row.unused_right_keys, row.max_fan_out, row.joined_rows) == (4, 2, 2, 1, 2, 4)
    assert row.null_left_keys == 1
    rules = [quality.not_null("k"), quality.in_range("k", 1, 1), quality.one_of("k", [1, 2])]
    report = quality.quality_report(
        [quality.row_rules(left, rules), quality.unique_rule(left, ["k"]), quality.reference_rule(left, right, "k", "k")]
    )
    assert [(r.violations, r.passed) for r in report.collect()] == [(1, False), (1, False), (0, True), (1, False), (1, False)]


def test_psi_is_zero_for_the_same_data(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 101).cast("double").alias("v"))
    assert ev.psi_drift(df, df, "v").agg(F.sum("psi")).first()[0] == pytest.approx(0)
    shifted = df.withColumn("v", F.col("v") + 500)
    assert ev.psi_drift(df, shifted, "v").agg(F.sum("psi")).first()[0] > 1


def test_rows_without_a_risk_are_in_no_bin(spark):
    from catalens.operators.evaluation import calibration_bins, threshold_tiers

    rows = [(i / 10, i % 2) for i in range(10)] + [(None, 1), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "risk double, event int")
    assert sum(r.n for r in calibration_bins(df, "risk", "event", bins=2).collect()) == 10
    assert sum(r.n for r in threshold_tiers(df, "risk", "event").collect()) == 10


def test_lookback_sums_keep_their_digits(spark, many_blocks):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1), 1e17), (1, datetime(2024, 2, 1), 1.5), (1, datetime(2024, 2, 2), -0.25), (2, datetime(2024, 1, 1), 1e30)]
    events = spark.createDataFrame(rows, "who int, at timestamp, v double")
    origins = spark.createDataFrame([(1, datetime(2024, 2, 3)), (2, datetime(2024, 2, 3)), (2, datetime(2024, 1, 1))], "who int, o timestamp")
    out = fe.lookback_features(events, origins, entity="who", time="at", origin="o", days=[7], value="v")
    assert {(r.who, r.o.month): (r.events_7d, r.v_7d) for r in out.collect()} == {(1, 2): (2, 1.25), (2, 2): (0, 0.0), (2, 1): (1, 1e30)}


def test_durations_of_rows_without_event_status(spark):
    df = spark.createDataFrame([(1, 1), (3, None), (5, None)], "t int, e int")
    assert {r.e: (r.n, r.median_duration) for r in sv.duration_stats(df, "t", "e").collect()} == {1: (1, 1.0), None: (2, 4.0)}
    assert {(r.e, r.t): r.ecdf for r in sv.duration_ecdf(df, "t", "e").collect()} == {(1, 1): 1.0, (None, 3): 0.5, (None, 5): 1.0}


def penalised_logistic(x, y, penalty):
    """Plain numpy: long gradient-free Newton on standardised columns, intercept unpenalised."""
    means, scales = x.mean(axis=0), x.std(axis=0, ddof=1)
    design = np.column_stack([np.ones(len(y)), (x - means) / scales])
    pull = np.diag([0.0, *[penalty * len(y)] * x.shape[1]])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + pull, design.T @ (y - p) - pull @ beta)
    slopes = beta[1:] / scales
    return [beta[0] - slopes @ means, *slopes]


@pytest.mark.parametrize("penalty", [0.0, 0.05])
def test_discrete_time_hazard_against_numpy(spark, penalty):
    rng = np.random.default_rng(4)
    rows = [(int(d), int(e), float(a)) for d, e, a in zip(rng.integers(0, 500, 300), rng.integers(0, 2, 300), rng.normal(size=300))]
    df = spark.createDataFrame(rows, "t int, e int, a double")
    found, _ = mo.discrete_time_hazard(df, "t", "e", ["a"], width=100, regularization=penalty)
    long = [(k, a, e if k == t // 100 else 0) for t, e, a in rows for k in range(t // 100 + 1)]
    want = penalised_logistic(np.array([r[:2] for r in long], float), np.array([r[2] for r in long], float), penalty)
    assert [r.coef for r in found.collect()] == pytest.approx(want, abs=1e-8)


def test_discrete_time_hazard_odd_features(spark):
    rows = [(250, 1, 0.5, 1.0), (120, 0, None, 1.0), (90, 1, float("nan"), 1.0), (310, 0, 0.1, 1.0), (40, 1, 0.9, 1.0), (220, 1, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "t int, e int, a double, c double")
    found, periods = mo.discrete_time_hazard(df, "t", "e", ["a", "c"], width=100, regularization=0.01)
    coefficients = {r.feature: r.coef for r in found.collect()}
    assert coefficients["c"] == 0 and all(np.isfinite(v) for v in coefficients.values())
    assert periods.count() == 3 + 2 + 1 + 4 + 1 + 3  # rows outside the fit stay
    with pytest.raises(ValueError):
        mo.discrete_time_hazard(df.withColumn("e", df.e * 0), "t", "e", ["a"], width=100)
