"""Rules of the panel, rating, event and model operators on small tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterdeck.functions import learners as L
from quarterdeck.functions import outlooks as o
from quarterdeck.functions.tdist import upper_tail
from quarterdeck.operators import evaluation as e
from quarterdeck.operators import events as ev
from quarterdeck.operators import fits
from quarterdeck.operators import models as mo
from quarterdeck.operators import pit
from quarterdeck.operators import quality as qu
from quarterdeck.operators import ratings as ra
from quarterdeck.operators import sharded as sh
from quarterdeck.sources import files as fs

D = dt.date


def test_asof_takes_the_latest_row_even_if_null(spark):
    facts = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, 1), ("a", D(2020, 2, 1), None, 2), ("a", D(2020, 2, 1), 7.0, 1)], "k string, d date, v double, t int")
    left = spark.createDataFrame([("a", D(2020, 1, 31)), ("a", D(2020, 2, 1)), ("a", D(2019, 1, 1)), ("b", D(2020, 2, 1))], "k string, day date")
    got = {(r.k, r.day): r.v for r in pit.asof_backward(left, facts, ["k"], "day", "d", ["v"], [F.col("t")]).collect()}
    assert got == {("a", D(2020, 1, 31)): 1.0, ("a", D(2020, 2, 1)): None, ("a", D(2019, 1, 1)): None, ("b", D(2020, 2, 1)): None}


def test_bounded_lookup_includes_both_ends(spark):
    daily = spark.createDataFrame([("a", D(2020, 1, 10), 1.0, 1), ("a", D(2020, 1, 25), None, 2)], "k string, d date, v double, t int")
    days = [D(2020, 1, 9), D(2020, 1, 10), D(2020, 1, 20), D(2020, 1, 21), D(2020, 1, 26)]
    got = {r.a: r.v for r in pit.bounded_lookup(spark.createDataFrame([("a", x) for x in days], "k string, a date"), daily, ["k"], "a", "d", "v", 10, "t").collect()}
    assert got == {days[0]: None, days[1]: 1.0, days[2]: 1.0, days[3]: None, days[4]: None}


def test_zscore_needs_ten_values_and_a_deviation(spark):
    base = D(2020, 1, 1)
    rows = [("a", base + dt.timedelta(days=i), float(i)) for i in range(12)] + [("b", base + dt.timedelta(days=i), 5.0) for i in range(12)] + [("c", base, 1.0)]
    anchors = spark.createDataFrame([(k, base + dt.timedelta(days=11)) for k in "abc"], "k string, a date")
    got = {r.k: r.zscore for r in pit.trailing_zscore(anchors, spark.createDataFrame(rows, "k string, d date, v double"), ["k"], "a", "d", "v", 364).collect()}
    x = np.arange(12.0)
    assert got["a"] == pytest.approx((11 - x.mean()) / x.std(ddof=1)) and got["b"] is None and got["c"] is None


def test_truncation_changes_no_earlier_zscore(spark):
    base, rng = D(2020, 1, 1), np.random.default_rng(0)
    rows = [("a", base + dt.timedelta(days=i), float(x)) for i, x in enumerate(rng.normal(size=60))]
    anchors = spark.createDataFrame([("a", base + dt.timedelta(days=i)) for i in (15, 25, 35)], "k string, a date")
    full, cut = (sorted(map(tuple, pit.trailing_zscore(anchors, spark.createDataFrame(r, "k string, d date, v double"), ["k"], "a", "d", "v", 20).collect())) for r in (rows, rows[:36]))
    assert full == cut


@pytest.mark.parametrize(
    "rating, outlook, want",
    [("BBB (Positive)", None, ("BBB", "Positive")), ("(P)B1", "Stable", ("B1", "Stable")), ("(Negative)", " ", (None, "Negative")), (" AA ", "n", ("AA", "n")), (None, None, (None, None)), ("  ", "x", (None, "x")), ("BB (Stable)", "Negative", ("BB", "Negative"))],
)
def test_letters_and_outlooks(spark, rating, outlook, want):
    r = spark.createDataFrame([(rating, outlook)], "r string, o string").select(o.letters_of(F.col("r")), o.outlook_of(F.col("r"), F.col("o"))).first()
    assert tuple(r) == want


@pytest.mark.parametrize(
    "a, b, agree, best",
    [("Stable", None, True, "Stable"), ("NR", "Positive", True, "Positive"), ("Negative watch", "Under Review", True, "Negative watch"), ("Negative", "Negative watch", True, "Negative watch"), ("Stable", "Positive", False, "Stable"), ("Under Review", "Negative", False, "Under Review"), (None, "NR", True, None)],
)
def test_outlook_agreement(spark, a, b, agree, best):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(o.outlooks_agree(F.col("a"), F.col("b")), o.preferred_outlook(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (agree, best)
    t = spark.createDataFrame([(a, b)], "a string, b string").select(o.agreement_ties(F.col("a")), o.agreement_ties(F.col("b"))).first()
    assert (not t[0] or not t[1] or bool(set(t[0]) & set(t[1]))) == agree


def _row(i, day, rating, outlook):
    return (i, "c", "x", D(2020, 5, day), rating, outlook, f"s{i}")


def test_reconcile_is_greedy_and_pairs_leftovers(spark):
    schema = "row_id bigint, country string, agency string, date date, rating string, outlook string, source string"
    p = [_row(1, 3, "BBB", None), _row(2, 4, "BBB", "Stable"), _row(3, 5, "A", None), _row(4, 6, "A-", None), _row(9, 6, "A-", None)]
    s = [_row(11, 3, "Baa2", "Stable"), _row(12, 20, "B", "Positive")]
    pairs = ra.reconcile(spark.createDataFrame(p, schema), spark.createDataFrame(s, schema))
    got = {(r.status, r.p and r.p.row_id, r.s and r.s.row_id) for r in pairs.collect()}
    assert got == {("matched", 1, 11), ("conflict", 2, 12), ("primary_only", 3, None), ("primary_only", 4, None)}
    rules = spark.createDataFrame([("x", D(2020, 5, 4), D(2020, 5, 20), "ce ", "late", 2), ("x", D(2020, 5, 4), D(2020, 5, 20), " ge", "first", 1)], "agency string, p_date date, s_date date, chosen_source string, note string, entry int")
    assert [(r.resolution, r.chosen_source, r.note) for r in ra.adjudicated(pairs, rules).collect()] == [("resolved", "GE", "first")]
    assert [r.resolution for r in ra.adjudicated(pairs, rules.limit(0)).collect()] == ["OPEN"]
    none = spark.createDataFrame([], schema)
    out = {(r.date.day, r.rating, r.outlook, r.source) for r in ra.merged(pairs, none, rules).collect()}
    assert out == {(3, "Baa2", "Stable", "s11 (confirmed by s1)"), (4, "BBB", "Stable", "s2 (conflict resolved: first)"), (5, "A", None, "s3"), (6, "A-", None, "s4")}
    assert ra.merged(pairs, none, rules.limit(0)).count() == 3 and ra.reconcile(none, none).count() == 0


def test_queues_match_as_the_plain_search_does():
    rng = random.Random(9)
    for _ in range(300):
        row = lambda: (rng.choice([5, 6, None]), frozenset(rng.sample(["=a", "~a", "watch", "=b"], rng.randint(0, 2))))
        p, s = [row() for _ in range(rng.randint(0, 8))], [row() for _ in range(rng.randint(0, 8))]
        free, matched = list(range(len(s))), []
        for i, (o_, t) in enumerate(p):
            hit = next((j for j in free if s[j][0] == o_ and (not t or not s[j][1] or t & s[j][1])), None)
            if hit is not None:
                free.remove(hit)
                matched.append((i, hit))
        got = ra.match_bucket(p, s)
        assert [(i, j) for k, i, j in got if k == "matched"] == matched
        assert sorted(i for _, i, _ in got if i is not None) == list(range(len(p))) and sorted(j for _, _, j in got if j is not None) == list(range(len(s)))


def test_stale_corrections_show(spark):
    log = spark.createDataFrame([("x", D(2020, 1, 1), " A "), ("x", D(2020, 1, 2), "B")], "agency string, date date, rating string")
    c = spark.createDataFrame([("x", D(2020, 1, 1), "A", "BBB"), ("x", D(2020, 1, 2), "C", "D")], "agency string, date date, wrong_rating string, corrected_rating string")
    fixed, stale = ra.apply_corrections(log, c)
    assert sorted(r.rating for r in fixed.collect()) == ["B", "BBB"] and [r.wrong_rating for r in stale.collect()] == ["C"]
    assert sorted(r.rating for r in ra.corrected(log, c.filter("wrong_rating = 'A'")).collect()) == ["B", "BBB"]
    with pytest.raises(Exception, match="stale or mistyped correction"):
        ra.corrected(log, c).collect()


def test_event_status_ladder(spark):
    scores = [("a", D(2020, 1, 1) + dt.timedelta(days=91 * i), float(i)) for i in range(10)]
    events = [(1, "a", D(2022, 1, 15)), (2, "a", D(2019, 1, 1)), (3, "a", D(2030, 1, 1)), (4, "a", D(2020, 8, 1)), (5, "b", D(2021, 1, 1))]
    got = {r.id: r for r in ev.event_windows(spark.createDataFrame(events, "id int, c string, d date"), spark.createDataFrame(scores, "c string, s date, v double"), "id", "c", "d", "s", "v").collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "no_preceding_data", 3: "event_after_panel_end", 4: "insufficient_history", 5: "no_preceding_data"}
    assert got[1].near_mean == 6.5 and got[1].baseline_mean == 2.5 and got[1].diff == 4.0


def test_published_t_tests():
    assert upper_tail(0.834, 35) == pytest.approx(0.204966, abs=3e-5)
    assert upper_tail(4.318, 210) == pytest.approx(1.21e-5, rel=0.01)
    assert upper_tail(-4.318, 210) == pytest.approx(1 - 1.21e-5, rel=1e-6) and upper_tail(0.0, 3) == pytest.approx(0.5)


def test_auc_ic_ari_by_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s, x = rng.integers(0, 2, 60), rng.integers(0, 8, 60) / 8.0, rng.integers(0, 5, 60) / 5.0
    df = spark.createDataFrame([("k", int(a), float(b), float(c)) for a, b, c in zip(y, s, x)], "k string, y int, s double, x double")
    wins = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert e.roc_auc(df, ["k"], "y", "s").first().auc == pytest.approx(np.mean(wins))
    ranks = [np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v]) for v in (s, x)]
    assert e.information_coefficient(df, ["k"], "s", "x").first().ic == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert e.adjusted_rand(df.withColumn("z", F.col("y") + 5), ["k"], "y", "z").first().ari == pytest.approx(1.0)
    assert e.information_coefficient(df.limit(2), ["k"], "s", "x").first().ic is None
    assert e.roc_auc(df.withColumn("y", F.lit(1)), ["k"], "y", "s").first().auc is None


def test_mad_skips_constant_groups(spark):
    rows = [("a", float(v)) for v in [1, 2, 2, 3, 50]] + [("b", 4.0)] * 5 + [("b", 99.0)]
    got = qu.mad_outliers(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    assert [(r.k, r.v) for r in got] == [("a", 50.0)]


def test_infer_actions(spark):
    rows = [(1, "x", D(2020, 1, 1), 5, None, ""), (2, "x", D(2020, 2, 1), 5, "Stable", None), (3, "x", D(2020, 3, 1), 5, None, None), (4, "x", D(2020, 4, 1), 5, "Negative", None), (5, "x", D(2020, 5, 1), 7, None, " "), (6, "x", D(2020, 6, 1), 6, None, None), (7, "x", D(2020, 7, 1), 9, None, " affirm ")]
    df = spark.createDataFrame(rows, "i int, k string, d date, rating_numeric int, outlook string, action string")
    got = {r.i: r.inferred_action for r in ra.infer_actions(df, ["k"], ["d"]).collect()}
    assert got == {1: "initial", 2: "affirm", 3: "affirm", 4: "outlook_change", 5: "downgrade", 6: "upgrade", 7: "affirm"}


def _panel(spark, quarters=16, entities=8):
    rng = np.random.default_rng(5)
    rows = []
    for q in range(quarters):
        day = (D(2015 + q // 4, 3 * (q % 4) + 3, 1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
        end = day + dt.timedelta(days=91)
        for k in range(entities):
            f = rng.normal(k % 2 * 3, 1, 3)
            rows.append((len(rows), f"e{k}", day, end, *(float(x) for x in f), float(f[0] / 50 + rng.normal(0, 0.01)), q < quarters - 1))
    return spark.createDataFrame(rows, "panel_id bigint, country_code string, rebal_date date, target_period_end date, a double, b double, c double, excess_return double, target_realized boolean")


def test_labels_and_scores_are_truncation_invariant(spark):
    p = _panel(spark).cache()
    cut = p.filter("rebal_date <= '2017-06-30'")
    for run, cols in (
        (lambda d: mo.label_panel(d, ["a", "b", "c"], "gmm", k=2, proxy="a"), ["panel_id", "risk_label"]),
        (lambda d: mo.label_panel(d, ["a", "b", "c"], k=2, proxy="a"), ["panel_id", "risk_label", "risk_score"]),
        (lambda d: mo.score_panel(d, ["a", "b", "c"]), ["panel_id", "signal_status", "predicted_excess_return", "predicted_prob_positive"]),
    ):
        full = run(p).filter("rebal_date <= '2017-06-30'").select(*cols).orderBy("panel_id").toPandas()
        part = run(cut).select(*cols).orderBy("panel_id").toPandas()
        assert full.equals(part) and len(part) == 80


def test_no_training_target_ends_after_its_fold(spark):
    s = mo.score_panel(_panel(spark), ["a", "b", "c"]).toPandas()
    used = s.dropna(subset=["training_window_max_target_period_end"])
    assert (used.training_window_max_target_period_end <= used.rebal_date).all() and (s.signal_status == "scored").any()
    assert (s[s.training_window_n_rows < 20].signal_status == "insufficient_data").all()


def test_learners_find_structure():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.3, (60, 2))])
    truth = np.repeat([0, 1], 60)
    for label in (L.kmeans(x, 2)[1], L.gaussian_mixture(x, 2)[0], L.density_clusters(x, 10)[0]):
        assert len({(t, g) for t, g in zip(truth, label) if g >= 0}) == 2
    label, _, _, predict = L.gaussian_mixture(x, 2)
    assert (predict(x) == label).all()
    y = 2 * x[:, 0] + rng.normal(0, 0.05, 120)
    w, b = L.lasso(x, y, 0.001)
    assert abs(x @ w + b - y).mean() < 0.1
    for p in (L.fit_forest(x, y, 20).predict(x), L.fit_boosted(x, y, False, 100).predict(x)):
        assert np.corrcoef(p, y)[0, 1] > 0.98
    w, b = L.logistic_l1(x, truth)
    assert (((x @ w + b) > 0) == truth).all() and L.silhouette(x, truth) > 0.8
    assert mo.tier_of(0, 1) == "core-eligible" and [mo.tier_of(r, 2) for r in (0, 1)] == ["core-eligible", "satellite-candidate"]


def _wide(spark, x, day=D(2020, 3, 31)):
    """A panel of one quarter with the rows of ``x`` as a, b, c."""
    return spark.createDataFrame([(i, f"e{i}", day, *map(float, r)) for i, r in enumerate(x)], "panel_id bigint, country_code string, rebal_date date, a double, b double, c double")


def test_density_labels_use_every_row_of_a_large_window(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(m, 0.2, (n, 3)) for m, n in ((0, 2955), (6, 2955), (3, 90))])
    got = mo.label_panel(_wide(spark, x), ["a", "b", "c"], "hdbscan", k=10, proxy="a").toPandas().sort_values("panel_id")
    label = got.raw_cluster_label.to_numpy(int)
    assert set(got.training_window_n_rows) == {6000}
    few = label[5910:]  # 90 rows are a cluster: 1 % is 60 of the 6000 rows, but 90 rows are under 60 of a sample of 2000
    assert (few >= 0).mean() > 0.9 and len(set(few[few >= 0])) == 1 and not set(few[few >= 0]) & set(label[:5910])
    assert set(got.risk_label[5910:][few >= 0]) == {"excluded"} and {"core-eligible", "satellite-candidate"} <= set(got.risk_label[:5910])


def test_risk_scores_come_from_every_row_of_a_large_window(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(m, 1.0, (n, 3)) for m, n in ((0, 15000), (3, 10000))])
    x[rng.random(x.shape) < 0.05] = np.nan
    panel = _wide(spark, x).select("panel_id", "country_code", "rebal_date", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abc"))
    got = mo.label_panel(panel, ["a", "b", "c"], k=2, proxy="a").toPandas().sort_values("panel_id")
    ok = (~np.isnan(x)).sum(axis=1) >= 2
    z = np.where(np.isnan(x[ok]), np.nanmedian(x[ok], axis=0), x[ok])
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    side = got.raw_cluster_label.to_numpy()[ok].astype(int)
    c = np.array([z[side == g].mean(axis=0) for g in (0, 1)])  # a fixed point of Lloyd's steps over all rows, as good as the best of ten starts
    means = [np.nanmean(x[ok][side == g, 0]) for g in (0, 1)]
    d = np.sqrt(((z[:, None] - c[np.argsort(means)][None]) ** 2).sum(axis=2))
    assert (np.sqrt(((z[:, None] - c[None]) ** 2).sum(axis=2)).argmin(axis=1) == side).all()
    assert (d.min(axis=1) ** 2).sum() <= 1.001 * L.kmeans(z, 2)[2]
    assert set(got.training_window_n_rows) == {ok.sum()} and ok.sum() > 20000
    assert got.risk_score.to_numpy()[ok] == pytest.approx(d[:, 0] / d.sum(axis=1), abs=1e-9) and np.isnan(got.risk_score.to_numpy()[~ok]).all()


def test_models_are_scaled_by_the_whole_window_and_lasso_takes_all_of_it(spark):
    p = _panel(spark, 6, 60)
    registry = {"regression": {"lasso": None, "forest": lambda x, y: L.fit_forest(x, y, 5, 2)}}
    got = mo.walk_forward(p, ["a", "b", "c"], most_rows=40, registry=registry).toPandas()
    rows = p.toPandas().sort_values("panel_id")
    assert set(got.model) == {"lasso", "forest"}
    for (day, model), g in got.groupby(["rebal_date", "model"]):
        train = rows[(rows.target_period_end <= day) & rows.target_realized]
        x, a = L.impute_scale(train[["a", "b", "c"]].to_numpy(), rows.set_index("panel_id").loc[g.panel_id, ["a", "b", "c"]].to_numpy(), keep_empty=True)
        y = train.excess_return.to_numpy()
        assert set(g.training_window_n_rows) == {len(train)}
        if model == "lasso":
            w, b = L.lasso(x, y, 0.01)
            assert set(g.n_train) == {len(train)} and g.predicted.to_numpy() == pytest.approx(a @ w + b)
            continue
        ids = spark.createDataFrame([(int(i),) for i in train.panel_id], "panel_id bigint").withColumn("u", F.pmod(F.xxhash64("panel_id"), F.lit(1_000_003)) / 1_000_003.0).toPandas()
        use = (ids.u < 40 / len(train)).to_numpy()
        assert set(g.n_train) == {use.sum()} and 0 < use.sum() < len(train)
        assert g.predicted.to_numpy() == pytest.approx(L.fit_forest(x[use], y[use], 5, 2).predict(a))
    s = mo.score_panel(p, ["a", "b", "c"], most_rows=40).toPandas()
    s = s[s.signal_status == "scored"]
    assert len(s) and (s.n_train < s.training_window_n_rows).all()


def test_medians_of_prefixes_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (700, 2)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    day = rng.integers(0, 12, 700)
    df = spark.createDataFrame([(int(k), *(None if np.isnan(v) else float(v) for v in r)) for k, r in zip(day, x)], "day int, a double, b double")
    got = sh.prefix_medians(df, "day", ["a", "b"], [-1, 0, 5, 11])
    assert np.isnan(got[0]).all()
    for i, until in ((1, 0), (2, 5), (3, 11)):
        assert got[i] == pytest.approx(np.nanmedian(x[day <= until], axis=0))
    assert sh.medians(df.limit(0), ["a", "b"]) == [None, None]


@pytest.mark.parametrize("most", [10**6, 40])
def test_ranges_change_no_scan(spark, most):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "x", None]), rng.randint(0, 20), rng.choice([None, "u", "v"])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string, t int, v string")
    out = sh.scan(df.repartition(3), ["k"], [F.col("t"), F.col("i")], "n", {"was": F.col("v"), "t_was": F.col("t")}, {"last": F.col("v")}, "all", most).collect()
    got = {r.i: (r.n, r.was, r.t_was, r["last"], r["all"], r.v) for r in out}
    for key in ("hot", "x", None):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        last = None
        for n, r in enumerate(mine):
            prev = mine[n - 1] if n else None
            assert got[r[0]] == (n + 1, prev and prev[3], prev and prev[2], last, len(mine), r[3])
            last = r[3] or last
    counts = df.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"))
    below = {(r.k, r.t): r.below for r in sh.running_counts(counts, ["k"], "t", "n", most // 10).collect()}
    assert below == {(k, t): sum(1 for r in rows if r[1] == k and r[2] < t) for k, t in {(r[1], r[2]) for r in rows}}
    parts = spark.range(1, 12).select(sh.share_of(F.col("id"), F.lit(11), 3).alias("p"), F.ntile(3).over(Window.orderBy("id")).alias("q")).collect()
    assert all(r.p == r.q for r in parts)


def test_density_sweep_shares_its_distances(spark):
    """Every task takes a share of the rows, once for all sizes; labels are those of all pairs in one place."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(m, 0.4, (n, 2)) for m, n in ((0, 140), (4, 90), (8, 30))])
    rows = spark.createDataFrame([(5 * i, *map(float, r)) for i, r in enumerate(x)], "id bigint, x0 double, x1 double").repartition(3)
    job = fits.Job(0, 0, len(x), np.zeros(2), np.zeros(2), np.ones(2), np.ones(2, bool))
    got = mo._density_sweep(rows, 2, job, [10, 40]).toPandas().sort_values("id")
    for name, least, groups in (("hd0", 10, 3), ("hd1", 40, 2)):
        assert (got[name].to_numpy() == L.density_clusters(x, least)[0]).all() and got[got[name] >= 0][name].nunique() == groups


def test_sweep_figures_are_of_all_rows(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(m, 0.3, (n, 3)) for m, n in ((0, 1500), (5, 1500))])
    got = mo.cluster_sweep(_wide(spark, x), {"t": ["a", "b", "c"]}, range(2, 3), (0.02,)).toPandas().set_index("algorithm")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    side = np.repeat([0, 1], 1500)
    cost = sum(((z[side == g] - z[side == g].mean(axis=0)) ** 2).sum() for g in (0, 1))
    assert set(got.n) == {3000} and got.k_or_mcs["hdbscan"] == 60 and set(got.n_clusters_found) == {2}
    assert got.cost["kmeans"] == pytest.approx(cost) and got.silhouette["kmeans"] == pytest.approx(L.silhouette(z, side))


def test_mixtures_maximise_the_likelihood_of_all_rows(spark):
    """Against the same algorithm in one array, and against the definition of a component's parameters."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.multivariate_normal([0, 0, 0], np.diag([1, 0.2, 0.5]), 700), rng.multivariate_normal([4, 4, 0], np.eye(3) * 0.6, 500)])
    rows = fits.prepared(_wide(spark, x), ["a", "b", "c"], F.lit("1970-01-01").cast("date"), {"id": F.col("panel_id")})
    job = fits.Job(0, 2)
    fits.standards(rows, 3, [job])
    fits.kmeans(rows, "id", 3, [job])
    fits.mixtures(rows, 3, [job])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    label, ll, _, _ = L.gaussian_mixture(z, 2)
    mine = fits.log_density(z, job.parts).argmax(axis=1)
    assert (mine == label).all() or (mine == 1 - label).all()
    assert job.likelihood == pytest.approx(ll, rel=1e-4)
    top = fits.log_density(z, job.parts)
    assert job.likelihood <= np.log(np.exp(top).sum(axis=1)).sum() + 1e-6
    own = [z[mine == g] for g in (0, 1)]
    assert sorted(p[0] for p in job.parts) == pytest.approx(sorted(len(o_) / len(z) for o_ in own), abs=0.01)


def test_silhouettes_by_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(mo, "QUERY_ROWS", 60)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (250, 2))
    one, two = rng.integers(0, 3, 250), np.where(rng.random(250) < 0.2, -1, rng.integers(0, 2, 250))
    df = spark.createDataFrame([(i, *map(float, r), int(a), int(b)) for i, (r, a, b) in enumerate(zip(x, one, two))], "id bigint, x0 double, x1 double, one int, two int")
    job = fits.Job(0, 0, 250, np.zeros(2), np.zeros(2), np.ones(2), np.ones(2, bool))
    got = mo._silhouettes(df, 2, ["one", "two"], job)
    assert got["one"] == pytest.approx(L.silhouette(x, one)) and got["two"] == pytest.approx(L.silhouette(x[two >= 0], two[two >= 0]))


def test_silhouettes_take_as_many_jobs_for_many_blocks_as_for_few(spark, monkeypatch):
    monkeypatch.setattr(mo, "QUERY_ROWS", 6)
    rng = np.random.default_rng(5)
    x, label = rng.normal(0, 1, (240, 2)), rng.integers(0, 3, 240)
    df = spark.createDataFrame([(i, *map(float, r), int(a)) for i, (r, a) in enumerate(zip(x, label))], "id bigint, x0 double, x1 double, one int")
    job = fits.Job(0, 0, 240, np.zeros(2), np.zeros(2), np.ones(2), np.ones(2, bool))
    spark.sparkContext.setJobGroup("silhouettes", "counted")
    try:
        got = mo._silhouettes(df, 2, ["one"], job)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("silhouettes")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got["one"] == pytest.approx(L.silhouette(x, label)) and len(jobs) < 20  # forty blocks


def test_chunks_of_a_wide_history(spark):
    a = spark.createDataFrame([(D(2020, 1, 1), 1.0, None), (D(2020, 1, 2), 2.0, 5.0)], "date date, `p|X` double, `q|Y` double")
    b = spark.createDataFrame([(D(2020, 1, 2), 9.0), (D(2020, 1, 3), 3.0)], "date date, `p|X` double")
    got = {(r.date.day, r.instrument): (r.p, r.q) for r in fs.concatenated([fs.flattened(a), fs.flattened(b)], ["date", "instrument"]).collect()}
    assert got == {(1, "X"): (1.0, None), (2, "X"): (2.0, None), (2, "Y"): (None, 5.0), (3, "X"): (3.0, None)}


def test_blocks_of_distances_give_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.3, (70, 2)), rng.normal(4, 0.3, (50, 2)), [[9.0, 9.0]]])
    label = np.repeat([0, 1, 2], [70, 50, 1])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i, g in enumerate(label):
        inside = d[i, label == g].sum() / max((label == g).sum() - 1, 1)
        other = min(d[i, label == h].mean() for h in range(3) if h != g)
        want.append((other - inside) / max(other, inside) if (label == g).sum() > 1 else 0.0)
    whole = L.density_clusters(x, 10)
    monkeypatch.setattr(L, "BLOCK_CELLS", 500)
    parts = L.density_clusters(x, 10)
    assert L.silhouette(x, label) == pytest.approx(np.mean(want))
    assert (whole[0] == parts[0]).all() and parts[1] == pytest.approx(np.sort(d, axis=1)[:, 9])
    assert sorted(e[0] for e in L._spanning_tree(x, parts[1] ** 2)) == pytest.approx(_tree_weights(np.maximum(d, np.maximum(parts[1][:, None], parts[1]))))


@pytest.mark.parametrize("kind", ["plain", "apart", "ties", "far", "outliers", "scales"])
def test_core_distances_and_tree_equal_brute_force(kind):
    rng = np.random.default_rng(4)
    for n, k in ((30, 9), (150, 12), (300, 25)):
        x = rng.normal(size=(n, 3))
        x = {
            "plain": x, "apart": x + np.where(np.arange(n) < n // 3, 9, 0)[:, None], "ties": np.round(x), "far": x + 1e4,
            "outliers": x * np.where(rng.random(n) < 0.1, 1e3, 1)[:, None], "scales": x * np.where(np.arange(n) < n // 2, 0.001, 1)[:, None],
        }[kind]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        own = np.arange(1, n, 3)
        core2, near = L.core_distances(x, [3, k])
        part, _ = L.core_distances(x, [3, k], own)  # the share of a task
        assert np.allclose(part, core2[own], rtol=1e-12) and np.allclose(np.sqrt(core2), np.sort(d, axis=1)[:, [2, k - 1]], rtol=1e-9, atol=1e-9)
        core = np.sort(d, axis=1)[:, k - 1]
        want = sorted(_tree_weights(np.maximum(d, np.maximum(core[:, None], core))))
        for kept in (near, None):
            assert sorted(e[0] for e in L._spanning_tree(x, core2[:, 1], kept)) == pytest.approx(want, rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("errors", [3.5, -20])  # with the usual bound, and with one so low that no distance is certain
def test_windows_alike_share_a_look_at_all_pairs(monkeypatch, errors):
    """Eight windows are served by few passes, and every window's core distances are those of its own medians and deviations."""
    monkeypatch.setattr(L, "BOUND_ERRORS", errors)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(900, 4)) * np.where(rng.random((900, 1)) < 0.02, 30, 1)
    x[:, 2], x[:, 3] = np.repeat(rng.normal(size=9), 100), np.round(x[:, 3])
    x[:, :2][rng.random((900, 2)) < 0.08] = np.nan
    sizes, rows = list(range(200, 901, 100)), np.arange(1, 900, 7)
    middle, _, sd = (np.array(v) for v in zip(*(L.standards(x[:n]) for n in sizes)))
    groups = L.window_groups(sizes, sd, np.ones(sd.shape, bool))
    assert sorted(t for g in groups for t in g) == list(range(8)) and len(groups) < 8
    for g in ([0, 3, 7], *groups):
        core2, near = L.nested_core_distances(x, [sizes[t] for t in g], [sizes[t] // 20 for t in g], middle[g], sd[g], rows[rows < sizes[g[-1]]])
        for t, got in zip(g, core2.T):
            n, own = sizes[t], rows[rows < sizes[t]]
            z = L.impute_scale(x[:n], x[:1], keep_empty=False)[0]
            d = ((z[own][:, None] - z[None]) ** 2).sum(axis=2)
            assert np.allclose(got[: len(own)], np.sort(d, axis=1)[:, n // 20 - 1], rtol=1e-11, atol=1e-12) and np.isnan(got[len(own) :]).all()
        assert np.allclose(np.sort(np.take_along_axis(d, near, axis=1), axis=1), np.sort(d, axis=1)[:, : near.shape[1]])


def test_walk_forward_density_labels_are_those_of_every_window_alone(spark):
    rng = np.random.default_rng(15)
    x, day = np.vstack([rng.normal(np.tile([[0, 0, 0], [7, 7, 0]], (60, 1)), [0.5, 0.6, 1]) for _ in range(4)]), np.repeat(range(4), 120)
    x[rng.random(x.shape) < 0.05] = np.nan
    days = [D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30), D(2020, 12, 31)]
    panel = spark.createDataFrame([(i, "e", days[day[i]], *(None if v != v else float(v) for v in r)) for i, r in enumerate(x)], "panel_id bigint, country_code string, rebal_date date, a double, b double, c double")
    got = mo.label_panel(panel, ["a", "b", "c"], "hdbscan", k=10, proxy="a").toPandas().sort_values("panel_id")
    enough = (~np.isnan(x)).sum(axis=1) >= 2
    for t, date in enumerate(days):
        part, train, own = got[day == t], x[(day <= t) & enough], enough[day == t]
        assert set(part.training_window_n_rows) == {len(train)} and (part.rebal_date == date).all()
        if len(train) < 150:
            assert set(part.risk_label) == {"insufficient_data"} and part.raw_cluster_label.isna().all()
            continue
        z, a = L.impute_scale(train, x[(day == t) & enough], keep_empty=False)
        seen, core = L.density_clusters(z, max(10, round(0.01 * len(train))))
        want = L.density_predict(z, seen, core, a)
        assert set(part.risk_label[~own]) <= {"insufficient_data"} and len(set(want[want >= 0])) == 2
        for g in set(part.raw_cluster_label[own]):
            assert len(set(want[(part.raw_cluster_label[own] == g).to_numpy(bool)])) == 1  # numbers may change with ties
        assert (part.raw_cluster_label[own].to_numpy(int) == -1).sum() == (want == -1).sum()


def test_density_clusters_leave_most_pairs_in_single_precision(monkeypatch):
    """Neither core distances nor the tree measure all pairs in double precision any more, and the clusters stay."""
    rng = np.random.default_rng(6)
    x, doubles, whole = np.vstack([rng.normal(m, 1, (1000, 6)) for m in (0, 9)]), [], L.squared_distances

    def counted(a, to=None, *args):
        doubles.append(len(a) * len(a if to is None else to))
        return whole(a, to, *args)

    monkeypatch.setattr(L, "squared_distances", counted)
    label, core = L.density_clusters(x, 20)
    assert sum(doubles) < 0.1 * len(x) ** 2
    assert set(label[:1000]) & set(label[1000:]) <= {-1} and len(set(label[label >= 0])) >= 2 and (core > 0).all()


def _tree_weights(d):
    """Weights of a minimum spanning tree, by joining the nearest pair of parts."""
    part, out = list(range(len(d))), []
    for i, j in sorted(((i, j) for i in range(len(d)) for j in range(i)), key=lambda e: d[e]):
        if part[i] != part[j]:
            out.append(d[i, j])
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    return out


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "bonds").mkdir()
    (tmp_path / "bonds" / "New_Land.csv").write_text("date,MID_PRICE,BID\n2020-01-01,1.5,\n")
    (tmp_path / "bonds" / "Old.csv").write_text("date,ZSPREAD\n2020-01-02,7\n")
    (tmp_path / "bonds" / "_skip.csv").write_text("date,ZSPREAD\n2020-01-02,7\n")
    got = {(r.entity, r.date, r.mid_price, r.zspread) for r in fs.entity_csvs(spark, str(tmp_path / "bonds")).collect()}
    assert got == {("New Land", D(2020, 1, 1), 1.5, None), ("Old", D(2020, 1, 2), None, 7.0)}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "Old_Land.csv").write_text("date,agency,rating,outlook,action,source\n2020-01-01,x,A,,,GE\n")
    assert [(r.country, r.rating) for r in fs.ratings_folder(spark, str(tmp_path / "r")).collect()] == [("Old Land", "A")]
    assert fs.optional(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    with pytest.raises(ValueError):
        fs.write_parquet(spark.range(3), str(tmp_path / "x.parquet"))
        fs.two_sources(spark, str(tmp_path / "x.parquet"), str(tmp_path / "x.parquet"))
    (tmp_path / "u.yaml").write_text("core:\n- {name: A, iso3: AAA, classification: DM}\nother: 3\n")
    assert fs.universe_frame(spark, fs.load_yaml(str(tmp_path / "u.yaml"))).first().iso3 == "AAA"


def test_workbooks_yaml_and_hot_entities(spark, tmp_path):
    import pandas as pd

    sheet = pd.DataFrame({"Agency": ["x & y"], "Rating": ["<A>"], "Outlook": [None], "Date": ["43831"], "Source": ["GE"]})
    book = fs.write_workbook({"GE": sheet, "CE": sheet.assign(Date="2020-02-01")})
    assert fs.read_sheet(book, "GE") == [{"agency": "x & y", "rating": "<A>", "outlook": None, "date": "2020-01-01", "source": "GE"}]
    with pytest.raises(ValueError, match="no sheet"):
        fs.read_sheet(book, "XX")
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "New_Land.xlsx").write_bytes(book)
    a, b = fs.workbook_sheets(spark, str(tmp_path / "books"))
    assert [tuple(r) for r in b.collect()] == [("New Land", "x & y", "<A>", None, D(2020, 2, 1), "GE")] and a.first().date == D(2020, 1, 1)
    (tmp_path / "books" / "Odd.xlsx").write_bytes(fs.write_workbook({"GE": sheet.drop(columns="Agency"), "CE": sheet}))
    with pytest.raises(Exception, match="missing required columns"):
        fs.workbook_sheets(spark, str(tmp_path / "books"))[0].collect()
    e_ = spark.createDataFrame([("A: 'b'", None, "AAA", "DM", None, None), (None, "x", "BBB", None, None, None)], "name string, iso2 string, iso3 string, classification string, bond_ric string, cds_ric string")
    fs.write_universe_yaml(e_, str(tmp_path / "u"))
    assert {(r.name, r.iso2, r.iso3, r.listing) for r in fs.universe_yaml(spark, str(tmp_path / "u")).collect()} == {("A: 'b'", None, "AAA", "core"), (None, "x", "BBB", "core")}
    hot = spark.createDataFrame([("hot land", D(2020, 1, 1), float(i)) for i in range(50)] + [("cold", D(2020, 1, 1), 0.0)], "c string, date date, mid_price double")
    fs.write_entity_csvs(hot, "c", str(tmp_path / "hot"), 10)
    assert len(list((tmp_path / "hot" / "entity=hot_land").glob("*.csv"))) > 1
    assert sorted((r.entity, r.mid_price) for r in fs.entity_csvs(spark, str(tmp_path / "hot")).collect()) == sorted([("cold", 0.0), *(("hot land", float(i)) for i in range(50))])


def test_payloads_are_fetched_once(spark, tmp_path):
    (tmp_path / "a.json").write_text("one")
    urls = spark.createDataFrame([(f"file://{tmp_path}/a.json", 1), (f"file://{tmp_path}/a.json", 2), (None, 3)], "url string, n int")
    cache = str(tmp_path / "cache")
    assert sorted((r.n, r.payload) for r in fs.cached_payloads(urls, cache).collect()) == [(1, "one"), (2, "one"), (3, None)]
    (tmp_path / "a.json").write_text("two")
    assert fs.cached_payloads(urls, cache).first().payload == "one"
    assert {r.payload for r in fs.cached_payloads(urls, cache, refresh=True).collect()} == {"two", None}
    with pytest.raises(Exception, match="No such file|not found|cannot find|OSError|URLError"):
        fs.cached_payloads(spark.createDataFrame([(f"file://{tmp_path}/none",)], "url string"), cache, pause=0.0).collect()


def test_retries_and_cache(tmp_path):
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "text"

    assert fs.with_retries(flaky, sleep=pauses.append) == "text" and pauses == [2.0, 4.0]
    path = str(tmp_path / "c" / "x.json")
    assert fs.cached_payload(path, lambda: "one") == fs.cached_payload(path, lambda: "two") == "one"
    assert fs.cached_payload(path, lambda: "two", refresh=True) == "two"


def test_model_operators_survive_empty_and_odd_panels(spark):
    schema = "panel_id bigint, country_code string, rebal_date date, target_period_end date, a double, b double, c double, excess_return double, target_realized boolean, x0 string, known int"
    odd = [
        (1, "A", None, None, 1.0, 2.0, 3.0, 0.1, True, "clash", 0), (2, None, D(2020, 3, 31), D(2020, 6, 30), None, None, None, None, None, "clash", 0),
        *((10 + i, f"e{i % 5}", D(2020, 3, 31), D(2020, 3, 31), float(i % 7), float("nan") if i % 3 else 1.0, None, 0.01 * (i % 4 - 1), True, "", 0) for i in range(60)),
    ]
    for rows in ([], odd):
        p = spark.createDataFrame(rows, schema)
        for algorithm in ("kmeans", "gmm", "hdbscan"):
            t = mo.label_panel(p, ["a", "b", "c"], algorithm, k=2, proxy="a").toPandas()
            assert len(t) == len(rows)
            if rows:
                assert (t[t.panel_id < 10].risk_label == "insufficient_data").all()
        s = mo.score_panel(p, ["a", "b", "c"]).toPandas()
        assert len(s) == len(rows) and (not rows or set(s[s.panel_id < 10].signal_status) == {"insufficient_data"} and (s[s.panel_id >= 10].signal_status == "scored").all())
        registry = {"regression": {"lasso": None, "forest": lambda x, y: L.fit_forest(x, y, 3, 2)}}
        w = mo.walk_forward(p, ["a", "b", "c"], registry=registry)
        assert w.count() == (120 if rows else 0)
        sweep = mo.cluster_sweep(p.select("panel_id", "a", "b", "c"), {"t": ["a", "b", "c"]}, range(2, 3), (0.05,), fraction=0.3)
        assert sweep.count() == (3 if rows else 0)
        z, weights = mo.fitted_lasso(p, "panel_id", ["a", "b", "c"], "excess_return")
        assert z.count() == (61 if rows else 0) and set(weights) == {"a", "b", "c"}
        n = sh.scan(p, ["country_code"], [F.col("rebal_date"), F.col("panel_id")], "n", {"was": F.col("a")}, {"last": F.col("b")}, "of", 5)
        assert n.count() == len(rows) and n.filter("n > of").count() == 0
        both = ra.reconcile(*(p.select(F.col("panel_id").alias("row_id"), F.col("country_code").alias("country"), F.lit(None).cast("string").alias("agency"), F.col("rebal_date").alias("date"), F.lit("A").alias("rating"), F.lit(None).cast("string").alias("outlook"), F.lit("s").alias("source")) for _ in range(2)))
        assert both.filter("status <> 'matched'").count() == 0


def test_lasso_of_covariances_is_the_lasso(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, (400, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 0.3 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i bigint, a double, b double, c double, y double")
    z, w = mo.fitted_lasso(df, "i", ["a", "b", "c"], "y", 0.02)
    t, _ = L.impute_scale(x, x[:0], keep_empty=True)
    assert list(w.values()) == pytest.approx(L.lasso(t, y, 0.02)[0], abs=1e-6) and w["a"] > 0.3
    assert z.orderBy("i").toPandas()[["a", "b", "c"]].to_numpy() == pytest.approx(t)
