"""The general problems: edge cases and brute force on small tables."""

import datetime as dt
import math
import random

import numpy as np

from quarterdeck.operators.hot_deck import filled_cells, hot_deck
from quarterdeck.operators.implausible import Rules, Tail, departures, implausible, implausible_fields, judge, pooled_tail, residual_bins, source_cutoff
from quarterdeck.operators.known_at import known_at
from quarterdeck.operators.regular_grid import to_quarter_grid

D = dt.date
READ = "ric string, date date, value double, id bigint, q int, shard string"


def test_grid_fills_gaps_and_marks_them(spark):
    rows = [
        ("a", D(2020, 1, 5), 1.0, 1, 0, "x"), ("a", D(2020, 2, 5), 2.0, 2, 0, "x"), ("a", D(2021, 5, 1), 3.0, 3, 0, "x"), ("a", D(2041, 12, 31), 9.0, 4, 0, "x"),
        ("b", D(2020, 1, 1), float("nan"), 5, 0, "x"), ("c", None, 1.0, 6, 0, "x"), (None, D(2020, 1, 1), 1.0, 7, 0, "x"), ("d", D(2020, 6, 30), -5.0, 8, 0, "x"), ("d", D(2020, 6, 30), -6.0, 9, 0, "x"), ("e", D(2020, 6, 30), None, 10, 0, "x"),
    ]
    g = to_quarter_grid(spark.createDataFrame(rows, READ), "ric", "date", "value", "id").toPandas().sort_values(["source", "rebal_date"])
    a = g[g.source == "a"]
    assert len(a) == 88 and a.filled.sum() == 85
    assert a.iloc[0].tolist()[2:] == [2.0, D(2020, 2, 5), 2, False, 0]
    assert a.iloc[4].value == 2.0 and a.iloc[4].periods_since == 4 and a.iloc[4].n_readings == 0
    assert set(g.source) == {"a", "d"} and g[g.source == "d"].value.tolist() == [-6.0]
    assert to_quarter_grid(spark.createDataFrame([], READ), "ric", "date", "value", "id").count() == 0


def test_grid_shards_change_nothing(spark):
    rng = random.Random(1)
    rows = [(f"r{rng.randint(0, 5)}", D(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 9000)), float(i), i, 0, "") for i in range(120)]
    df = spark.createDataFrame(rows, READ)
    results = [sorted(map(tuple, to_quarter_grid(df, "ric", "date", "value", "id", k).collect())) for k in (1, 3, 1000)]
    assert results[0] == results[1] == results[2]


FACT = "fact_id bigint, country string, series string, period_date date, available_date date, value double, entity string"
EVENT = "panel_id bigint, country_name string, rebal_date date, series string, bucket int"


def _brute(events, facts):
    out = set()
    for pid, c, day, *_ in events:
        if c is None or day is None:
            continue
        for s in {f[2] for f in facts if f[2] is not None}:
            ok = [f for f in facts if f[1] == c and f[2] == s and f[3] and f[4] and f[3] <= day and f[4] <= day and f[5] is not None and not math.isnan(f[5])]
            if ok:
                out.add((pid, s, max(ok, key=lambda f: (f[3], f[4], -f[0]))[0]))
    return out


def test_known_at_equals_brute_force(spark):
    rng = random.Random(2)
    day = lambda: rng.choice([None] + [D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 60)) for _ in range(9)])
    facts = [(i, rng.choice(["x", "x", "y", None]), rng.choice(["s", "t", None]), day(), day(), rng.choice([None, float("nan"), 1.0, 2.0]), "clash") for i in range(400)]
    events = [(i, rng.choice(["x", "y", "z", None]), day(), "clash", 1) for i in range(150)]
    events += [(1000, *events[0][1:]), (1001, "x", D(2019, 1, 1), "c", 1)]
    got = known_at(spark.createDataFrame(events, EVENT), spark.createDataFrame(facts, FACT)).collect()
    assert {(r.panel_id, r.series, r.fact_id) for r in got} == _brute(events, facts)
    assert known_at(spark.createDataFrame([], EVENT), spark.createDataFrame(facts, FACT)).count() == 0
    assert known_at(spark.createDataFrame(events, EVENT), spark.createDataFrame([], FACT)).count() == 0


def test_known_at_ignores_the_future(spark):
    """Truncation: facts that become available later change no earlier answer."""
    facts = [(i, "x", "s", D(2020, 1, 1) + dt.timedelta(days=7 * i), D(2020, 1, 3) + dt.timedelta(days=9 * i), float(i), "") for i in range(20)]
    events = [(i, "x", D(2020, 1, 1) + dt.timedelta(days=5 * i), "", 0) for i in range(20)]
    cut = D(2020, 3, 1)
    e = spark.createDataFrame([x for x in events if x[2] <= cut], EVENT)
    full = sorted(map(tuple, known_at(e, spark.createDataFrame(facts, FACT)).collect()))
    assert full == sorted(map(tuple, known_at(e, spark.createDataFrame([f for f in facts if f[4] <= cut], FACT)).collect()))


CELL = "panel_id bigint, country_code string, dm_em_flag string, rebal_date date, yield_spread_bps double, fx_reserves_mo double, cds_5y double, coverage_tier string, date string, id int"


def test_hot_deck(spark):
    nan = float("nan")
    rows = [
        (1, "A", "DM", D(2020, 3, 31), 10.0, 0.0, nan, "full_dm", "", 0), (2, "A", "DM", D(2020, 6, 30), -9999.0, -1.0, None, " N/A ", "", 0), (3, "A", "DM", D(2020, 12, 31), 30.0, 5.0, -1.0, "", "", 0),
        (4, "B", "DM", D(2020, 6, 30), 1.0, 999.9, 7.0, None, "", 0), (5, None, None, D(2020, 6, 30), None, None, None, None, "", 0), (6, "C", "EM", None, None, 2.0, 3.0, "x", "", 0), (7, "A", "DM", D(2020, 6, 30), -9999.0, -1.0, None, "-", "", 0),
    ]
    out = {r.panel_id: r for r in hot_deck(spark.createDataFrame(rows, CELL)).collect()}
    assert out[2].yield_spread_bps == 10.0 and out[2].yield_spread_bps_donor == 1 and out[2].yield_spread_bps_distance == 91 and out[2].yield_spread_bps_filled
    assert out[1].fx_reserves_mo == 0.0 and not out[1].fx_reserves_mo_filled  # a zero is an observation
    assert out[2].cds_5y == 7.0 and out[2].cds_5y_donor == 4  # no donor in the issuer: same kind and date
    assert out[5].yield_spread_bps is not None and out[6].yield_spread_bps == 10.0 and out[6].yield_spread_bps_donor == 1 and out[6].yield_spread_bps_distance is None
    assert out[7].yield_spread_bps == out[2].yield_spread_bps
    found = {tuple(r) for r in filled_cells(hot_deck(spark.createDataFrame(rows, CELL))).collect()}
    assert (2, "coverage_tier") in found and (1, "fx_reserves_mo") not in found and (4, "fx_reserves_mo") in found
    assert hot_deck(spark.createDataFrame([], CELL)).count() == 0
    bare = [(*r[:4], None, *r[5:]) for r in rows]  # a field that nobody observes is filled nowhere
    bare = hot_deck(spark.createDataFrame(bare, CELL))
    assert not any(r.yield_spread_bps_filled or r.yield_spread_bps is not None for r in bare.collect())
    assert "yield_spread_bps" not in {r.field_name for r in filled_cells(bare).collect()}
    assert "Window" in filled_cells(hot_deck(spark.createDataFrame(rows, CELL)))._jdf.queryExecution().executedPlan().toString()  # marks come from the donor scans


def test_hot_deck_equals_brute_force(spark):
    rng = random.Random(11)
    days = [D(2020, 1, 1) + dt.timedelta(days=30 * i) for i in range(8)]
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice(["DM", "EM"]), rng.choice(days), rng.choice([None, None, -999.0, float(i)]), 1.0, 1.0, "x", "", 0) for i in range(60)]
    seen = {r[0]: r for r in rows if r[4] is not None and r[4] != -999.0}

    def nearest(own, ok):
        best = {}  # one donor per date: the smallest id
        for i, r in sorted(seen.items()):
            if ok(r):
                best.setdefault(r[3], i)
        return min(best.items(), key=lambda b: (abs((b[0] - own[3]).days), b[0] > own[3]))[1] if best else None

    got = {r.panel_id: r for r in hot_deck(spark.createDataFrame(rows, CELL)).collect()}
    for r in rows:
        if r[0] in seen:
            assert not got[r[0]].yield_spread_bps_filled and got[r[0]].yield_spread_bps == r[4]
            continue
        donor = nearest(r, lambda x: x[1] == r[1])  # noqa: B023
        donor = donor if donor is not None else nearest(r, lambda x: x[2] == r[2])  # noqa: B023
        assert got[r[0]].yield_spread_bps_donor == donor and got[r[0]].yield_spread_bps == seen[donor][4]
        assert got[r[0]].yield_spread_bps_distance == abs((seen[donor][3] - r[3]).days)


def _series(n=300, seed=0, move=0.3):
    return 100 + np.cumsum(np.random.default_rng(seed).normal(0, move, n))


def test_spikes_stuck_and_shifts():
    v = _series()
    v[50] += 20  # spike of one reading
    v[100:102] -= 15  # of two
    v[150:] += 40  # a lasting change
    v[200:230] = v[200]  # stuck
    v[0] += 50  # the first reading has one side only
    s, m = np.zeros(len(v), int), np.arange(len(v)) % 12
    r = judge(v, s, m, None, Rules(lowest=1e-9))
    assert {i for i in range(len(v)) if r[i] == "spike"} == {50, 100, 101}
    assert {i for i in range(len(v)) if r[i] == "stuck"} == set(range(201, 230))
    v[10] = -1
    assert judge(v, s, m, None, Rules(lowest=1e-9))[10] == "impossible"


def test_seldom_traded_series_are_not_stuck():
    rng = np.random.default_rng(3)
    v = np.repeat(_series(200), rng.geometric(0.5, 200))
    assert (judge(v, np.zeros(len(v), int), np.ones(len(v), int), None, Rules()) == "").all()


def test_numbers_stuck_while_letters_move():
    letters = np.array([8, 9, 10, 11, 12, 12, 11, 10, 8.0])
    numbers = np.array([8, 9, 9, 9, 9, 9, 9, 10, 8.0])
    r = judge(numbers, np.zeros(9, int), np.ones(9, int), letters, Rules(lowest=1, highest=22, by_moves=False, grid=0.5, risk=3e-4, trim=3e-4))
    assert [i for i in range(9) if r[i] == "stuck"] == [2, 3, 4, 5, 6]
    same = judge(numbers, np.zeros(9, int), np.ones(9, int), numbers.copy(), Rules(by_moves=False, grid=0.5, risk=3e-4, trim=3e-4))
    assert (same == "").all()


def test_tail_of_known_distributions():
    rng = np.random.default_rng(0)
    rules = Rules(trim=1e-4)
    z = rng.exponential(1, 200_000)
    tail = pooled_tail(residual_bins(z, 0.0), rules)
    assert abs(tail.shape) < 0.05 and abs(tail.threshold + tail.over(1e-4) - -math.log(1e-4)) < 0.7
    spiked = np.r_[z, rng.uniform(20, 50, 1500)]  # spikes don't widen the tail that judges them
    assert abs(pooled_tail(residual_bins(spiked, 0.0), rules).over(1e-4) - tail.over(1e-4)) < 0.8
    parts = [residual_bins(p, 0.0) for p in np.array_split(z, 7)]
    assert np.allclose(sum(parts), residual_bins(z, 0.0))
    assert pooled_tail(residual_bins(np.zeros(0), 0.0), rules) is None
    # The source's own scale counts: a source of twice the residuals gets about twice the cutoff; few peaks stay near the pool's.
    assert 1.6 < source_cutoff(rng.exponential(2, 20_000), tail, rules) / source_cutoff(rng.exponential(1, 20_000), tail, rules) < 2.2
    assert source_cutoff(rng.exponential(2, 20), tail, rules) < 1.3 * (tail.threshold + tail.over(rules.risk))
    assert source_cutoff(z, tail, Rules(trim=1e-4, risk=1e-4)) < source_cutoff(z, tail, rules)  # the risk is the knob


def test_a_reading_beside_a_spike_is_none():
    n = np.array([10, 9, 8, 6, 18, 18, 7, 9, 12, 12, 12, 12.0])
    pool = Tail(1.16, 0.0, 0.58, 0.1)  # twelve readings have no tail of their own
    r = judge(n, np.zeros(12, int), np.ones(12, int), None, Rules(lowest=1, highest=22, window=4, by_moves=False, grid=0.5, risk=3e-4, trim=3e-4), pool)
    assert [i for i in range(12) if r[i]] == [4, 5]


def test_departures_stay_within_series():
    v = np.array([1.0, 1, 1, 50, 50, 50])
    assert (departures(v, np.array([0, 0, 0, 1, 1, 1]), np.ones(6, int), 5) == 0).all()


def test_implausible_flags_copies_and_survives_dirt(spark):
    v = _series(80)
    v[40] += 30
    rows = [("r", D(2020, 1, 1) + dt.timedelta(days=i), float(x), i, "clash") for i, x in enumerate(v)]
    rows += [("r", rows[40][1], rows[40][2], 500, ""), (None, D(2020, 1, 1), 5.0, 501, ""), ("r", None, -3.0, 502, ""), ("r", D(2020, 1, 9), float("nan"), 503, ""), ("q", D(2020, 1, 1), None, 504, ""), ("one", D(2020, 1, 1), 7.0, 505, "")]
    schema = "ric string, date date, value double, row_id bigint, reason string"
    got = {tuple(r) for r in implausible(spark.createDataFrame(rows, schema), ["ric"], "date", "value", "row_id", Rules(lowest=1e-9)).collect()}
    assert got == {(40, "spike"), (500, "spike"), (502, "impossible")}
    assert implausible(spark.createDataFrame([], schema), ["ric"], "date", "value", "row_id", Rules()).count() == 0


def test_fields_are_judged_apart(spark):
    a, b = _series(300), _series(300, 9)
    a[40] += 30
    b[200] -= 30
    rows = [("r", D(2020, 1, 1) + dt.timedelta(days=i), float(x), float(y), i) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "ric string, date date, one double, two double, row_id bigint")
    got = {tuple(r) for r in implausible_fields(df, ["ric"], "date", "row_id", {"one": Rules(), "two": Rules(highest=1e6)}).collect()}
    assert got == {("one", 40, "spike"), ("two", 200, "spike")}


def test_time_shards_change_no_verdict(spark):
    rng = np.random.default_rng(8)
    v = _series(4000, 4)
    for i in rng.choice(np.arange(20, 3980), 25, replace=False):
        v[i] += 15
    v[1900:2100] = v[1900]  # stuck across a border
    rows = [("hot", D(2000, 1, 1) + dt.timedelta(days=i // 2), float(x), i) for i, x in enumerate(v)] + [("cold", D(2000, 1, 1) + dt.timedelta(days=i), float(x), 10_000 + i) for i, x in enumerate(_series(90, 5))]
    df = spark.createDataFrame(rows, "ric string, date date, value double, row_id bigint")
    whole, cut = (sorted(map(tuple, implausible(df, ["ric"], "date", "value", "row_id", Rules(lowest=1e-9), shard_rows=n).collect())) for n in (10**6, 1500))
    assert whole == cut and len(whole) > 200
    crowded = spark.createDataFrame([("hot", D(2000, 1, 1), float(x), i) for i, x in enumerate(v)], "ric string, date date, value double, row_id bigint")
    assert implausible(crowded, ["ric"], "date", "value", "row_id", Rules(lowest=1e-9), shard_rows=500).count() >= 0
