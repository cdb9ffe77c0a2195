"""Queries of evaluation, selection and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import enough_observed
from ..operators import evaluation as e
from ..operators import models as mo
from ..operators import panel as pn
from ..operators import sharded as sh
from ..session import cut_lineage, load
from .base import panel, query, r6, signals
from .logs import _EVENTS, _windows

CORE = list(pn.CORE_FEATURES)
MODEL_FEATURES = ["yield_spread_bps", "debt_gdp", "fiscal_bal_gdp", "cpi_inflation", "real_gdp_growth", "us_10y", "curve_slope", "vix", "dxy_proxy"]
GROUPS = {f: "carry" if f == "yield_spread_bps" else "macro" if f in pn.MACRO_FEATURES else "global" for f in MODEL_FEATURES}


def _ari_sql(keys: str) -> str:
    g = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""WITH t AS (SELECT *, ntile(3) OVER (PARTITION BY rebal_date ORDER BY yield_spread_bps, country_code) AS tier FROM panel WHERE yield_spread_bps IS NOT NULL),
c AS (SELECT {g}dm_em_flag AS a, tier AS b, count(*) AS n FROM t WHERE dm_em_flag IS NOT NULL GROUP BY ALL),
s AS (SELECT {g}sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM c GROUP BY ALL),
x AS (SELECT {g}sum(m * (m - 1) / 2.0) AS sa, count(*) AS ka FROM (SELECT {g}a, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL),
y AS (SELECT {g}sum(m * (m - 1) / 2.0) AS sb, count(*) AS kb FROM (SELECT {g}b, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL)
SELECT {g}round(CASE WHEN ka >= 2 AND kb >= 2 THEN CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0 ELSE (s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) END END, 6) AS ari, CAST(n AS BIGINT) AS n FROM s JOIN x {using} JOIN y {using}"""


def _thirds(spark: SparkSession, d: str) -> DataFrame:
    t = panel(spark, d, "dm_em_flag", "yield_spread_bps").filter("yield_spread_bps IS NOT NULL").select("rebal_date", "country_code", "dm_em_flag", "yield_spread_bps")
    t = sh.scan(t, ["rebal_date"], [F.col("yield_spread_bps"), F.col("country_code")], "place", total="of")
    return t.withColumn("tier", sh.share_of(F.col("place"), F.col("of"), 3))


@query(_ari_sql("rebal_date"), "panel")
def o120_ari_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """O-120: adjusted Rand index of flag and spread thirds, per quarter."""
    return e.adjusted_rand(_thirds(spark, d), ["rebal_date"], "dm_em_flag", "tier").withColumn("ari", r6("ari"))


@query(_ari_sql(""), "panel")
def o120_ari(spark: SparkSession, d: str) -> DataFrame:
    """O-120: the same over the whole sample."""
    return e.adjusted_rand(_thirds(spark, d), [], "dm_em_flag", "tier").withColumn("ari", r6("ari"))


_IC = """WITH p AS (SELECT run_id, rebal_date, score, excess_return FROM signals WHERE score IS NOT NULL AND excess_return IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY run_id, rebal_date ORDER BY score) + (count(*) OVER (PARTITION BY run_id, rebal_date, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY run_id, rebal_date ORDER BY excess_return) + (count(*) OVER (PARTITION BY run_id, rebal_date, excess_return) - 1) / 2.0 AS b FROM p),
i AS (SELECT run_id, rebal_date, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS ic FROM k GROUP BY ALL)
"""


@query(_IC + "SELECT run_id, rebal_date, round(ic, 6) AS ic, n FROM i", "signals")
def o124_information_coefficient(spark: SparkSession, d: str) -> DataFrame:
    """O-124: Spearman correlation of score and realized excess return per run and date."""
    return e.information_coefficient(signals(spark, d, "excess_return"), ["run_id", "rebal_date"], "score", "excess_return").withColumn("ic", r6("ic"))


@query(_IC + "SELECT run_id, count(ic) AS n, round(avg(ic), 6) AS mean, round(CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END, 4) AS t_stat FROM i WHERE ic IS NOT NULL GROUP BY run_id", "signals")
def o125_ic_t_statistic(spark: SparkSession, d: str) -> DataFrame:
    """O-125, O-79: mean IC and its t statistic over the folds that have one."""
    ic = e.information_coefficient(signals(spark, d, "excess_return"), ["run_id", "rebal_date"], "score", "excess_return")
    return e.t_test_greater(ic, ["run_id"], "ic").select("run_id", "n", r6("mean").alias("mean"), F.round("t_stat", 4).alias("t_stat"))


def _p_sql(tests: str, key: str) -> str:
    """One-sided p-values of ``tests`` (key, n, mean, t): Simpson's rule on Student's density from 0 to t, in 2,000 steps."""
    return f"""g AS (SELECT x.*, i, t / 2000 AS h, n - 1.0 AS v, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM {tests} x CROSS JOIN (SELECT unnest(range(2001)) AS i)),
    q AS (SELECT {key}, n, mean, t, 0.5 - sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + (i * h) * (i * h) / v, -(v + 1) / 2)) * any_value(h) / 3 AS p FROM g GROUP BY {key}, n, mean, t)"""


_IC_T = "y AS (SELECT run_id, count(ic) AS n, avg(ic) AS mean, CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS t FROM i WHERE ic IS NOT NULL GROUP BY run_id)"


@query(
    _IC.rstrip() + f", {_IC_T}, {_p_sql('y', 'run_id')} SELECT run_id, n, round(mean, 6) AS mean, round(t, 4) AS t_stat, round(p, 6) AS p_value, mean > 0.05 AND p < 0.05 AS cleared FROM q",
    "signals",
)
def o125_ic_t_test(spark: SparkSession, d: str) -> DataFrame:
    """O-125, O-129: the same with one-sided p (Student's t), and whether the bar of IC > 0.05 and p < 0.05 is cleared."""
    ic = e.information_coefficient(signals(spark, d, "excess_return"), ["run_id", "rebal_date"], "score", "excess_return")
    t = e.t_test_greater(ic, ["run_id"], "ic").withColumn("cleared", (F.col("mean") > 0.05) & (F.col("p_value") < 0.05))
    return t.withColumns({"mean": r6("mean"), "t_stat": F.round("t_stat", 4), "p_value": r6("p_value")})


@query(
    _EVENTS + "SELECT country_name, count(*) AS n, round(avg(nm - bm), 6) AS mean, round(CASE WHEN count(*) >= 2 AND stddev_samp(nm - bm) > 0 THEN avg(nm - bm) / (stddev_samp(nm - bm) / sqrt(count(*))) END, 4) AS t_stat, round(100 * avg((nm - bm > 0)::INT), 4) AS pct_increase FROM t WHERE status = 'ok' GROUP BY ALL",
    "ratings", "panel",
)
def o126_paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """O-126: paired tests of near against baseline windows, per country."""
    w = cut_lineage(_windows(spark, d).filter("status = 'ok'"))
    share = w.groupBy("country_name").agg(F.round(100 * F.avg((F.col("diff") > 0).cast("int")), 4).alias("pct_increase"))
    return e.t_test_greater(w, ["country_name"], "diff").select("country_name", "n", r6("mean").alias("mean"), F.round("t_stat", 4).alias("t_stat")).join(share, "country_name")


_POOLED = "y AS (SELECT 'all' AS pool, count(*) AS n, avg(nm - bm) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(nm - bm) > 0 THEN avg(nm - bm) / (stddev_samp(nm - bm) / sqrt(count(*))) END AS t FROM t WHERE status = 'ok' HAVING count(*) > 0)"


@query(_EVENTS.rstrip() + f", {_POOLED}, {_p_sql('y', 'pool')} SELECT pool, n, round(mean, 6) AS mean, round(t, 4) AS t_stat, round(p, 6) AS p_value FROM q", "ratings", "panel")
def o126_pooled_test(spark: SparkSession, d: str) -> DataFrame:
    """O-126: the pooled test, with p; events of one country aren't independent."""
    t = e.t_test_greater(_windows(spark, d).filter("status = 'ok'").withColumn("pool", F.lit("all")), ["pool"], "diff")
    return t.withColumns({"mean": r6("mean"), "t_stat": F.round("t_stat", 4), "p_value": r6("p_value")})


@query(
    """WITH p AS (SELECT run_id, excess_return > 0 AS y, prob FROM signals WHERE prob IS NOT NULL AND excess_return IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY prob) + (count(*) OVER (PARTITION BY run_id, prob) - 1) / 2.0 AS r FROM p)
    SELECT run_id, round(CASE WHEN sum(y::INT) > 0 AND sum((NOT y)::INT) > 0 THEN (sum(r) FILTER (y) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * sum((NOT y)::INT)) END, 6) AS auc, CAST(sum(y::INT) AS BIGINT) AS n_pos, CAST(sum((NOT y)::INT) AS BIGINT) AS n_neg FROM k GROUP BY run_id""",
    "signals",
)
def o127_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """O-127: area under the ROC curve on pooled predictions of a run."""
    t = signals(spark, d, "excess_return").withColumn("y", F.col("excess_return") > 0)
    return e.roc_auc(t, ["run_id"], "y", "prob").withColumn("auc", r6("auc"))


_FEATURE_SQL = ", ".join(f"median({c}) AS m_{c}" for c in CORE)


@query(
    f"WITH t AS (SELECT * FROM panel WHERE ({' + '.join(f'({c} IS NOT NULL)::INT' for c in CORE)}) >= 5), m AS (SELECT {_FEATURE_SQL} FROM t) SELECT " + ", ".join(f"round(m_{c}, 6) AS median_{c}, round((SELECT stddev_pop(coalesce({c}, (SELECT m_{c} FROM m))) FROM t), 6) AS sd_{c}" for c in CORE) + " FROM m",
    "panel",
)
def o131_impute_scale(spark: SparkSession, d: str) -> DataFrame:
    """O-131, O-132: exact training medians, and population deviations after imputation."""
    t = panel(spark, d, *CORE).filter(enough_observed(CORE, 0.5))
    m = dict(zip(CORE, sh.medians(t, CORE)))
    s = t.agg(*(F.stddev_pop(F.coalesce(F.col(c), F.lit(m[c]).cast("double"))).alias(f"s_{c}") for c in CORE))
    return s.select(*(x for c in CORE for x in (r6(F.lit(m[c]).cast("double")).alias(f"median_{c}"), r6(f"s_{c}").alias(f"sd_{c}"))))


@query(
    """WITH m AS (SELECT median(debt_gdp) AS m FROM panel), i AS (SELECT panel_id, coalesce(debt_gdp, (SELECT m FROM m)) AS x FROM panel), s AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM i) SELECT panel_id, round((x - (SELECT a FROM s)) / (SELECT s FROM s), 6) AS z FROM i""",
    "panel",
)
def o133_apply_transform(spark: SparkSession, d: str) -> DataFrame:
    """O-133: a fitted transform applied to all rows."""
    t = panel(spark, d, "debt_gdp").select("panel_id", "debt_gdp")
    x = t.select("panel_id", F.coalesce(F.col("debt_gdp"), F.lit(sh.medians(t, ["debt_gdp"])[0]).cast("double")).alias("x"))
    s = x.agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s"))
    return x.crossJoin(F.broadcast(s)).select("panel_id", r6((F.col("x") - F.col("a")) / F.col("s")).alias("z"))  # one row each


@query(
    """WITH t AS (SELECT country_code, ntile(4) OVER (PARTITION BY rebal_date ORDER BY debt_gdp, country_code) AS label, yield_spread_bps FROM panel WHERE debt_gdp IS NOT NULL),
    p AS (SELECT label, coalesce(avg(yield_spread_bps), 0) AS proxy FROM t GROUP BY label), r AS (SELECT label, proxy, row_number() OVER (ORDER BY proxy, label) - 1 AS rank, count(*) OVER () AS n FROM p)
    SELECT label, round(proxy, 6) AS proxy, CAST(rank AS INT) AS rank, CASE WHEN rank < ceil(n / 3.0) THEN 'core-eligible' WHEN rank >= n - ceil(n / 3.0) THEN 'satellite-candidate' ELSE 'excluded' END AS tier FROM r""",
    "panel",
)
def o093_cluster_tiers(spark: SparkSession, d: str) -> DataFrame:
    """O-67, O-93: groups ranked by mean observed spread (0 where none), ranks to thirds."""
    t = panel(spark, d, "debt_gdp", "yield_spread_bps").filter("debt_gdp IS NOT NULL").select("rebal_date", "country_code", "debt_gdp", "yield_spread_bps")
    t = sh.scan(t, ["rebal_date"], [F.col("debt_gdp"), F.col("country_code")], "place", total="of").withColumn("label", sh.share_of(F.col("place"), F.col("of"), 4))
    p = t.groupBy("label").agg(F.coalesce(F.avg("yield_spread_bps"), F.lit(0.0)).alias("proxy"))
    every = Window.partitionBy(F.lit(0))  # one row per group
    rank = F.row_number().over(every.orderBy("proxy", "label")) - 1
    r = p.withColumn("rank", rank).withColumn("n", F.count(F.lit(1)).over(every))
    third = F.ceil(F.col("n") / 3)
    tier = F.when(F.col("rank") < third, mo.TIERS[0]).when(F.col("rank") >= F.col("n") - third, mo.TIERS[2]).otherwise(mo.TIERS[1])
    return r.select("label", r6("proxy").alias("proxy"), "rank", tier.alias("tier"))


_PAIR = ["yield_spread_bps", "debt_gdp"]


@query(
    """WITH p AS (SELECT yield_spread_bps AS x, debt_gdp AS y, row_number() OVER (ORDER BY yield_spread_bps, panel_id) AS i, count(*) OVER () AS n FROM panel WHERE yield_spread_bps IS NOT NULL AND debt_gdp IS NOT NULL),
    t AS (SELECT k, x, y, n, CASE WHEN i - 1 < (n % k) * (n // k + 1) THEN (i - 1) // (n // k + 1) ELSE n % k + (i - 1 - (n % k) * (n // k + 1)) // greatest(n // k, 1) END AS g FROM p CROSS JOIN (SELECT unnest(range(2, 9)) AS k)),
    c AS (SELECT k, g, count(*) AS n, var_pop(x) * count(*) + var_pop(y) * count(*) AS cost FROM t GROUP BY k, g), s AS (SELECT k, sum(n) AS n, sum(cost) AS cost FROM c GROUP BY k),
    w AS (SELECT *, cost / greatest(n - k, 1) AS q, k * 2 + 1 AS p FROM s), l AS (SELECT *, -0.5 * n * 2 * ln(2 * pi() * q) - 0.5 * (n - k) * 2 AS ll FROM w WHERE q > 0)
    SELECT CAST(k AS INT) AS k_or_mcs, CAST(n AS BIGINT) AS n, round(cost, 2) AS cost, CASE WHEN n > k THEN round(-2 * ll + p * ln(n), 4) END AS bic, round(-2 * ll + 2 * p, 4) AS aic FROM l""",
    "panel",
)
def o122_kmeans_information(spark: SparkSession, d: str) -> DataFrame:
    """O-122: BIC and AIC of partitions of the panel into k = 2 to 8 groups, from their costs (infinite shown as NULL)."""
    t = panel(spark, d, *_PAIR).filter("yield_spread_bps IS NOT NULL AND debt_gdp IS NOT NULL").select("panel_id", *_PAIR, F.lit(1).alias("all"))
    t = sh.scan(t, ["all"], [F.col("yield_spread_bps"), F.col("panel_id")], "i", total="of").withColumn("parts", F.explode(F.sequence(F.lit(2), F.lit(8))))
    s = e.within_cost(t.withColumn("label", sh.share_of(F.col("i"), F.col("of"), F.col("parts"))), ["parts"], "label", _PAIR)
    bic, aic = e.kmeans_information(F.col("cost"), F.col("n"), F.col("parts"), 2)
    finite = [F.when(c != float("inf"), F.round(c, 4)) for c in (bic, aic)]
    return s.select(F.col("parts").alias("k_or_mcs"), "n", F.round("cost", 2).alias("cost"), finite[0].alias("bic"), finite[1].alias("aic"))


@query()
def o147_cluster_sweep(spark: SparkSession, d: str) -> DataFrame:
    """O-121, O-123, O-128, O-134, O-135, O-136, O-147: k-means, mixtures and density clusters over k, with their diagnostics."""
    return mo.cluster_sweep(panel(spark, d, *CORE, "cds_5y", "vix"), {"core": CORE, "extended": [*CORE, "cds_5y", "vix"]})


@query()
def o139_risk_labels(spark: SparkSession, d: str) -> DataFrame:
    """O-138, O-139: walk-forward risk labels and scores."""
    return mo.label_panel(panel(spark, d, *CORE), CORE)


@query()
def o139_mixture_labels(spark: SparkSession, d: str) -> DataFrame:
    """O-135, O-139: walk-forward labels by Gaussian mixtures."""
    return mo.label_panel(panel(spark, d, *CORE), CORE, "gmm")


@query()
def o137_density_labels(spark: SparkSession, d: str) -> DataFrame:
    """O-137: walk-forward labels by density clusters; noise and unseen labels are excluded."""
    return mo.label_panel(panel(spark, d, *CORE), CORE, algorithm="hdbscan", k=10)


def targets(spark: SparkSession, d: str) -> DataFrame:
    """A panel with a target: the next quarter's change of spread of the issuer, as a return, and its realized flag."""
    t = panel(spark, d)
    ahead = t.select("country_code", F.last_day(F.add_months("rebal_date", -3)).alias("rebal_date"), F.col("rebal_date").alias("target_period_end"), F.col("yield_spread_bps").alias("next_spread"))
    rows = t.join(ahead, ["country_code", "rebal_date"], "left")
    excess = (F.col("yield_spread_bps") - F.col("next_spread")) / 1000
    return pn.with_target(rows.withColumn("excess_return", excess)).filter("dm_em_flag = 'EM'")


@query()
def o145_scores(spark: SparkSession, d: str) -> DataFrame:
    """O-140, O-141, O-145, O-149: walk-forward scores by lasso and L1 logistic."""
    return mo.score_panel(targets(spark, d), MODEL_FEATURES)


def compared(panel: DataFrame, features: list[str]) -> DataFrame:
    """A row per framing and model, with or without folds: folds, pooled rows, mean information coefficient with its test, and area under the curve."""
    p = cut_lineage(mo.walk_forward(panel, features))
    ic = e.information_coefficient(p.filter("framing = 'regression'"), ["model", "rebal_date"], "predicted", "truth")
    t = e.t_test_greater(ic, ["model"], "ic").select("model", F.col("n").alias("n_folds_with_ic"), F.col("mean").alias("mean_ic"), "t_stat", "p_value")
    folds = p.groupBy("framing", "model").agg(F.countDistinct("rebal_date").alias("n_folds"), F.count(F.lit(1)).alias("n_pooled"))
    auc = e.roc_auc(p.filter("framing = 'classification'"), ["model"], "truth", "predicted").select("model", "auc")
    every = panel.sparkSession.createDataFrame([(f, m) for f, ms in mo.REGISTRY.items() for m in ms], "framing string, model string")
    both = every.join(folds, ["framing", "model"], "left").na.fill(0, ["n_folds", "n_pooled"])
    both = both.join(t.withColumn("framing", F.lit("regression")), ["framing", "model"], "left").join(auc.withColumn("framing", F.lit("classification")), ["framing", "model"], "left")
    return both.withColumn("cleared", (F.col("mean_ic") > 0.05) & (F.col("p_value") < 0.05))


@query()
def o144_model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """O-142, O-143, O-144, O-129: all models of both framings, walk-forward; folds counted with and without an IC."""
    return compared(targets(spark, d), MODEL_FEATURES)


@query()
def o130_linear_importance(spark: SparkSession, d: str) -> DataFrame:
    """O-130, O-78, O-140: lasso of all realized rows, mean absolute Shapley values over them, shares by group."""
    t = targets(spark, d).filter(F.col("target_realized") & enough_observed(MODEL_FEATURES, 0.5))
    z, w = mo.fitted_lasso(t, "panel_id", MODEL_FEATURES, "excess_return", 0.001)
    imp = e.linear_importance(z, MODEL_FEATURES, w)
    group = F.create_map(*(F.lit(v) for kv in GROUPS.items() for v in kv))
    every = Window.partitionBy(F.lit(0))  # one row per feature
    total = F.sum("mean_abs_shap")
    out = imp.withColumn("group", group[F.col("feature")])
    return out.withColumn("share_of_total", F.col("mean_abs_shap") / total.over(every)).withColumn("group_total", total.over(Window.partitionBy("group")))


@query(
    """WITH t AS (SELECT rebal_date, CASE WHEN debt_gdp IS NULL THEN -1 ELSE ntile(3) OVER (PARTITION BY rebal_date ORDER BY yield_spread_bps, country_code) END AS label FROM panel WHERE yield_spread_bps IS NOT NULL)
    SELECT rebal_date, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT label) FILTER (label >= 0) AS INT) AS n_clusters_found, round(avg((label < 0)::INT), 6) AS noise_frac FROM t GROUP BY rebal_date""",
    "panel",
)
def o128_noise(spark: SparkSession, d: str) -> DataFrame:
    """O-128: groups found and share of noise per quarter, of labels computed here (thirds by spread; rows without a debt figure are noise)."""
    t = panel(spark, d, "yield_spread_bps", "debt_gdp").filter("yield_spread_bps IS NOT NULL").select("rebal_date", "country_code", *_PAIR)
    t = sh.scan(t, ["rebal_date"], [F.col("yield_spread_bps"), F.col("country_code")], "i", total="of")
    label = F.when(F.col("debt_gdp").isNull(), -1).otherwise(sh.share_of(F.col("i"), F.col("of"), 3))
    return e.noise(t.withColumn("label", label), ["rebal_date"], "label").withColumn("noise_frac", r6("noise_frac"))
