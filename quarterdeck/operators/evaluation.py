"""Agreement, rank correlation, discrimination and t-tests as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tdist import t_upper_tail
from .sharded import running_counts


def adjusted_rand(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """``keys, ari, n``: adjusted Rand index of two labellings; NULL with fewer than two labels on either side.

    From the contingency table alone, so it costs the label pairs and not the rows.  Rows lacking a label don't count.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))

    def pairs(c: Column) -> Column:
        return c * (c - 1) / 2

    def side(x: str) -> DataFrame:
        return cells.groupBy(*keys, x).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias(f"s_{x}"), F.count(F.lit(1)).alias(f"k_{x}"))

    both = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    if keys:
        t = both.join(side(a), keys).join(side(b), keys)
    else:
        t = both.join(F.broadcast(side(a))).join(F.broadcast(side(b)))  # one row each
    expected, most = F.col(f"s_{a}") * F.col(f"s_{b}") / pairs(F.col("n")), (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected))
    return t.select(*keys, F.when((F.col(f"k_{a}") >= 2) & (F.col(f"k_{b}") >= 2), ari).alias("ari"), F.col("n"))


def average_ranks(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``rank_<v>``: ranks upwards within the key, ties sharing their mean rank.

    Ranks are computed on (key, value) counts, so ties are one row, in ranges where a key has very many; then they return by an equi-join.
    """
    out = df
    for v in values:
        counts = df.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_c"))
        below = running_counts(counts, keys, v, "_c")
        ranks = below.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(v).alias("_v"), (F.col("below") + (F.col("_c") + 1) / 2).alias(f"rank_{v}"))
        on = F.col(v) == F.col("_v")
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}"))
        out = out.join(ranks, on).drop("_v", *(f"_{k}" for k in keys))
    return out


def information_coefficient(df: DataFrame, keys: list[str], predicted: str, realized: str) -> DataFrame:
    """``keys, ic, n``: Spearman rank correlation; NULL below three pairs or where one side is constant."""
    pairs = df.filter(F.col(predicted).isNotNull() & F.col(realized).isNotNull())
    ranked = average_ranks(pairs, keys, [predicted, realized])
    p, r = F.col(f"rank_{predicted}"), F.col(f"rank_{realized}")
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(r).alias("sr"), F.sum(p * p).alias("pp"), F.sum(r * r).alias("rr"), F.sum(p * r).alias("pr"))
    n = F.col("n")
    vp, vr = n * F.col("pp") - F.col("sp") * F.col("sp"), n * F.col("rr") - F.col("sr") * F.col("sr")
    ic = F.when((n >= 3) & (vp > 0) & (vr > 0), (n * F.col("pr") - F.col("sp") * F.col("sr")) / F.sqrt(vp) / F.sqrt(vr))
    return sums.select(*keys, ic.alias("ic"), "n")


def roc_auc(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """``keys, auc, n_pos, n_neg`` by the Mann-Whitney statistic with mean ranks; NULL with one class only."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    ranked = average_ranks(rows, keys, [score])
    pos = F.col(truth).cast("int")
    t = ranked.groupBy(*keys).agg(F.sum(pos).alias("n_pos"), F.sum(1 - pos).alias("n_neg"), F.sum(F.when(pos == 1, F.col(f"rank_{score}"))).alias("_r"))
    auc = (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return t.select(*keys, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc).alias("auc"), "n_pos", "n_neg")


def t_test_greater(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, mean, t_stat, p_value``: one-sided test that the mean exceeds zero; missing values don't count, two are needed.

    On differences of pairs it is the paired test.
    """
    t = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    stat = F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt(F.col("n"))))
    return t.withColumn("t_stat", stat).select(*keys, "n", "mean", "t_stat", t_upper_tail(F.col("t_stat"), F.col("n") - 1).alias("p_value"))


def kmeans_information(cost: Column, n: Column, k: Column, d: int | Column) -> tuple[Column, Column]:
    """BIC and AIC of k-means as spherical Gaussians with one variance, ``cost / (n - k)``; infinite if it vanishes."""
    variance = cost / F.greatest(n - k, F.lit(1))
    log_likelihood = -0.5 * n * d * F.log(2 * 3.141592653589793 * variance) - 0.5 * (n - k) * d
    params = k * d + 1
    inf = F.lit(float("inf"))
    bic = F.when((n <= k) | (variance <= 0), inf).otherwise(-2 * log_likelihood + params * F.log(n))
    return bic, F.when(variance <= 0, inf).otherwise(-2 * log_likelihood + 2 * params)


def within_cost(df: DataFrame, keys: list[str], label: str, features: list[str]) -> DataFrame:
    """``keys, k, n, cost``: clusters, rows and sum of squared distances to the clusters' means; rows lacking a feature don't count.

    From counts, means and variances per cluster: one map-side combined aggregation.
    """
    t = df.filter(sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) == 0)
    parts = t.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(f).alias(f"v_{f}") for f in features))
    spread = sum((F.col(f"v_{f}") for f in features), F.lit(0.0)) * F.col("n")
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("k"), F.sum("n").alias("n"), F.sum(spread).alias("cost"))


def noise(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys, n, n_clusters_found, noise_frac`` of labels where -1 is noise; rows without a label don't count."""
    has = F.col(label).isNotNull()
    found = df.filter(has).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    quiet = F.col(label) >= 0
    return found.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(quiet.cast("int")).cast("int").alias("n_clusters_found"), (F.sum(F.when(~quiet, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("noise_frac"))


def linear_importance(df: DataFrame, features: list[str], weights: dict[str, float]) -> DataFrame:
    """``feature, coef, mean_abs_shap``: mean of |w (x - mean)| over all rows, the Shapley values of a linear model."""
    means = df.agg(*(F.avg(f).alias(f"_m_{f}") for f in features))
    rows = df.crossJoin(F.broadcast(means))  # one row of means
    t = rows.agg(*(F.avg(F.abs(F.lit(float(weights[f])) * (F.col(f) - F.col(f"_m_{f}")))).alias(f) for f in features))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(float(weights[f])).alias("coef"), F.col(f).alias("mean_abs_shap")) for f in features)))
    return t.select(pairs.alias("p")).select("p.*")
