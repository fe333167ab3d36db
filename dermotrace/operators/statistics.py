"""Group statistics and inference: summaries, correlation, regression, Welch's test, meta-analysis, false discovery rate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import fisher_z, t_p_sql, t_p_value
from ..sources.tables import EVENTS_SQL, events

#: A group needs so many pairs to enter a meta-analysis.
LEAST = 10


def summary(df: DataFrame, key: str, x: str) -> DataFrame:
    """n, mean, population deviation and variance, least and most; zeros where a group has no values."""
    z = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return df.groupBy(key).agg(F.count(x).alias("n"), z(F.avg(x), "mean"), z(F.stddev_pop(x), "sigma"), z(F.var_pop(x), "variance"), z(F.min(x), "low"), z(F.max(x), "high"))


def upper_median(df: DataFrame, key: str, x: str) -> DataFrame:
    """The element at n // 2 of the sorted values, by rank: no group is gathered into an array."""
    w = Window.partitionBy(key).orderBy(x)
    ranked = df.where(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where("_r = floor(_n / 2) + 1").select(key, F.col(x).alias("median"))


def correlations(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """n, Pearson's r, slope and intercept of each group."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def meta_correlation(groups: DataFrame) -> DataFrame:
    """One row from (n, r): random-effects mean of Fisher's z by DerSimonian and Laird; k groups of ``LEAST`` or more."""
    use = groups.where((F.col("n") >= LEAST) & F.col("r").isNotNull()).select(fisher_z(F.col("r")).alias("z"), (F.col("n") - 3).cast("double").alias("w"))
    s = use.agg(F.count("*").alias("k"), F.sum("w").alias("w"), F.sum(F.expr("w * w")).alias("w2"), F.sum(F.expr("w * z")).alias("wz"), F.sum(F.expr("w * z * z")).alias("wzz"))
    q = F.col("wzz") - F.col("wz") * F.col("wz") / F.col("w")
    tau = F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("w") - F.col("w2") / F.col("w")))
    both = use.crossJoin(F.broadcast(s.select("k", tau.alias("tau2"))))  # one row
    v = 1 / (1 / F.col("w") + F.col("tau2"))
    out = both.groupBy("k", "tau2").agg((F.sum(v * F.col("z")) / F.sum(v)).alias("z"), (1 / F.sqrt(F.sum(v))).alias("se"))
    return out.select("k", "tau2", F.tanh("z").alias("r"), "se")


def welch(df: DataFrame, key: str, x: str, group: str, a, b) -> DataFrame:
    """Welch's t and its degrees of freedom between two groups, for each key."""
    of = lambda v: F.when(F.col(group) == v, F.col(x))
    s = df.groupBy(key).agg(*(f(of(v)).alias(f"{name}_{side}") for side, v in (("a", a), ("b", b)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    ea, eb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    t = (F.col("m_a") - F.col("m_b")) / F.sqrt(ea + eb)
    freedom = F.pow(ea + eb, F.lit(2)) / (F.pow(ea, F.lit(2)) / (F.col("n_a") - 1) + F.pow(eb, F.lit(2)) / (F.col("n_b") - 1))
    return s.where("n_a > 1 and n_b > 1 and v_a + v_b > 0").select(key, t.alias("t"), freedom.alias("df"))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, b) for a, b in zip(t, df, strict=True)])


def benjamini_hochberg(df: DataFrame, p: str, family: str) -> DataFrame:
    """``q`` of each p-value within its family; nulls and NaN count for nothing."""
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(family)
    ranked = df.where(valid).withColumns({"_m": F.count("*").over(w), "_r": F.rank().over(w.orderBy(p)), "_n": F.count("*").over(w.orderBy(p))})
    q = F.min(F.col(p) * F.col("_m") / F.col("_n")).over(w.orderBy(F.desc(p)))
    done = ranked.withColumn("q", F.least(F.lit(1.0), q)).drop("_m", "_r", "_n")
    return done.unionByName(df.where(~valid | F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.floor(F.col("t") / 3600) % 24)


def _tested(spark, d):
    w = welch(events(spark, d), "track", "value", "kind", "click", "view")
    p = w.withColumn("p", t_p("t", "df")).withColumn("family", F.col("track") % 5)
    return _round(benjamini_hochberg(p, "p", "family"), 6)


QUERIES = {
    "stats_summary": lambda s, d: _round(summary(events(s, d), "track", "value"), 8),
    "stats_median": lambda s, d: upper_median(events(s, d), "track", "value"),
    "stats_correlations": lambda s, d: _round(correlations(_hour(events(s, d)), "track", "hour", "value")),
    "stats_meta": lambda s, d: _round(meta_correlation(correlations(_hour(events(s, d)), "track", "hour", "value"))),
    "stats_welch": lambda s, d: _round(welch(events(s, d), "track", "value", "kind", "click", "view").withColumn("p", t_p("t", "df"))),
    "stats_false_discovery": _tested,
}
_CORR = f"""{EVENTS_SQL}, h AS (SELECT *, floor(t / 3600)::bigint % 24 AS hour FROM e),
c AS (SELECT track, count(*) AS n, corr(hour, value) AS r, regr_slope(value, hour) AS slope, regr_intercept(value, hour) AS intercept FROM h WHERE value IS NOT NULL GROUP BY track)"""
_WELCH = f"""{EVENTS_SQL}, s AS (SELECT track, count(value) FILTER (kind = 'click') AS na, count(value) FILTER (kind = 'view') AS nb,
  avg(value) FILTER (kind = 'click') AS ma, avg(value) FILTER (kind = 'view') AS mb, var_samp(value) FILTER (kind = 'click') AS va, var_samp(value) FILTER (kind = 'view') AS vb FROM e GROUP BY track),
w AS (SELECT track, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM s WHERE na > 1 AND nb > 1 AND va + vb > 0)"""
ORACLE_SQL = {
    "stats_summary": f"""WITH {EVENTS_SQL} SELECT track, count(value) AS n, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS sigma,
round(var_pop(value), 8) AS variance, round(min(value), 8) AS low, round(max(value), 8) AS high FROM e GROUP BY track""",
    "stats_median": f"WITH {EVENTS_SQL} SELECT track, list_sort(list(value) FILTER (value IS NOT NULL))[count(value) // 2 + 1] AS median FROM e GROUP BY track HAVING count(value) > 0",
    "stats_correlations": f"WITH {_CORR} SELECT track, n, round(r, 4) AS r, round(slope, 4) AS slope, round(intercept, 4) AS intercept FROM c",
    "stats_meta": f"""WITH {_CORR}, u AS (SELECT atanh(greatest(-0.999999, least(0.999999, r))) AS z, (n - 3)::double AS w FROM c WHERE n >= 10 AND r IS NOT NULL),
s AS (SELECT count(*) AS k, greatest(0, (sum(w * z * z) - sum(w * z) ** 2 / sum(w) - (count(*) - 1)) / (sum(w) - sum(w * w) / sum(w))) AS tau2 FROM u),
v AS (SELECT k, tau2, z, 1 / (1 / w + tau2) AS v FROM u, s)
SELECT k, round(tau2, 4) AS tau2, round(tanh(sum(v * z) / sum(v)), 4) AS r, round(1 / sqrt(sum(v)), 4) AS se FROM v GROUP BY k, tau2""",
    "stats_welch": f"""WITH {_WELCH} SELECT track, round(t, 4) AS t, round(df, 4) AS df, round({t_p_sql("t", "df")}, 4) AS p FROM w""",
    "stats_false_discovery": f"""WITH {_WELCH}, v AS (SELECT *, {t_p_sql("t", "df")} AS p, track % 5 AS family FROM w),
n AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p) AS n FROM v)
SELECT track, family, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p, round(least(1, min(p * m / n) OVER (PARTITION BY family ORDER BY p DESC)), 6) AS q FROM n""",
}
