"""Inference over recordings: serial correlation, effective sample sizes, partial and pooled correlations, classes of places.

What is summed over rows is summed by Spark (group sums combine before the shuffle). Only the serial correlation of one
walk needs its rows side by side: walks come in order in Arrow batches, some whole ones at a time, and their lags stop as
soon as they are noise. Everything after that is one row a walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import t_critical, t_p_sql
from ..sources.tables import EVENTS_SQL, events
from .orbits import gated
from .statistics import benjamini_hochberg, t_p
from .windows import rolling_percentile

#: Rows that a walk needs; pairs that are left after covariates; walks for a verdict; seconds of a peak bin; rows of a class, and of a walk in it.
LEAST_ROWS, LEAST_EFFECTIVE, SOLID, BIN_S, CLASS_ROWS, WALK_ROWS = 10, 4, 5, 15.0, 5, 5
#: Rows of whole walks that are worked on at once, about.
BATCH = 50_000
#: Fixed value: a distance that means "nothing near".
NOTHING_NEAR = 999.0


def valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x != NOTHING_NEAR)


def as_binary(x: Column) -> Column:
    """1 and 0 for what is or means true and false, else null."""
    text = F.lower(x.cast("string"))
    return F.when(text.isin("true", "1", "1.0"), 1.0).when(text.isin("false", "0", "0.0"), 0.0)


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.3, "strong").when(a >= 0.2, "moderate").when(a >= 0.1, "small").otherwise("negligible")


def grade(k: Column) -> Column:
    return F.when(k < 3, "fewWalks").when(k < SOLID, "metaProvisional").otherwise("meta")


def autocorrelation(x: np.ndarray, most: int) -> np.ndarray:
    """Of lags 0 to ``most``, over the variance at lag 0; zeros for a constant and beyond the series."""
    out, d = np.zeros(most + 1), x - x.mean() if x.size else x
    size = float(d @ d)
    if x.size > 1 and size > 0:
        for k in range(min(most, x.size - 1) + 1):
            out[k] = float(d[: x.size - k] @ d[k:]) / size
    return out


def inflation(a: np.ndarray, b: np.ndarray | None = None) -> float:
    """Of the variance of a mean (one series) or of a correlation (two), by their serial correlation up to the first lag that is noise."""
    n = a.size
    da, db = a - a.mean() if n else a, None if b is None else b - b.mean()
    ca, cb = float(da @ da), None if b is None else float(db @ db)
    if n < 8 or ca == 0 or cb == 0:
        return 1.0
    total, noise = 0.0, 2 / n**0.5
    for k in range(1, max(1, n // 5) + 1):
        ra = float(da[: n - k] @ da[k:]) / ca
        rb = ra if b is None else float(db[: n - k] @ db[k:]) / cb
        if abs(ra) < noise and abs(rb) < noise:
            break
        total += (1 - k / n) * (ra if b is None else ra * rb)
    return max(1.0, 1 + 2 * total)


def effective(a: np.ndarray, b: np.ndarray | None = None) -> float:
    return float(a.size) if a.size < 8 else max(2.0, min(float(a.size), a.size / inflation(a, b)))


def _r(x: np.ndarray, y: np.ndarray) -> float:
    dx, dy = x - x.mean(), y - y.mean()
    size = float(dx @ dx) * float(dy @ dy)
    return max(-1.0, min(1.0, float(dx @ dy) / size**0.5)) if size > 0 else 0.0


def _residual(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    dz = z - z.mean()
    return y - y.mean() - dz * (float(dz @ y) / float(dz @ dz))


def _per_walk(df: DataFrame, keys: list[str], columns: list[str], out: list[str], kernel: Callable[..., list[float | None]]) -> DataFrame:
    """One row for each group of ``keys``: n and what the kernel makes from the columns in time order."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in out)])

    def done(table: pa.Table) -> pa.RecordBatch:
        first = _starts(table, keys)
        values = [table.column(c).to_numpy().astype(float) for c in columns]
        ends = np.append(first[1:], table.num_rows)
        made = [kernel(*(v[a:b] for v in values)) for a, b in zip(first, ends, strict=True)]
        cols = [pa.array([m[i] for m in made], pa.float64()) for i in range(len(out))]
        return pa.RecordBatch.from_arrays([*(table.column(k).take(pa.array(first)).combine_chunks() for k in keys), pa.array(ends - first, pa.int64()), *cols], names=[*keys, "n", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (keys, time): whole walks of some batches at once; the last one waits for its end."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                table = pa.Table.from_batches(held).combine_chunks()
                if last := int(_starts(table, keys)[-1]):
                    yield done(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), table.num_rows - last
        if rows:
            yield done(pa.Table.from_batches(held).combine_chunks())

    rows = df.select(*keys, "t", "idx", *columns)
    for c in columns:
        rows = rows.where(valid(F.col(c)))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "t", "idx").mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new group begins in rows that are sorted by the keys."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def effective_sizes(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mean, n_eff) of each walk."""
    return _per_walk(df, keys or ["track"], [x], ["mean", "n_eff"], lambda a: [float(a.mean()), effective(a)])


def autocorrelations(df: DataFrame, x: str, most: int) -> DataFrame:
    """(track, lag, r): lags by a window over the walk, for a fixed number of them; no walk is gathered."""
    whole, by = Window.partitionBy("track"), Window.partitionBy("track").orderBy("t", "idx")
    d = df.where(valid(F.col(x))).withColumn("_d", F.col(x) - F.avg(x).over(whole))
    sums = d.withColumns({f"_{k}": F.col("_d") * F.lead("_d", k).over(by) for k in range(1, most + 1)}).groupBy("track").agg(F.sum(F.col("_d") * F.col("_d")).alias("_0"), *(F.sum(f"_{k}").alias(f"_{k}") for k in range(1, most + 1)))
    long = sums.select("track", F.col("_0").alias("size"), F.posexplode(F.array(*(F.col(f"_{k}") for k in range(most + 1)))).alias("lag", "s"))
    return long.select("track", "lag", F.when(F.col("size") > 0, F.coalesce(F.col("s") / F.col("size"), F.lit(0.0))).otherwise(0.0).alias("r"))


def walk_correlations(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, r, n_eff, varied, p): Pearson's r of each walk, tested on its effective number of pairs."""
    kernel = lambda a, b: [_r(a, b), effective(a, b), float(a.var() > 0 and b.var() > 0)]
    return _tested(_per_walk(df, keys or ["track"], [x, y], ["r", "n_eff", "varied"], kernel), 0)


def partial_correlations(df: DataFrame, x: str, y: str, z: str, keys: list[str] | None = None) -> DataFrame:
    """``walk_correlations`` of what z leaves of x and y, with ``raw_r`` of the same rows; a z that doesn't vary leaves all of it."""

    def kernel(a, b, c):
        raw = _r(a, b)
        if a.size < 4 or not c.var() > 1e-12:
            return [raw if a.size >= 4 else 0.0, effective(a, b), 0.0, raw]
        a, b = _residual(a, c), _residual(b, c)
        return [_r(a, b), effective(a, b), 1.0, raw]

    made = _per_walk(df, keys or ["track"], [x, y, z], ["r", "n_eff", "varied", "raw_r"], kernel)
    return _tested(made, F.col("varied"))


def _tested(walks: DataFrame, covariates) -> DataFrame:
    freedom = F.col("n_eff") - 2 - covariates
    t = F.col("r") * F.sqrt(freedom / (1 - F.col("r") * F.col("r")))
    tested = (F.col("n_eff") - covariates > 3) & (F.abs("r") < 1)
    p = F.when(tested, t_p(F.when(tested, t), freedom)).when((F.col("n_eff") - covariates > 3) & (F.abs("r") >= 1), 0.0).otherwise(1.0)
    return walks.withColumn("p", p)


def pooled(walks: DataFrame, keys: list[str], covariates: int = 0) -> DataFrame:
    """(keys, k, r, tau2, i2, se, t, p, method) from (r, n, n_eff, varied) of walks: random effects with the wider of two errors.

    Walks of under ``LEAST_ROWS`` rows, without variation or with too few effective pairs are left out; under three
    walks r is their mean and nothing is tested.
    """
    left = F.col("n_eff") - covariates
    use = walks.where((F.col("n") >= LEAST_ROWS) & (F.col("varied") > 0) & (left >= LEAST_EFFECTIVE)).select(*keys, "r", F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), "r"))).alias("z"), (left - 3).alias("w"))
    s = use.groupBy(*keys).agg(F.count("*").alias("k"), F.avg("r").alias("mean_r"), F.sum("w").alias("sw"), F.sum(F.expr("w * w")).alias("sw2"), (F.sum(F.expr("w * z")) / F.sum("w")).alias("fixed"))
    met = use.join(s, keys) if keys else use.crossJoin(F.broadcast(s))  # one row a key
    q = met.groupBy(*keys, "k", "mean_r", "sw", "sw2").agg(F.sum(F.expr("w * (z - fixed) * (z - fixed)")).alias("q"))
    c, df = F.col("sw") - F.col("sw2") / F.col("sw"), F.col("k") - 1
    q = q.select(*keys, "k", "mean_r", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / c)).otherwise(0.0).alias("tau2"), F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q")) * 100).otherwise(0.0).alias("i2"))
    v = 1 / (1 / F.col("w") + F.col("tau2"))
    met = (use.join(q, keys) if keys else use.crossJoin(F.broadcast(q))).withColumn("v", v)
    e = met.groupBy(*keys, "k", "mean_r", "tau2", "i2").agg(F.sum("v").alias("sv"), F.sum(F.expr("v * z")).alias("svz"), F.sum(F.expr("v * z * z")).alias("svzz"))
    mean = F.col("svz") / F.col("sv")
    spread = F.greatest(F.lit(0.0), F.col("svzz") - F.col("svz") * mean)
    se = F.greatest(F.sqrt(1 / F.col("sv")), F.coalesce(F.sqrt(F.try_divide(spread, df * F.col("sv"))), F.lit(0.0)))
    few = F.col("k") < 3
    out = e.select(*keys, "k", "mean_r", "tau2", "i2", mean.alias("z"), se.alias("se"))
    t = F.when(~few, F.col("z") / F.col("se"))
    out = out.withColumn("t", t).withColumn("p", F.when(~few, t_p("t", (F.col("k") - 1).cast("double"))).otherwise(1.0))
    some = lambda c: F.when(~few, F.col(c)).alias(c)
    return out.select(*keys, "k", F.when(few, F.col("mean_r")).otherwise(F.tanh("z")).alias("r"), some("tau2"), some("i2"), some("se"), "t", "p", grade(F.col("k")).alias("method"))


def peak_bins(samples: DataFrame, peaks: DataFrame, seconds: float = BIN_S) -> DataFrame:
    """``samples`` with ``peaks``: how many of the peaks fall into their bin of time."""
    bin_ = F.floor(F.col("t") / seconds)
    counts = peaks.groupBy("track", bin_.alias("_bin")).agg(F.count("*").alias("peaks"))
    return samples.withColumn("_bin", bin_).join(counts, ["track", "_bin"], "left").withColumn("peaks", F.coalesce("peaks", F.lit(0).cast("long"))).drop("_bin")


def binned(samples: DataFrame, x: str, seconds: float = BIN_S) -> DataFrame:
    """(track, t, idx, x, peaks): a point for each bin, so that a bin's count is no longer repeated for each row."""
    g = samples.where(valid(F.col(x))).groupBy("track", F.floor(F.col("t") / seconds).alias("idx")).agg(F.avg(x).alias(x), F.max("peaks").cast("double").alias("peaks"))
    return g.withColumn("t", F.col("idx") * seconds)


def every_second(df: DataFrame, values: list[str], step_s: float = 1.0) -> DataFrame:
    """Samples no closer than ``step_s``: means of the ``values`` over the time before each. The gate goes by blocks, so that no track is gathered."""
    frame = f"over (partition by track order by t range between {step_s - 1e-6}D preceding and current row)"
    means = df.select("track", "t", "idx", *(F.expr(f"avg({v}) {frame}").alias(v) for v in values))
    return gated(means, ["track"], F.col("t"), step_s - 1e-9, ["t", "idx"])


def feature_matrix(samples: DataFrame, features: list[str], channels: list[str], covariate: str | None = None) -> DataFrame:
    """(feature, channel, k, r, ..., varies, q): pooled correlation of each feature with each channel, q over the features of a channel.

    With a covariate its share is taken out of both first. Only solid verdicts on features that vary enter q.
    """
    stacked = lambda names, key, v: F.explode(F.array(*(F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(v)) for c in names))).alias(f"_{key}")
    keep = ["track", "t", "idx", *([covariate] if covariate else [])]
    long = samples.select(*keep, *channels, stacked(features, "feature", "x")).select(*keep, "_feature.*", stacked(channels, "channel", "y")).select(*keep, "feature", "x", "_channel.*")
    keys = ["feature", "channel"]
    walks = partial_correlations(long, "x", "y", covariate, [*keys, "track"]) if covariate else walk_correlations(long, "x", "y", [*keys, "track"])
    made = pooled(walks, keys, 1 if covariate else 0)
    sigma = F.stddev_pop("x")
    varies = long.where(valid(F.col("x"))).groupBy("feature").agg(((F.count("x") > 2) & (sigma > 0) & (sigma / (F.abs(F.avg("x")) + 1e-9) >= 0.01)).alias("varies"))
    made = made.join(varies, "feature").withColumn("_p", F.when(F.col("varies") & (F.col("method") == "meta"), F.col("p")))
    return benjamini_hochberg(made, "_p", "channel").drop("_p")


@F.pandas_udf(T.DoubleType())
def t_limit(df: pd.Series) -> pd.Series:
    return pd.Series([t_critical(d) if d > 0 else None for d in df])


def class_profile(rows: DataFrame, key: str, x: str, peaks: DataFrame | None = None, skip: tuple[str, ...] = ("unclassified",)) -> DataFrame:
    """(key, n, walks, mean, sigma, n_eff, se, df, half_width, peaks_a_minute) of each class of places, the highest mean first.

    The error is the larger of that within walks (effective sizes, summed over walks) and that between walks' means.
    Rows are seconds; ``peaks`` has (key) for each peak.
    """
    known = rows.where(F.col(key).isNotNull() & ~F.col(key).isin(*skip) & valid(F.col(x)))
    walks = effective_sizes(known, x, [key, "track"])
    spread = known.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sigma"))
    of = walks.groupBy(key).agg(F.count("*").alias("walks"), F.sum("n_eff").alias("n_eff"), F.count(F.when(F.col("n") >= WALK_ROWS, 1)).alias("k"), F.stddev_samp(F.when(F.col("n") >= WALK_ROWS, F.col("mean"))).alias("between"))
    g = spread.join(of, key).where(F.col("n") >= CLASS_ROWS)
    inner = F.when(F.col("n_eff") > 1, F.col("sigma") / F.sqrt("n_eff")).otherwise(0.0)
    outer = F.when(F.col("k") > 1, F.col("between") / F.sqrt("k"))
    wider = F.coalesce(outer > inner, F.lit(False))
    g = g.withColumns({"se": F.when(wider, outer).otherwise(inner), "df": F.when(wider, F.col("k") - 1).otherwise(F.greatest(F.lit(1.0), F.col("n_eff") - 1)).cast("double")})
    if peaks is not None:
        g = g.join(peaks.groupBy(key).agg(F.count("*").alias("peaks")), key, "left")
    else:
        g = g.withColumn("peaks", F.lit(0))
    g = g.withColumn("half_width", F.when(F.col("se") > 0, t_limit("df") * F.col("se")).otherwise(0.0)).withColumn("peaks_a_minute", F.coalesce("peaks", F.lit(0)) / (F.col("n") / 60))
    return g.select(key, "n", "walks", "mean", "sigma", "n_eff", "se", "df", "half_width", "peaks_a_minute").orderBy(F.desc("mean"), key)


def compare_extremes(profile: DataFrame, key: str) -> DataFrame:
    """One row: the class with the highest against that with the lowest mean, p times the number of pairs they were picked from."""
    row = F.struct("mean", key, "se", "df")
    e = profile.agg(F.max(row).alias("hi"), F.min(row).alias("lo"), F.count("*").alias("groups")).where("groups > 1")
    va, vb = F.pow("hi.se", F.lit(2)), F.pow("lo.se", F.lit(2))
    both = va + vb
    e = e.withColumns({"t": F.when(both > 0, (F.col("hi.mean") - F.col("lo.mean")) / F.sqrt(both)).otherwise(0.0), "df": F.when(both > 0, F.pow(both, F.lit(2)) / (va * va / F.col("hi.df") + vb * vb / F.col("lo.df"))).otherwise(0.0)})
    e = e.withColumn("p", F.when((both > 0) & (F.col("df") > 0), t_p("t", "df")).otherwise(1.0))
    pairs = F.col("groups") * (F.col("groups") - 1) / 2
    change = F.when(F.col("lo.mean") != 0, (F.col("hi.mean") / F.col("lo.mean") - 1) * 100).otherwise(0.0)
    return e.select(F.col(f"hi.{key}").alias("high"), F.col(f"lo.{key}").alias("low"), change.alias("change_pct"), "t", "df", "p", F.least(F.lit(1.0), F.col("p") * pairs).alias("p_adjusted"), "groups")


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _samples(spark, d):
    e = events(spark, d)
    return e.withColumns({"tonic": rolling_percentile(F.col("value"), 10, 0.1), "hour": F.floor(F.col("t") / 3600) % 24, "seven": (F.col("idx") % 7).cast("double"), "speed": (F.col("idx") * 31 % 50) / 10.0})


def _profile(spark, d):
    return class_profile(events(spark, d), "kind", "value", events(spark, d).where("value > 60"), ())


QUERIES = {
    "stats_effective": lambda s, d: _round(effective_sizes(events(s, d), "value")),
    "stats_autocorrelation": lambda s, d: _round(autocorrelations(events(s, d), "value", 5)),
    "stats_walks": lambda s, d: _round(walk_correlations(_samples(s, d), "hour", "tonic").select("track", "n", "r", "n_eff")),
    "stats_partial": lambda s, d: _round(partial_correlations(_samples(s, d), "hour", "tonic", "speed").select("track", "n", "r", "n_eff", "raw_r")),
    "stats_matrix": lambda s, d: _round(feature_matrix(_samples(s, d), ["hour", "seven"], ["value", "tonic"]).select("feature", "channel", "k", "r", "tau2", "i2", "se", "t", "p", "method", "varies", "q")),
    "stats_peak_bins": lambda s, d: peak_bins(events(s, d), events(s, d).where("value > 60"), 86400.0).select("track", "idx", "peaks"),
    "stats_classes": lambda s, d: _round(_profile(s, d).select("kind", "n", "walks", "mean", "sigma", "n_eff", "se", "df", "half_width", "peaks_a_minute")),
    "stats_extremes": lambda s, d: _round(compare_extremes(_profile(s, d), "kind").select("high", "low", "change_pct", "t", "df", "p", "p_adjusted", "groups")),
    "stats_every_second": lambda s, d: _round(every_second(events(s, d), ["value"], 7200.0)),
}
_S = f"""{EVENTS_SQL}, s0 AS (SELECT *, list_sort(list(value) OVER (PARTITION BY track ORDER BY t, idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS fr FROM e),
s AS (SELECT track, t, idx, value, fr[least(floor(len(fr) * 0.1), len(fr) - 1)::int + 1] AS tonic, floor(t / 3600)::bigint % 24 AS hour, (idx % 7)::double AS seven, (idx * 31 % 50) / 10.0::double AS speed FROM s0)"""
#: Effective pairs of (g, x, y) in rows q(g, r, n, x, y) with r from 1 in time order; y is x for a mean.
_EFF = """m AS (SELECT g, r, n, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, corr(x, y) OVER w AS c FROM q WINDOW w AS (PARTITION BY g)),
z AS (SELECT g, any_value(n) AS n, sum(x * x) AS cx, sum(y * y) AS cy, sum(x * y) AS cxy FROM m GROUP BY g),
l AS (SELECT a.g, b.r - a.r AS k, sum(a.x * b.x) AS lx, sum(a.y * b.y) AS ly FROM m a JOIN m b ON a.g = b.g AND b.r > a.r AND b.r - a.r <= greatest(1, a.n // 5) GROUP BY a.g, b.r - a.r),
h AS (SELECT l.g, k, n, lx / cx AS ra, ly / cy AS rb, min(CASE WHEN abs(lx / cx) < 2 / sqrt(n) AND abs(ly / cy) < 2 / sqrt(n) THEN k END) OVER (PARTITION BY l.g) AS stop FROM l JOIN z ON z.g = l.g WHERE cx > 0 AND cy > 0),
v AS (SELECT g, sum((1 - k / n) * {0}) AS s FROM h WHERE stop IS NULL OR k < stop GROUP BY g),
f AS (SELECT z.g, z.n, cx, cy, CASE WHEN cx > 0 AND cy > 0 THEN greatest(-1, least(1, cxy / sqrt(cx * cy))) ELSE 0 END AS rr,
  CASE WHEN z.n < 8 THEN z.n ELSE greatest(2, least(z.n, z.n / greatest(1, 1 + 2 * coalesce(s, 0)))) END AS n_eff FROM z LEFT JOIN v ON v.g = z.g)"""
_NUM = "row_number() OVER (PARTITION BY {0} ORDER BY t, idx) AS r, count(*) OVER (PARTITION BY {0}) AS n"
_META = """w AS (SELECT *, atanh(greatest(-0.9999::double, least(0.9999::double, rr))) AS zz, n_eff - 3 AS wt FROM f WHERE n >= 10 AND cx > 0 AND cy > 0 AND n_eff >= 4),
a AS (SELECT g[1] AS feature, g[2] AS channel, count(*) AS k, avg(rr) AS mr, sum(wt * zz * zz) - sum(wt * zz) ** 2 / sum(wt) AS q, sum(wt) - sum(wt * wt) / sum(wt) AS c FROM w GROUP BY ALL),
b AS (SELECT *, CASE WHEN c > 0 THEN greatest(0, (q - (k - 1)) / c) ELSE 0 END AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END AS i2 FROM a),
d AS (SELECT feature, channel, k, mr, tau2, i2, sum(1 / (1 / wt + tau2)) AS sv, sum(zz / (1 / wt + tau2)) AS sz, sum(zz * zz / (1 / wt + tau2)) AS szz FROM b JOIN w ON w.g[1] = feature AND w.g[2] = channel GROUP BY ALL),
u AS (SELECT *, sz / sv AS mz, greatest(sqrt(1 / sv), sqrt(greatest(0, szz - sz * sz / sv) / ((k - 1) * sv))) AS se FROM d)"""
ORACLE_SQL = {
    "stats_effective": f"WITH {EVENTS_SQL}, q AS (SELECT track AS g, value AS x, value AS y, {_NUM.format('track')} FROM e WHERE value IS NOT NULL), {_EFF.format('ra')}, o AS (SELECT g, avg(x) AS mean FROM q GROUP BY g) SELECT f.g AS track, n, round(mean, 6) AS mean, round(n_eff::double, 6) AS n_eff FROM f JOIN o ON o.g = f.g",
    "stats_autocorrelation": f"""WITH {EVENTS_SQL}, q AS (SELECT track, value - avg(value) OVER (PARTITION BY track) AS d, row_number() OVER (PARTITION BY track ORDER BY t, idx) AS r FROM e WHERE value IS NOT NULL),
k AS (SELECT a.track, lag, sum(a.d * b.d) AS s FROM q a, range(6) l(lag) LEFT JOIN q b ON b.track = a.track AND b.r = a.r + lag GROUP BY ALL), z AS (SELECT track, sum(d * d) AS c FROM q GROUP BY track)
SELECT k.track, lag::int AS lag, round(CASE WHEN c > 0 THEN coalesce(s / c, 0) ELSE 0 END, 6) AS r FROM k JOIN z USING (track)""",
    "stats_walks": f"WITH {_S}, q AS (SELECT track AS g, hour::double AS x, tonic AS y, {_NUM.format('track')} FROM s WHERE tonic IS NOT NULL), {_EFF.format('ra * rb')} SELECT g AS track, n, round(rr, 6) AS r, round(n_eff::double, 6) AS n_eff FROM f",
    "stats_partial": f"""WITH {_S}, r0 AS (SELECT *, regr_slope(hour, speed) OVER p AS bx, regr_slope(tonic, speed) OVER p AS by_, avg(speed) OVER p AS ms, avg(hour) OVER p AS mx, avg(tonic) OVER p AS my, var_pop(speed) OVER p AS vz, corr(hour, tonic) OVER p AS raw, count(*) OVER p AS nn FROM s WHERE tonic IS NOT NULL WINDOW p AS (PARTITION BY track)),
q AS (SELECT track AS g, {_NUM.format('track')}, CASE WHEN vz > 1e-12 AND nn >= 4 THEN hour - mx - bx * (speed - ms) ELSE hour END AS x, CASE WHEN vz > 1e-12 AND nn >= 4 THEN tonic - my - by_ * (speed - ms) ELSE tonic END AS y FROM r0), {_EFF.format('ra * rb')},
o AS (SELECT track, max(raw) AS raw FROM r0 GROUP BY track) SELECT g AS track, n, round(CASE WHEN n < 4 THEN 0 ELSE rr END, 6) AS r, round(n_eff::double, 6) AS n_eff, round(coalesce(raw, 0), 6) AS raw_r FROM f JOIN o ON o.track = f.g""",
    "stats_matrix": f"""WITH {_S}, q0 AS (SELECT [feature, channel, track::varchar] AS g, t, idx, x, y FROM (SELECT track, t, idx, value, tonic, unnest(['hour', 'seven']) AS feature, unnest([hour::double, seven]) AS x FROM s) f0, LATERAL (SELECT unnest(['value', 'tonic']) AS channel, unnest([value, tonic]) AS y) c0 WHERE x IS NOT NULL AND y IS NOT NULL),
q AS (SELECT g, x, y, {_NUM.format('g')} FROM q0), {_EFF.format('ra * rb')}, {_META},
y0 AS (SELECT feature, stddev_pop(x) AS sd, avg(x) AS mx, count(*) AS nx FROM (SELECT 'hour' AS feature, hour::double AS x FROM s UNION ALL SELECT 'seven', seven FROM s) GROUP BY feature),
pt AS (SELECT u.*, CASE WHEN k >= 3 THEN {t_p_sql("(mz / se)", "(k - 1)")} ELSE 1 END AS p, nx > 2 AND sd > 0 AND sd / (abs(mx) + 1e-9) >= 0.01 AS varies FROM u JOIN y0 USING (feature)),
pv AS (SELECT *, CASE WHEN varies AND k >= 5 THEN p END AS pp FROM pt), pn AS (SELECT *, count(pp) OVER (PARTITION BY channel) AS pm, count(pp) OVER (PARTITION BY channel ORDER BY pp NULLS LAST) AS pr FROM pv),
pq AS (SELECT *, CASE WHEN pp IS NOT NULL THEN least(1, min(pp * pm / pr) OVER (PARTITION BY channel ORDER BY pp DESC NULLS LAST)) END AS q FROM pn)
SELECT feature, channel, k, round(CASE WHEN k < 3 THEN mr ELSE tanh(mz) END, 6) AS r, round(CASE WHEN k >= 3 THEN tau2 END, 6) AS tau2, round(CASE WHEN k >= 3 THEN i2 END, 6) AS i2, round(CASE WHEN k >= 3 THEN se END, 6) AS se, round(CASE WHEN k >= 3 THEN mz / se END, 6) AS t,
  CASE WHEN k < 3 THEN 'fewWalks' WHEN k < 5 THEN 'metaProvisional' ELSE 'meta' END AS method, varies, round(p, 6) AS p, round(q, 6) AS q FROM pq""",
    "stats_peak_bins": f"WITH {EVENTS_SQL}, b AS (SELECT track, floor(t / 86400) AS b, count(*) AS peaks FROM e WHERE value > 60 GROUP BY ALL) SELECT e.track, idx, coalesce(peaks, 0) AS peaks FROM e LEFT JOIN b ON b.track = e.track AND b.b = floor(e.t / 86400)",
    "stats_every_second": f"""WITH RECURSIVE {EVENTS_SQL}, m AS (SELECT track, t, idx, avg(value) OVER (PARTITION BY track ORDER BY t RANGE BETWEEN 7199.999999 PRECEDING AND CURRENT ROW) AS value, row_number() OVER (PARTITION BY track ORDER BY t, idx) AS r FROM e),
g AS (SELECT track, r, t, true AS ok, t AS last FROM m WHERE r = 1 UNION ALL SELECT m.track, m.r, m.t, m.t >= g.last + 7200 - 1e-9, CASE WHEN m.t >= g.last + 7200 - 1e-9 THEN m.t ELSE g.last END FROM g JOIN m ON m.track = g.track AND m.r = g.r + 1)
SELECT m.track, round(m.t, 6) AS t, idx, round(value, 6) AS value FROM m JOIN g ON g.track = m.track AND g.r = m.r AND ok""",
}
_CLASS = f"""WITH {EVENTS_SQL}, q AS (SELECT [kind, track::varchar] AS g, value AS x, value AS y, {_NUM.format('kind, track')} FROM e WHERE value IS NOT NULL AND kind IS NOT NULL), {_EFF.format('ra')},
wm AS (SELECT f.g, n_eff, f.n, o.mean FROM f JOIN (SELECT g, avg(x) AS mean FROM q GROUP BY g) o ON o.g = f.g),
k AS (SELECT g[1] AS kind, count(*) AS walks, sum(n_eff) AS n_eff, count(*) FILTER (n >= 5) AS k, stddev_samp(mean) FILTER (n >= 5) AS between_ FROM wm GROUP BY ALL),
y0 AS (SELECT kind, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sigma, count(*) FILTER (value > 60) AS peaks FROM e WHERE value IS NOT NULL GROUP BY kind),
p AS (SELECT y0.*, walks, n_eff, k, CASE WHEN n_eff > 1 THEN sigma / sqrt(n_eff) ELSE 0 END AS i, CASE WHEN k > 1 THEN between_ / sqrt(k) END AS o FROM y0 JOIN k USING (kind) WHERE n >= 5),
pr AS (SELECT *, CASE WHEN coalesce(o > i, false) THEN o ELSE i END AS se, CASE WHEN coalesce(o > i, false) THEN k - 1 ELSE greatest(1, n_eff - 1) END::double AS df FROM p)"""
ORACLE_SQL |= {
    "stats_classes": f"{_CLASS.replace('WITH', 'WITH RECURSIVE', 1)}, bi AS (SELECT kind, df, 0::DOUBLE AS lo, 1000::DOUBLE AS hi, 0 AS i FROM pr UNION ALL SELECT kind, df, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, i + 1 FROM (SELECT *, {t_p_sql('mid', 'df', 4000)} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE i < 45))) SELECT kind, round(CASE WHEN se > 0 THEN lo * se ELSE 0 END, 6) AS half_width, n, walks, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(n_eff, 6) AS n_eff, round(se, 6) AS se, round(df, 6) AS df, round(peaks / (n / 60), 6) AS peaks_a_minute FROM pr JOIN (SELECT kind, lo FROM bi WHERE i = 45) USING (kind)",
    "stats_extremes": f"""{_CLASS}, hi AS (SELECT * FROM pr ORDER BY mean DESC LIMIT 1), lo AS (SELECT * FROM pr ORDER BY mean LIMIT 1), ng AS (SELECT count(*) AS groups FROM pr),
ex AS (SELECT hi.kind AS high, lo.kind AS low, (hi.mean / lo.mean - 1) * 100 AS change_pct, (hi.mean - lo.mean) / sqrt(hi.se ** 2 + lo.se ** 2) AS t, (hi.se ** 2 + lo.se ** 2) ** 2 / (hi.se ** 4 / hi.df + lo.se ** 4 / lo.df) AS df, groups FROM hi, lo, ng),
ep AS (SELECT *, {t_p_sql("t", "df")} AS p FROM ex)
SELECT high, low, round(change_pct, 6) AS change_pct, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p, round(least(1, p * (groups * (groups - 1) / 2)), 6) AS p_adjusted, groups FROM ep""",
}
