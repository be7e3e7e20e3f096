"""Daily aggregates over long observations (patient_id, day, score): one shuffle by day, partial aggregation before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERE = 20.0
EPS = 1e-6
FEATURES = ["mean", "std", "cv", "skewness", "pct_severe", "median", "iqr"]


def daily_cv(obs: DataFrame) -> DataFrame:
    """The detection signal: sample deviation over mean; days with mean 0 or one observation are left out."""
    g = obs.groupBy("day").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    return g.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).where("cv IS NOT NULL")


def check_signal(n: int, std: float | None) -> None:
    if n < 20:
        raise ValueError(f"signal too short: {n} points, 20 are needed")
    if std is None or std < 1e-6:
        raise ValueError("signal has near-zero variance")


def daily_features(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Features for clustering days, also by other columns; what is undefined is 0."""
    g = obs.groupBy(*by, "day").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("score").alias("n_obs"), F.avg((F.col("score") >= SEVERE).cast("double")).alias("pct_severe"))
    cv = F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col("std") / (F.col("mean") + EPS)))
    return g.withColumn("cv", cv).fillna(0.0, ["mean", "std", "cv", "pct_severe"]).select(*by, "day", "mean", "std", "cv", "n_obs", "pct_severe")


def daily_moments(obs: DataFrame) -> DataFrame:
    """Standard and robust moments of days with two observations or more."""
    x = F.col("score")
    g = obs.groupBy("day").agg(
        F.count(x).alias("n_observations"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"),
        (F.avg((x >= SEVERE).cast("double")) * 100).alias("pct_severe"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    ).where("n_observations >= 2")
    n, q1, q2, q3 = F.col("n_observations"), F.col("q")[0], F.col("q")[1], F.col("q")[2]
    return g.select(
        "day", "n_observations", "mean", "std",
        F.when(F.col("mean") > 0, F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).otherwise(0.0).alias("cv"),
        F.when(n >= 3, F.coalesce(F.col("skew") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)), F.lit(0.0))).otherwise(0.0).alias("skewness"),
        "pct_severe", q2.alias("median"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        F.when(q2 > 0, (q3 - q1) / F.nullif(q2, F.lit(0.0))).otherwise(0.0).alias("quartile_cv"),
        F.coalesce((q3 + q1 - 2 * q2) / F.nullif(q3 - q1, F.lit(0.0)), F.lit(0.0)).alias("bowley_skew"),
    )


def summary_statistics(obs: DataFrame, n_patients: int | None = None) -> DataFrame:
    """describe() of each day over the roster; n_patients counts patients that were never seen too."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = obs.groupBy("day").agg(F.count("score").alias("count"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("min"), q.alias("q"), F.max("score").alias("max"))
    roster = F.lit(n_patients) if n_patients is not None else F.col("n")
    if n_patients is None:
        g = g.crossJoin(F.broadcast(obs.agg(F.count_distinct("patient_id").alias("n"))))  # one row
    missing = (roster - F.col("count")).alias("missing_count")
    return g.select("day", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max", missing, ((roster - F.col("count")) * 100.0 / roster).alias("missing_pct"))


def unpivot_features(moments: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return moments.unpivot(["day"], features, "feature", "value")


def score_distribution(obs: DataFrame) -> DataFrame:
    x = F.col("score")
    share = lambda c: F.avg(c.cast("double"))
    return obs.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"),
        share(x < 5).alias("minimal"), share((x >= 5) & (x < 10)).alias("mild"), share((x >= 10) & (x < 15)).alias("moderate"), share((x >= 15) & (x < 20)).alias("moderately_severe"), share(x >= 20).alias("severe"),
    )


def outlier_rate(obs: DataFrame, z: float = 3.0) -> DataFrame:
    """Two passes: the moments, one row, go to every task."""
    m = obs.agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
    far = F.abs((F.col("score") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))) > z
    return obs.crossJoin(F.broadcast(m)).agg(F.count_if(far).alias("n_outliers"), F.avg(F.coalesce(far, F.lit(False)).cast("double")).alias("rate"))


def missingness(obs: DataFrame, n_days: int | None = None, surveys: float = 15.0) -> DataFrame:
    """Total, structural (the schedule's) and excess missingness of the roster by day grid."""
    g = obs.agg(F.count("score").alias("n_obs"), F.count_distinct("patient_id").alias("n_patients"), (F.lit(n_days) if n_days else F.count_distinct("day")).alias("n_days"))
    total = 1 - F.col("n_obs") / (F.col("n_patients") * F.col("n_days"))
    g = g.withColumn("total", total).withColumn("structural", 1 - surveys / F.col("n_days")).withColumn("excess", F.col("total") - F.col("structural"))
    word = F.when(F.col("excess") < -0.05, "lower").when(F.col("excess") > 0.10, "higher").otherwise("within")
    return g.withColumn("interpretation", word)


def patient_missingness(obs: DataFrame, n_days: int | None = None) -> DataFrame:
    """(n_patients, mean, std, min, max) of the shares of days without a score, over the patients with a visit."""
    days = obs.agg((F.lit(n_days) if n_days else F.count_distinct("day")).alias("n_days"))  # one row
    each = obs.groupBy("patient_id").agg(F.count("score").alias("n")).crossJoin(F.broadcast(days)).select((1 - F.col("n") / F.col("n_days")).alias("rate"))
    return each.agg(F.count("*").alias("n_patients"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("std"), F.min("rate").alias("min"), F.max("rate").alias("max"))


def daily_trend(obs: DataFrame) -> DataFrame:
    """Line through daily means over the position of the day; the days are few, so one window orders them."""
    d = obs.groupBy("day").agg(F.avg("score").alias("mean"))
    i = d.withColumn("i", (F.row_number().over(Window.orderBy("day")) - 1).cast("double"))
    return i.agg(F.regr_slope("mean", "i").alias("slope"), F.regr_intercept("mean", "i").alias("intercept"), F.count("*").alias("n_days"))


def feature_correlation(moments: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Pearson correlations of all pairs of features, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = moments.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def strong_pairs(correlations: DataFrame, least: float = 0.5) -> DataFrame:
    return correlations.where(F.abs("r") > least).orderBy(F.desc(F.abs("r")))
