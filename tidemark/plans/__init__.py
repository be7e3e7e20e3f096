"""The registered queries over the driver's tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import daily, models, posthoc, quality, segmentation, trajectories
from ..session import ship, stored
from ..sources import obs_events, obs_lineitem, obs_orders
from . import more

CPS = [8, 15, 22]


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return posthoc.segments(daily.daily_moments(obs_events(s, d)), CPS, 5)


def _pelt(cost: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        found = segmentation.pelt(more.signals(s, d), cost)
        return found.select("series_id", "n", F.size("cps").alias("n_cp"), F.array_join(F.transform("cps", lambda c: c.cast("string")), ",").alias("cps"), F.round("penalty", 8).alias("penalty"), F.round("bic", 4).alias("bic"))

    return run


def _curve(s: SparkSession, d: str) -> DataFrame:
    return segmentation.tuning_curve(more.signals(s, d), "l2").select("series_id", F.round("penalty", 8).alias("penalty"), F.size("cps").alias("n_cp"), F.round("bic", 4).alias("bic"))


def _bh(s: SparkSession, d: str) -> DataFrame:
    """The rank tests' p values of all change points and features, corrected together."""
    return posthoc.bh(posthoc.tested(_parts(s, d)).select("change_point", "feature", F.round("p_value", 9).alias("p_value")))


def _agreement(s: SparkSession, d: str) -> DataFrame:
    """How well each type's days of largest mean and of largest deviation agree, as change points of two models."""
    days = more._days_by_type(s, d)
    whole = Window.partitionBy("dataset")
    at = days.withColumn("at", F.row_number().over(whole.orderBy("day")) / F.count("*").over(whole))
    points = at.unpivot(["dataset", "day", "at"], ["mean", "std"], "model_id", "value")
    top = F.row_number().over(Window.partitionBy("dataset", "model_id").orderBy(F.desc(F.round("value", 9)), "day"))
    return models.agreement(points.withColumn("k", top).where("k <= 5").select(F.col("dataset").alias("series_id"), "model_id", F.col("at").alias("cp")))


def _ranking(s: SparkSession, d: str) -> DataFrame:
    found = stored(segmentation.detected(more.signals(s, d)), "detected")
    return models.rank_models(models.score_models(found))


def _detected_agreement(s: SparkSession, d: str) -> DataFrame:
    return models.agreement(segmentation.detected(more.signals(s, d), costs=("l2",)).select("series_id", "model_id", F.col("position").alias("cp")))


def _kmeans_profile(s: SparkSession, d: str) -> DataFrame:
    f = daily.daily_features(obs_lineitem(s, d))
    return models.cluster_profile(f, models.kmeans_days(f))


_RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "daily_cv": lambda s, d: daily.daily_cv(obs_events(s, d)),
    "daily_features": lambda s, d: daily.daily_features(obs_events(s, d)),
    "daily_moments": lambda s, d: daily.daily_moments(obs_events(s, d)),
    "summary_statistics": lambda s, d: daily.summary_statistics(obs_events(s, d)),
    "unpivot_long": lambda s, d: daily.unpivot_features(daily.daily_moments(obs_events(s, d)), ["mean", "cv", "median"]),
    "pivot_effects": lambda s, d: posthoc.effects(_parts(s, d)).groupBy("feature").pivot("change_point", CPS).agg(F.first("cohens_d")).toDF("feature", *(f"cp{c}" for c in CPS)),
    "score_distribution": lambda s, d: daily.score_distribution(obs_events(s, d)),
    "outlier_rate": lambda s, d: daily.outlier_rate(obs_events(s, d)),
    "missingness": lambda s, d: daily.missingness(obs_orders(s, d)),
    "weighted_autocorr": lambda s, d: trajectories.weighted_autocorrelation(obs_orders(s, d)),
    "baseline_final": lambda s, d: trajectories.baseline_final(obs_orders(s, d)),
    "endpoint_nearest": lambda s, d: trajectories.endpoint_nearest(obs_orders(s, d)),
    "trajectory_fit": lambda s, d: trajectories.fits(obs_orders(s, d)),
    "response_patterns": lambda s, d: trajectories.response_patterns(obs_orders(s, d)).groupBy("pattern").count().withColumnRenamed("count", "n"),
    "pattern_vs_expected": lambda s, d: trajectories.pattern_vs_expected(trajectories.response_patterns(obs_orders(s, d))),
    "plateau": lambda s, d: trajectories.plateau(obs_orders(s, d)),
    "relapses": lambda s, d: trajectories.relapses(obs_orders(s, d)),
    "relapse_summary": lambda s, d: trajectories.relapse_summary(obs_orders(s, d)),
    "daily_trend": lambda s, d: daily.daily_trend(obs_events(s, d)),
    "feature_correlation": lambda s, d: daily.feature_correlation(daily.daily_moments(obs_events(s, d)), ["mean", "std", "cv", "median"]),
    "segment_shift": lambda s, d: posthoc.effects(_parts(s, d)),
    "mann_whitney_u": lambda s, d: posthoc.mann_whitney(_parts(s, d)),
    "permutation_exact": lambda s, d: posthoc.permutation_exact(_parts(s, d)),
    "bh_correction": _bh,
    "dominant_features": lambda s, d: posthoc.dominant(posthoc.effects(_parts(s, d))),
    "contribution_entropy": lambda s, d: posthoc.entropy(posthoc.dominant(posthoc.effects(_parts(s, d)))),
    "mahalanobis": lambda s, d: rounded(posthoc.mahalanobis(_parts(s, d)), 6),
    "pelt_l1": _pelt("l1"),
    "tuning_curve": _curve,
    "pelt_rbf": _pelt("rbf"),
    "pelt_ar": _pelt("ar"),
    "model_agreement": _agreement,
    "model_ranking": _ranking,
    "permutation_bh": lambda s, d: posthoc.bh(posthoc.permutation_exact(_parts(s, d))),
    "detected_agreement": _detected_agreement,
    "kmeans_profile": _kmeans_profile,
    "kmeans_days": lambda s, d: models.kmeans_days(daily.daily_features(obs_lineitem(s, d))),
    "validation_checks": lambda s, d: quality.checks(obs_orders(s, d)).drop("low", "high"),
}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(f(ship(spark), sf_dir))


QUERIES = {k: _query(f) for k, f in (_RAW | more.RAW).items()}

_EV = "ob AS (SELECT user_id AS p, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS day, least(27.0, avg(value) * 0.27) AS x FROM events GROUP BY 1, 2)"
_OR = "ob AS (SELECT o_custkey AS p, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7) + 1 AS INT) AS day, least(27.0, avg(o_totalprice) * 27 / 500000) AS x FROM orders GROUP BY 1, 2)"
_LI = "ob AS (SELECT l_suppkey AS p, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) + 1 AS INT) AS day, avg(l_quantity) * 27 / 50 AS x FROM lineitem GROUP BY 1, 2)"
_SIG = _LI + ", sg AS (SELECT 'lineitem' AS series_id, day AS t, stddev_samp(x) / nullif(avg(x), 0) AS x FROM ob GROUP BY day HAVING count(*) > 1)"
_MOM = (
    _EV + ", mo AS (SELECT day, count(*) AS n_observations, avg(x) AS mean, stddev_samp(x) AS std, CASE WHEN avg(x) > 0 THEN stddev_samp(x) / avg(x) ELSE 0 END AS cv, "
    "coalesce(skewness(x), 0) AS skewness, avg(CASE WHEN x >= 20 THEN 100.0 ELSE 0 END) AS pct_severe, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, "
    "quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM ob GROUP BY day HAVING count(*) >= 2)"
)
_LONG = _MOM + ", lo AS (SELECT day, f AS feature, v AS value FROM (UNPIVOT (SELECT day, mean, std, cv, CAST(skewness AS DOUBLE) AS skewness, CAST(pct_severe AS DOUBLE) AS pct_severe, median, iqr FROM mo) ON mean, std, cv, skewness, pct_severe, median, iqr INTO NAME f VALUE v))"
_SEG = _LONG + ", cp AS (SELECT unnest([8, 15, 22]) AS c), pa AS (SELECT c AS change_point, feature, day, value, day >= c AS post FROM lo JOIN cp ON day >= c - 5 AND day < least(c + 5, (SELECT max(day) FROM mo)))"
_EFF = (
    _SEG + ", e0 AS (SELECT change_point, feature, count(*) FILTER (NOT post) AS n1, count(*) FILTER (post) AS n2, avg(value) FILTER (NOT post) AS pre_mean, avg(value) FILTER (post) AS post_mean, var_samp(value) FILTER (NOT post) AS v1, var_samp(value) FILTER (post) AS v2 FROM pa GROUP BY ALL), "
    "ef AS (SELECT *, post_mean - pre_mean AS delta, coalesce((post_mean - pre_mean) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0), 0) AS cohens_d FROM e0)"
)
_DOM = _EFF + ", dm AS (SELECT change_point, feature, cohens_d, abs(cohens_d) * 100 / sum(abs(cohens_d)) OVER (PARTITION BY change_point) AS contribution FROM ef)"
_FIT = (
    _OR + ", f0 AS (SELECT p AS patient_id, count(*) AS n_obs, arg_min(x, day) AS baseline, arg_max(x, day) AS final, regr_slope(x, day) AS slope, regr_r2(x, day) AS r2, max(day) - min(day) AS duration, "
    "count(*) FILTER (day <= 70) AS ne, arg_min(x, day) FILTER (day <= 70) AS e0, arg_max(x, day) FILTER (day <= 70) AS e1 FROM ob GROUP BY p HAVING count(*) >= 5), "
    "ft AS (SELECT *, CASE WHEN baseline > 0 THEN (baseline - final) / baseline ELSE 0 END AS pct, CASE WHEN ne >= 2 AND e0 > 0 THEN (e0 - e1) / e0 ELSE 0 END AS early FROM f0), "
    "pt AS (SELECT CASE WHEN pct < 0.2 OR slope > -0.02 THEN 'non_responder' WHEN slope <= -0.08 THEN 'early_responder' WHEN slope <= -0.04 THEN 'gradual_responder' ELSE 'late_responder' END AS pattern, count(*) AS n FROM ft GROUP BY 1)"
)
_STEP = _OR + ", st AS (SELECT *, lead(day) OVER w AS nd, lead(x) OVER w AS nx FROM ob WINDOW w AS (PARTITION BY p ORDER BY day))"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


ORACLE: dict[str, str] = {
    "daily_cv": f"WITH {_EV}, g AS (SELECT day, avg(x) AS mean, stddev_samp(x) AS std, stddev_samp(x) / nullif(avg(x), 0) AS cv FROM ob GROUP BY day) SELECT day, {_r('mean', 'std', 'cv')} FROM g WHERE cv IS NOT NULL",
    "daily_features": f"WITH {_EV} SELECT day, round(avg(x), 9) AS mean, round(coalesce(stddev_samp(x), 0), 9) AS std, round(coalesce(greatest(0, least(5, stddev_samp(x) / (avg(x) + 1e-6))), 0), 9) AS cv, count(*) AS n_obs, round(avg(CASE WHEN x >= 20 THEN 1.0 ELSE 0 END), 9) AS pct_severe FROM ob GROUP BY day",
    "daily_moments": f"WITH {_MOM} SELECT day, n_observations, {_r('mean', 'std', 'cv', 'skewness', 'pct_severe', 'median', 'q1', 'q3', 'iqr')}, round(CASE WHEN median > 0 THEN iqr / median ELSE 0 END, 9) AS quartile_cv, round(coalesce((q3 + q1 - 2 * median) / nullif(iqr, 0), 0), 9) AS bowley_skew FROM mo",
    "summary_statistics": f"WITH {_EV}, n AS (SELECT count(DISTINCT p) AS n FROM ob) SELECT day, count(*) AS \"count\", round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, round(min(x), 9) AS \"min\", round(quantile_cont(x, 0.25), 9) AS p25, round(quantile_cont(x, 0.5), 9) AS p50, round(quantile_cont(x, 0.75), 9) AS p75, round(max(x), 9) AS \"max\", any_value(n) - count(*) AS missing_count, round((any_value(n) - count(*)) * 100.0 / any_value(n), 9) AS missing_pct FROM ob, n GROUP BY day",
    "unpivot_long": f"WITH {_LONG} SELECT day, feature, round(value, 9) AS value FROM lo WHERE feature IN ('mean', 'cv', 'median')",
    "pivot_effects": f"WITH {_EFF} SELECT feature, " + ", ".join(f"round(max(cohens_d) FILTER (change_point = {c}), 9) AS cp{c}" for c in CPS) + " FROM ef GROUP BY feature",
    "score_distribution": f"WITH {_EV} SELECT count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, round(skewness(x) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 9) AS skewness, round(kurtosis_pop(x), 9) AS kurtosis, round(min(x), 9) AS \"min\", round(max(x), 9) AS \"max\", " + ", ".join(f"round(avg(CASE WHEN x >= {a} AND x < {b} THEN 1.0 ELSE 0 END), 9) AS {n}" for n, a, b in (("minimal", -1, 5), ("mild", 5, 10), ("moderate", 10, 15), ("moderately_severe", 15, 20), ("severe", 20, 99))) + " FROM ob",
    "outlier_rate": f"WITH {_EV}, m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM ob) SELECT count(*) FILTER (abs(x - mu) / sd > 3) AS n_outliers, round(avg(CASE WHEN abs(x - mu) / sd > 3 THEN 1.0 ELSE 0 END), 9) AS rate FROM ob, m",
    "missingness": f"WITH {_OR}, g AS (SELECT count(*) AS n_obs, count(DISTINCT p) AS n_patients, count(DISTINCT day) AS n_days FROM ob), h AS (SELECT *, 1 - n_obs / (n_patients * n_days) AS total, 1 - 15.0 / n_days AS structural FROM g), i AS (SELECT *, total - structural AS excess FROM h) SELECT n_obs, n_patients, n_days, {_r('total', 'structural', 'excess')}, CASE WHEN excess < -0.05 THEN 'lower' WHEN excess > 0.1 THEN 'higher' ELSE 'within' END AS interpretation FROM i",
    "weighted_autocorr": f"WITH {_STEP}, c AS (SELECT p FROM ob GROUP BY p HAVING count(*) >= 3), w AS (SELECT p, x, nx AS y, exp(-(nd - day) / 10.0) AS w FROM st SEMI JOIN c USING (p) WHERE nd - day <= 21), g AS (SELECT p, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM w GROUP BY p) SELECT p AS patient_id, round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 9) AS r, round(sw * sw / sww, 9) AS n_eff FROM g WHERE sw * sw / sww >= 3 AND xx - mx * mx > 1e-12 AND yy - my * my > 1e-12",
    "baseline_final": f"WITH {_OR} SELECT p AS patient_id, count(*) AS n, round(arg_min(x, day), 9) AS baseline, round(arg_max(x, day), 9) AS final FROM ob GROUP BY p",
    "endpoint_nearest": f"WITH {_OR}, b AS (SELECT p, count(*) AS n, arg_min(x, day) AS baseline FROM ob GROUP BY p), e AS (SELECT p, day, x, row_number() OVER (PARTITION BY p ORDER BY abs(day - 84), day) AS i FROM ob WHERE abs(day - 84) <= 14) SELECT p AS patient_id, round(baseline, 9) AS baseline, day AS end_day, round(x, 9) AS end_score, round(baseline - x, 9) AS improvement, baseline > 0 AS counted, coalesce((baseline - x) / nullif(baseline, 0) >= 0.5, false) AS responder FROM b JOIN e USING (p) WHERE i = 1 AND n >= 2",
    "trajectory_fit": f"WITH {_FIT} SELECT patient_id, n_obs, {_r('baseline', 'final')}, round(baseline - final, 9) AS improvement, round(pct, 9) AS improvement_pct, {_r('slope', 'r2')}, duration, round(early, 9) AS early_improvement FROM ft",
    "response_patterns": f"WITH {_FIT} SELECT pattern, n FROM pt",
    "pattern_vs_expected": f"WITH {_FIT}, e AS (SELECT * FROM (VALUES ('early_responder', 30.0), ('gradual_responder', 35.0), ('late_responder', 15.0), ('non_responder', 20.0)) t(pattern, expected_pct)), j AS (SELECT pattern, coalesce(n, 0) AS observed, coalesce(n, 0) * 100.0 / (SELECT sum(n) FROM pt) AS observed_pct, CAST(expected_pct AS DOUBLE) AS expected_pct FROM e LEFT JOIN pt USING (pattern)) SELECT pattern, observed, {_r('observed_pct', 'expected_pct')}, round(greatest(0, 100 - avg(abs(observed_pct - expected_pct)) OVER ()), 9) AS match_score FROM j",
    "plateau": f"WITH {_OR}, n AS (SELECT *, count(*) OVER (PARTITION BY p) AS n FROM ob), w AS (SELECT p, day, n, " + ", ".join(f"count(*) OVER w{k} AS c{k}, var_pop(x) OVER w{k} AS v{k}, regr_slope(x, day) OVER w{k} AS s{k}" for k in (3, 4)) + " FROM n WHERE n >= 6 WINDOW w3 AS (PARTITION BY p ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), w4 AS (PARTITION BY p ORDER BY day ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT p AS patient_id, min(day) AS plateau_day FROM w WHERE (n < 8 AND c3 = 3 AND v3 <= 2 AND abs(s3) <= 0.01) OR (n >= 8 AND c4 = 4 AND v4 <= 2 AND abs(s4) <= 0.01) GROUP BY p",
    "relapses": f"WITH {_STEP} SELECT p AS patient_id, nd AS day, nd - day AS gap, round(nx - x, 9) AS increase FROM st WHERE nd - day BETWEEN 7 AND 30 AND nx - x >= 3",
    "relapse_summary": f"WITH {_STEP}, r AS (SELECT p, count(*) AS c FROM st WHERE nd - day BETWEEN 7 AND 30 AND nx - x >= 3 GROUP BY p), a AS (SELECT count(DISTINCT p) AS n FROM ob) SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS events, count(c) AS patients_with, round(count(c) / any_value(n), 9) AS rate, round(coalesce(sum(c), 0) / any_value(n), 9) AS per_patient FROM a LEFT JOIN r ON true",
    "daily_trend": f"WITH {_EV}, d AS (SELECT day, avg(x) AS m FROM ob GROUP BY day), i AS (SELECT m, row_number() OVER (ORDER BY day) - 1 AS i FROM d) SELECT round(regr_slope(m, i), 9) AS slope, round(regr_intercept(m, i), 9) AS intercept, count(*) AS n_days FROM i",
    "feature_correlation": f"WITH {_MOM} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM mo" for a, b in (("mean", "std"), ("mean", "cv"), ("mean", "median"), ("std", "cv"), ("std", "median"), ("cv", "median"))),
    "segment_shift": f"WITH {_EFF} SELECT change_point, feature, n1, n2, {_r('pre_mean', 'post_mean', 'delta')}, round(coalesce(delta * 100 / nullif(pre_mean, 0), 0), 9) AS pct_change, round(cohens_d, 9) AS cohens_d, CASE WHEN abs(cohens_d) < 0.2 THEN 'Trivial' WHEN abs(cohens_d) < 0.5 THEN 'Small' WHEN abs(cohens_d) < 0.8 THEN 'Medium' ELSE 'Large' END AS interpretation FROM ef",
    "mann_whitney_u": f"WITH {_SEG}, r AS (SELECT *, count(*) OVER (PARTITION BY change_point, feature, value) AS t, rank() OVER (PARTITION BY change_point, feature ORDER BY value) AS k FROM pa), g AS (SELECT change_point, feature, count(*) FILTER (NOT post) AS n1, count(*) FILTER (post) AS n2, sum(k + (t - 1) / 2) FILTER (NOT post) AS r1, sum(t * t - 1) AS tie FROM r GROUP BY ALL), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM g) SELECT change_point, feature, n1, n2, round(u, 9) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))), 0), 9) AS z FROM u",
    "dominant_features": f"WITH {_DOM} SELECT change_point, feature, {_r('cohens_d', 'contribution')}, CAST(row_number() OVER (PARTITION BY change_point ORDER BY contribution DESC, feature) AS INT) AS rank, contribution >= 25 AS is_dominant FROM dm",
    "contribution_entropy": f"WITH {_DOM}, g AS (SELECT change_point, sum(CASE WHEN contribution > 0 THEN -contribution / 100 * ln(contribution / 100) ELSE 0 END) AS entropy, count(*) AS k FROM dm GROUP BY change_point) SELECT change_point, round(entropy, 9) AS entropy, round(entropy / ln(k), 9) AS normalized FROM g",
}

ORACLE["autocorrelation_report"] = (
    f"WITH {_STEP}, ra AS ({ORACLE['weighted_autocorr']}), c AS (SELECT p FROM ob GROUP BY p HAVING count(*) >= 3), ga AS (SELECT nd - day AS gap FROM st SEMI JOIN c USING (p) WHERE nd IS NOT NULL) "
    "SELECT round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS std, min(r) AS least, max(r) AS greatest, count(r) AS n_patients, (SELECT CAST(quantile_cont(gap, 0.5) AS DOUBLE) FROM ga) AS median_gap, (SELECT round(avg(CASE WHEN gap <= 14 THEN 1e0 ELSE 0 END), 9) FROM ga) AS share_near FROM ra"
)


def _checks_sql() -> str:
    """The values of the checks from the SQL of their parts, and each check's bounds."""
    parts = {
        "score_min": f"(WITH {_OR} SELECT min(x) FROM ob)",
        "score_max": f"(WITH {_OR} SELECT max(x) FROM ob)",
        "autocorrelation": f"(SELECT avg(r) FROM ({ORACLE['weighted_autocorr']}))",
        "baseline_mean": f"(SELECT avg(baseline) FROM ({ORACLE['baseline_final']}))",
        "improvement_12_weeks": f"(SELECT avg(improvement) FROM ({ORACLE['endpoint_nearest']}))",
        "response_rate_12_weeks": f"(SELECT avg(CASE WHEN responder THEN 1e0 ELSE 0e0 END) FILTER (counted) FROM ({ORACLE['endpoint_nearest']}))",
        "missingness": f"(SELECT total FROM ({ORACLE['missingness']}))",
        "excess_missingness": f"(SELECT excess FROM ({ORACLE['missingness']}))",
        "n_days": f"(SELECT n_days FROM ({ORACLE['missingness']}))",
        "n_observations": f"(SELECT n_obs FROM ({ORACLE['missingness']}))",
        "outlier_rate": f"(WITH {_OR}, m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM ob) SELECT avg(CASE WHEN abs(x - mu) / sd > 3 THEN 1e0 ELSE 0e0 END) FROM ob, m)",
    }
    bound = lambda b: "NULL" if b is None else f"{b}e0"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", round(CAST({parts[k]} AS DOUBLE), 6) AS value, CAST({bound(lo)} AS DOUBLE) AS low, CAST({bound(hi)} AS DOUBLE) AS high, '{level}' AS level" for k, (lo, hi, level) in quality.BOUNDS.items())
    return f"SELECT \"check\", value, level, coalesce((low IS NULL OR value >= low) AND (high IS NULL OR value <= high) AND value IS NOT NULL, false) AS ok FROM ({rows})"


ORACLE["validation_checks"] = _checks_sql()
ORACLE |= more.oracle(_EV, _OR, _LI, _MOM, _EFF, _SEG, _DOM, _FIT, _r)


ORACLE["tuning_curve"] = ORACLE["pelt_l2"][: ORACLE["pelt_l2"].index(", ch AS (")] + " SELECT series_id, round(pen, 8) AS penalty, CAST(len(cps) AS INT) AS n_cp, round(bic, 4) AS bic FROM bi"
ORACLE["model_agreement"] = """WITH ob AS (SELECT event_type AS ds, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS day, least(27.0, avg(value) * 0.27) AS x FROM events GROUP BY 1, 2, 3),
f AS (SELECT ds, day, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std FROM ob GROUP BY ds, day), a AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY day) / count(*) OVER (PARTITION BY ds) AS cp FROM f),
p AS (SELECT ds, day, cp, 'mean' AS m, mean AS v FROM a UNION ALL SELECT ds, day, cp, 'std', std FROM a), t AS (SELECT ds, m, cp FROM p QUALIFY row_number() OVER (PARTITION BY ds, m ORDER BY round(v, 9) DESC, day) <= 5),
e AS (SELECT a.ds, a.m, a.cp, max(exp(-pow((a.cp - b.cp) / 0.02e0, 2))) AS c, avg(exp(-pow((a.cp - b.cp) / 0.02e0, 2))) AS d FROM t a JOIN t b ON a.ds = b.ds AND a.m <> b.m GROUP BY ALL)
SELECT ds AS series_id, m AS model_id, round(avg(c), 9) AS consensus, round(avg(d), 9) AS density, count(*) AS n_cp, round((avg(c) + avg(d)) / 2, 9) AS stability FROM e GROUP BY 1, 2"""
ORACLE["bh_correction"] = f"""WITH t AS (SELECT change_point, feature, round(p_value, 9) AS p_value FROM ({ORACLE['effects_with_tests']})), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, change_point, feature) AS i FROM t)
SELECT change_point, feature, p_value, round(least(1, min(p_value * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_bh, round(least(1, p_value * m), 9) AS p_bonferroni,
least(1, min(p_value * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) < 0.05 AS significant FROM r"""


def _mahalanobis_sql() -> str:
    """The inverse covariance by sweeping one row of the matrix after the other, a table for each step."""
    names = ["cv", "mean", "skewness", "pct_severe"]
    k = range(len(names))
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in k for j in k if i <= j]
    wide = ", ".join(f"max(value) FILTER (feature = '{f}') AS f{i}" for i, f in enumerate(names))
    cov = ", ".join(f"((n0 - 1) * c0_{i}{j} + (n1 - 1) * c1_{i}{j}) / (n0 + n1 - 2) + {1e-6 if i == j else 0e0} AS s{i}{j}" for i, j in pairs)
    side = ", ".join(f"covar_samp(f{i}, f{j}) FILTER ({'NOT ' * (not b)}post) AS c{b}_{i}{j}" for b in (0, 1) for i, j in pairs)
    moved = ", ".join(f"avg(f{i}) FILTER (post) - avg(f{i}) FILTER (NOT post) AS z{i}" for i in k)
    out = f"WITH {_SEG}, w AS (SELECT change_point, day, post, {wide} FROM pa GROUP BY ALL HAVING count(DISTINCT feature) FILTER (feature IN ({', '.join(repr(f) for f in names)})) = 4), a AS (SELECT change_point, count(*) FILTER (NOT post) AS n0, count(*) FILTER (post) AS n1, {moved}, {side} FROM w GROUP BY 1), t0 AS (SELECT change_point, {', '.join(f'z{i}' for i in k)}, {cov} FROM a WHERE n0 >= 2 AND n1 >= 2)"
    for p in k:
        d = s(p, p)
        new = {(i, j): f"-1 / {d}" if i == j == p else f"{s(i, j)} / {d}" if p in (i, j) else f"{s(i, j)} - {s(i, p)} * {s(p, j)} / {d}" for i, j in pairs}
        out += f", t{p + 1} AS (SELECT change_point, {', '.join(f'z{i}' for i in k)}, {', '.join(f'{e} AS s{i}{j}' for (i, j), e in new.items())} FROM t{p})"
    square = " - ".join(["0"] + [f"z{i} * z{j} * {s(i, j)}" for i in k for j in k])
    parts = " UNION ALL ".join(f"SELECT change_point, '{f}' AS feature, z{i} * z{i} / s{i}{i} AS part FROM t0" for i, f in enumerate(names))
    return out + f", e AS ({parts}) SELECT change_point, round(sqrt({square}), 6) AS distance, feature, round(coalesce(part / nullif(sum(part) OVER (PARTITION BY change_point), 0) * 100, 0), 6) AS share FROM e JOIN t4 USING (change_point)"


ORACLE["mahalanobis"] = _mahalanobis_sql()
