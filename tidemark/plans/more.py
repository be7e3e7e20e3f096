"""More registered queries: change points of many series, labels, evidence, datasets, streams; and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare, daily, detect, inference, labels, linkage, models, optimal, plotdata, posthoc, sequence, trajectories
from ..session import stored
from ..settings import Detection
from ..sources import obs_events, obs_lineitem, obs_orders

CPS = [8, 15, 22]


def signals(s: SparkSession, d: str) -> DataFrame:
    """Weekly variation of the suppliers' mean quantities, a series for each region."""
    t = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("supplier", "nation", "region")}
    of = t["supplier"].join(F.broadcast(t["nation"]), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    obs = obs_lineitem(s, d).join(of.select(F.col("s_suppkey").alias("patient_id"), F.col("r_name").alias("series_id")), "patient_id")
    g = obs.groupBy("series_id", "day").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    return g.select("series_id", F.col("day").alias("t"), (F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).alias("x")).where("x IS NOT NULL")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return posthoc.segments(daily.daily_moments(obs_events(s, d)), CPS, 5)


def _pelt(s: SparkSession, d: str) -> DataFrame:
    found = detect.pelt_l2(signals(s, d))
    return found.select("series_id", "n", F.size("cps").alias("n_cp"), F.array_join(F.transform("cps", lambda c: c.cast("string")), ",").alias("cps"), F.round("penalty", 8).alias("penalty"), F.round("bic", 4).alias("bic"))


def _bocpd(s: SparkSession, d: str) -> DataFrame:
    x = signals(s, d)
    return detect.bocpd(x, "student_t").withColumn("likelihood", F.lit("student_t")).unionByName(detect.bocpd(x, "gaussian").withColumn("likelihood", F.lit("gaussian")))


def _hazards(s: SparkSession, d: str) -> DataFrame:
    x = signals(s, d)
    v, a, u = (detect.hazard(x, k, 50.0, 300.0).withColumnRenamed("hazard_lambda", k) for k in ("variance", "autocorr", "uniform"))
    return v.join(a.drop("n"), "series_id").join(u.drop("n"), "series_id")


def _cp_tests(s: SparkSession, d: str) -> DataFrame:
    x = signals(s, d)
    return detect.validate(stored(detect.points(detect.pelt_l2(x)), "points"), x)


def _seg_stats(s: SparkSession, d: str) -> DataFrame:
    x = signals(s, d)
    return detect.segment_statistics(detect.pelt_l2(x), x)


def _labels(s: SparkSession, d: str) -> DataFrame:
    x = F.col("score")
    rows = obs_events(s, d).select(labels.band_of_whole_scores(x).alias("whole"), labels.band(x).alias("band"), labels.colour(x).alias("colour"))
    return rows.groupBy("whole", "band", "colour").agg(F.count("*").alias("n"))


def _slopes(s: SparkSession, d: str) -> DataFrame:
    return trajectories.fits(obs_orders(s, d)).select(labels.pattern_of_slope(F.col("slope")).alias("pattern"), "slope").groupBy("pattern").agg(F.count("*").alias("n"), F.avg("slope").alias("mean_slope"))


def _bins(s: SparkSession, d: str) -> DataFrame:
    return posthoc.effects(_parts(s, d)).select(labels.effect_bin(F.col("cohens_d")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def _full(s: SparkSession, d: str) -> DataFrame:
    return posthoc.effects_with_tests(_parts(s, d))


def _hypotheses(s: SparkSession, d: str) -> DataFrame:
    return posthoc.hypotheses(_full(s, d), posthoc.dominant(posthoc.effects(_parts(s, d))))


def _evidence(s: SparkSession, d: str) -> DataFrame:
    share = posthoc.dominant(posthoc.effects(_parts(s, d)))
    return posthoc.evidence(share, daily.feature_correlation(daily.daily_moments(obs_events(s, d))), _hypotheses(s, d))


def _stated(s: SparkSession, d: str) -> DataFrame:
    """What a dataset should look like: the days and users of the whole table, half of the grid missing."""
    e = s.read.parquet(f"{d}/events.parquet")
    whole = e.agg(F.count_distinct(F.to_date("ts")).cast("int").alias("total_days"), F.count_distinct("user_id").cast("int").alias("n_patients"))
    return e.select(F.col("event_type").alias("dataset")).distinct().crossJoin(F.broadcast(whole)).withColumn("missingness_rate", F.lit(0.5))


def _clusters(obs: DataFrame) -> DataFrame:
    return optimal.two_clusters(daily.daily_features(obs, ("dataset",)), ["mean", "std", "cv", "n_obs", "pct_severe"])


def _datasets(s: SparkSession, d: str) -> DataFrame:
    obs = obs_events(s, d, by_type=True)
    return compare.rank_datasets(obs, _clusters(obs), _stated(s, d))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return _clusters(obs_lineitem(s, d).withColumn("dataset", F.lit("lineitem")))


def _profile(s: SparkSession, d: str) -> DataFrame:
    return models.cluster_profile(daily.daily_features(obs_lineitem(s, d)), _levels(s, d).select("day", "label"))


def _samples(s: SparkSession, d: str) -> DataFrame:
    obs = obs_orders(s, d)
    return sequence.sample_trajectories(obs, trajectories.response_patterns(obs).select("patient_id", "pattern"))


def _stream(which: str, keys: list[str] | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        from .. import streaming

        schema = s.read.parquet(f"{d}/events.parquet").schema
        events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
        return streaming.drain(getattr(streaming, which)(events), keys)

    return run


def _days_by_type(s: SparkSession, d: str) -> DataFrame:
    g = obs_events(s, d, by_type=True).groupBy("dataset", "day")
    return g.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"))


def _heights(s: SparkSession, d: str) -> DataFrame:
    merges = linkage.agglomerate(linkage.temporal_distances(_days_by_type(s, d), ["mean", "std"]), "average")
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("height"))
    return merges.select("dataset", place.alias("place"), "height")


def _elbow(s: SparkSession, d: str) -> DataFrame:
    return optimal.elbows(optimal.inertias(optimal.fits(_days_by_type(s, d), ["mean", "std"], 2)))


def _run(s: SparkSession, d: str) -> DataFrame:
    from . import runs

    return runs.summary(runs.detection(signals(s, d), Detection(costs=("l2",), likelihoods=("student_t",)))["detected"])


def _temporal(s: SparkSession, d: str) -> DataFrame:
    return linkage.temporal_clusters(_days_by_type(s, d), ["mean", "std"]).withColumnRenamed("dataset", "series_id")


def _events(s: SparkSession, d: str, series: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return events.select(F.col(series).cast("string").alias("series_id"), "ts", F.col("value").alias("x"))


def _online_runs(s: SparkSession, d: str) -> DataFrame:
    from ..streaming import online

    out = online.drained(online.run_lengths(_events(s, d, "event_type"), 50.0, 30.0, 900.0, longest=32))
    return out.where("NOT late").select("series_id", "t", F.round("p", 8).alias("p"), "run")


def _online_relapses(s: SparkSession, d: str) -> DataFrame:
    from ..streaming import online

    out = online.drained(online.relapses(_events(s, d, "user_id"), threshold=20.0, low=1, high=5))
    return out.where("NOT late").select("series_id", F.timestamp_micros("at").alias("ts"), "gap", F.round("increase", 6).alias("increase"))


RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pelt_l2": _pelt,
    "bocpd": _bocpd,
    "hazard_heuristics": _hazards,
    "change_point_tests": _cp_tests,
    "segment_statistics": _seg_stats,
    "lag1_corr": lambda s, d: sequence.lag1(signals(s, d)),
    "rolling_variance": lambda s, d: detect.rolling_variance(signals(s, d)),
    "score_labels": _labels,
    "slope_patterns": _slopes,
    "effect_bins": _bins,
    "effects_with_tests": _full,
    "significant_effects": lambda s, d: posthoc.significant_effects(_full(s, d)).select("change_point", "feature", "cohens_d", "place"),
    "hypotheses": _hypotheses,
    "evidence": _evidence,
    "dataset_ranking": _datasets,
    "cluster_profile": _profile,
    "cluster_boundaries": lambda s, d: sequence.boundaries(_levels(s, d)),
    "observation_days": lambda s, d: sequence.observation_days(obs_orders(s, d)),
    "score_histogram": lambda s, d: sequence.histogram(obs_events(s, d), "score", 0.0, 27.0, 20),
    "sample_trajectories": _samples,
    "hazard_predictive": lambda s, d: detect.predictive_hazard(signals(s, d)),
    "patient_missingness": lambda s, d: daily.patient_missingness(obs_orders(s, d)),
    "plot_daily_line": lambda s, d: plotdata.daily_line(obs_events(s, d)),
    "plot_relapses_by_gap": lambda s, d: plotdata.relapses_by_gap(obs_orders(s, d)),
    "plot_marked_signal": lambda s, d: plotdata.marked_signal(signals(s, d), detect.pelt_l2(signals(s, d))),
    "stream_daily_cv": _stream("daily_cv", ["day"]),
    "stream_sliding_cv": _stream("sliding_cv", ["start"]),
    "stream_sessions": _stream("sessions", None),
    "t_test": lambda s, d: inference.t_test(_parts(s, d)),
    "chosen_tests": lambda s, d: inference.chosen_tests(_parts(s, d)),
    "permutation_shuffled": lambda s, d: inference.permutation(posthoc.segments(daily.daily_moments(obs_events(s, d)), CPS, 10)),
    "shapiro_wilk": lambda s, d: inference.shapiro_wilk(_days_by_type(s, d).withColumnRenamed("mean", "value"), ["dataset"]),
    "temporal_cluster": _temporal,
    "linkage_heights": _heights,
    "elbow_select": _elbow,
    "posterior_map": lambda s, d: detect.posterior_map(signals(s, d), least=0.001),
    "detection_run": _run,
    "autocorrelation_report": lambda s, d: trajectories.autocorrelation_report(obs_orders(s, d)),
    "cluster_numbers": lambda s, d: optimal.choose(_days_by_type(s, d), ["mean", "std"]),
    "gap_statistic": lambda s, d: optimal.gap(_days_by_type(s, d), ["mean", "std"]),
    "online_run_lengths": _online_runs,
    "online_relapses": _online_relapses,
}


def _two_sql(obs: str, starts: int = 9, rounds: int = 12) -> str:
    """Two clusters of the days of each ds by rounds of k-means from several cuts along the mean; lb has the cheapest ones."""
    f = ("m", "s", "c", "o", "v")
    out = f"""da AS (SELECT ds, day, CAST(avg(x) AS DOUBLE) AS m, CAST(coalesce(stddev_samp(x), 0) AS DOUBLE) AS s, CAST(coalesce(greatest(0, least(5, stddev_samp(x) / (avg(x) + 1e-6))), 0) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS o, avg(CASE WHEN x >= 20 THEN 1e0 ELSE 0e0 END) AS v FROM {obs} GROUP BY 1, 2),
pl AS (SELECT *, count(*) OVER (PARTITION BY ds) AS n, row_number() OVER (PARTITION BY ds ORDER BY round(m, 9), day) - 1 AS i FROM da),
l0 AS (SELECT ds, run, day, {", ".join(f)}, CAST(i * {starts + 1} >= n * run AS INT) AS label, 0e0 AS square FROM pl CROSS JOIN (SELECT CAST(unnest(range(1, {starts + 1})) AS INT) AS run))"""
    for i in range(rounds):
        out += f""",
c{i} AS (SELECT ds, run, label, {", ".join(f"avg({x}) AS c{x}" for x in f)} FROM l{i} GROUP BY ALL),
l{i + 1} AS (SELECT ds, run, day, {", ".join(f"any_value({x}) AS {x}" for x in f)}, CAST(arg_min(label, (round(q, 9), label)) AS INT) AS label, arg_min(q, (round(q, 9), label)) AS square
    FROM (SELECT p.ds, p.run, p.day, {", ".join(f"p.{x}" for x in f)}, k.label, {" + ".join(f"(p.{x} - k.c{x}) * (p.{x} - k.c{x})" for x in f)} AS q FROM l0 p JOIN c{i} k ON p.ds = k.ds AND p.run = k.run) GROUP BY ds, run, day)"""
    return out + f""",
ch AS (SELECT ds, arg_min(run, (round(q, 6), run)) AS run FROM (SELECT ds, run, sum(square) AS q FROM l{rounds} GROUP BY ALL) GROUP BY 1),
lm AS (SELECT ds, run, label, avg(m) AS a FROM l{rounds} GROUP BY ALL), lo AS (SELECT ds, label, row_number() OVER (PARTITION BY ds ORDER BY round(a, 9), label) - 1 AS place FROM lm SEMI JOIN ch USING (ds, run)),
lb AS (SELECT ds, day, m, CAST(place AS INT) AS label FROM l{rounds} SEMI JOIN ch USING (ds, run) JOIN lo USING (ds, label))"""


def _fits_sql(smallest: int, largest: int, rounds: int, runs: int, seed: int = 1234) -> str:
    """The rounds of k-means over days by type, and uniform references, as a chain of tables; ct has the costs."""
    chance = lambda f: f"CAST(CAST('0x' || substr(md5('{seed}:' || run || ':' || dataset || ':' || day || ':{f}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0"
    out = f"""ob AS (SELECT event_type AS ds, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS day, least(27.0, avg(value) * 0.27) AS x FROM events GROUP BY 1, 2, 3),
da AS (SELECT ds AS dataset, day, CAST(avg(x) AS DOUBLE) AS m, CAST(coalesce(stddev_samp(x), 0) AS DOUBLE) AS s FROM ob GROUP BY 1, 2),
bo AS (SELECT dataset, min(m) AS m0, max(m) AS m1, min(s) AS s0, max(s) AS s1 FROM da GROUP BY 1),
po AS (SELECT dataset, -1 AS run, day, m, s FROM da UNION ALL SELECT dataset, run, day, m0 + {chance("mean")} * (m1 - m0), s0 + {chance("std")} * (s1 - s0) FROM da JOIN bo USING (dataset) CROSS JOIN (SELECT CAST(unnest(range({runs})) AS INT) AS run)),
pl AS (SELECT *, count(*) OVER (PARTITION BY dataset, run) AS n, row_number() OVER (PARTITION BY dataset, run ORDER BY round(m, 9), day) - 1 AS i FROM po),
l0 AS (SELECT dataset, run, k, day, m, s, CAST(floor(i * k / n) AS INT) AS label, 0e0 AS square FROM pl CROSS JOIN (SELECT CAST(unnest(range({smallest}, {largest + 1})) AS INT) AS k) WHERE k <= n)"""
    for i in range(rounds):
        out += f""",
c{i} AS (SELECT dataset, run, k, label, avg(m) AS cm, avg(s) AS cs FROM l{i} GROUP BY ALL),
l{i + 1} AS (SELECT dataset, run, k, day, any_value(m) AS m, any_value(s) AS s, CAST(arg_min(label, (round(q, 9), label)) AS INT) AS label, arg_min(q, (round(q, 9), label)) AS square
    FROM (SELECT p.dataset, p.run, p.k, p.day, p.m, p.s, c.label, (p.m - c.cm) * (p.m - c.cm) + (p.s - c.cs) * (p.s - c.cs) AS q FROM l0 p JOIN c{i} c ON p.dataset = c.dataset AND p.run = c.run AND p.k = c.k) GROUP BY dataset, run, k, day)"""
    return out + f", ct AS (SELECT dataset, run, k, sum(square) AS inertia FROM l{rounds} GROUP BY ALL)"


_BEND = """, sc AS (SELECT dataset, k, (k - min(k) OVER w) / nullif(CAST(max(k) OVER w - min(k) OVER w AS DOUBLE), 0) AS x, (inertia - min(inertia) OVER w) / nullif(max(inertia) OVER w - min(inertia) OVER w, 0) AS y FROM ct WINDOW w AS (PARTITION BY dataset)),
be AS (SELECT dataset, CAST(coalesce(arg_max(k, (round(abs(x + y - 1), 9), -k)) FILTER (y IS NOT NULL), 2) AS INT) AS k FROM sc GROUP BY dataset)"""
_WIDTHS = """, pr AS (SELECT a.dataset, a.k, a.day, a.label, b.label AS l, sum(sqrt((a.m - b.m) * (a.m - b.m) + (a.s - b.s) * (a.s - b.s))) AS s, count(*) AS n FROM l8 a JOIN l8 b ON a.dataset = b.dataset AND a.k = b.k GROUP BY ALL),
wi AS (SELECT dataset, k, day, max(n) FILTER (l = label) AS own, max(s / nullif(n - 1, 0)) FILTER (l = label) AS a, min(s / n) FILTER (l <> label) AS b FROM pr GROUP BY ALL),
si AS (SELECT dataset, k, coalesce(avg(CASE WHEN own = 1 THEN 0e0 ELSE coalesce((b - coalesce(a, 0)) / nullif(greatest(coalesce(a, 0), b), 0), 0) END) FILTER (b IS NOT NULL), -1) AS silhouette FROM wi GROUP BY ALL)"""


def oracle(ev: str, orders: str, li: str, mom: str, eff: str, seg: str, dom: str, fit: str, r: Callable[..., str]) -> dict[str, str]:
    """SQL from the common table expressions of the other queries."""
    rg = li + ", og AS (SELECT r_name AS series_id, day, ob.x FROM ob JOIN supplier ON s_suppkey = p JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey), sg AS (SELECT series_id, day AS t, stddev_samp(x) / nullif(avg(x), 0) AS x FROM og GROUP BY ALL HAVING count(*) > 1)"
    roll = rg + ", rv AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, CASE WHEN count(*) OVER w = 5 THEN var_samp(x) OVER w END AS v FROM sg WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), rf AS (SELECT series_id, t, i, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS variance FROM rv)"
    test = seg + ", mr AS (SELECT *, count(*) OVER (PARTITION BY change_point, feature, value) AS ti, rank() OVER (PARTITION BY change_point, feature ORDER BY value) AS k FROM pa), mg AS (SELECT change_point, feature, count(*) FILTER (NOT post) AS n1, count(*) FILTER (post) AS n2, sum(k + (ti - 1) / 2) FILTER (NOT post) AS r1, sum(ti * ti - 1) AS tie FROM mr GROUP BY ALL), mu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM mg), mz AS (SELECT change_point, feature, u, greatest(0, coalesce((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))), 0), 0)) / sqrt(2) AS z FROM mu), "
    test += "mp AS (SELECT change_point, feature, u, CASE WHEN z <= 0 THEN 1.0 ELSE least(1, greatest(0, 1 - exp(-z * z) * list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(z) - lgamma(n + 1.5)))))) END AS p_value FROM mz), mt AS (SELECT *, 0.05 / count(*) OVER () AS alpha_corrected FROM mp)"
    full = eff.replace(seg, test) + ", fu AS (SELECT *, p_value < alpha_corrected AS significant FROM ef JOIN mt USING (change_point, feature))"
    full_dom = dom.replace(eff, full)
    hyp = full_dom + ", rk AS (SELECT *, row_number() OVER (PARTITION BY change_point ORDER BY contribution DESC, feature) AS i FROM dm), hy AS (SELECT change_point, feature AS driver, contribution, contribution >= 30 AND significant AS confirmed FROM rk JOIN (SELECT change_point, feature, significant FROM fu) USING (change_point, feature) WHERE i = 1)"
    bands = lambda edges: " ".join(f"WHEN {c} THEN '{n}'" for c, n in edges)
    types = "eo AS (SELECT event_type AS ds, user_id AS p, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS day, least(27.0, avg(value) * 0.27) AS x FROM events GROUP BY 1, 2, 3)"
    levels = li + ", ol AS (SELECT 'lineitem' AS ds, * FROM ob), " + _two_sql("ol")
    out = {
        "pelt_l2": f"WITH RECURSIVE {rg}, ar AS (SELECT series_id, list(x ORDER BY t) AS x, CAST(count(*) AS INT) AS n FROM sg GROUP BY 1 HAVING count(*) >= 10), pr AS (SELECT series_id, n, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(x[1:i]), 0.0)) AS p, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda v: v * v)), 0.0)) AS q FROM ar), "
        "pn AS (SELECT pow(10.0, -2 + 3 * unnest(range(0, 50)) / 49.0) AS pen), f AS (SELECT series_id, n, pen, 0 AS j, [-pen] AS best, [0] AS back FROM pr, pn UNION ALL SELECT f.series_id, f.n, pen, j + 1, list_append(best, m.c), list_append(back, m.i) FROM (SELECT f.*, CASE WHEN j + 1 < 5 THEN {'c': CAST('inf' AS DOUBLE), 'i': 0} ELSE list_min(list_transform(range(0, j - 3), lambda i: {'c': best[i + 1] + (q[j + 2] - q[i + 1]) - (p[j + 2] - p[i + 1]) * (p[j + 2] - p[i + 1]) / (j + 1 - i) + pen, 'i': CAST(i AS INT)})) END AS m FROM f JOIN pr USING (series_id) WHERE j < f.n) f), "
        "en AS (SELECT series_id, n, pen, back FROM f WHERE j = n), b AS (SELECT series_id, n, pen, back, n AS pos, CAST([] AS INT[]) AS cps FROM en UNION ALL SELECT series_id, n, pen, back, back[pos + 1], CASE WHEN back[pos + 1] > 0 THEN list_prepend(back[pos + 1], cps) ELSE cps END FROM b WHERE pos > 0), "
        "dn AS (SELECT b.series_id, b.n, pen, cps, list_concat([0], cps, [b.n]) AS e, p, q FROM b JOIN pr USING (series_id) WHERE pos = 0), rs AS (SELECT *, list_sum(list_transform(range(1, len(e)), lambda k: q[e[k + 1] + 1] - q[e[k] + 1] - pow(p[e[k + 1] + 1] - p[e[k] + 1], 2) / (e[k + 1] - e[k]))) AS rss FROM dn), bi AS (SELECT *, n * ln(greatest(rss / n, 1e-10)) + 2 * (len(cps) + 1) * ln(n) AS bic FROM rs), ch AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(bic, 9), pen) AS k FROM bi) "
        "SELECT series_id, n, CAST(len(cps) AS INT) AS n_cp, array_to_string(cps, ',') AS cps, round(pen, 8) AS penalty, round(bic, 4) AS bic FROM ch WHERE k = 1",
        "hazard_heuristics": f"WITH {roll}, sz AS (SELECT series_id, CAST(count(*) AS INT) AS n FROM sg GROUP BY 1), df AS (SELECT series_id, i, abs(lead(variance) OVER (PARTITION BY series_id ORDER BY i) - variance) AS d FROM rf), lm AS (SELECT series_id, quantile_cont(d, 0.75) AS l FROM df GROUP BY 1), ro AS (SELECT series_id, i FROM df JOIN lm USING (series_id) WHERE d > l), ed AS (SELECT series_id, i FROM ro UNION ALL SELECT series_id, 0 FROM sz UNION ALL SELECT series_id, n FROM sz), gp AS (SELECT series_id, lead(i) OVER (PARTITION BY series_id ORDER BY i) - i AS g FROM ed), md AS (SELECT series_id, quantile_cont(g, 0.5) AS g FROM gp GROUP BY 1), k AS (SELECT series_id, count(*) AS k FROM ro GROUP BY 1), "
        "au AS (SELECT series_id, greatest(-0.99, least(0.99, corr(x, y))) AS r FROM (SELECT *, lead(x) OVER (PARTITION BY series_id ORDER BY t) AS y FROM sg) GROUP BY 1) SELECT series_id, n, round(greatest(50, least(300, CASE WHEN n < 10 THEN n / 4 WHEN coalesce(k, 0) > 1 THEN g ELSE n / 5 END)), 9) AS variance, round(greatest(50, least(300, CASE WHEN n <= 5 THEN n / 4 WHEN r > 0.01 THEN least(-1 / ln(r), n / 3) ELSE n / 5 END)), 9) AS autocorr, round(greatest(50, least(300, n / (greatest(3, least(6, n // 60)) + 1))), 9) AS uniform FROM sz JOIN md USING (series_id) LEFT JOIN k USING (series_id) JOIN au USING (series_id)",
        "lag1_corr": f"WITH {rg}, c AS (SELECT series_id, x, x - avg(x) OVER (PARTITION BY series_id) AS a, lead(x) OVER (PARTITION BY series_id ORDER BY t) AS y, lead(x) OVER (PARTITION BY series_id ORDER BY t) - avg(x) OVER (PARTITION BY series_id) AS b FROM sg) SELECT series_id, round(corr(x, y), 9) AS r, round(sum(a * b) / sum(a * a), 9) AS autocorrelation FROM c GROUP BY 1",
        "rolling_variance": f"WITH {roll} SELECT series_id, t, CAST(i AS INT) AS i, round(variance, 9) AS variance FROM rf",
        "score_labels": f"WITH {ev}, l AS (SELECT CASE WHEN x < 0 OR x > 27 THEN NULL {bands([(f'x >= {a} AND x <= {b}', n) for n, (a, b) in labels.BANDS.items()])} ELSE 'unknown' END AS whole, CASE {bands([('x < 5', 'minimal'), ('x < 10', 'mild'), ('x < 15', 'moderate'), ('x < 20', 'moderately_severe')])} ELSE 'severe' END AS band FROM ob) SELECT whole, band, CASE band {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in labels.COLOURS.items())} END AS colour, count(*) AS n FROM l GROUP BY ALL",
        "slope_patterns": f"WITH {fit} SELECT CASE WHEN slope <= -0.08 THEN 'early_responder' WHEN slope <= -0.04 THEN 'gradual_responder' WHEN slope <= -0.02 THEN 'late_responder' ELSE 'non_responder' END AS pattern, count(*) AS n, round(avg(slope), 9) AS mean_slope FROM ft GROUP BY 1",
        "effect_bins": f"WITH {eff} SELECT CASE " + " ".join(f"WHEN abs(cohens_d) > {a} AND abs(cohens_d) <= {b} THEN '({a}, {b}]'" for a, b in zip(labels.EFFECT_EDGES, labels.EFFECT_EDGES[1:], strict=False)) + " END AS bin, count(*) AS n FROM ef GROUP BY 1",
        "effects_with_tests": f"WITH {full} SELECT change_point, feature, n1, n2, {r('pre_mean', 'post_mean', 'delta')}, round(coalesce(delta * 100 / nullif(pre_mean, 0), 0), 9) AS pct_change, round(cohens_d, 9) AS cohens_d, CASE WHEN abs(cohens_d) < 0.2 THEN 'Trivial' WHEN abs(cohens_d) < 0.5 THEN 'Small' WHEN abs(cohens_d) < 0.8 THEN 'Medium' ELSE 'Large' END AS interpretation, round(u, 9) AS u, {r('p_value', 'alpha_corrected')}, significant FROM fu",
        "significant_effects": f"WITH {full} SELECT change_point, feature, round(cohens_d, 9) AS cohens_d, CAST(row_number() OVER (PARTITION BY change_point ORDER BY round(cohens_d, 9) DESC, feature) AS INT) AS place FROM fu WHERE significant",
        "hypotheses": f"WITH {hyp} SELECT change_point, driver, round(contribution, 9) AS contribution, confirmed FROM hy",
        "evidence": f"WITH {hyp}, ey AS (SELECT change_point, sum(CASE WHEN contribution > 0 THEN -contribution / 100 * ln(contribution / 100) ELSE 0 END) / ln(count(*)) AS z FROM dm GROUP BY 1), co AS ("
        + " UNION ALL ".join(f"SELECT corr(cv, {f}) AS r FROM mo" for f in ("mean", "std", "skewness", "pct_severe", "median", "iqr"))
        + "), on1 AS (SELECT (SELECT count(DISTINCT driver) FROM hy) AS n_drivers, (SELECT count(*) FROM co WHERE abs(r) < 0.5) AS n_independent, (SELECT avg(z) FROM ey) AS mean_entropy, (SELECT count(*) FROM hy WHERE confirmed) AS n_confirmed), tw AS (SELECT *, CAST(n_drivers > 1 AS INT) + CAST(n_independent >= 2 AS INT) + CAST(mean_entropy > 0.6 AS INT) + CAST(n_confirmed >= 2 AS INT) AS evidence FROM on1) SELECT n_drivers, n_independent, round(mean_entropy, 9) AS mean_entropy, n_confirmed, evidence, CASE WHEN evidence >= 3 THEN 'proceed' WHEN evidence >= 2 THEN 'consider' ELSE 'reject' END AS verdict FROM tw",
        "dataset_ranking": f"WITH {types}, {_two_sql('eo')}, mv AS (SELECT ds, label <> lag(label) OVER (PARTITION BY ds ORDER BY day) AS moved FROM lb), ts AS (SELECT ds, CASE WHEN count(*) < 2 THEN 50.0 ELSE (1 - count(*) FILTER (moved) / (count(*) - 1)) * 100 END AS temporal_stability FROM mv GROUP BY 1), dc AS (SELECT ds, avg(s / (m + 1e-6)) AS cv FROM (SELECT ds, day, avg(x) AS m, stddev_samp(x) AS s FROM eo GROUP BY ALL) GROUP BY 1), mm AS (SELECT ds, avg(x) AS mu, stddev_pop(x) AS sd, skewness(x) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS sk, kurtosis_pop(x) AS ku, avg(CASE WHEN (x >= 10 AND x < 15) OR x >= 20 THEN 1.0 ELSE 0 END) AS sh, count(*) AS n, count(DISTINCT day) AS nd, count(DISTINCT p) AS np FROM eo GROUP BY 1), ou AS (SELECT ds, avg(CASE WHEN abs(x - mu) > 3 * sd THEN 1.0 ELSE 0 END) AS rate FROM eo JOIN mm USING (ds) GROUP BY 1), wh AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS td, count(DISTINCT user_id) AS tp FROM events), "
        "sc AS (SELECT ds AS dataset, temporal_stability, (CASE WHEN cv BETWEEN 0.10 AND 0.60 THEN 100.0 ELSE 50.0 END + 100 - abs(sh - 0.70) * 100) / 2 AS clinical_realism, 0.5 * CASE WHEN rate <= 0.05 THEN 100.0 ELSE 100 * (1 - rate) END + 0.25 * CASE WHEN abs(sk) < 1 THEN 100.0 ELSE greatest(0, 100 - (abs(sk) - 1) * 20) END + 0.25 * CASE WHEN abs(ku) < 2 THEN 100.0 ELSE greatest(0, 100 - (abs(ku) - 2) * 20) END AS statistical_quality, 100.0 - CASE WHEN nd <> td THEN 20 ELSE 0 END - CASE WHEN np <> tp THEN 20 ELSE 0 END - CASE WHEN abs(1 - n / (nd * np) - 0.5) > 0.03 THEN 20 ELSE 0 END AS metadata_consistency FROM ts JOIN dc USING (ds) JOIN mm USING (ds) JOIN ou USING (ds) CROSS JOIN wh), cs AS (SELECT *, 0.35 * temporal_stability + 0.30 * clinical_realism + 0.20 * statistical_quality + 0.15 * metadata_consistency AS composite_score FROM sc), rk AS (SELECT *, CAST(row_number() OVER (ORDER BY round(composite_score, 9) DESC, dataset) AS INT) AS rank FROM cs) "
        f"SELECT dataset, {r('temporal_stability', 'clinical_realism', 'statistical_quality')}, round(CAST(metadata_consistency AS DOUBLE), 9) AS metadata_consistency, round(composite_score, 9) AS composite_score, rank, rank = 1 AS recommended FROM rk",
        "cluster_profile": f"WITH {levels}, f AS (SELECT day, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, count(*) AS n FROM ob GROUP BY day), g AS (SELECT label, count(*) AS n_days, avg(mean) AS avg_score, avg(std) AS std_score_daily, avg(n) AS n_obs_avg, min(mean) AS min_score, max(mean) AS max_score FROM f JOIN lb USING (day) GROUP BY 1) SELECT label, n_days, {r('avg_score', 'std_score_daily', 'n_obs_avg', 'min_score', 'max_score')}, CASE WHEN avg_score >= 20 THEN 'Severe' WHEN avg_score >= 15 THEN 'Moderate' WHEN avg_score >= 10 THEN 'Mild' ELSE 'Minimal' END AS severity FROM g",
        "cluster_boundaries": f"WITH {levels}, b AS (SELECT ds, day, label, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ds) AS n, lag(label) OVER w AS a, lead(label) OVER w AS c, lead(label, 2) OVER w AS e FROM lb WINDOW w AS (PARTITION BY ds ORDER BY day)) SELECT ds AS dataset, day AS after FROM b WHERE label <> c AND (i = 0 OR i = n - 2 OR a = label OR c = e)",
        "observation_days": f"WITH {orders} SELECT day, count(DISTINCT p) AS n_patients, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS day_idx FROM ob GROUP BY day",
        "score_histogram": f"WITH {ev} SELECT CAST(least(floor(x / 1.35), 19) AS INT) AS bin, round(least(floor(x / 1.35), 19) * 1.35, 9) AS low, count(*) AS count FROM ob WHERE x BETWEEN 0 AND 27 GROUP BY ALL",
        "sample_trajectories": f"WITH {fit}, pa AS (SELECT patient_id, CASE WHEN pct < 0.2 OR slope > -0.02 THEN 'non_responder' WHEN slope <= -0.08 THEN 'early_responder' WHEN slope <= -0.04 THEN 'gradual_responder' ELSE 'late_responder' END AS pattern FROM ft), pk AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY patient_id) AS i FROM pa) SELECT patient_id, day, round(x, 9) AS score, pattern FROM ob JOIN pk ON patient_id = p WHERE i <= 5",
        # Simpson's rule over the density
        "t_test": f"WITH {eff}, t0 AS (SELECT change_point, feature, n1, n2, n1 + n2 - 2 AS df, (pre_mean - post_mean) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)), 0) AS t, pre_mean = post_mean AS same FROM e0 WHERE n1 >= 2 AND n2 >= 2), "
        "s0 AS (SELECT *, exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(df * pi()) AS k, list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2e0))) AS f FROM t0) "
        "SELECT change_point, feature, n1, n2, round(t, 9) AS t, CAST(df AS BIGINT) AS df, round(CASE WHEN t IS NULL THEN CAST(same AS INT) ELSE greatest(0, 1 - 2 * k * f * abs(t) / 12000) END, 9) AS p_value FROM s0",
        "elbow_select": f"WITH {_fits_sql(2, 6, 8, 0)}{_BEND} SELECT dataset, k FROM be",
        "cluster_numbers": f"WITH {_fits_sql(2, 6, 8, 0)}{_BEND}{_WIDTHS} SELECT dataset, ct.k, {r('inertia', 'silhouette')}, ct.k = be.k AS elbow, row_number() OVER (PARTITION BY dataset ORDER BY round(silhouette, 9) DESC, ct.k) = 1 AS chosen FROM ct JOIN si USING (dataset, k) JOIN be USING (dataset)",
        "gap_statistic": f"WITH {_fits_sql(1, 6, 8, 4)}, g AS (SELECT dataset, k, max(inertia) FILTER (run < 0) AS inertia, avg(ln(greatest(inertia, 1e-10))) FILTER (run >= 0) AS expected, stddev_pop(ln(greatest(inertia, 1e-10))) FILTER (run >= 0) AS spread FROM ct GROUP BY ALL), h AS (SELECT *, expected - ln(greatest(inertia, 1e-10)) AS gap FROM g) SELECT dataset, k, {r('inertia', 'expected', 'spread', 'gap')}, row_number() OVER (PARTITION BY dataset ORDER BY round(gap, 9) DESC, k) = 1 AS chosen FROM h",
        "linkage_heights": """WITH RECURSIVE ob AS (SELECT event_type AS ds, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS day, least(27.0, avg(value) * 0.27) AS x FROM events GROUP BY 1, 2, 3),
f AS (SELECT ds, day, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std FROM ob GROUP BY ds, day),
z AS (SELECT ds, row_number() OVER (PARTITION BY ds ORDER BY day) - 1 AS i, count(*) OVER p - 1 AS last, (mean - avg(mean) OVER p) / coalesce(nullif(stddev_pop(mean) OVER p, 0), 1) AS a, (std - avg(std) OVER p) / coalesce(nullif(stddev_pop(std) OVER p, 0), 1) AS b FROM f WINDOW p AS (PARTITION BY ds)),
m AS (SELECT x.ds, list({'h': 0.7 * sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) + 0.3 * (y.i - x.i) / greatest(x.last, 1), 'i': x.i, 'j': y.i, 'ni': 1, 'nj': 1}) AS m FROM z x JOIN z y ON x.ds = y.ds AND x.i < y.i GROUP BY x.ds),
r AS (SELECT ds, 0 AS k, 0e0 AS h, m FROM m UNION ALL SELECT ds, k + 1, c.h, list_transform(list_filter(m, lambda x: x.i <> c.j AND x.j <> c.j), lambda x: CASE
WHEN x.i = c.i THEN {'h': (c.ni * x.h + c.nj * list_filter(m, lambda y: (y.i = c.j AND y.j = x.j) OR (y.j = c.j AND y.i = x.j))[1].h) / (c.ni + c.nj), 'i': x.i, 'j': x.j, 'ni': c.ni + c.nj, 'nj': x.nj}
WHEN x.j = c.i THEN {'h': (c.ni * x.h + c.nj * list_filter(m, lambda y: (y.i = c.j AND y.j = x.i) OR (y.j = c.j AND y.i = x.i))[1].h) / (c.ni + c.nj), 'i': x.i, 'j': x.j, 'ni': x.ni, 'nj': c.ni + c.nj} ELSE x END)
FROM (SELECT *, list_min(m) AS c FROM r WHERE len(m) > 0))
SELECT ds AS dataset, CAST(row_number() OVER (PARTITION BY ds ORDER BY h) AS INT) AS place, round(h, 9) AS height FROM r WHERE k > 0""",
        # the recursion as a step over all series at once; lists of log probabilities, means, variances and counts, the youngest run first
        "online_run_lengths": """WITH RECURSIVE e AS (SELECT event_type AS s, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS t FROM events WHERE value IS NOT NULL AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
r AS (SELECT s, CAST(0 AS BIGINT) AS t, [0e0] AS l, [30e0] AS m, [900e0] AS v, [1e0] AS c, 0e0 AS p FROM e WHERE t = 0
UNION ALL
SELECT s, t, list_transform(l, lambda y: y - z), m, v, c, exp(l[1] - z) FROM (SELECT *, list_max(l) + ln(list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS z FROM (
SELECT r.s, e.t,
list_prepend(ln(1 / 50e0) + lgamma(2e0) - lgamma(1.5e0) - 0.5 * ln(3 * pi()) - 0.5 * ln(1800 + 1e-8) - 2 * ln(1 + (x - 30) * (x - 30) / (1800 + 1e-8) / 3),
  list_transform(range(1, least(31, len(l)) + 1), lambda i: l[i] + ln(1 - 1 / 50e0) + lgamma(2e0) - lgamma(1.5e0) - 0.5 * ln(3 * pi()) - 0.5 * ln(v[i] * (1 + 1 / c[i]) + 1e-8) - 2 * ln(1 + (x - m[i]) * (x - m[i]) / (v[i] * (1 + 1 / c[i]) + 1e-8) / 3))) AS l,
list_prepend(30e0, list_transform(range(1, least(31, len(l)) + 1), lambda i: m[i] + (x - m[i]) / (c[i] + 1))) AS m,
list_prepend(900e0, list_transform(range(1, least(31, len(l)) + 1), lambda i: greatest(1e-8, (c[i] * v[i] + (x - m[i]) * (x - m[i] - (x - m[i]) / (c[i] + 1))) / (c[i] + 1)))) AS v,
list_prepend(1e0, list_transform(range(1, least(31, len(l)) + 1), lambda i: c[i] + 1)) AS c
FROM r JOIN e ON e.s = r.s AND e.t = r.t + 1)))
SELECT s AS series_id, t, round(p, 8) AS p, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS run FROM r""",
        "online_relapses": """WITH e AS (SELECT user_id, ts, value, lag(ts) OVER w AS ts0, lag(value) OVER w AS x0 FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
SELECT CAST(user_id AS VARCHAR) AS series_id, ts, (epoch_us(ts) - epoch_us(ts0)) // 86400000000 AS gap, round(value - x0, 6) AS increase FROM e WHERE (epoch_us(ts) - epoch_us(ts0)) // 86400000000 BETWEEN 1 AND 5 AND value - x0 >= 20""",
        "stream_daily_cv": f"SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, count(*) AS n, round(stddev_samp(value) / nullif(avg(value), 0), 9) AS cv FROM events GROUP BY 1",
        "stream_sessions": "WITH a AS (SELECT user_id, ts, value, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n, round(avg(value), 9) AS mean FROM b GROUP BY user_id, k",
        "stream_sliding_cv": f"SELECT CAST(CAST(ts AS DATE) - k AS TIMESTAMP) AS start, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, count(*) AS n, round(stddev_samp(value) / nullif(avg(value), 0), 9) AS cv FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1",
    }
    step = orders + ", st AS (SELECT *, lead(day) OVER (PARTITION BY p ORDER BY day) AS nd, lead(x) OVER (PARTITION BY p ORDER BY day) AS nx FROM ob)"
    out["hazard_predictive"] = (
        f"WITH {rg}, nm AS (SELECT series_id, x, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM sg), fo AS (SELECT unnest([0.7e0, 0.7e0 + 0.05e0 * 1, 0.7e0 + 0.05e0 * 2]) AS share), "
        "fr AS (SELECT *, floor(n * share) AS e FROM nm, fo WHERE floor(n * share) < n - 10 AND floor(n * share) >= 5), tr AS (SELECT series_id, n, share, e, avg(x) AS mu, var_pop(x) + 1e-8 AS v FROM fr WHERE i < e GROUP BY ALL), "
        "te AS (SELECT tr.series_id, tr.n, tr.share, sum(-0.5 * (x - mu) * (x - mu) / v - 0.5 * ln(2 * pi() * v)) AS ll FROM tr JOIN fr USING (series_id, share) WHERE i >= fr.e AND i < fr.e + 10 GROUP BY ALL), sc AS (SELECT series_id, n, avg(ll) AS score FROM te GROUP BY ALL) "
        "SELECT series_id, CAST(n AS INT) AS n, round(pow(10e0, log10(30e0) + k * log10(10e0) / 19), 9) AS hazard_lambda, round(score, 9) AS score, k = 0 AS chosen FROM sc, (SELECT unnest(range(0, 20)) AS k)"
    )
    out["patient_missingness"] = f"WITH {orders}, c AS (SELECT 1 - count(*) / (SELECT count(DISTINCT day) FROM ob) AS rate FROM ob GROUP BY p) SELECT count(*) AS n_patients, round(avg(rate), 9) AS mean, round(stddev_samp(rate), 9) AS std, round(min(rate), 9) AS \"min\", round(max(rate), 9) AS \"max\" FROM c"
    out["plot_daily_line"] = f"WITH {ev}, d AS (SELECT day, avg(x) AS m, CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS i FROM ob GROUP BY day), l AS (SELECT regr_slope(m, i) AS b, regr_intercept(m, i) AS a FROM d) SELECT day, i, round(m, 9) AS mean, round(a + b * i, 9) AS fitted FROM d, l"
    out["plot_relapses_by_gap"] = f"WITH {step} SELECT nd - day AS gap, count(*) AS n, round(avg(nx - x), 9) AS mean_increase, round(max(nx - x), 9) AS largest FROM st WHERE nd - day BETWEEN 7 AND 30 AND nx - x >= 3 GROUP BY 1"
    out["plot_marked_signal"] = (
        f"WITH {rg}, se AS (SELECT series_id, list_transform(list_filter(string_split(cps, ','), lambda c: c <> ''), lambda c: CAST(c AS INT)) AS c FROM ({out['pelt_l2']})), nm AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i FROM sg) "
        "SELECT series_id, t, round(nm.x, 9) AS x, CAST(coalesce(len(list_filter(c, lambda v: v <= i)), 0) AS INT) AS segment, coalesce(list_contains(c, CAST(i AS INT)), false) AS starts FROM nm LEFT JOIN se USING (series_id)"
    )
    return out
