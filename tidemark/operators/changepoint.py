"""Change points of daily signals: penalised segmentation, Bayesian run lengths, their tuning and validation.

Signals are short (one value a day); each series and model is one group of a grouped function, so a grid of series and
models spreads over the cluster."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COSTS = ("l1", "l2", "rbf", "ar")


def cost_table(x: np.ndarray, model: str, order: int = 4) -> np.ndarray:
    """cost[i, j] of the segment x[i:j]."""
    n = len(x)
    out = np.zeros((n + 1, n + 1))
    if model == "l2":
        s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        i, j = np.triu_indices(n + 1, 1)
        out[i, j] = q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
    elif model == "l1":
        for i in range(n):
            order_so_far: list[float] = []
            import bisect

            for j in range(i, n):
                bisect.insort(order_so_far, x[j])
                a = np.asarray(order_so_far)
                out[i, j + 1] = np.abs(a - np.median(a)).sum()
    elif model == "rbf":
        d = (x[:, None] - x[None, :]) ** 2
        off = d[np.triu_indices(n, 1)]
        med = float(np.median(off)) if len(off) else 0.0
        k = np.exp(-np.clip(d * (1 / med if med else 1.0), 1e-2, 1e2))
        np.fill_diagonal(k, 1.0)
        p = np.zeros((n + 1, n + 1))
        p[1:, 1:] = k.cumsum(0).cumsum(1)
        i, j = np.triu_indices(n + 1, 1)
        out[i, j] = (j - i) - (p[j, j] - p[i, j] - p[j, i] + p[i, i]) / (j - i)
    elif model == "ar":
        lags = np.stack([np.concatenate([np.full(k, x[0]), x[:-k]]) for k in range(1, order + 1)] + [np.ones(n)], axis=1)
        y = x.copy()
        y[:order] = x[min(order, n - 1)]
        m = order + 1
        xx = np.concatenate([np.zeros((1, m, m)), np.cumsum(lags[:, :, None] * lags[:, None, :], axis=0)])
        xy = np.concatenate([np.zeros((1, m)), np.cumsum(lags * y[:, None], axis=0)])
        yy = np.concatenate([[0], np.cumsum(y * y)])
        for i in range(n):
            a, b = xx[i + 1 :] - xx[i], xy[i + 1 :] - xy[i]
            beta = np.einsum("kij,kj->ki", np.linalg.pinv(a, hermitian=True), b)
            out[i, i + 1 :] = np.maximum(0, yy[i + 1 :] - yy[i] - (beta * b).sum(axis=1))
    else:
        raise ValueError(f"unknown cost model {model}")
    return out


def segment(cost: np.ndarray, penalty: float, min_size: int = 5) -> list[int]:
    """Change points of the least penalised cost: exact dynamic programming over ends of segments."""
    n = len(cost) - 1
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for j in range(min_size, n + 1):
        i = np.concatenate([[0], np.arange(min_size, j - min_size + 1)])
        total = best[i] + cost[i, j] + penalty
        k = int(np.argmin(total))
        best[j], back[j] = total[k], i[k]
    out, j = [], n
    while j > 0 and back[j] > 0:
        j = int(back[j])
        out.append(j)
    return out[::-1]


def bic(x: np.ndarray, cps: list[int]) -> float:
    edges, n = [0, *cps, len(x)], len(x)
    rss = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:], strict=False))
    return n * math.log(max(rss / n, 1e-10)) + 2 * (len(edges) - 1) * math.log(n)


def tune(x: np.ndarray, cost: np.ndarray, low: float = 0.01, high: float = 10.0, n: int = 50, min_size: int = 5) -> tuple[float, list[int], list[tuple[float, float, int]]]:
    """The penalty of least BIC, the first of ties; one cost table for all penalties."""
    curve, found = [], []
    for p in np.logspace(np.log10(low), np.log10(high), n):
        cps = segment(cost, p, min_size)
        curve.append((float(p), bic(x, cps), len(cps)))
        found.append(cps)
    k = int(np.argmin([c[1] for c in curve]))
    return curve[k][0], found[k], curve


def cohens_d(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2 or len(b) < 2:
        return 0.0
    pooled = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    return 0.0 if pooled < 1e-10 else float((b.mean() - a.mean()) / pooled)


def permutation(a: np.ndarray, b: np.ndarray, most: int = 100_000, seed: int = 0) -> float:
    """Two-sided p of the difference of means: all splits when there are few enough, else seeded shuffles."""
    both, k = np.concatenate([a, b]), len(a)
    seen, total = abs(a.mean() - b.mean()), both.sum()
    if math.comb(len(both), k) <= most:
        s = np.array([both[list(c)].sum() for c in combinations(range(len(both)), k)])
    else:
        rng = np.random.default_rng(seed)
        s = np.array([rng.permutation(both)[:k].sum() for _ in range(10_000)])
    return float((np.abs(s / k - (total - s) / len(b)) >= seen - 1e-12).mean())


def adjust(p: list[float], method: str = "fdr_bh") -> list[float]:
    m = len(p)
    if method == "none" or not m:
        return list(p)
    if method == "bonferroni":
        return [min(1.0, x * m) for x in p]
    order = np.argsort(p, kind="stable")
    out = np.empty(m)
    out[order] = np.minimum(1, np.minimum.accumulate((np.asarray(p)[order] * m / np.arange(1, m + 1))[::-1])[::-1])
    return out.tolist()


def validate(x: np.ndarray, cps: list[int], window: int = 5, least_side: int = 7, alpha: float = 0.05, least_effect: float = 0.3, method: str = "fdr_bh") -> list[dict]:
    """A record for each change point: why it is rejected, or its p, effect size and significance."""
    out = []
    for cp in cps:
        n, reason = len(x), None
        if not 0 < cp < n:
            reason = "out of bounds"
        elif cp / n < 0.05:
            reason = "too early"
        elif cp / n > 0.95:
            reason = "too late"
        elif cp < least_side or n - cp < least_side:
            reason = "side too short"
        a, b = x[max(0, cp - window) : cp], x[cp : cp + window]
        if reason is None and (len(a) < 5 or len(b) < 5):
            reason = "window too short"
        out.append({"index": cp, "reason": reason, "p": None if reason else permutation(a, b), "d": 0.0 if reason else cohens_d(a, b)})
    tested = [r for r in out if r["reason"] is None]
    for r, q in zip(tested, adjust([r["p"] for r in tested], method), strict=True):
        r["p_adjusted"], r["significant"] = q, q < alpha and abs(r["d"]) >= least_effect
    return [{"p_adjusted": None, "significant": False} | r for r in out]


#: ln Gamma(2) - ln Gamma(3/2) - ln(3 pi) / 2: the constant of Student's t with 3 degrees of freedom.
_T3 = math.lgamma(2.0) - math.lgamma(1.5) - 0.5 * math.log(3 * math.pi)


def run_lengths(x: np.ndarray, hazard_lambda: float, likelihood: str = "student_t", most: int = 365) -> np.ndarray:
    """P(run length 0) at each time but the first, where it is set to 0, by the Bayesian recursion with a prior from the
    whole signal."""
    t_all, r_all = len(x), min(most, len(x))
    h = min(1 / hazard_lambda, 0.99)
    mu0, var0 = x.mean(), max(x.var(), 1e-8)
    log_r = np.full(r_all, -np.inf)
    log_r[0] = 0.0
    mean, var, count = np.full(r_all, mu0), np.full(r_all, var0), np.ones(r_all)
    out = np.zeros(t_all)

    def predictive(v: float, m, s2, n):
        scale = s2 * (1 + 1 / n) + 1e-8
        z = (v - m) ** 2 / scale
        return _T3 - 0.5 * np.log(scale) - 2 * np.log1p(z / 3) if likelihood == "student_t" else -0.5 * (np.log(2 * np.pi * scale) + z)

    for t in range(1, t_all):
        grow = log_r + predictive(x[t], mean, var, count) + math.log(1 - h)
        top = log_r.max()
        start = top + math.log(np.exp(log_r - top).sum()) + math.log(h) + float(predictive(x[t], mu0, var0, 1.0))
        nxt = np.full(r_all, -np.inf)
        nxt[1:] = grow[:-1]
        nxt[0] = start
        top = nxt.max()
        log_r = nxt - (top + math.log(np.exp(nxt - top).sum()))
        out[t] = math.exp(log_r[0])
        upto = min(t, r_all - 1)
        n = count[:upto] + 1
        delta = x[t] - mean[:upto]
        m = mean[:upto] + delta / n
        v = np.maximum(1e-8, ((n - 1) * var[:upto] + delta * (x[t] - m)) / n)
        mean[1 : upto + 1], var[1 : upto + 1], count[1 : upto + 1] = m, v, n
        mean[0], var[0], count[0] = mu0, var0, 1.0
    return out


def smooth(p: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(p, radius, mode="edge"), w / w.sum(), mode="valid")


def threshold(p: np.ndarray, k: float = 1.5) -> float:
    return float(np.clip(p.mean() + k * max(p.std(), 1e-6), 0.01, 0.99))


def persistent_peaks(p: np.ndarray, level: float, persistence: int = 5) -> list[int]:
    """The highest place of each run above the level that lasts long enough; persistence 1 takes every place."""
    above = p > level
    if persistence <= 1:
        return np.flatnonzero(above).tolist()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], above.astype(np.int8), [0]])))
    return [int(a + np.argmax(p[a:b])) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= persistence]


def hazard_heuristic(x: np.ndarray, low: float = 100.0, high: float = 300.0) -> float:
    """`detect.hazard` by variance, for one array."""
    n = len(x)
    if n < 10:
        return float(np.clip(n / 4, max(50.0, low), high))
    full = np.lib.stride_tricks.sliding_window_view(x, 5).var(axis=1, ddof=1)
    moved = np.abs(np.diff(np.concatenate([[full[0]] * 2, full, [full[-1]] * 2])))
    rough = np.flatnonzero(moved > np.quantile(moved, 0.75))
    spacing = float(np.median(np.diff([0, *rough, n]))) if len(rough) > 1 else n / 5
    return float(np.clip(spacing, max(50.0, low), high))


DETECTED = "series_id string, model_id string, parameter double, cp int, position double, p_value double, cohens_d double, significant boolean, reason string, posterior double"


def detect(signals: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Change points of every series (series_id, t, x) under every model: pelt_<cost> and bocpd_<likelihood>."""
    names = models or [f"pelt_{c}" for c in COSTS] + ["bocpd_student_t", "bocpd_gaussian"]
    grid = signals.withColumn("model_id", F.explode(F.array(*map(F.lit, names))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, series, model = pdf["x"].to_numpy(float), pdf["series_id"].iloc[0], pdf["model_id"].iloc[0]
        kind, how = model.split("_", 1)
        rows = []
        if kind == "pelt" and len(x) >= 10:
            par, cps, _ = tune(x, cost_table(x, how))
            rows = [(series, model, par, r["index"], r["index"] / len(x), r["p"], r["d"], r["significant"], r["reason"], None) for r in validate(x, cps)]
        elif kind == "bocpd" and len(x) >= 5:
            par = hazard_heuristic(x)
            p = smooth(run_lengths(x, par, how))
            rows = [(series, model, par, i, i / len(x), None, None, True, None, p[i]) for i in persistent_peaks(p, threshold(p))]
        return pd.DataFrame(rows, columns=["series_id", "model_id", "parameter", "cp", "position", "p_value", "cohens_d", "significant", "reason", "posterior"])

    return grid.groupBy("series_id", "model_id").applyInPandas(one, DETECTED)


def segments(detected: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, model_id, start, end, length) between change points; lengths: (series_id, n)."""
    g = detected.groupBy("series_id", "model_id").agg(F.array_sort(F.collect_list("cp")).alias("cps")).join(F.broadcast(lengths), "series_id")
    edges = F.concat(F.array(F.lit(0)), "cps", F.array(F.col("n").cast("int")))
    g = g.withColumn("e", edges).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("cps") + 1)))
    return g.select("series_id", "model_id", F.element_at("e", F.col("i")).alias("start"), F.element_at("e", F.col("i") + 1).alias("end")).withColumn("length", F.col("end") - F.col("start"))
