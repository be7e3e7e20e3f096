"""Labels of scores, slopes, effects and shares, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bands of whole scores, their names in order, and the colours of the names.
BANDS = {"minimal": (0, 4), "mild": (5, 9), "moderate": (10, 14), "moderately_severe": (15, 19), "severe": (20, 27)}
COLOURS = {"minimal": "green", "mild": "yellow", "moderate": "orange", "moderately_severe": "orange", "severe": "red"}
#: Upper edges of absolute effects, the lower one left out of each bin.
EFFECT_EDGES = (0.0, 0.2, 0.5, 0.8, 5.0)


def band_of_whole_scores(score: Column) -> Column:
    """Bands of whole numbers, both ends included: what lies between two bands is unknown, beyond 0 to 27 null."""
    out = F.when((score < 0) | (score > 27), F.lit(None).cast("string"))
    for name, (low, high) in BANDS.items():
        out = out.when((score >= low) & (score <= high), name)
    return out.when(score.isNotNull(), "unknown")


def band(score: Column) -> Column:
    """Bands without gaps."""
    return F.when(score < 5, "minimal").when(score < 10, "mild").when(score < 15, "moderate").when(score < 20, "moderately_severe").when(score.isNotNull(), "severe")


def colour(score: Column) -> Column:
    of, out = band(score), None
    for name, value in COLOURS.items():
        out = F.when(of == name, value) if out is None else out.when(of == name, value)
    return out


def separation(silhouette: Column) -> Column:
    return F.when(silhouette >= 0.7, "strong").when(silhouette >= 0.5, "good").when(silhouette >= 0.3, "acceptable").otherwise("poor")


def pattern_of_slope(slope: Column) -> Column:
    return F.when(slope <= -0.08, "early_responder").when(slope <= -0.04, "gradual_responder").when(slope <= -0.02, "late_responder").otherwise("non_responder")


def verdict(evidence: Column) -> Column:
    return F.when(evidence >= 3, "proceed").when(evidence >= 2, "consider").otherwise("reject")


def effect_bin(d: Column) -> Column:
    """(low, high] of |d|; 0 and what is beyond the last edge are null."""
    out = F.lit(None).cast("string")
    for low, high in zip(EFFECT_EDGES, EFFECT_EDGES[1:], strict=False):
        out = F.when((F.abs(d) > low) & (F.abs(d) <= high), f"({low}, {high}]").otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0, by the series of erf, all of whose terms are positive."""
    x = z / 2**0.5
    step = lambda s, k: F.struct((s["t"] * 2 * x * x / (2 * k + 3)).alias("t"), (s["u"] + s["t"] * 2 * x * x / (2 * k + 3)).alias("u"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(150)), F.struct(x.alias("t"), x.alias("u")), step)["u"]
    return F.greatest(F.lit(0.0), 0.5 - F.exp(-x * x) / 3.141592653589793**0.5 * total)
