"""A whole detection over many series: every model of the settings, a status row for each, tests and the choice of a model."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segmentation, selection
from ..session import stored
from ..settings import Detection, Selection

LOG = logging.getLogger("tidemark")
STATUS = "model_id string, status string, error string, n_points long"


def _one(signals: DataFrame, settings: Detection, model: str) -> DataFrame:
    kind, _, what = model.partition("_")
    penalties = None if settings.auto_tune_penalty else [settings.penalty]
    bounds = {"alpha": settings.alpha, "least_effect": settings.effect_size_threshold}
    if kind == "pelt":
        return segmentation.detected(signals, (what,), (), penalties=penalties, min_size=settings.minimum_segment_size, **bounds)
    return segmentation.detected(signals, (), (what,), settings.hazard_strategy, smoothing=float(settings.smoothing), persistence=settings.persistence)


def detection(signals: DataFrame, settings: Detection | None = None, chosen: Selection | None = None) -> dict[str, DataFrame]:
    """detected: the change points of all models, with the settings' hash; status: (model_id, status, error, n_points), a row for
    each model, those that failed too; selected: the choice for each series, where selection is enabled and a point was found.

    A model that fails doesn't stop the others; if all fail, RuntimeError tells their errors. signals: (series_id, t, x); null
    values are left out, and a series that is too short for a model has no rows of it."""
    settings, chosen = settings or Detection(), chosen or Selection()
    done, status = [], []
    for model in settings.models():  # a few names; each is one distributed job over all series
        try:
            found = stored(_one(signals, settings, model), f"detected-{model}")
            n = found.count()
        except Exception as e:  # noqa: BLE001
            LOG.warning("%s failed: %s", model, e)
            status.append((model, "failed", f"{type(e).__name__}: {str(e)[:500]}", None))
            continue
        LOG.info("%s: %d change points", model, n)
        done.append(found)
        status.append((model, "ok", None, n))
    if not done:
        raise RuntimeError("every model failed: " + "; ".join(f"{m}: {e}" for m, _, e, _ in status))
    detected = done[0]
    for other in done[1:]:
        detected = detected.unionByName(other)
    out = {"detected": settings.stamped(detected), "status": settings.stamped(signals.sparkSession.createDataFrame(status, STATUS))}
    if settings.selection_enabled:
        out["selected"] = chosen.stamped(selection.select(detected, chosen.families, chosen.model_ids, chosen.strategy, chosen.weights))
    return out


def summary(detected: DataFrame) -> DataFrame:
    """(series_id, model_id, n_points, n_significant, first, last) of detected change points."""
    return detected.groupBy("series_id", "model_id").agg(F.count("*").alias("n_points"), F.count_if("significant").alias("n_significant"), F.min("cp").alias("first"), F.max("cp").alias("last"))
