"""Settings of exploration, detection and selection: checked together, as canonical JSON with a hash that results carry.

A setting that can't work raises ValueError; one that is only doubtful warns. Unknown names are refused."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults, bounds and weights that published results rest on.
COSTS = ("l1", "l2", "rbf", "ar")
LIKELIHOODS = ("student_t", "gaussian")
METRICS = {"n_significant_cps": 0.30, "mean_effect_size": 0.30, "posterior_mass": 0.20, "stability_score": 0.20}
LEAST_HAZARD, NARROW_HAZARD, MANY_CLUSTERS, LEAST_EFFECT = 30.0, 100.0, 15, 0.2


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def _doubt(doubtful: bool, why: str) -> None:
    if doubtful:
        warnings.warn(why, stacklevel=4)


def _among(name: str, found: tuple, allowed: tuple) -> None:
    _need(len(found) > 0 and set(found) <= set(allowed), f"{name} takes some of {', '.join(allowed)}")


class _Settings:
    def __post_init__(self) -> None:
        for f in fields(self):  # JSON has lists where settings have tuples
            if isinstance(getattr(self, f.name), list):
                object.__setattr__(self, f.name, tuple(getattr(self, f.name)))
        self.check()

    def canonical(self) -> str:
        """JSON with sorted keys and no blanks: equal settings have equal text."""
        return json.dumps({"kind": type(self).__name__, **asdict(self)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    @classmethod
    def read(cls, text: str):
        found = json.loads(text)
        _need(isinstance(found, dict), "settings are a JSON object")
        _need(found.pop("kind", cls.__name__) == cls.__name__, f"these aren't settings of {cls.__name__}")
        unknown = sorted(set(found) - {f.name for f in fields(cls)})
        _need(not unknown, f"unknown settings: {', '.join(unknown)}")
        return cls(**found)

    def stamped(self, df: DataFrame) -> DataFrame:
        """The rows with the hash of the settings they came from."""
        return df.withColumn("config_hash", F.lit(self.digest()))


@dataclass(frozen=True)
class Detection(_Settings):
    execution_mode: str = "compare"
    detectors: tuple[str, ...] = ("pelt", "bocpd")
    selection_enabled: bool = False
    penalty: float = 0.5
    penalty_range: tuple[float, float] = (0.01, 10.0)
    auto_tune_penalty: bool = True
    costs: tuple[str, ...] = COSTS
    minimum_segment_size: int = 5
    likelihoods: tuple[str, ...] = LIKELIHOODS
    hazard_strategy: str = "variance"
    hazard_range: tuple[float, float] = (100.0, 500.0)
    smoothing: int = 3
    persistence: int = 5
    alpha: float = 0.05
    effect_size_threshold: float = 0.3

    def check(self) -> None:
        _need(self.execution_mode in ("single", "compare", "ensemble"), f"unknown mode {self.execution_mode}")
        _among("detectors", self.detectors, ("pelt", "bocpd"))
        _among("costs", self.costs, COSTS)
        _among("likelihoods", self.likelihoods, LIKELIHOODS)
        _need(self.execution_mode != "single" or len(self.detectors) == 1, "mode single takes one detector")
        _need(self.execution_mode != "compare" or len(self.detectors) > 1, "mode compare takes two detectors or more")
        _need(self.execution_mode != "ensemble" or self.selection_enabled, "mode ensemble needs selection_enabled")
        _need(self.penalty > 0 and 0 < self.penalty_range[0] < self.penalty_range[1], "penalties are above 0, their range ascends")
        _need(self.minimum_segment_size >= 1, "a segment has a value at least")
        _need(self.hazard_strategy in ("variance", "autocorr", "uniform", "predictive"), f"unknown strategy {self.hazard_strategy}")
        low, high = self.hazard_range
        _need(low >= LEAST_HAZARD and high > low, f"hazard_range ascends from {LEAST_HAZARD:g} or more")
        _need(0 < self.alpha < 1, "alpha lies between 0 and 1")
        _need(self.smoothing >= 1 and self.persistence >= 1, "smoothing and persistence are 1 or more")
        _doubt(high < NARROW_HAZARD, "hazard_range ends early")
        _doubt(self.smoothing > self.persistence, "smoothing is wider than persistence and may hide it")
        _doubt(self.effect_size_threshold < LEAST_EFFECT, "effects below 0.2 may mean little")

    def models(self) -> list[str]:
        found = [f"pelt_{c}" for c in self.costs] if "pelt" in self.detectors else []
        return found + ([f"bocpd_{x}" for x in self.likelihoods] if "bocpd" in self.detectors else [])


@dataclass(frozen=True)
class Exploration(_Settings):
    max_clusters: int = 6
    use_temporal_clustering: bool = False
    temporal_weight: float = 0.0
    standardize_features: bool = False

    def check(self) -> None:
        _need(self.max_clusters >= 2, "two clusters at least")
        _need(0 <= self.temporal_weight <= 1, "temporal_weight lies between 0 and 1")
        _need(not (self.use_temporal_clustering and self.temporal_weight == 0), "temporal clustering needs a temporal_weight")
        _doubt(not self.use_temporal_clustering and self.temporal_weight > 0, "temporal_weight has no effect without temporal clustering")
        _doubt(self.max_clusters > MANY_CLUSTERS, "so many clusters take long")


@dataclass(frozen=True)
class Selection(_Settings):
    families: tuple[str, ...] = ("pelt", "bocpd")
    model_ids: tuple[str, ...] | None = None
    strategy: str = "agreement_first"
    weights: dict[str, float] = field(default_factory=lambda: dict(METRICS))

    def check(self) -> None:
        _among("families", self.families, ("pelt", "bocpd"))
        _need(self.model_ids is None or len(self.model_ids) > 0, "model_ids is null or names a model")
        _need(self.strategy == "agreement_first", f"unknown strategy {self.strategy}")
        extra = sorted(set(self.weights) - set(METRICS))
        _need(not extra, f"weights for unused metrics: {', '.join(extra)}")
        _need(sum(self.weights.values()) <= 1 + 1e-9, "weights add up to more than 1")
