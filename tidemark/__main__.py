"""python -m tidemark explore|detect VISITS OUT [--settings FILE]: over a wide CSV or a Parquet table of (patient_id, day, score).

Exit codes: 0 done; 1 the run failed; 2 the settings or the visits aren't valid (explore: an error, or more than a few warnings)."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from . import settings as st

LOG = logging.getLogger("tidemark")


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("command", choices=["explore", "detect"])
    p.add_argument("visits")
    p.add_argument("out")
    p.add_argument("--settings")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.WARNING if a.quiet else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    kind = st.Detection if a.command == "detect" else st.Exploration
    try:
        chosen = kind.read(Path(a.settings).read_text()) if a.settings else kind()
    except (ValueError, TypeError, OSError) as e:
        LOG.error("settings: %s", e)
        return 2
    LOG.info("%s with settings %s", a.command, chosen.digest()[:12])
    try:
        return _run(a, chosen, spark)
    except Exception:
        LOG.exception("%s failed", a.command)
        return 1


def _run(a: argparse.Namespace, chosen, spark) -> int:
    from pyspark.sql import functions as F

    from . import sinks
    from .operators import daily, optimal, quality
    from .plans import runs
    from .session import session, ship
    from .sources import parquet, wide_csv

    spark = ship(spark or session("tidemark"))
    obs = parquet(spark, a.visits) if a.visits.rstrip("/").endswith(".parquet") else wide_csv(spark, a.visits)
    if a.command == "detect":
        signal = daily.daily_cv(obs).select(F.lit("visits").alias("series_id"), F.col("day").alias("t"), F.col("cv").alias("x"))
        found = runs.detection(signal, chosen)
        sinks.detection(a.out, found["detected"], selected=found.get("selected"))
        sinks.json(found["status"], a.out, "status")
        return 0
    checked = quality.checks(obs).persist()
    sinks.table(chosen.stamped(checked), a.out, "checks", csv=True)
    days = daily.daily_features(obs).withColumn("dataset", F.lit("visits"))
    sinks.table(chosen.stamped(optimal.choose(days, ["mean", "std", "cv", "n_obs", "pct_severe"], chosen.max_clusters)), a.out, "cluster_numbers", csv=True)
    return 0 if quality.verdict(checked).first()["overall_valid"] else 2


if __name__ == "__main__":
    sys.exit(main())
