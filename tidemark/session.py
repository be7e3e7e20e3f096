"""Sessions, and this package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_FOLDER: dict[str, str] = {}


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the library relies on: adaptive plans, Arrow, UTC. Further settings by keyword, dots as `__`."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_lib.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines of a cluster share. Where it is unset, one temporary folder a session does on one
    machine (a local master); on a cluster that is an error, for a lost machine would take its tables along."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_FOLDER[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage of a loop, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
