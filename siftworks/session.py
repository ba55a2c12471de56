"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where neither the session nor the context names a folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/siftworks-checkpoints"


#: A union that takes over its children's partitioning lost rows in about one of ten runs where adaptive execution had
#: joined partitions of one child only (Spark 4.1.2; ``tests/test_external.py`` has such a plan).
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def settled(spark: SparkSession) -> SparkSession:
    """The session, with the settings that results depend on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(name: str = "siftworks", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC, and the given settings over that."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; without one a cluster is an error."""
    settled(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; its lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: sends it along unless they find it as this process does."""
    settled(spark)
    home = Path(__file__).resolve().parents[1]
    known = {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    context = spark.sparkContext
    if home in known or getattr(context, "_siftworks_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="siftworks-"), "siftworks.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(Path(__file__).parent.rglob("*.py")):
            out.write(source, source.relative_to(home))
    context.addPyFile(str(path))
    context._siftworks_shipped = True
