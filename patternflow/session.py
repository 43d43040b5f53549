"""Session defaults and the shared folder for tables written between steps."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "patternflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Shuffle partitions are left to AQE, which coalesces from a generous start;
    the library's hot path is map-only, so this only matters for the small
    aggregates. On a cluster pass nothing but what your launcher does not set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Call sites are recorded for every Column built otherwise, which doubles planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach.

    A local temporary folder stands in only when the setting is missing and the
    session runs in local mode; on a cluster a missing setting is an error. What an
    application leaves there goes when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster")
        root = os.path.join(tempfile.gettempdir(), "patternflow-scratch")
    own = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def ensure_on_executors(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for the few Python tasks.

    Also in local mode: workers see the driver's files but not its ``sys.path``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_patternflow_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "patternflow")
    sc.addPyFile(shutil.make_archive(archive, "zip", root, "patternflow"))
    sc._patternflow_sent = True
