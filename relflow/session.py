"""Session set-up shared by tests, bench and the entry module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Fixed settings every relflow job relies on: UTC session time (all event times
# are epoch milliseconds), AQE for runtime coalescing / skew joins, Arrow for the
# few pandas steps.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "relflow", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    master = master or os.environ.get("RELFLOW_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    # Python processes that Spark's JVM starts by itself (stateful streams) inherit its
    # environment: they must find the package from any working directory
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    conf["spark.driver.memory"] = os.environ.get("RELFLOW_DRIVER_MEMORY", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``. A local session without one gets a fresh
    scratch folder; on a cluster, where a machine's own folder would be seen by
    that machine alone, a missing setting is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="relflow-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scan_partitions(spark: SparkSession) -> int:
    """Number of range partitions used by ordered scans (shuffle partitions)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make ``relflow`` importable in the Python workers (as ``--py-files``
    does): zip the package once per SparkContext and ``addPyFile`` it; Spark
    distributes the zip to every executor."""
    import shutil

    import relflow

    sc = spark.sparkContext
    if getattr(sc, "_relflow_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(relflow.__file__))
    out = tempfile.mkdtemp(prefix="relflow-pyfiles-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "relflow"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir="relflow")
    sc.addPyFile(archive)
    sc._relflow_shipped = True
