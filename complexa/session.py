"""SparkSession construction and cluster-safe scratch locations.

Production jobs get their session from the cluster; ``get_session`` only
fills settings that are unset, so a cluster's ``spark.checkpoint.dir`` (a
shared folder) is always the one used.  A private temporary checkpoint
folder is created only when nothing is configured and the master is local; it
goes when the process ends.  On a cluster without a shared folder work stops.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "complexa", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in _DEFAULTS.items():  # skewed joins and partition sizes are left to the adaptive planner
            if k.startswith("spark.sql.adaptive"):
                active.conf.set(k, v)
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a private one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="complexa-ckpt-")  # one machine, nothing configured: tests and local runs
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001  (some sessions reject core settings at runtime)
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local


def work_parts(spark: SparkSession) -> int:
    """Several parts a core, for steps whose rows take far more time than they have bytes: by bytes the planner would join the parts
    to few of unequal size, with cores idle at the end."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a full URI of the store that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (functions of UDFs are imported there by name)."""
    sc = spark.sparkContext
    if getattr(sc, "_complexa_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="complexa-zip-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/complexa", "zip", os.path.dirname(root), os.path.basename(root)))
    sc._complexa_shipped = True
