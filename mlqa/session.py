"""Spark session with the settings every job here assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# AQE re-plans joins and partition counts at run time from the real shuffle
# sizes: small data-derived join sides are turned into broadcast joins only
# when their materialised size is below the threshold (a checked size, with
# sort-merge join as the way beyond it), and skewed partitions are split.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "mlqa",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) the session.

    On a cluster pass ``master=None`` and let the launcher decide; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder in force: one that the caller has set, else the cluster's shared
    ``spark.checkpoint.dir``; only when neither is set (local tests) a fresh local scratch folder."""
    in_force = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_force.isDefined():
        return in_force.get()
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="mlqa-ckpt-", dir=os.environ.get("MLQA_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # non-SQL conf may be read-only on some builds
            pass
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``mlqa`` importable in the Python workers (pandas UDFs, mapInPandas):
    zip the package once per application and hand it to ``addPyFile``, which
    distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="mlqa-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
