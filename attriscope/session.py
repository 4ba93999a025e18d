"""Session helpers: a local session for tests / bench and the shared work folder."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Settings recommended for a large cluster (applied by the cluster's launcher, not set here).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",                          # runtime re-planning (join choice, coalescing)
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",     # shuffle partitions sized to fit executor memory
    "spark.sql.shuffle.partitions": "8000",                        # upper bound; AQE coalesces small ones
    "spark.sql.adaptive.skewJoin.enabled": "true",                 # split hot partitions of shuffle joins
    "spark.sql.files.maxPartitionBytes": "256m",                   # scan split size
    "spark.sql.autoBroadcastJoinThreshold": "64m",                 # size-checked broadcast by estimated size
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",           # Arrow batches for the pandas functions
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "attriscope") -> SparkSession:
    """Local session used by tests and the bench (never on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession, folder: str) -> None:
    """Make ``attriscope`` importable in Python workers (pandas functions refer to it).

    The package is zipped into the shared ``folder``, so the install itself may be read-only, and added with
    ``addPyFile`` once per application; Spark distributes it to executors.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import hashlib
    import io
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest, body = hashlib.sha256(), io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for full in files:
            name = os.path.relpath(full, root)
            with open(full, "rb") as fh:
                data = fh.read()
            digest.update(name.encode() + data)
            z.writestr(name, data)
    # one archive per code version, visible only when whole (concurrent applications may race)
    path = sc._jvm.org.apache.hadoop.fs.Path
    target = path(f"{folder.rstrip('/')}/attriscope/attriscope-{digest.hexdigest()[:16]}.zip")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(target):
        part = path(f"{target.toString()}.{uuid.uuid4().hex[:8]}.part")
        out = fs.create(part)
        out.write(bytearray(body.getvalue()))
        out.close()
        fs.rename(part, target)
    sc.addPyFile(fs.makeQualified(target).toString())
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local tests) a folder under /tmp is chosen.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = os.path.join("/tmp", "attriscope-checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    ship_package(spark, d)
    return d


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/attriscope/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts lineage (an executor loss later re-reads the files instead of
    recomputing the plan) and gives the optimizer exact statistics.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    for paths in getattr(_SCRATCH, "open", []):
        paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread materializes inside, at the end.

    Only for a block whose result is itself checkpointed or written: a lazy plan would still read them.
    """
    paths: list[str] = []
    _SCRATCH.open = [*getattr(_SCRATCH, "open", []), paths]
    try:
        yield
    finally:
        _SCRATCH.open = [p for p in _SCRATCH.open if p is not paths]
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
