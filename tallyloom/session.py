"""Session settings and the shared scratch folder."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    # Runtime re-planning: coalesces small shuffles, splits skewed join partitions and
    # turns a sort-merge join into a broadcast join only when the measured side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tallyloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; cluster size and memory stay with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (a laptop, a test) is a local folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            root = jvm_dir.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="tallyloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application so that it can be dropped with it."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/tallyloom/{app}/{label}-{uuid.uuid4().hex}"


def data_version(spark: SparkSession, directory: str) -> str:
    """A digest of names, sizes and times of the files below a folder: new data, new digest."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(directory)
    found, files = [], path.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


#: Paths that ``store`` wrote, oldest first.
_STORED: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove at the end what was stored meanwhile; frames read from it are of no use afterwards."""
    first = len(_STORED)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _STORED[first:]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _STORED[first:]


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For a result that several steps read: it is computed once whatever columns each step needs, its
    lineage ends here, and it outlives the executors that made it.
    """
    path = scratch_path(df.sparkSession, label)
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, also when fits of several threads ask for it.

    Functions that run inside tasks import it, and executors do not share the driver's path.
    """
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app not in _SHIPPED:
            root = Path(__file__).resolve().parent
            folder = tempfile.mkdtemp(prefix="tallyloom-package-")
            archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
            spark.sparkContext.addPyFile(archive)
            _SHIPPED.add(app)
