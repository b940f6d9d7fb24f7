"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: Settings that hold for any size.  Nothing here fixes a partition count: AQE
#: coalesces small shuffles and splits skewed join partitions at run time, and
#: joins turn into broadcast joins only by measured size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "swapledger", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names, if it is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once, so that their Python can import it from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_swapledger_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # The driver serves this file to executors as long as the application lives.
    path = os.path.join(tempfile.mkdtemp(prefix="swapledger-package-"), "swapledger.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("swapledger", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._swapledger_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ready a session: package on the workers, and a scratch folder where one machine runs alone.

    A session in local mode without ``spark.checkpoint.dir`` gets a temporary folder; on a
    cluster the setting must name a folder that the driver and all executors share.
    """
    ship_package(spark)
    if not shared_folder(spark) and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="swapledger-"))
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates and stream checkpoints, under the shared one."""
    root = shared_folder(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Remove a folder under the shared one, once nothing reads it any more."""
    root = shared_folder(spark)
    if not root or not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"not a scratch folder: {path}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
