"""Session helpers and the shared folder used to cut lineage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor of a
cluster can reach.  Only a local master, as in tests, gets a temporary folder when the setting is
absent.
"""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.openCostInBytes", "262144")  # small test files are read by several tasks
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can
    import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_webstrata_shipped", False):
        return
    package = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context._webstrata_shipped = True
    try:
        context.addPyFile(write_shared(spark, "webstrata_code.zip", held.getvalue()))
    except RuntimeError:  # no shared folder is named: the executors have to have the package installed
        pass


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` as a file of the shared folder; its address is returned.  It goes at exit."""
    folder = f"{shared_dir(spark)}/webstrata-files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    _remove_at_exit(spark, folder)
    return f"{folder}/{name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only for a local master that names none."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="webstrata-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    _remove_at_exit(spark, folder)
    return folder


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    def remove() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(remove)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it
    nor depend on the executors that made it."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/webstrata-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _remove_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
