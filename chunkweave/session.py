"""Session helpers: a shared folder for stage outputs and the settings the operators rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent (local tests) a fresh temporary folder is made and remembered
    for the application, so that a cluster never ends up with a folder of one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _local.setdefault(app, _local.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return found.rstrip("/")


_local: dict[str, str] = {}
_owners: set[str] = set()


def _stages_of(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new place for something that goes with the stages."""
    return f"{_stages_of(spark)}/{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession) -> None:
    """Delete the stages of this application. Results that were not written or collected are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stages_of(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session was stopped before: its stages are left to whoever cleans the shared folder
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet stage in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what lies before the stage, and
    several later steps can read it without running the plan again. Stages are deleted by ``release``,
    at the latest when the driver ends.
    """
    spark = df.sparkSession
    if (app := spark.sparkContext.applicationId) not in _owners:
        _owners.add(app)
        atexit.register(_release_at_exit, spark)
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{here.name}.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def session(app: str = "chunkweave", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
