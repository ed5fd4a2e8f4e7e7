"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

#: Whole texts make rows large: Arrow batches of a tenth of Spark's default keep workers and buffers small.
BATCH_ROWS, BATCH_ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def session(name: str = "textloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries expect; on a cluster, set the same with spark-submit."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors once for each application, so that Python functions import there."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == BATCH_ROWS_DEFAULT:
        spark.conf.set(BATCH_ROWS, "1000")
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here while the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "textloom_package.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


#: Where checkpoints go if a local session names no folder (tests); a cluster has to name a shared one.
LOCAL_CHECKPOINT_DIR = "/tmp/textloom-checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session without one takes its machine's own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINT_DIR


def checkpoints(spark: SparkSession) -> str:
    """The application's own folder for checkpoints."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage, so that lost executors cost nothing."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``durable``, for tables of many rows: compressed by columns, of which a later step reads those it needs."""
    path = f"{checkpoints(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
