"""Session settings the library is tuned for; a cluster's own settings win."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Packed frames and vector blocks are wide rows: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

WRITTEN = "_recut_written"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recut")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECUT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="recut-checkpoint-"))  # one machine: its own disk is shared
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per Spark context, so that its Python kernels run from any folder."""
    context = spark.sparkContext
    if getattr(context, "_recut_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="recut-package-"), "recut"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)  # the driver serves it to every executor
    context._recut_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; where none is named, one in the warehouse, which is shared as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    They survive the loss of any executor, later steps read only the columns they need, and the
    optimizer knows the true size, which decides what may be broadcast.  Shuffle files of the write
    are of no more use after it and go at its end.
    """
    return _written(df, f"{checkpoint_dir(df.sparkSession)}/recut-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    setattr(written, WRITTEN, True)
    return written


def settled(df: DataFrame) -> DataFrame:
    """The rows as a written table; one that is written, or known to follow from one row by row, is taken as it is."""
    return df if getattr(df, WRITTEN, False) else cut_lineage(df)


class Scratch:
    """Written tables of one computation, each dropped when it is of no more use, all of them at the end.

    What leaves the computation must not read them: write it with ``cut_lineage`` before the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}
        self._held: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self._paths.values():
            self._delete(path)
        self._paths.clear()

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/recut-{uuid.uuid4().hex}"
        written = _written(df, path)
        self._paths[id(written)] = path
        self._held.append(written)  # an id is not given again while its table is held
        return written

    def drop(self, *tables: DataFrame) -> None:
        for written in tables:
            self._delete(self._paths.pop(id(written)))

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
