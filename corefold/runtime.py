"""Session defaults and the tables in which long jobs cut their lineage.

A job that iterates, or reads an expensive intermediate result twice, writes it with
``stash`` as parquet into the folder that all executors share (``spark.checkpoint.dir``).
Such a table survives the loss of executors, keeps its statistics for the optimizer and is
read with column pruning. Where the setting is absent, a temporary folder of this machine is used if
all of Spark runs on it (tests, a laptop); on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def session(app: str = "corefold", cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, wherever it was imported from."""
    context = spark.sparkContext
    if getattr(context, "_corefold_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corefold-code-")  # on the driver; Spark distributes the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/corefold.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/corefold.zip")
    context._corefold_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's stashed tables."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="corefold-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        base = "file://" + _own_folder
    return f"{base.rstrip('/')}/corefold-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    folder = shared_folder(spark)
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if path.replace("file:///", "file:/").startswith(folder.replace("file:///", "file:/")):
                _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all stashed tables of this application. Results not yet written become unreadable."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def one_row_each(df: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """One row for each value of ``key``; of repeated rows any. Rows with a null key are kept as they are.

    Only the rows of repeated keys are shuffled, as long as at most ``most`` keys repeat; these are counted on the key column
    alone. Beyond that all rows are.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    repeated = stash(counts.where("__rows > 1").select(key), "repeated")
    n = repeated.limit(most + 1).count()
    if not n:
        discard(df.sparkSession, repeated)
        return df
    if n > most:
        return df.where(F.col(key).isNull()).unionByName(df.where(F.col(key).isNotNull()).dropDuplicates([key]))
    few = F.broadcast(repeated)
    repeats = df.join(few, key, "left_semi").dropDuplicates([key])
    return df.join(few, key, "left_anti").unionByName(repeats).select(df.columns)


def by_document(rows: DataFrame, *columns, each: int = 200_000) -> DataFrame:
    """``columns`` of the rows, partitioned by doc_id, one partition for every ``each`` rows: tables of as many rows are partitioned alike."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(*columns).repartition(max(least, -(-rows.count() // each)), "doc_id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
