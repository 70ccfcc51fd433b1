"""Session helpers: configuration, and tables that outlive executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["BATCH_BYTES", "bound_batches", "clean_up", "discard", "fresh", "let", "local_session", "materialize", "shared_dir", "spread"]

#: Bytes that an Arrow batch carries to Python, so that memory doesn't follow the number of long texts.
BATCH_BYTES = 4 << 20


def local_session(cpus: int = 8, name: str = "millrace", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own."""
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the master is
    local a temporary folder is made and set as the checkpoint folder; a cluster without
    the setting is an error, as no machine's own folder would do there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Cuts lineage with Spark's commit protocol, so a lost executor costs its running
    tasks only, and what follows knows the table's size. The table is left until
    ``discard`` or ``clean_up``, as lazy results may still refer to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["millrace_path"] = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing refers to it any more."""
    if path := table.__dict__.pop("millrace_path", None):
        remove(table.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that refer to them are lost."""
    remove(spark, f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, for the whole session, unless the caller has done so.

    The setting is read when a query is run, so it can't be scoped to one plan.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "-1"):  # the default, or unbounded
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(table: DataFrame) -> DataFrame:
    """A table that lies in fewer files than there are cores, dealt to all of them; any other comes back as it is.

    For work that is dear per row: a file of one row group is one task's work, however
    many cores wait. What is dealt is smaller than that work, and with as many files as
    cores nothing is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system of that path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value, body):
    """``body`` of a column that is computed once per row, also inside lambdas.

    Catalyst may inline a projected column into a lambda and compute it per element;
    an argument of a lambda stays one value.
    """
    return F.transform(F.array(value), body)[0]


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
