"""Written tables in the folder that driver and executors share, where a long lineage should end."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its checkpoint folder.

    Where neither is set, a session on one machine gets a temporary folder; on a cluster that is an error, as executors
    would not see each other's files.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application writes what it needs again."""
    return f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}"


#: After so many written tables, what no plan refers to any more is released.
EVERY = 6
_written = 0


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again: later plans start from files that no lost executor takes along.

    A ``narrow`` table has short rows, a few numbers each: it is written in no more files than two for each core, whatever
    the number of shuffle partitions, as thousands of tiny files cost more than they hold.
    """
    global _written
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    _written += 1
    if _written % EVERY == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcast tables of plans that are gone.

    Its cleaner acts on what the collectors of Python and the JVM have found, and a driver with little to do may not
    collect for the whole of an iteration, while files and memory add up on the executors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of files between which a table is dealt out before work on it.
SPREAD = (1 << 20, 64 << 20)


def spread(df: DataFrame) -> DataFrame:
    """A table of a few files dealt out to all cores; a larger one, which has splits for them, as it is.

    A file with one row group is one task however many cores there are. At these sizes a shuffle costs less than that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and SPREAD[0] <= size <= SPREAD[1] else df


def clean(spark: SparkSession) -> bool:
    """Delete all that this application has written so; results that still read it have to be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
