"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of our own, but only on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written there and read back: the lineage ends, and lost executors cost no work that was done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table that stored() made and that nothing reads any more. Hadoop's client does it, as only Spark may reach the folder."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._loomspan_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for a context, unless their Python finds it anyway (working folder or PYTHONPATH)."""
    import atexit
    import os
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    near = [Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    context = spark.sparkContext
    if root in near or getattr(context, "_loomspan_shipped", False):
        return
    d = tempfile.mkdtemp(prefix="loomspan-")  # executors fetch from it while the context lives
    atexit.register(shutil.rmtree, d, True)
    shutil.copytree(root / "loomspan", Path(d, "code", "loomspan"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(d, "loomspan-code")), "zip", Path(d, "code")))
    context._loomspan_shipped = True


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over all cores before Python works on it; larger ones stay as they are, unshuffled."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if len(table.inputFiles()) < n else table
