"""Cutting lineage with tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the setting is absent, a local session gets one of its own; on a cluster, whose machines share no local folder, that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meshloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written.

    The result survives lost executors, and nothing above it is computed twice.
    ``drop_table`` removes it; otherwise it stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshloom_path = path
    return out


def side_by_side(*jobs: Callable):
    """Results of independent calls that each start Spark jobs, run in threads, so that small jobs share the executors."""
    if len(jobs) == 1:
        return [jobs[0]()]
    with ThreadPoolExecutor(len(jobs)) as pool:
        inherit = inheritable_thread_target(SparkSession.active())
        return [f.result() for f in [pool.submit(inherit(j)) for j in jobs]]


def materialize_all(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """``materialize`` of several tables at once."""
    return side_by_side(*[lambda n=n, df=df: materialize(df, n) for n, df in frames.items()])


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a ``materialize`` result that no later plan reads."""
    path = getattr(df, "_meshloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
