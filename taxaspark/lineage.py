"""Where intermediate tables live, and how an iterative job cuts its lineage.

Tables go to the shared folder the cluster names in ``spark.checkpoint.dir``, so
a lost executor costs a re-read and never the table.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only for local masters without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="taxaspark-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table and go on from the table.

    Unlike a cached frame it has a known size, which lets Catalyst choose the
    join strategy of the next step, and its plan is one scan. The shuffle files
    behind it go as soon as the table is there, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
