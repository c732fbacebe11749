"""Session helpers: where recoverable intermediate results live."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as named by the session. A session on this
    machine alone that names none gets a temporary one; on a cluster it has to be named."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.TemporaryDirectory(prefix="shared-")
    return _own[context.applicationId].name


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    shared = shared_folder(spark)
    return f"{shared if '://' in shared else 'file://' + shared}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read to the shared checkpoint folder
    and continue from the files: a lost executor re-reads files instead of recomputing
    the history."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``settle``, by a table of files: a checkpoint computes its plan twice, this once,
    and later steps read only the columns they need."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_code(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
