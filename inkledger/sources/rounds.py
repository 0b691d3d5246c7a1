"""Tables between the rounds of a job, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made, by session.
_made: dict[str, list[str]] = {}


def fresh_uri(spark: SparkSession, name: str) -> str:
    """A folder of no other call below ``spark.checkpoint.dir``. Only a local session may leave that unset: it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="inkledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = root if re.match(r"\w+:/", root) else f"file://{root}"
    uri = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(uri)
    return uri


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later rounds don't repeat earlier ones, nor calls that were made."""
    uri = fresh_uri(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def sweep(spark: SparkSession) -> int:
    """Deletes the folders of ``written`` that this process has made, once no result reads them any more; their number."""
    uris = _made.pop(spark.sparkContext.applicationId, [])
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(uris)
