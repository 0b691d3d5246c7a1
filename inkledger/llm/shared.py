"""Files and tables in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only a local session may
leave that unset (tests on one machine): it gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders that this process has made, by session.
_made: dict[str, set[str]] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(SETTING, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="inkledger-")
        spark.conf.set(SETTING, root)
    return root if re.match(r"\w+:/", root) else f"file://{root}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """The URI of a folder that no other call uses; not made yet."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(uri)
    return uri


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it: lost executors cost no earlier work.

    The folder's URI is kept in ``inkledger_dir`` of the result, for ``discard``.
    """
    spark = df.sparkSession
    uri = fresh_dir(spark, name)
    df.write.parquet(uri)
    back = spark.read.schema(df.schema).parquet(uri)
    back.inkledger_dir = uri
    return back


def discard(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete tables of ``materialize`` (or folders by URI) that nothing reads any more."""
    for x in frames:
        uri = x if isinstance(x, str) else x.inkledger_dir
        _made.get(spark.sparkContext.applicationId, set()).discard(uri)
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Deletes all folders that this process has made and not discarded, once no result reads them any more; their number.

    Results are often read from such tables, so only the caller knows when: after its own output is written.
    """
    uris = sorted(_made.get(spark.sparkContext.applicationId, set()))
    discard(spark, *uris)
    return len(uris)


def publish(uri: str, write) -> None:
    """Call ``write(stream)`` on a file of this task attempt's own, then move it to ``uri``.

    A task that runs twice (retry, speculation) writes equal bytes, so the first file stays,
    and no reader sees half of one.
    """
    fs, path = open_fs(uri)
    context = TaskContext.get()
    attempt = f"{path}.{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}.tmp"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(attempt, compression=None) as out:
        write(out)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(attempt)
    else:
        fs.move(attempt, path)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def spread(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """One row to a partition: work lists such as the files to read."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    # createDataFrame slices its list evenly, so this many slices hold a row each.
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), df.schema)
