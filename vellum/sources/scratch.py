"""Tables written to the cluster's shared folder, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``, else the context's checkpoint
directory. Written tables survive the loss of executors, unlike cached blocks.
Only a local session without either (tests, notebooks on one machine) gets a folder
of our own; on a cluster that raises, as executors don't share their disks.

What a result still reads stays until :func:`clean`.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    return _own[app]


def clean(spark: SparkSession) -> int:
    """Delete the tables that this session's results read, once they are used or written elsewhere; returns how many there were."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator's run, under a folder of their own.

    Use as a context manager: what was written is deleted at the end, but for the
    tables written with ``keep=True``, which the operator's result reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
        self.temporary: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.temporary:
            self.drop(path)
        self.temporary = []

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Write ``df`` and return the written table, read with its known schema."""
        path = self.path(name, keep)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vellum_path = path  # type: ignore[attr-defined]
        return out

    def path(self, name: str, keep: bool = False) -> str:
        """A path of this run for what is not a table, deleted like one."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        (_kept.setdefault(self.spark.sparkContext.applicationId, []) if keep else self.temporary).append(path)
        return path

    def release(self, df: DataFrame) -> None:
        """Delete a table of :meth:`write` before the run ends."""
        path = df._vellum_path  # type: ignore[attr-defined]
        if path in self.temporary:
            self.temporary.remove(path)
        self.drop(path)

    def drop(self, path: str) -> None:
        _delete(self.spark, path)
