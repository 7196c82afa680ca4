"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import functions as F

_STAGED: list = []
_NOTED: ContextVar[list | None] = ContextVar("noted", default=None)


def shared_dir(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a fresh one where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="covertile-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df, name: str):
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/covertile/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_in = path
    if (inside := _NOTED.get()) is not None:
        inside.append(out)
    return out


@contextmanager
def noted():
    """A list that gets every table that is staged inside, so that all can be released once their result is staged."""
    tables: list = []
    before = _NOTED.set(tables)
    try:
        yield tables
    finally:
        _NOTED.reset(before)


def release(*tables) -> None:
    """Delete staged tables that nothing reads any more; others, and those already released, are left alone."""
    for table in tables:
        path = getattr(table, "staged_in", None)
        if path and (table.sparkSession, path) in _STAGED:
            _delete(table.sparkSession, path)
            _STAGED.remove((table.sparkSession, path))


def _delete(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df, rows: int):
    """``df``, marked for broadcast if it has at most ``rows`` rows by count; otherwise joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def _drop_staged() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # its session is gone: the folder's owner cleans up
            continue
