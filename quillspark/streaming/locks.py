"""One run at a time of a named job, across sessions that share a folder."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Hours after which a run that has not ended no longer holds its name; fixed value.
HOURS = 20


def acquire(spark: SparkSession, folder: str, name: str, hours: float = HOURS) -> str | None:
    """The owner's token, or null while another run holds the name.

    Each run is a numbered file, and the next number is taken by creating its file, which one of several can do where
    the file system creates atomically (HDFS does, plain object stores don't). A number counts as ended when its mark
    of release is there or it is older than `hours`. Numbers only grow, so that nobody takes over a newer run's lock.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    began = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(top) if s.getPath().getName().startswith(f"{name}.")}
    numbers = [int(n.rsplit(".", 1)[1]) for n in began if n.rsplit(".", 1)[1].isdigit()]
    last = max(numbers, default=0)
    held = f"{name}.{last}"
    if last and f"{held}.released" not in began and time.time() - began[held] / 1000 < hours * 3600:
        return None
    mine = jvm.org.apache.hadoop.fs.Path(top, f"{name}.{last + 1}")
    return mine.toString() if fs.createNewFile(mine) else None


def release(spark: SparkSession, token: str) -> None:
    """Ends the token's own run; a later run's lock stays as it is."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{token}.released")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(mark)


def single_flight(spark: SparkSession, folder: str, name: str, run: Callable[[], object], hours: float = HOURS) -> bool:
    """Whether run() was called: not while another run of the name goes on. It is released whether or not run() fails."""
    token = acquire(spark, folder, name, hours)
    if token is None:
        return False
    try:
        run()
    finally:
        release(spark, token)
    return True
