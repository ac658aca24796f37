"""Tables that cut lineage, written to the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset on a local
master (tests, a laptop) a folder of this process is used instead; on a cluster it must be set.
Tables are removed when Python ends, or by ``drop`` once they are superseded.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def base(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspark-"))
    return f"file://{_own[0]}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet and returns a plan that reads it; a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{base(spark)}/quillspark-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop(df: DataFrame) -> None:
    """Removes the table that ``save`` returned as ``df``, which nothing will read again."""
    found = (df.sparkSession, df.scratch_path)
    remove(found[1], found[0])
    _written.remove(found)


def remove(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _end() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            remove(path, spark)
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)
