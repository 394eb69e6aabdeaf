"""A store of capture records: the whole of it replaced at once, or not at all.

A store is a folder of versions and a small file that names the current one. A new
version is written aside and the name switched last, in one step of the file system,
so a failed or lost writer leaves what was there, and a job may replace the store it
reads from. The version before the current one stays for those who still read it.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Answer(NamedTuple):
    """Whether a store was replaced, and if not, why."""

    saved: bool
    error: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that ``spark.checkpoint.dir`` names; a local session may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallygrid-store-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tallygrid/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """(the file system's context, the path) as the JVM has them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    if files.util().exists(place):
        files.delete(place, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """The current version and the one before, as the store's file names them."""
    files, place = _files(spark, f"{path}/current")
    if not files.util().exists(place):
        return []
    return [r["value"] for r in spark.read.text(f"{path}/current").take(2)]


def _switch(spark: SparkSession, path: str, names: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, aside = _files(spark, f"{path}/current-{uuid.uuid4().hex}")
    out = aside.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, True)
    try:
        out.write(bytearray("".join(n + "\n" for n in names).encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(aside, hadoop.Path(f"{path}/current"), options)


def replace(records: DataFrame, path: str) -> Answer:
    """Makes ``records`` all that the store at ``path`` has.

    ``records`` may be made from the store itself. If they can't be computed or
    written, the store stays as it was, and the answer says why.
    """
    spark, name = records.sparkSession, f"version-{uuid.uuid4().hex}"
    try:
        before = _names(spark, path)
        records.write.parquet(f"{path}/{name}")
        _switch(spark, path, [name, *before[:1]])
    except Exception as error:  # a full disk, a bad row, lost rights: whatever it is, the answer is no
        _delete(spark, f"{path}/{name}")
        return Answer(False, str(error).splitlines()[0])
    for old in before[1:]:
        _delete(spark, f"{path}/{old}")
    return Answer(True)


def load(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What the store at ``path`` has; nothing if there is none."""
    names = _names(spark, path)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{names[0]}")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes the store."""
    _delete(spark, path)
