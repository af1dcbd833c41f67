"""Tables written down between the rounds of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a new local folder in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-ridgeline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/written-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing will read again."""
    for path in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again; any other DataFrame is left alone."""
    for d in tables:
        if path := _folders.pop(d, None):
            removed(d.sparkSession, path)
