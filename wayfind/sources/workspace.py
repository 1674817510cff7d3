"""Where tables that outlive one plan are kept: the folder that all executors of a cluster share, and files in it that are created once."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir; where that is not set, a temporary one of a local session, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-wayfind-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df, written once to a new folder and read again, where a plan reads it more than once."""
    df.write.parquet(path := new_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _store(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it; nothing if there is none."""
    at, store = _store(spark, path)
    store.delete(at, True)


def create_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Whether this call created the file. It is written aside, under a name that Spark's readers pass over, and then renamed without overwriting: of several writers one succeeds, and no
    reader sees half a file."""
    jvm = spark.sparkContext._jvm
    aside, store = _store(spark, f"{folder}/_{uuid.uuid4().hex}")
    store.mkdirs(aside.getParent())
    out = store.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(rename, 1)
    never[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(aside, _store(spark, f"{folder}/{name}")[0], never)
    except Py4JJavaError as error:
        store.delete(aside, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
