"""What several operators share: column helpers and tables in the folder that all executors see."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of all operators: blank and the control characters from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN: list[str] = []


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay, unlike with lower()."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, a temporary folder of a local session, and an error on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-wayfind-"))
    return _OWN[0]


#: Bytes of a batch that goes to Python at once, where the session has Spark's own bound: with that, two batches of long texts as pandas objects fill a small executor.
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Lets the session send texts to Python in batches of BATCH_BYTES, if it has no bound of its own below Spark's."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, "67108864b") in ("67108864b", "64MB", "67108864"):
        spark.conf.set(bound, str(BATCH_BYTES))


class Tables:
    """Intermediate tables of one operator run: written once, read often. Those that the (lazy) result does not read are dropped on the way;
    the others stay in the shared folder, as they are read when the result is.

    They cut lineage, so a lost executor costs no more than its own tasks. Most hold hashes, numbers and packed bytes, which do
    not compress, and codecs would hold native memory for each of many small files; so they have a codec only where one is named.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        small_batches(spark)

    def write(self, df: DataFrame, name: str, by: str | None = None, codec: str = "uncompressed") -> DataFrame:
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)  # an empty table may have no file to tell its schema

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def _bytes_of(of: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(of), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + _bytes_of(x, kind.elementType)), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return functools.reduce(Column.__add__, [_bytes_of(of[f.name], f.dataType) for f in kind], F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def broadcast_if_small(df: DataFrame, limit: int = 8_000_000) -> DataFrame:
    """df with a broadcast hint if its measured size (values, and 16 bytes a row) is at most ``limit`` bytes; else Spark joins it by a shuffle.

    df is read once more for the measurement, so it should be a written table."""
    row = functools.reduce(Column.__add__, [_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(16).cast("long"))
    size = df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def row_key(df: DataFrame, key: str, text: str = "text") -> tuple[Column, Column]:
    """Two columns that tell rows apart even where ids are null or repeat with different texts."""
    return F.coalesce(df[key].cast("long"), F.lit(-(2**63))).alias("_k"), F.xxhash64(df[text]).alias("_t")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts
