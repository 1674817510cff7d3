"""Tables kept in buckets of the columns that joins ask for, so a join shuffles only its other side.

A bucketed table is Parquet files in a folder, which any reader may take as such; only the session's catalog tells Spark of the buckets. ``describe`` therefore keeps the layout beside
the tables, and ``opened`` enters a folder into the catalog of whatever session reads it. Dropping the entry (``forget``) leaves the files.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wayfind.sources.workspace import exists

#: Rows of a bucket, about: some 100 MB of Parquet.
ROWS = 4_000_000
LAYOUT = "name string, columns array<string>, buckets int"


@dataclass(frozen=True)
class Buckets:
    columns: tuple[str, ...]
    number: int

    @classmethod
    def of(cls, columns: tuple[str, ...], rows: int | None) -> Buckets:
        """A power of two of them, so tables of different sizes still fit each other."""
        return cls(columns, 1 << max(0, -(-(rows or 0) // ROWS) - 1).bit_length())


def _entry(path: str, name: str) -> str:
    return f"wayfind_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}_{name}"


def put(df: DataFrame, path: str, name: str, buckets: Buckets) -> DataFrame:
    """Written to path/name, one sorted file for each bucket that has rows."""
    spark, entry = df.sparkSession, _entry(path, name)
    one = df.repartition(buckets.number, *buckets.columns)
    one.write.format("parquet").mode("overwrite").bucketBy(buckets.number, *buckets.columns).sortBy(*buckets.columns).option("path", f"{path}/{name}").saveAsTable(entry)
    return spark.table(entry)


def describe(spark: SparkSession, path: str, tables: dict[str, Buckets]) -> None:
    rows = [(name, list(b.columns), b.number) for name, b in tables.items()]
    spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def layout(spark: SparkSession, path: str) -> dict[str, Buckets]:
    """The bucketed tables of a folder, as many as describe() was told of; none if there is no layout."""
    if not exists(spark, f"{path}/layout"):
        return {}
    return {r["name"]: Buckets(tuple(r["columns"]), r["buckets"]) for r in spark.read.schema(LAYOUT).json(f"{path}/layout").collect()}


def opened(spark: SparkSession, path: str, name: str, buckets: Buckets) -> DataFrame:
    entry = _entry(path, name)
    if not spark.catalog.tableExists(entry):
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
        columns = ", ".join(f"`{c}`" for c in buckets.columns)
        at = f"{path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"create table if not exists {entry} ({fields}) using parquet clustered by ({columns}) sorted by ({columns}) into {buckets.number} buckets location '{at}'")
    return spark.table(entry)


def forget(spark: SparkSession, path: str, names: tuple[str, ...]) -> None:
    """Takes a folder's tables out of the catalog."""
    for name in names:
        spark.sql(f"drop table if exists {_entry(path, name)}")
