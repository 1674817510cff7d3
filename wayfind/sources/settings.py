"""Settings of an engine, kept beside its index. Each change is a row of a small table, so a change is committed whole and the newest one counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names, kinds (by the value) and defaults. Fixed values.
DEFAULTS: dict[str, bool | float | str] = {"debug#enabled": False, "debug#logLevel": "info", "debug#simulateFailure": "", "ui#showReasons": False, "ui#incremental": True, "search#maxResults": 300.0}
STORED = "version long, name string, value string"


class Settings:
    """A stored value comes first, then the caller's, then the default. Names without a default are texts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/settings"
        self.stored = {r["name"]: (r["version"], r["value"]) for r in self.table().collect()}  # one row a name

    def table(self) -> DataFrame:
        """(name, version, value): each name's newest value."""
        try:
            rows = self.spark.read.schema(STORED).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], STORED)
        return rows.groupBy("name").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))

    def get(self, name: str, default: bool | float | str | None = None) -> bool | float | str | None:
        if name not in self.stored:
            return DEFAULTS.get(name) if default is None else default
        text, kind = self.stored[name][1], type(DEFAULTS.get(name, ""))
        return text == "true" if kind is bool else kind(text)

    def set(self, name: str, value: bool | float | str) -> None:
        if name in DEFAULTS and (isinstance(value, bool) != isinstance(DEFAULTS[name], bool) or isinstance(value, str) != isinstance(DEFAULTS[name], str)):
            raise ValueError(f"{name} is a {type(DEFAULTS[name]).__name__}")
        version = 1 + max((v for v, _ in self.stored.values()), default=0)
        text = str(value).lower() if isinstance(value, bool) else str(value)
        self.spark.createDataFrame([(version, name, text)], STORED).coalesce(1).write.mode("append").parquet(self.path)
        self.stored[name] = (version, text)
