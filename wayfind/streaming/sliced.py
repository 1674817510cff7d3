"""An index built in slices: a stream over a snapshot of the catalog, one file a micro-batch, that may be stopped after any slice and goes on later, in this session or another."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import index as I  # noqa: E741
from wayfind.sources.workspace import exists


class SlicedBuild:
    """folder: of this build alone; whoever opens it again goes on where it stopped. The snapshot keeps the build to one state of the catalog.

    Slices hold what costs most, valid items and their normalised fields. A slice's number names its files, so one that was cut off and runs again replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, catalog: Callable[[], DataFrame], slice_items: int = 200_000):
        self.spark, self.folder, self.catalog, self.slice_items = spark, folder, catalog, slice_items
        self.staged = f"{folder}/staged"

    def _begin(self) -> None:
        if exists(self.spark, f"{self.staged}/_SUCCESS"):
            return
        catalog = self.catalog()
        slices = max(1, -(-catalog.count() // self.slice_items))
        catalog.repartition(slices).write.mode("overwrite").parquet(self.staged)

    def done(self) -> bool:
        return exists(self.spark, f"{self.folder}/_DONE")

    def step(self, budget: float | None = None) -> bool:
        """Takes slices for about ``budget`` seconds, one at least; all of them without a budget. Whether all are taken."""
        if self.done():
            return True
        ends = None if budget is None else time.monotonic() + budget
        self._begin()
        taken = 0

        def add(batch: DataFrame, number: int) -> None:
            nonlocal taken
            items = f"{self.folder}/items/batch={number}"
            I.named(I.valid_items(batch)).write.mode("overwrite").parquet(items)
            I.item_fields(self.spark.read.parquet(items)).write.mode("overwrite").parquet(f"{self.folder}/fields/batch={number}")
            taken += 1

        source = self.spark.readStream.schema(self.spark.read.parquet(self.staged).schema).option("maxFilesPerTrigger", 1).parquet(self.staged)
        query = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{self.folder}/cursor").trigger(availableNow=True).start()
        while not query.awaitTermination(0.2 if ends is None else max(0.05, min(0.2, ends - time.monotonic()))):
            if ends is not None and time.monotonic() >= ends and taken:
                query.stop()  # a slice that was under way runs again
                return False
        self.spark.createDataFrame([(1,)], "done int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_DONE")
        return True

    def parts(self) -> tuple[I.Index, DataFrame]:
        """The index of the snapshot as plans over the slices, and its fields, which need no more normalising."""
        items = self._slices("items", I.named(I.valid_items(self.spark.read.parquet(self.staged))))
        fields = self._slices("fields", I.item_fields(items))
        return I.index_of(self.spark.read.parquet(self.staged), items, fields), fields

    def _slices(self, name: str, like: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(like.schema).parquet(path).select(*[F.col(f"`{c}`") for c in like.columns]) if exists(self.spark, path) else like.where("false")
