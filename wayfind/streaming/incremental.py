"""Streaming: an index that grows by micro-batches, rings of latencies, and a rate limiter of log lines, the latter two with state."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfind.operators.index import item_fields, postings_of, valid_items, vocabulary_of
from wayfind.sources.catalogs import parts_of
from wayfind.sources.workspace import new_folder


def index_stream(catalog: DataFrame, path: str, checkpoint: str):
    """Each micro-batch adds its postings below its own number; a batch that runs again replaces what it wrote before."""

    def add(batch: DataFrame, number: int) -> None:
        items = valid_items(batch)
        postings_of(item_fields(items)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        items.select("item_id", "key").write.mode("overwrite").parquet(f"{path}/items/batch={number}")

    return catalog.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, vocabulary) of all batches so far; an item that came again counts with its latest batch."""
    items, postings = spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/postings")
    latest = items.groupBy("item_id").agg(F.max("batch").alias("batch"))
    postings = postings.join(latest, ["item_id", "batch"], "left_semi").drop("batch")
    return postings, vocabulary_of(postings, latest.count())


class Ring(StatefulProcessor):
    """The last ``size`` values of a key, by time and number, whatever order they come in; a key's rows are read frame by frame, and no more than the ring is held."""

    def __init__(self, size: int, ps: tuple[float, ...]):
        self.size, self.ps = size, ps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "at timestamp, seq long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        heapq.heapify(last)
        for pdf in rows:
            for row in zip(pdf["at"], pdf["seq"].astype(int), pdf["value"].astype(float), strict=True):
                (heapq.heappush if len(last) < self.size else heapq.heappushpop)(last, (row[0].to_pydatetime(), *row[1:]))
        self.ring.put(sorted(last))
        values = sorted(v for *_, v in last)
        rank = lambda p: values[max(1, min(len(values), math.ceil(p * len(values)))) - 1]
        yield pd.DataFrame([(key[0], len(values), *map(rank, self.ps))], columns=["key", "n", *[f"p{round(p * 100)}" for p in self.ps]])

    def close(self) -> None:
        pass


def latency_rings(values: DataFrame, path: str, checkpoint: str, size: int = 100, ps: tuple[float, ...] = (0.5, 0.95)):
    """values (key, at, seq, value) as a stream: after each micro-batch, the size and nearest-rank percentiles of the rings of its keys, below the batch's number. Rows with nulls are no values.
    The rings are kept by RocksDB, which the session is set to."""
    values.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "key string, n int, " + ", ".join(f"p{round(p * 100)} double" for p in ps)
    rings = values.where("at is not null and seq is not null and value is not null").groupBy("key").transformWithStateInPandas(Ring(size, ps), kind, "Update", "None")
    return rings.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).outputMode("update").option("checkpointLocation", checkpoint)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """Each key's row of its latest batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["key", "batch"], "left_semi").drop("batch")


def limit_logs(lines: DataFrame, seconds: float = 60.0) -> DataFrame:
    """lines (key, ts) as a stream: (key, ts, suppressed), at most one in ``seconds`` for a key since the last one let through."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, 0)
        rows, out = pd.concat(list(batches)).sort_values("ts"), []
        for t in rows["ts"]:
            at = t.timestamp()
            if last is None or at - last >= seconds:
                out.append((key[0], t, held))
                last, held = at, 0
            else:
                held += 1
        state.update((last, held))
        yield pd.DataFrame(out, columns=["key", "ts", "suppressed"])

    return lines.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, suppressed long", "last double, held long", "append", GroupStateTimeout.NoTimeout)


def stream_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the part table's index after a stream over its file."""
    root = new_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    table = spark.readStream.schema(schema).parquet(f"{sf_dir}/part.parquet*")
    index_stream(parts_of(table), root, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return published(spark, root)[1]
