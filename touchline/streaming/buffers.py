"""Bounded sliding buffers: the newest samples of each key as keyed stream state, and exact order statistics over them.

The state of a key is a list of at most ``size`` samples, however long the stream runs. What stays is decided by (time, tie), not by arrival, so
late rows, other micro-batches and a restart from the checkpoint give the same buffer. A micro-batch's rows of a key arrive in chunks
and are reduced to the newest ``size`` one chunk after the other. The state store is RocksDB's, as keyed list state requires.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Samples kept of timings and of scraper latencies, and the quantiles told.
SAMPLES, SCRAPER_SAMPLES, QUANTILES = 1_000, 500, (0.50, 0.95, 0.99)
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("value", T.DoubleType())])
STATS = [("n", T.LongType()), ("mean", T.DoubleType()), ("least", T.DoubleType()), ("most", T.DoubleType()), *[(f"p{int(q * 100)}", T.DoubleType()) for q in QUANTILES]]


def newest(samples: pd.DataFrame, size: int) -> pd.DataFrame:
    """The last ``size`` samples by (at, tie), oldest first."""
    return samples.sort_values(["at", "tie"], kind="stable").tail(size)


def statistics(values: pd.Series) -> dict:
    """Exact order statistics: the quantile q of n sorted values is the one at place int(n * q)."""
    v = values.sort_values().reset_index(drop=True)
    n = len(v)
    return {"n": n, "mean": float(v.mean()), "least": float(v.iloc[0]), "most": float(v.iloc[-1]), **{f"p{int(q * 100)}": float(v.iloc[min(n - 1, int(n * q))]) for q in QUANTILES}}


class Newest(StatefulProcessor):
    """State and output of one key: its buffer, and the statistics over it after each micro-batch that brought it rows."""

    def __init__(self, keys: list[str], size: int):
        self.keys, self.size = keys, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", SAMPLE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in SAMPLE]
        kept = pd.DataFrame(list(self.samples.get()), columns=names)
        for chunk in rows:
            chunk = chunk[names].dropna()
            kept = newest(pd.concat([kept, chunk]) if len(kept) else chunk, self.size)
        if len(kept):
            self.samples.put([(int(a), int(t), float(v)) for a, t, v in kept.itertuples(index=False)])
            yield pd.DataFrame([{**dict(zip(self.keys, key)), **statistics(kept["value"].astype(float))}])

    def close(self) -> None:
        pass


def buffered(stream: DataFrame, keys: list[str], value: str, time: str, tie: str, size: int = SAMPLES) -> DataFrame:
    """A stream of (keys, n, mean, least, most, quantiles) over the newest ``size`` samples of each key. Rows whose value, time or tie is null
    are no samples."""
    rows = stream.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    out = T.StructType([*[stream.schema[k] for k in keys], *[T.StructField(n, t) for n, t in STATS]])
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Newest(keys, size), outputStructType=out, outputMode="Update", timeMode="None")


@contextmanager
def rocksdb(spark: SparkSession):
    """RocksDB as the session's state store while queries are started."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def drain(stats: DataFrame, out: str, checkpoint: str) -> None:
    """Write what there is, a folder a micro-batch, and stop; a later call with the same checkpoint goes on from there. A batch that is done again
    overwrites itself."""
    with rocksdb(stats.sparkSession):
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        stats.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last statistics of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
