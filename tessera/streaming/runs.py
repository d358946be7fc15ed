"""Running a stream to its end over tables that come in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.scratch import scratch_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state is held by RocksDB for the streams that are started inside; it spills to disk and goes to the checkpoint folder."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream gives to a table, until all that is there has been read."""
    with rocksdb_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def stream_in_parts(parts: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream gives for parts that arrive one after another. It ends after each part and goes on from its checkpoint with the next."""
    spark = parts[0].sparkSession
    source, out, checkpoint = (scratch_folder(spark, name) for name in ("arrived", "out", "progress"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(parts[0].schema).parquet(source))
        run_to_end(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)
