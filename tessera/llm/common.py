"""What the operators of this package share: scratch tables, table reading and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Words of the whitespace rule, as a pattern of Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name under sf_dir, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or one of our own where that is unset and everything runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks in flight, never the work
    that is already written.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables from which nothing is to be read any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when no result is still to be read."""
    _delete(spark, scratch_root(spark))


def utf8(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def n_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_values(df: DataFrame, column: str, added: str, make: Callable[[list], Sequence]) -> DataFrame:
    """df without the column, with the columns ``added`` (a schema) that make computes from a batch of its values.

    All other columns pass through as Arrow arrays, so no value of theirs changes, nulls or not.
    """
    rest, new = [c for c in df.columns if c != column], StructType.fromDDL(added)
    names, types = [*rest, *new.names], [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True))], names=names)

    return df.select(*rest, column).mapInArrow(run, StructType([*(df.schema[c] for c in rest), *new]))


def filter_values(df: DataFrame, column: str, keep: Callable[[list], Sequence[bool]]) -> DataFrame:
    """The rows of df that keep chooses by a batch of the column's values; all columns pass through as Arrow arrays."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
