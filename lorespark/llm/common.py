"""What the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where it is unset, which is an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_folder()
    return found


@functools.lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="lorespark-")


class Scratch:
    """df written as a table in the shared folder, for a wide result that is read a few times; drop() deletes it when nothing is left to read."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{_folder(df.sparkSession)}/lorespark-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _counted(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows with `_part`, the task, and `_at`: how many rows of the key came before in this task."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        at = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
        if keys[0] == last:
            at[: starts[1] if len(starts) > 1 else len(keys)] += seen
        last, seen = keys[-1], at[-1] + 1
        more = [pa.array(np.full(len(keys), part, np.int32)), pa.array(at.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "_at"])


def placed(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, Scratch]:
    """rows with `_pos`, the place among those of equal key (an integer, never null) in that order, from 0; and the table they are read from.

    All rows are sorted by ranges and counted task by task, then shifted by what earlier tasks hold: no key has to fit into a task.
    """
    names = rows.columns
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    kept = Scratch(ranged.mapInArrow(functools.partial(_counted, key=key), schema))
    held = kept.df.groupBy(key, "_part").agg(F.count("*").alias("_held"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_before", F.sum("_held").over(earlier)).filter("_before > 0").select(key, "_part", "_before")
    # only keys that a border of two tasks cuts: at most one row for each task
    found = kept.df.join(small_side(before), [key, "_part"], "left")
    return found.select(*names, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("_pos")), kept


#: Rows of an Arrow batch, where the session has Spark's default.
ARROW_ROWS, DEFAULT_ROWS = 1024, "10000"


def short_batches(spark: SparkSession) -> None:
    """Python workers get batches of ARROW_ROWS rows at most, as rows are whole texts; a session that says otherwise is left alone.

    The setting stays, as a plan takes it when it runs.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a bounded count finds at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sample_of_each(rows: DataFrame, key: str, count: int) -> DataFrame:
    """Of rows with a 64-bit hash `h`, for each value of key those with (about) the smallest 4 * count hashes: all where there are fewer.

    One count and one filter: no row is shuffled, and what comes out is bounded whatever the table holds, but for rows of equal hashes.
    """
    sizes = rows.groupBy(key).agg(F.approx_count_distinct("h").alias("_different"))
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    return rows.join(small_side(sizes), key).filter(place * F.col("_different") < 4 * count).drop("_different")


def ascii_lower(text: Column) -> Column:
    """A-Z only; pure ASCII takes the faster built-in, which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Bytes of text that a Python worker looks through together.
SLICE_BYTES = 8 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into stretches of so many rows and SLICE_BYTES of text at most (or one row)."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_numpy()
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(ends.searchsorted(before + SLICE_BYTES, side="right"))))
            yield batch.slice(start, end - start)
            start = end
