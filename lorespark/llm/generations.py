"""Late arrivals: partitions of a table of files are overwritten day by day, under a manifest of generations.

A layout keeps the latest-arrived row of each key and cuts every day, in order, into Parquet files of a fixed number of rows. Executors write the files
with pyarrow below the folder, first under a name of the attempt, then moved to a name that says day, place and generation; so a task that runs
again leaves the same files. The files of a generation that count are those in its manifest, a small table written last. `absorb` takes rows that
came late: the days where they stand, and where the rows stood that they replace, are dirty. Only their files are read again and written under
the next generation; files of clean days are named by the new manifest and not touched. When the new manifest stands, the driver
deletes the files that it no longer names. A run that breaks off before leaves the old manifest and its files.

The places of rows come from a range sort (`common.placed`), so no day has to fit into one task; a file is written by one task, in stretches.

Defined results: a null key is a key like any other; a null arrival is earlier than any other; rows of one key and arrival are ordered by their other
columns, but a late row must have arrived after the standing one to replace it; a null time is day -1; empty tables give no
files; further columns of the table are kept in the files, in order. Internal columns begin with `_lore_`.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from lorespark.llm.common import Scratch, _folder, materialize, placed, small_side, table

#: Rows that a writer holds back, and so the rows of a row group.
GROUP_ROWS = 1 << 16
MANIFEST = "day long, file_no long, name string, generation int, n_rows long"
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Keys:
    """The columns that a layout goes by, and the rows of a file."""

    key: str
    time: str
    arrived: str
    file_rows: int


def day_of(rows: DataFrame, time: str) -> Column:
    """Whole days since 1970 in UTC, -1 for null."""
    if isinstance(rows.schema[time].dataType, TimestampType):
        days = F.floor(F.unix_micros(time) / DAY_US)
    else:
        days = F.datediff(time, F.lit("1970-01-01"))
    return F.coalesce(days.cast("long"), F.lit(-1).cast("long"))


def latest(rows: DataFrame, keys: Keys) -> DataFrame:
    """The latest-arrived row of each key."""
    rest = [c for c in rows.columns if c not in (keys.key, keys.arrived)]
    best = rows.groupBy(keys.key).agg(F.max(F.struct(keys.arrived, *rest)).alias("_lore_best"))
    return best.select(*[c if c == keys.key else F.col(f"_lore_best.{c}").alias(c) for c in rows.columns])


class _File:
    """One file being written: under the attempt's name until it is complete."""

    def __init__(self, store: fs.FileSystem, root: str, name: str, schema: pa.Schema):
        self.store, self.path, self.attempt = store, f"{root}/{name}", f"{root}/_attempts/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/_attempts", recursive=True)
        self.out = pq.ParquetWriter(self.attempt, schema, filesystem=store)
        self.schema, self.held, self.n_held, self.n_rows = schema, [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.n_held += batch.num_rows
        self.n_rows += batch.num_rows
        if self.n_held >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held, self.schema))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        try:
            self.store.move(self.attempt, self.path)
        except OSError:
            # an earlier attempt has written the same rows
            if self.store.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.store.delete_file(self.attempt)


def _write(batches: Iterable[pa.RecordBatch], root: str, generation: int) -> Iterator[pa.RecordBatch]:
    """Rows (_lore_day, _lore_file, columns of the file) in order -> manifest rows of the files that they fill."""
    store, root = fs.FileSystem.from_uri(root)
    place, file = None, None

    def done() -> pa.RecordBatch:
        file.close()
        values = [place[0], place[1], name_of(*place, generation), generation, file.n_rows]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["day", "file_no", "name", "generation", "n_rows"])

    for batch in batches:
        day, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(day):
            continue
        own = pa.RecordBatch.from_arrays(batch.columns[2:], batch.schema.names[2:])
        starts = np.flatnonzero(np.r_[True, (day[1:] != day[:-1]) | (number[1:] != number[:-1])])
        for start, end in zip(starts, [*starts[1:], len(day)], strict=True):
            if (now := (int(day[start]), int(number[start]))) != place:
                if file:
                    yield done()
                place, file = now, _File(store, root, name_of(*now, generation), own.schema)
            file.add(own.slice(start, end - start))
    if file:
        yield done()


def name_of(day: int, file_no: int, generation: int) -> str:
    return f"day={day}/{file_no:05d}-g{generation}.parquet"


def _read(batches: Iterable[pa.RecordBatch], root: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Manifest rows (day, name) -> the rows of the files, with `_lore_day`."""
    store, root = fs.FileSystem.from_uri(root)
    for batch in batches:
        for day, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_file(f"{root}/{name}") as source:
                for rows in pq.ParquetFile(source).iter_batches(GROUP_ROWS, columns=columns):
                    days = pa.array(np.full(rows.num_rows, day, np.int64))
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in columns], days], [*columns, "_lore_day"])


@dataclass(frozen=True)
class Layout:
    """The files of one generation below a folder."""

    spark: SparkSession
    folder: str
    keys: Keys
    schema: StructType
    generation: int

    @property
    def root(self) -> str:
        """The folder as a URI with its file system, as executors open it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found

    def _manifest_path(self, generation: int) -> str:
        return f"{self.folder}/_manifest/g{generation}"

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(self._manifest_path(self.generation))

    def opened(self, files: DataFrame, f: Callable, schema: StructType | str) -> DataFrame:
        """f over manifest rows, dealt out by name; their number is fixed, as Spark would merge rows as short as these into one task."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return files.repartition(tasks, "name").mapInArrow(f, schema)

    def rows(self, files: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of the files (all by default), with `_lore_day`."""
        root, columns = self.root, columns or self.schema.names
        schema = StructType([*[self.schema[c] for c in columns], StructField("_lore_day", LongType())])
        files = (self.manifest() if files is None else files).select("day", "name")
        return self.opened(files, lambda batches: _read(batches, root, columns), schema)

    def _written(self, rows: DataFrame, generation: int) -> tuple[DataFrame, Scratch]:
        """Manifest rows of the files of rows with `_lore_day`; the files are written when the manifest is."""
        root, keys = self.root, self.keys
        found, kept = placed(rows.select("_lore_day", *self.schema.names), "_lore_day", [keys.time, keys.key])
        found = found.withColumn("_lore_file", F.floor(F.col("_pos") / keys.file_rows).cast("long"))
        dealt = found.repartition("_lore_day", "_lore_file").sortWithinPartitions("_lore_day", "_lore_file", "_pos").select("_lore_day", "_lore_file", *self.schema.names)
        return dealt.mapInArrow(lambda batches: _write(batches, root, generation), MANIFEST), kept

    def _commit(self, files: DataFrame, generation: int) -> Layout:
        files.write.json(self._manifest_path(generation))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_attempts")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return Layout(self.spark, self.folder, keys=self.keys, schema=self.schema, generation=generation)

    def absorb(self, late: DataFrame) -> Layout:
        """The layout of these rows and the standing ones, as the next generation."""
        keys, old = self.keys, self.manifest()
        fresh = latest(late, keys).withColumn("_lore_day", day_of(late, keys.time))
        standing = self.rows(columns=[keys.key, keys.arrived]).select(F.col(keys.key).alias("_lore_key"), F.col(keys.arrived).alias("_lore_arrived"), F.col("_lore_day").alias("_lore_old_day"))
        # Spark takes what executors read from files for as small as the manifest, and would broadcast it
        met = fresh.join(standing.hint("merge"), fresh[keys.key].eqNullSafe(standing["_lore_key"]), "left")
        newer = F.col("_lore_old_day").isNull() | (F.col(keys.arrived) > F.col("_lore_arrived")) | (F.col("_lore_arrived").isNull() & F.col(keys.arrived).isNotNull())
        winners = Scratch(met.filter(newer).select(*self.schema.names, "_lore_day", "_lore_old_day"))
        days = winners.df.select(F.explode(F.array("_lore_day", "_lore_old_day")).alias("day")).filter("day IS NOT NULL").distinct()
        dirty = small_side(materialize(days))
        replaced = winners.df.filter("_lore_old_day IS NOT NULL").select(F.col(keys.key).alias("_lore_key"))
        again = self.rows(old.join(dirty, "day", "left_semi"))
        again = again.join(replaced.hint("merge"), again[keys.key].eqNullSafe(replaced["_lore_key"]), "left_anti")
        files, kept = self._written(again.unionByName(winners.df.drop("_lore_old_day")), self.generation + 1)
        # files are written here; the manifest of the generation then names them and the clean ones
        written = materialize(files)
        layout = self._commit(old.join(dirty, "day", "left_anti").unionByName(written), self.generation + 1)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for row in old.join(dirty, "day", "left_semi").select("name").toLocalIterator():
            store.delete(path(f"{self.folder}/{row['name']}"), False)
        for used in (kept, winners):
            used.drop()
        return layout


def lay_out(rows: DataFrame, folder: str, keys: Keys) -> Layout:
    """Generation 0 of a layout in a new folder."""
    empty = Layout(rows.sparkSession, folder, keys, rows.schema, 0)
    files, kept = empty._written(latest(rows, keys).withColumn("_lore_day", day_of(rows, keys.time)), 0)
    layout = empty._commit(files, 0)
    kept.drop()
    return layout


def _details(batches: Iterable[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Manifest rows -> what the query tells of each file, in stretches of GROUP_ROWS rows."""
    store, root = fs.FileSystem.from_uri(root)
    for batch in batches:
        out = []
        for day, file_no, name, generation in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            n_rows = cents = crc = 0
            ids = hashlib.sha256()
            with store.open_input_file(f"{root}/{name}") as source:
                file = pq.ParquetFile(source)
                for rows in file.iter_batches(GROUP_ROWS, columns=["sale_id", "total", "sold_at", "arrived_at"]):
                    total = rows.column("total").drop_null().to_numpy(zero_copy_only=False)
                    cents += int(np.floor(100 * total + 0.5).astype(np.int64).sum())
                    texts = [pc.fill_null(rows.column("sale_id").cast(pa.string()), "")]
                    texts += [pc.fill_null(rows.column(c).cast(pa.int64()).cast(pa.string()), "") for c in ("sold_at", "arrived_at")]
                    crc += sum(zlib.crc32(x.encode()) for x in pc.binary_join_element_wise(*texts, ":").to_pylist())
                    ids.update((b"," if n_rows else b"") + ",".join(texts[0].to_pylist()).encode())
                    n_rows += rows.num_rows
                columns = ",".join(file.schema_arrow.names)
            out.append((day, file_no, n_rows, cents, crc, name, columns, ids.hexdigest(), generation > 0))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], DETAILS_NAMES)


DETAILS = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean"
DETAILS_NAMES = [c.split()[0] for c in DETAILS.split(", ")]
CUTOFF = "2024-04-10 00:00:00"


def with_copies(sales: DataFrame) -> DataFrame:
    """The query's rows: those of sale_ids and days that its rule picks come once more, later."""
    h = F.crc32(F.col("sale_id").cast("string"))
    own = sales.withColumns({"_h": h, "_lore_day": day_of(sales, "sold_at")})
    days = lambda n: F.make_dt_interval(n.cast("int"))
    changed = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(F.col("_h") % 2), "arrived_at": F.col("arrived_at") + days(1 + F.col("_h") % 97)}
    row = F.struct(*sales.columns)
    copy = F.struct(*[changed.get(c, F.col(c)).cast(sales.schema[c].dataType).alias(c) for c in sales.columns])
    twice = (F.col("_h") % 3 == 0) & (F.col("_lore_day") % 7 == 0)
    return own.select(F.inline(F.when(twice, F.array(row, copy)).otherwise(F.array(row))))


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    keys = Keys("sale_id", "sold_at", "arrived_at", 1 + sales.count() // 700)
    rows = with_copies(sales)
    early = F.coalesce(F.col("arrived_at") < F.lit(CUTOFF).cast(sales.schema["arrived_at"].dataType), F.lit(False))
    folder = f"{_folder(spark)}/late-overwrite-{uuid.uuid4().hex}"
    layout = lay_out(rows.filter(early), folder, keys).absorb(rows.filter(~early))
    root = layout.root
    found = layout.opened(layout.manifest().select("day", "file_no", "name", "generation"), lambda batches: _details(batches, root), DETAILS)
    return found.withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))
