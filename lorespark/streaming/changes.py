"""The change stream: debounced, coalesced, renames paired; the same fold in batch and in Structured Streaming.

Changes are rows (wiki, path, kind, from_path, ts, seq) with kind create, modify, delete or rename. A path is reported when it has been
quiet for `window`: that is a session with that gap. Event time and a watermark, which the reference lacks, let state be
dropped: what comes later than the watermark is discarded.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorespark.functions import files
from lorespark.session import shared_folder
from lorespark.sources import folders

WINDOW = "150 milliseconds"
CHANGES = "wiki string, path string, kind string, from_path string, ts timestamp, seq long"


def coalesced(kinds: Column) -> Column:
    """One kind from an array in order of time: what was created stays so until deleted, a delete undone by a create is a modification."""

    def step(s: Column, k: Column) -> Column:
        return (
            F.when(s == "", k)
            .when((s == "create") & (k == "modify"), "create")
            .when((s == "create") & (k == "delete"), "delete")
            .when((s == "rename") & (k == "modify"), "rename")
            .when((s == "delete") & (k == "create"), "modify")
            .when((s == "delete") & (k == "modify"), "delete")
            .otherwise(k)
        )

    return F.aggregate(kinds, F.lit(""), step)


def settled(changes: DataFrame, keys: list[str], window: str = WINDOW) -> DataFrame:
    """(keys, start, end, n, kind): one row per session of a key; works on static and streaming frames alike."""
    found = changes.groupBy(*keys, F.session_window("ts", window).alias("s")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ts", "seq", "kind"))).alias("all"))
    return found.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", coalesced(F.transform("all", lambda x: x["kind"])).alias("kind"))


def watermarked(changes: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return changes.withWatermark("ts", delay)


PAIRED = "wiki string, path string, kind string, from_path string, ts timestamp"
#: Milliseconds within which a target follows its source.
FOLLOWS = 600


def rename_key(changes: DataFrame) -> Column:
    """What sources and targets of renames meet by, within a wiki: the watcher's cookie of the move where changes have one, else the wiki alone."""
    return F.coalesce(F.col("cookie").cast("string"), F.lit("")) if "cookie" in changes.columns else F.lit("")


class _Pairing(StatefulProcessor):
    """One open source for each key, which a timer closes."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "path string, at long")

    def _take(self) -> tuple[str, int] | None:
        """The open source, no longer open."""
        found = self.open.get() if self.open.exists() else None
        if found is not None:
            self.handle.deleteTimer(found[1] + self.within + 1)
            self.open.clear()
        return None if found is None else (found[0], found[1])

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["wiki", "path", "kind", "from_path", "ts"]).astype({"ts": "datetime64[ns]"})

    @staticmethod
    def _deleted(wiki: str, source: tuple[str, int]) -> tuple:
        return (wiki, source[0], "delete", None, pd.Timestamp(source[1], unit="ms"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wiki, out = key[0], []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if not r.kind.startswith("rename_"):
                out.append((wiki, r.path, r.kind, None, r.ts))
                continue
            now, source = int(r.ts.value // 1_000_000), self._take()
            follows = source is not None and r.kind == "rename_to" and now - source[1] <= self.within
            if source is not None and not follows:
                out.append(self._deleted(wiki, source))
            if r.kind == "rename_from":
                self.open.update((r.path, now))
                self.handle.registerTimer(now + self.within + 1)
            else:
                out.append((wiki, r.path, "rename", source[0], r.ts) if follows else (wiki, r.path, "create", None, r.ts))
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        source = self._take()
        yield self._out([] if source is None else [self._deleted(key[0], source)])

    def close(self) -> None:
        pass


#: Where streaming keeps state of values and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pair_renames(changes: DataFrame, within_ms: int = FOLLOWS) -> DataFrame:
    """Streaming: (wiki, path, kind, from_path, ts) with a rename_from and the rename_to that follows in `within_ms` of the same key made one rename.

    A key (see rename_key) has one open source at a time. A target without a source was created; a source that nothing follows was deleted, which a
    timer tells when the watermark passes. What comes later than the watermark is discarded.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = changes.withColumn("_move", rename_key(changes)).groupBy("wiki", "_move")
    return keyed.transformWithStateInPandas(_Pairing(within_ms), PAIRED, "append", "eventTime")


def paired(changes: DataFrame, within_ms: int = FOLLOWS) -> DataFrame:
    """The same of a static table: a source looks to the next source or target of its key, a target to the one before."""
    rows = changes.withColumn("_move", rename_key(changes))
    order = Window.partitionBy("wiki", "_move").orderBy("ts", "seq")
    near = lambda a, b: (F.unix_millis(b) - F.unix_millis(a)) <= within_ms
    moves = rows.filter(F.startswith("kind", F.lit("rename_"))).select(
        "*", *[f(c).over(order).alias(f"_{n}_{c}") for n, f in (("next", F.lead), ("last", F.lag)) for c in ("kind", "path", "ts")]
    )
    goes_on = (F.col("kind") == "rename_from") & (F.col("_next_kind") == "rename_to") & near("ts", "_next_ts")
    follows = (F.col("kind") == "rename_to") & (F.col("_last_kind") == "rename_from") & near("_last_ts", "ts")
    kind = F.when(F.col("kind") == "rename_from", "delete").when(follows, "rename").otherwise("create")
    out = moves.filter(~F.coalesce(goes_on, F.lit(False))).select("wiki", "path", kind.alias("kind"), F.when(follows, F.col("_last_path")).alias("from_path"), "ts")
    others = rows.filter(~F.startswith("kind", F.lit("rename_"))).select("wiki", "path", "kind", F.lit(None).cast("string").alias("from_path"), "ts")
    return others.unionByName(out)


def known_sources(paired: DataFrame, tracked: DataFrame) -> DataFrame:
    """Paired changes, where a rename from a path that tracked(wiki, path) does not hold is a modification of its target: a file that was
    written elsewhere and then moved into place. tracked is a static table, so this works on streams too."""
    known = tracked.select("wiki", F.col("path").alias("from_path"), F.lit(True).alias("_known")).distinct()
    out = paired.join(known, ["wiki", "from_path"], "left")
    saved = (F.col("kind") == "rename") & F.col("_known").isNull()
    return out.select(
        "wiki", "path", F.when(saved, "modify").otherwise(F.col("kind")).alias("kind"), F.when(~saved, F.col("from_path")).alias("from_path"),
        *[c for c in paired.columns if c not in ("wiki", "path", "kind", "from_path")],
    )


def in_order(settled_changes: DataFrame) -> DataFrame:
    """Changes of a batch by wiki, then path components."""
    return settled_changes.orderBy("wiki", F.split("path", "/"))


def apply_batches(stream: DataFrame, reconcile, checkpoint: str, once: bool = True, refresh=None):
    """Starts a query that calls reconcile(wiki) once for every wiki touched in a micro-batch, then refresh(changes in order), if given, for
    views of what changed."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select("wiki").distinct().orderBy("wiki").collect():  # wikis, not documents
            reconcile(row["wiki"])
        if refresh:
            refresh(in_order(batch))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


class _Share(InputPartition):
    def __init__(self, share: int, start: int, end: int):
        self.share, self.start, self.end = share, start, end


class _Watcher(DataSourceStreamReader):
    """Differences between two versions of a folder's snapshot. Each share of the folders is listed, compared and stored by a task; an offset is the number of a version.

    A task that finds its share of a version stored gives the differences stored with it, so a batch that runs again has the same rows.
    """

    def __init__(self, options: dict):
        self.root, self.state, self.wiki = options["path"], options["state"], options.get("wiki", "main")
        self.shares = int(options.get("shares", "16"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        versions = [int(n) for n in os.listdir(self.state) if n.isdigit()] if os.path.isdir(self.state) else []
        return {"version": max(versions, default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[_Share]:
        return [_Share(i, start["version"], end["version"]) for i in range(self.shares)]

    def _file(self, version: int, share: int) -> str:
        return f"{self.state}/{version}/{share}.json"

    def _stored(self, version: int, share: int) -> dict | None:
        try:
            with open(self._file(version, share)) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _list(self, share: int) -> dict[str, list[int]]:
        """Files of the share: folders are dealt out by their first two names."""
        at, found, todo = folders.Folder(self.root), {}, [""]
        while todo:
            folder = todo.pop()
            depth = folder.count("/")
            mine = depth > 2 or zlib.crc32(folder.encode()) % self.shares == share
            if not mine and depth == 2:
                continue
            for name, is_folder, size, ns in at.entries(folder):
                if is_folder and name not in files.VCS:
                    todo.append(f"{folder}{name}/")
                elif not is_folder and mine:
                    found[folder + name] = [size, ns]
        return found

    def read(self, part: _Share) -> Iterator[tuple]:
        done = self._stored(part.end, part.share)
        if done is None:
            was = self._stored(part.start, part.share) if part.start else {"files": {}}
            if was is None:
                raise ValueError(f"the snapshot of version {part.start} in {self.state} has gone; start with a new checkpoint")
            was, now = was["files"], self._list(part.share)
            kinds = {p: "create" if p not in was else "delete" if p not in now else "modify" for p in sorted({*was, *now}) if was.get(p) != now.get(p)}
            done = {"files": now, "changes": list(kinds.items()), "at": time.time()}
            os.makedirs(f"{self.state}/{part.end}", exist_ok=True)
            attempt = f"{self._file(part.end, part.share)}.{uuid.uuid4().hex}"
            with open(attempt, "w") as f:
                json.dump(done, f)
            try:
                os.link(attempt, self._file(part.end, part.share))
            except FileExistsError:  # another attempt was first, and counts
                done = self._stored(part.end, part.share)
            os.unlink(attempt)
        at = datetime.fromtimestamp(done["at"], timezone.utc)
        for i, (path, kind) in enumerate(done["changes"]):
            yield self.wiki, path, kind, None, at, (part.end << 40) + (part.share << 32) + i

    def commit(self, end: dict) -> None:
        """Snapshots before a committed one are not asked for again."""
        for n in os.listdir(self.state):
            if n.isdigit() and int(n) < end["version"]:
                shutil.rmtree(f"{self.state}/{n}", ignore_errors=True)


class FolderChanges(DataSource):
    """Stream source `folder_changes`: options path, state, wiki for the name that rows carry, and shares. Folder and state are seen by all machines at the same place."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Watcher(self.options)


def folder_stream(spark: SparkSession, path: str, wiki: str = "main", state: str | None = None, shares: int = 16) -> DataFrame:
    """Changes of files below a folder. Snapshots are kept in `state`, which a query that is started again has to name; a new folder if there is none."""
    spark.dataSource.register(FolderChanges)
    state = re.sub("^file:/*", "/", state or f"{shared_folder(spark)}/lorespark-watch-{uuid.uuid4().hex}")
    return spark.readStream.format("folder_changes").option("path", path).option("wiki", wiki).option("state", state).option("shares", str(shares)).load()


def from_events(events: DataFrame) -> DataFrame:
    """The events table as changes: a user stands for a path."""
    #: Event types and the changes that they stand for.
    kinds = {"signup": "create", "click": "modify", "view": "modify", "purchase": "rename", "error": "delete"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return events.select(F.lit("main").alias("wiki"), F.col("user_id").cast("string").alias("path"), F.element_at(kind, F.col("event_type")).alias("kind"), F.lit(None).cast("string").alias("from_path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def owned(events: DataFrame, wikis: DataFrame) -> DataFrame:
    """events(path, ...) with wiki and relative, of wikis(name, root): the longest root above a path; others fall away."""
    roots = wikis.select(F.col("name").alias("_name"), F.regexp_replace("root", "/+$", "").alias("_root"))
    by = [c for c in events.columns if c not in ("wiki", "relative")]
    # each folder above a path is looked up, so events meet roots by equality however many there are; a path is looked up once, and every event of it gets what was found
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    paths = events.select("path").filter(F.contains("path", F.lit("/"))).distinct()
    best = paths.withColumn("_root", F.explode(above)).join(roots, "_root").groupBy("path").agg(F.max(F.struct(F.length("_root").alias("n"), F.col("_name").alias("name"))).alias("_own"))
    return events.select(*by).join(best, "path").select(*by, F.col("_own.name").alias("wiki"), F.substring("path", F.col("_own.n") + 2, F.length("path")).alias("relative"))


def not_ignored(events: DataFrame, rules: list[tuple[str, bool]], path: str = "relative") -> DataFrame:
    """events whose path no ignore rule (see sources.files.ignore_rules) and no version control folder covers; the last rule that fits decides."""
    gone = files.is_vcs_internal(F.col(path))
    for pattern, kept in rules:
        gone = F.when(F.col(path).rlike(pattern), not kept).otherwise(gone)
    return events.filter(~gone)
