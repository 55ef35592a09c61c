"""Incremental index: change detection, tables in segments, reconciliation."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorespark.errors import IndexMissing, LoreError
from lorespark.operators import graph, index

SCHEMA_VERSION = 4
#: Of more than FEW segments, one is merged with the later ones if these have a MERGEth of its documents or more.
MERGE, FEW = 4, 4
#: Tables in the order in which they are made from each other, and how many are written at a time.
STAGES, WRITERS = [["documents", "removed"], ["state", "entries", "pages", "names"], ["sums", "again"], ["edges", "gone"]], 4
#: Tables of a segment that are only read while it is written.
FOR_WRITING = ["removed", "again"]
#: Tables whose rows of all segments are added up.
ADDED_UP = {"sums": index.merge_sums}
#: Tables that are not written but made from another as it is read.
MADE = {"blocks": ("entries", index.blocks)}
#: What a store can keep of its documents beside themselves and their state: the search index, and names and links.
KEPT = ("index", "links")
#: What is kept of each document to see whether it changed.
STATE = ["wiki", "relative", "size", "mtime", "content_hash"]
#: Versions that stay for readers which have one open; seconds after which a writer's lock is taken for left behind.
VERSIONS, LOCK_SECONDS = 2, 3600


def changes(current: DataFrame, previous: DataFrame, always_hash: bool = False) -> DataFrame:
    """(wiki, relative, change, touched) from files of STATE and the previous state of the same columns.

    Equal size and time mean unchanged, without a look at the hash; else equal hashes mean unchanged (touched), others modified; what only one
    side has is added or deleted.
    """
    a, b = current.alias("a"), previous.alias("b")
    both = a.join(b, (F.col("a.wiki") == F.col("b.wiki")) & (F.col("a.relative") == F.col("b.relative")), "full_outer")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime")) & F.lit(not always_hash)
    hashes = F.col("a.content_hash") == F.col("b.content_hash")
    change = F.when(F.col("b.relative").isNull(), "added").when(F.col("a.relative").isNull(), "deleted")
    change = change.when(same | hashes, "unchanged").otherwise("modified")
    touched = F.coalesce(~same & hashes, F.lit(False))
    return both.select(
        F.coalesce("a.wiki", "b.wiki").alias("wiki"), F.coalesce("a.relative", "b.relative").alias("relative"), change.alias("change"), touched.alias("touched")
    )


def suspects(listed: DataFrame, previous: DataFrame) -> DataFrame:
    """Of listed files (wiki, relative, size, mtime, ...) those to be read: new ones, and those whose size or time differ."""
    return listed.join(previous, ["wiki", "relative", "size", "mtime"], "left_anti")


def summary(delta: DataFrame) -> DataFrame:
    """(change, n)"""
    return delta.groupBy("change").agg(F.count("*").alias("n"))


def apply(table: DataFrame, delta: DataFrame, fresh: DataFrame) -> DataFrame:
    """A table keyed by (wiki, relative), without rows of deleted and modified documents, plus the rows of fresh (added and modified ones)."""
    gone = delta.filter(F.col("change").isin("deleted", "modified")).select("wiki", "relative")
    new = fresh.join(delta.filter(F.col("change").isin("added", "modified")).select("wiki", "relative"), ["wiki", "relative"], "left_semi")
    return table.join(gone, ["wiki", "relative"], "left_anti").unionByName(new)


@dataclass
class Store:
    """Tables of documents in segments, in a folder that Spark can write; a small text file names the segments that count, for all tables at once.

    A segment is what one update wrote: the rows of new and changed documents, and in `gone` the keys (wiki, relative) whose rows in earlier segments no longer
    count (of one table, if `only` names it). Of more than FEW segments those that together outweigh a fourth of the one before are merged with it, so
    their number grows with the logarithm of the documents', and each row is written again a few times at most. Readers keep the version they opened: segments of the last VERSIONS stay.
    """

    spark: SparkSession
    root: str
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf()), path

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _text(self, name: str) -> str | None:
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def meta(self) -> dict | None:
        """The current version's metadata, or None."""
        text = self._text("CURRENT")
        return None if text is None else json.loads(text)

    def read(self, name: str) -> DataFrame:
        """A table as of now: rows of all segments without those that have gone, or sums over them."""
        meta = self.meta()
        if meta is None:
            raise IndexMissing(f"no index in {self.root}; build it first")
        return self._rows(name, meta["segments"], meta["schemas"])

    def index(self) -> index.Index:
        """The search index of the same version as the documents."""
        meta = self.meta()
        if meta is None or "entries" not in meta["schemas"]:
            raise IndexMissing(f"no search index in {self.root}; build it first")
        return index.Index(*(self._rows(name, meta["segments"], meta["schemas"]) for name in ("entries", "pages", "blocks", "sums")))

    def _part(self, name: str, segment: dict, schemas: dict) -> DataFrame | None:
        if name not in segment["tables"]:
            return None
        schema = StructType.fromJson(schemas[name])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment['id']}/{name}").select(*schema.names)

    def _rows(self, name: str, segments: list[dict], schemas: dict) -> DataFrame:
        """A table over segments in order."""
        if name in MADE:
            of, made = MADE[name]
            return made(self._rows(of, segments, schemas))
        out = None
        for i, segment in enumerate(segments):
            rows = self._part(name, segment, schemas)
            if rows is None:
                continue
            later = [self._part("gone", s, schemas) for s in segments[i + 1 :] if "gone" in s["tables"]]
            if later and name not in (*ADDED_UP, "gone"):
                gone = reduce(DataFrame.unionByName, later).filter(F.col("only").isNull() | (F.col("only") == name))
                rows = rows.join(gone.select("wiki", "relative"), ["wiki", "relative"], "left_anti")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], StructType.fromJson(schemas[name]))
        return ADDED_UP[name](out) if name in ADDED_UP and len(segments) > 1 else out

    def _write_segment(self, tables: index.Tables, schemas: dict) -> dict:
        version = f"v{time.time_ns()}"
        segment = {"id": version, "tables": [], "documents": 0}

        def write(name: str) -> None:
            df = tables[name]
            df = df if isinstance(df, DataFrame) else df(lambda t: self._part(t, segment, schemas))
            index.write_table(df, f"{self.root}/{version}/{name}", name)
            schemas[name] = df.schema.jsonValue()
            segment["tables"].append(name)

        with ThreadPoolExecutor(WRITERS) as pool:  # tables of a stage do not read each other
            for names in (*STAGES, [n for n in tables if not any(n in names for names in STAGES)]):
                list(pool.map(write, [n for n in names if n in tables]))
        if "documents" in tables:
            segment["documents"] = self._part("documents", segment, schemas).count()
        for name in set(tables) & set(FOR_WRITING):
            fs, path = self._path(f"{version}/{name}")
            fs.delete(path, True)
            segment["tables"].remove(name)
            del schemas[name]
        return segment

    def write(self, tables: index.Tables) -> dict:
        """Writes all tables anew, as one segment, and points to it. Readers see the old version or the new one, never none."""
        schemas: dict = {}
        segment = self._write_segment(tables, schemas)
        return self._publish([segment], schemas, segment["documents"])

    def append(self, tables: index.Tables, count: int) -> dict:
        """Adds a segment of these tables, of which `gone` (wiki, relative, only) takes the rows of earlier segments away; count is the new number of documents."""
        meta = self.meta()
        segments, schemas = list(meta["segments"]), dict(meta["schemas"])
        segments.append(self._write_segment(tables, schemas))
        sizes = [max(1, s["documents"]) for s in segments]
        first = len(segments) - 1
        while first > 0 and len(sizes) > FEW and (sum(sizes[first:]) * MERGE >= sizes[first - 1] or sum(sizes) > 2 * max(1, count)):
            first -= 1
        if first < len(segments) - 1:
            segments = [*segments[:first], self._merged(segments, first, schemas)]
        return self._publish(segments, schemas, count)

    def _merged(self, segments: list[dict], first: int, schemas: dict) -> dict:
        """One segment of those from `first` on. What they took away stays known, unless there is no earlier segment."""
        own = segments[first:]
        names = list(dict.fromkeys(n for s in own for n in s["tables"] if n not in MADE and (n != "gone" or first > 0)))
        rows: index.Tables = {}
        for name in names:
            found = self._rows(name, own, schemas)
            rows[name] = index.in_order(found) if name == "entries" else found.distinct() if name == "gone" else found
        return self._write_segment(rows, schemas)

    def _publish(self, segments: list[dict], schemas: dict, count: int) -> dict:
        """Replaces the pointer by a rename, at once, and drops segments that neither it nor the last VERSIONS - 1 pointers name."""
        version, was = f"v{time.time_ns()}", None
        try:
            was = self.meta()
        except ValueError:  # a broken pointer is replaced
            pass
        before = [[s["id"] for s in was["segments"]], *was["before"]] if was and "before" in was else []
        meta = {
            "schema_version": SCHEMA_VERSION, "built_at": int(time.time()), "document_count": count, "version": version, "segments": segments, "schemas": schemas,
            "before": before[: VERSIONS - 1],
        }
        fs, temporary = self._path(f"CURRENT.{version}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        jvm = self.spark._jvm
        replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        root = fs.makeQualified(self._path("")[1])
        qualified = [fs.makeQualified(self._path(n)[1]) for n in (f"CURRENT.{version}", "CURRENT")]
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self._conf()).rename(*qualified, replace)
        named = {s["id"] for s in segments} | {i for ids in meta["before"] for i in ids}
        for old in (s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()):
            if old[:1] == "v" and old not in named:
                fs.delete(self._path(old)[1], True)
        return meta

    def lock(self) -> bool:
        """Takes the writers' lock; False if another has it. One older than LOCK_SECONDS was left behind and is taken over."""
        fs, path = self._path("LOCK")
        for _ in range(2):
            try:
                out = fs.create(path, False)
                out.write(bytearray(json.dumps({"owner": self.owner, "at": time.time()}).encode()))
                out.close()
                return True
            except Exception as e:
                if "exist" not in str(e).lower():
                    raise
            try:
                left = time.time() - json.loads(self._text("LOCK") or "{}").get("at", 0) > LOCK_SECONDS
            except ValueError:  # being written
                left = False
            if not left:
                return False
            fs.delete(path, False)
        return False

    def unlock(self) -> None:
        """Gives the lock back if it is this writer's."""
        text = self._text("LOCK")
        if text and json.loads(text).get("owner") == self.owner:
            fs, path = self._path("LOCK")
            fs.delete(path, False)


def open_or_create(spark: SparkSession, root: str, empty: Callable[[], dict[str, DataFrame]]) -> Store:
    """The store of a folder; where it can't be opened one is created with empty(). If that fails too, the error names both reasons."""
    store = Store(spark, root)
    try:
        if store.meta() is not None:
            return store
        opening = "no index"
    except Exception as e:
        opening = str(e)
    try:
        store.write(empty())
        return store
    except Exception as e:
        raise LoreError(f"can't open {root} ({opening}) nor create it ({e})") from e


def state(store: Store) -> str:
    """absent, schema_mismatch, unreadable or loaded"""
    try:
        meta = store.meta()
    except Exception:
        return "unreadable"
    if meta is None:
        return "absent"
    return "loaded" if meta.get("schema_version") == SCHEMA_VERSION else "schema_mismatch"


def reconcile(store: Store, listed: DataFrame, read: Callable[[DataFrame], DataFrame], auto_update: bool = True, rebuild: bool = False, kept: tuple[str, ...] = KEPT) -> tuple[str, dict]:
    """Brings the store up to date with the files `listed` (wiki, relative, size, mtime, ...); read(files) gives the documents of the files it
    is given, with size, mtime and content_hash, and is called with all files on a rebuild, else with new and suspect ones alone. Documents, state and
    search index go into one new segment; what is written is in proportion to what has changed. A store that is built anew has the tables of `kept`;
    updates go on with those that it has.

    Returns what was done: rebuilt (with the reason), as_stored, current, updated (with counts), or busy when another writer holds the lock.
    Changes of time alone are stored too, so such a file is hashed once. Files that were listed but could not be read keep their old rows and
    are counted as skipped.
    """
    was = state(store)
    if not auto_update and not rebuild and was in ("loaded", "absent"):
        return "as_stored", {}
    if not store.lock():
        return "busy", {}
    try:
        if was != "loaded" or rebuild:
            rows = read(listed)
            tables: index.Tables = {"documents": _by_key(rows), "state": lambda own: own("documents").select(*STATE)}
            tables |= (index.tables() if "index" in kept else {}) | (_links() if "links" in kept and "links" in rows.columns else {})
            meta = store.write(tables)
            return "rebuilt", {"reason": "asked" if was == "loaded" else was, "documents": meta["document_count"]}
        return _update(store, listed, read)
    finally:
        store.unlock()


def follow(store: Store, docs: DataFrame, kept: tuple[str, ...] = KEPT) -> tuple[str, dict]:
    """Brings the store up to date with a table of documents, which has the columns of STATE."""
    return reconcile(store, docs.select(*STATE[:4]), lambda todo: docs.join(todo, STATE[:4], "left_semi"), kept=kept)


def _by_key(rows: DataFrame) -> DataFrame:
    """Documents sorted by key, so that a few of them are found without reading all."""
    return rows.repartitionByRange("wiki", "relative").sortWithinPartitions("wiki", "relative")


def _differing(listed: DataFrame, previous: DataFrame) -> DataFrame:
    """(wiki, relative, there, known, old_hash): keys that only one side has, or with another size or time; the one join over all keys."""
    a, b = listed.select(*STATE[:4]).alias("a"), previous.alias("b")
    both = a.join(b, (F.col("a.wiki") == F.col("b.wiki")) & (F.col("a.relative") == F.col("b.relative")), "full_outer")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime"))
    return both.filter(~F.coalesce(same, F.lit(False))).select(
        F.coalesce("a.wiki", "b.wiki").alias("wiki"), F.coalesce("a.relative", "b.relative").alias("relative"), F.col("a.relative").isNotNull().alias("there"),
        F.col("b.relative").isNotNull().alias("known"), F.col("b.content_hash").alias("old_hash"),
    )


#: Keys up to which rows are looked up by their values, which Parquet's statistics can use; beyond it by a join.
KEYS = 1000


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose (wiki, relative) is in keys."""
    few = keys.limit(KEYS + 1).collect()
    if len(few) <= KEYS:
        rows = rows.filter(F.col("relative").isin([r.relative for r in few])) if few else rows.limit(0)
    return rows.join(keys, ["wiki", "relative"], "left_semi")


def _links() -> index.Tables:
    """Names of pages and resolved links, of documents that have links."""
    return {"names": lambda read: graph.names(read("documents")), "edges": lambda read: graph.edges(read("documents")).sortWithinPartitions("target")}


def _links_again(store: Store) -> index.Tables:
    """Names and edges of fresh pages, with those links of other pages resolved again whose target a change gave another meaning.

    A page with such a link (`again`) has all its edges written again, the others as they are.
    """
    key = ["wiki", "relative"]

    def again(read: index.Read) -> DataFrame:
        before, after = graph.names(read("removed")), read("names")
        changed = before.select(*key).unionByName(after.select(*key)).distinct()
        return graph.links_to_resolve(store.read("edges"), changed, *graph.changed_names(before, after))

    def edges(read: index.Read) -> DataFrame:
        changed = read("removed").select(*key).unionByName(read("documents").select(*key)).distinct()
        now = store.read("names").join(changed, key, "left_anti").unionByName(read("names"))
        new = graph.resolved_again(graph.page_links(read("documents")).unionByName(read("again")), now)
        rest = store.read("edges").join(read("again").select(*key).distinct(), key, "left_semi").join(read("again"), [*key, "pos", "target"], "left_anti")
        return new.unionByName(rest).sortWithinPartitions("target")

    return {"names": lambda read: graph.names(read("documents")), "again": again, "edges": edges}


def _update(store: Store, listed: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[str, dict]:
    differing = _differing(listed, store.read("state").select(*STATE)).persist()
    held = [differing]
    try:
        if differing.isEmpty():
            return "current", {}
        key = ["wiki", "relative"]
        rows = read(listed.join(differing.filter("there").select(*key), key, "left_semi")).persist()
        now = rows.select(*key, F.col("content_hash").alias("new_hash"))
        kind = F.when(~F.col("there"), "deleted").when(F.col("new_hash").isNull(), "skipped").when(~F.col("known"), "added")
        kind = kind.when(F.col("old_hash") == F.col("new_hash"), "touched").otherwise("modified")
        delta = differing.join(now, key, "left").select(*key, kind.alias("kind")).persist()
        held += [rows, delta]
        counts = {r["kind"]: r["count"] for r in delta.groupBy("kind").count().collect()}
        changed = {k: counts.get(k, 0) for k in ("added", "modified", "deleted")}
        if "skipped" in counts:
            changed["skipped"] = counts["skipped"]
        if set(counts) <= {"skipped"}:
            return "current", {}
        of = lambda *kinds: delta.filter(F.col("kind").isin(*kinds)).select(*key)
        lost = of("modified", "deleted").withColumn("only", F.lit(None).cast("string")).unionByName(of("touched").withColumn("only", F.lit("state")))
        # each table is made from those before it, as written
        tables: index.Tables = {
            "documents": rows.join(of("added", "modified"), key, "left_semi").sortWithinPartitions(*key), "state": rows.select(*STATE),
            "removed": _with_keys(store.read("documents"), of("modified", "deleted")),
        }
        schemas = store.meta()["schemas"]
        if "entries" in schemas:
            tables |= index.tables(removed=True)
        if "edges" in schemas:
            tables |= _links_again(store)
            tables["gone"] = lambda read: lost.unionByName(read("again").select(*key).distinct().withColumn("only", F.lit("edges")))
        else:
            tables["gone"] = lost
        store.append(tables, store.meta()["document_count"] + changed["added"] - changed["deleted"])
        return "updated", changed
    finally:
        for df in held:
            df.unpersist()


def status(store: Store) -> dict:
    """Documents, schema version and build time, or ready=False."""
    meta = store.meta()
    return {"ready": False} if meta is None else {"ready": True, **{k: meta[k] for k in ("document_count", "schema_version", "built_at")}}
