"""Folders listed and files read where tasks run.

A walk goes through folders depth first and hands ignore rules down from each to the ones below, so an ignored folder is never opened. It stops after a
bounded number of entries and returns the folders that it has not opened yet. The driver walks first: a small wiki needs no job. What it leaves open goes to
executors, where every task walks a share of the open folders with the same bound; what these leave open is dealt out again. So no task and no driver
holds more than the bound and one folder's names.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import files
from lorespark.session import checkpointed

#: Rule files, the stronger ones first; the last is the repository's own list.
IGNORE_FILES = [".loreignore", ".gitignore", ".git/info/exclude"]
#: Entries after which a walk leaves the rest to others.
ENTRIES = 10_000
LISTED = "folder boolean, relative string, size long, mtime long, rules string"

#: (folder that it holds below, regular expression, kept) by kind of file, the weaker rules first.
Rules = dict[str, list[tuple[str, str, bool]]]


def _local(root: str) -> str | None:
    """The path, if it is one of a local disk."""
    path = re.sub(r"^file:/*", "/", root)
    return path if path.startswith("/") else None


class Folder:
    """What a walk needs of a file system; symbolic links, which only local disks have here, are left out."""

    def __init__(self, root: str):
        self.path = _local(root)
        if self.path is None:
            self.store, self.path = fs.FileSystem.from_uri(root)
        else:
            self.store = None
        self.path = self.path.rstrip("/")

    def entries(self, relative: str) -> list[tuple[str, bool, int, int]]:
        """(name, is a folder, bytes, nanoseconds) in a folder, by name; nothing if it has gone."""
        at = f"{self.path}/{relative}".rstrip("/") or "/"
        out = []
        try:
            if self.store is None:
                with os.scandir(at) as found:
                    for x in found:
                        s = x.stat(follow_symlinks=False)
                        if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                            out.append((x.name, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns))
            else:
                for x in self.store.get_file_info(fs.FileSelector(at)):
                    out.append((x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime_ns or 0))
        except FileNotFoundError:
            return []
        return sorted(out)

    def read(self, relative: str, most: int | None = None) -> bytes | None:
        """A file's bytes; None if it has gone, is no plain file or has more than `most`."""
        at = f"{self.path}/{relative}"
        try:
            if self.store is None:
                if not stat.S_ISREG(os.lstat(at).st_mode):
                    return None
                with open(at, "rb") as source:
                    data = source.read() if most is None else source.read(most + 1)
            else:
                with self.store.open_input_stream(at) as source:
                    data = source.read() if most is None else source.read(most + 1)
        except OSError:
            return None
        return None if most is not None and len(data) > most else data


def _parsed(data: bytes | None, folder: str) -> list[tuple[str, str, bool]]:
    from lorespark.sources.files import ignore_rules

    return [(folder, rule, kept) for rule, kept in ignore_rules((data or b"").decode("utf-8", "replace").splitlines())]


def _below(rules: Rules, at: Folder, folder: str, names: set[str]) -> Rules:
    """The rules that hold in a folder: those handed down and its own."""
    out = dict(rules)
    for kind in IGNORE_FILES[:2]:
        if kind in names:
            out[kind] = [*out.get(kind, []), *_parsed(at.read(folder + kind), folder)]
    if not folder and ".git" in names:
        out[IGNORE_FILES[2]] = _parsed(at.read(IGNORE_FILES[2]), "")
    return out


def _gone(seen: str, name: str, rules: Rules, own: list[tuple[str, bool]], hidden: bool) -> bool:
    """Whether rules cover a path (a folder's ends in a slash); the last that fits decides, and settings after all files."""
    gone = name.startswith(".") and not hidden
    for kind in reversed(IGNORE_FILES):
        for folder, rule, kept in rules.get(kind, []):
            if seen.startswith(folder) and re.search(rule, seen[len(folder) :]):
                gone = not kept
    for rule, kept in own:
        if re.search(rule, seen):
            gone = not kept
    return gone


def walk(at: Folder, todo: list[tuple[str, Rules]], own: list[tuple[str, bool]], hidden: bool, most: int = ENTRIES) -> Iterator[tuple[bool, str, int, int, Rules | None]]:
    """(is an open folder, relative path, bytes, seconds, its rules) of files below the folders `todo`, and of folders left when `most` entries were seen.

    A folder ends in a slash; the root is the empty one.
    """
    todo, seen = list(todo), 0
    while todo:
        folder, handed = todo.pop()
        if seen >= most:
            yield True, folder, 0, 0, handed
            continue
        found = at.entries(folder)
        seen += len(found) + 1
        rules = _below(handed, at, folder, {name for name, is_folder, _, _ in found if not is_folder or name == ".git"})
        for name, is_folder, size, ns in found:
            path = folder + name
            if name in files.VCS or _gone(path + "/" * is_folder, name, rules, own, hidden):
                continue
            if is_folder:
                todo.append((f"{path}/", rules))
            else:
                yield False, path, size, ns // 10**9, None


def _walked(batches: Iterable[pa.RecordBatch], root: str, own: list[tuple[str, bool]], hidden: bool, most: int) -> Iterator[pa.RecordBatch]:
    at = Folder(root)
    for batch in batches:
        rows = walk(at, [(r["relative"], json.loads(r["rules"])) for r in batch.to_pylist()], own, hidden, most)
        while chunk := [row for _, row in zip(range(ENTRIES), rows)]:
            columns = list(zip(*((f, p, n, t, None if r is None else json.dumps(r)) for f, p, n, t, r in chunk), strict=True))
            kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["folder", "relative", "size", "mtime", "rules"])


def listing(spark: SparkSession, root: str, own: list[tuple[str, bool]], hidden: bool, most: int = ENTRIES) -> DataFrame:
    """(relative, size, mtime) of the files below root that no rule covers."""
    rows = list(walk(Folder(root), [("", {})], own, hidden, most))
    out = spark.createDataFrame([r[1:4] for r in rows if not r[0]], "relative string, size long, mtime long")
    left = [(p, json.dumps(r)) for is_open, p, _, _, r in rows if is_open]
    if not left:
        return out
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = spark.createDataFrame(left, "relative string, rules string")
    while not todo.isEmpty():
        walker = partial(_walked, root=root, own=own, hidden=hidden, most=most)
        found = checkpointed(todo.repartition(tasks, "relative").mapInArrow(walker, LISTED))
        out = out.unionByName(found.filter("NOT folder").select("relative", "size", "mtime"))
        todo = found.filter("folder").select("relative", "rules")
    return out


def _contents(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, large = batch.column("path").to_pylist(), batch.column("too_large").to_pylist()
        for i, path in enumerate(paths):  # one file to a batch: files may be large
            folder, _, name = path.rpartition("/")
            data = None if large[i] else Folder(folder).read(name, most)
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data], pa.binary())], [*batch.schema.names, "content"])


def contents(listed: DataFrame, most: int) -> DataFrame:
    """listed (path, too_large, ...) with `content`: null for files that are too large or have gone."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*listed.schema.fields, StructField("content", BinaryType())])
    return listed.mapInArrow(partial(_contents, most=most), schema)


def qualified(spark: SparkSession, root: str) -> str:
    """A folder with its file system, as all tasks open it; local ones as plain paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return (_local(found) or found).rstrip("/")


def path_of(root: str) -> F.Column:
    return F.concat(F.lit(f"{root}/"), "relative")
