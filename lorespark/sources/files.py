"""Files of a wiki folder as rows.

Folders are of a local disk, which all machines see at the same place, or of a store that pyarrow opens. They are listed and their files read where tasks
run (`sources/folders.py`).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import files, markup, text
from lorespark.sources import folders
from lorespark.sources.folders import IGNORE_FILES

CONFIG_FILES = [".lorespark.toml", "lorespark.toml"]
MAX_SIZE = 16 * 1024 * 1024


def glob_regex(pattern: str) -> str:
    """An ignore glob as a regular expression over relative paths."""
    anchored = "/" in pattern.rstrip("/")
    folder = pattern.endswith("/")
    pattern = pattern.strip("/")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[:1] == '!' else inner}]"
            i = end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, kept) of ignore lines in order; the last that fits decides."""
    rules = []
    for line in lines:
        line = line.rstrip()
        if line and line[0] != "#":
            kept = line[0] == "!"
            rules.append((glob_regex(line[1:] if kept else line), kept))
    return rules


def hadoop_path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file through the file system's own interface."""
    fs, path = hadoop_path(spark, path)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def scan(
    spark: SparkSession, root: str, wiki: str = "main", ignore: list[str] | None = None, hidden: bool = False, code: bool = True, max_size: int = MAX_SIZE
) -> DataFrame:
    """(wiki, path, relative, size, mtime, content_type, too_large), to be ordered by `relative` where order matters; contents are not read.

    Ignore rules are those of .gitignore and .loreignore in any folder, for what is below it, and `ignore`, which is stronger; of one
    file the last rule that fits decides. Symbolic links are left out.
    """
    root = folders.qualified(spark, root)
    found = folders.listing(spark, root, ignore_rules(ignore or []), hidden)
    out = found.select(F.lit(wiki).alias("wiki"), folders.path_of(root).alias("path"), "relative", "size", "mtime")
    out = out.filter(~files.file_name(F.col("relative")).isin([*CONFIG_FILES, *IGNORE_FILES[:1]]))
    kind = F.coalesce(files.classify_extension(F.col("relative")), F.lit("text"))
    out = out.withColumn("content_type", kind).withColumn("too_large", F.col("size") > max_size)
    return out if code else out.filter("content_type <> 'code'")


def in_order(listed: DataFrame) -> DataFrame:
    """Listed files by wiki, then path components."""
    return listed.orderBy("wiki", F.split("relative", "/"))


def inside(root: str, relative: str) -> bool:
    """Whether a page's path stays in its wiki: no absolute path, no way out by `..`, and on a local disk none by a symbolic link."""
    parts, depth = relative.split("/"), 0
    for part in parts:
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return False
    if relative.startswith("/"):
        return False
    if not re.match("^(file:|/)", root):
        return True
    base = os.path.realpath(re.sub("^file:/*", "/", root))
    return os.path.realpath(os.path.join(base, relative)).startswith(base.rstrip("/") + "/")


def first_links(read: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(wiki, relative, links) of Markdown files with content, from their first bytes: enough for a graph where there is no index."""
    pages = read.filter((F.col("content_type") == "markdown") & F.col("content").isNotNull())
    head = text.lossy_utf8(read_limited(F.col("content"), limit)["data"])
    return pages.select("wiki", "relative", markup.page_links(head).alias("links"))


def read_limited(content, limit: int):
    """The first bytes, and whether there are more."""
    return F.struct(F.substring(content, 1, limit).alias("data"), (F.octet_length(content) > limit).alias("truncated"))


def should_index(listed: DataFrame) -> DataFrame:
    """Of listed files those whose text is read and indexed."""
    return listed.filter(~F.col("too_large") & ~F.col("content_type").isin("binary", "image"))


def with_content(spark: SparkSession, listed: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """listed with `content`, read where the rows are; no other file is. Files that are too large or have gone since have null."""
    return folders.contents(listed, max_size)


def skipped(read: DataFrame) -> DataFrame:
    """(wiki, relative, reason) of listed files without content."""
    out = read.filter("content IS NULL")
    return out.select("wiki", "relative", F.when(F.col("too_large"), "too large").otherwise("gone").alias("reason"))


def documents(listed: DataFrame, compat: bool = False) -> DataFrame:
    """Documents from files with content: header block, Markdown or plain body; the title is the header's, else the first heading, else the
    file's stem.

    Files that are too large have no body and, as their hash, one of size and time, so a change of them is seen; compat=True hashes them as
    empty. Files that have gone are left out.
    """
    listed = listed.filter(F.col("too_large") | F.col("content").isNotNull())
    whole = F.coalesce("content", F.lit(b""))
    stamp = F.concat_ws(":", "size", "mtime").cast("binary")
    digest = files.content_hash(whole if compat else F.when(F.col("too_large"), stamp).otherwise(whole))
    own = listed.withColumn("content_hash", digest).withColumn("content", whole)
    own = own.withColumn("content_type", F.when(files.looks_binary(F.col("content")), "binary").otherwise(F.col("content_type")))
    readable = ~F.col("content_type").isin("binary", "image")
    own = own.withColumn("raw", F.when(readable, text.lossy_utf8(F.col("content"))).otherwise(""))
    is_markdown = F.col("content_type") == "markdown"
    own = own.withColumn("front", F.when(is_markdown, markup.frontmatter(F.col("raw"))))
    after = F.expr("CAST(substring(CAST(raw AS BINARY), front.body_offset + 1) AS STRING)")
    own = own.withColumn("rest", F.when(F.col("front.present"), after).otherwise(F.col("raw")))
    own = own.withColumn("parsed", F.when(is_markdown, markup.markdown(F.col("rest"))))
    none = F.array().cast("array<string>")
    title = F.coalesce(F.col("front.title"), F.when(is_markdown, markup.first_heading(F.col("rest"))), files.stem(F.col("relative")))
    links = F.coalesce(F.when(is_markdown, markup.page_links(F.col("rest"))), none)
    return own.select(
        "wiki", "path", "relative", "size", "mtime", "content_hash", "content_type", text.sanitize_line(title).alias("title"),
        F.coalesce("front.aliases", none).alias("aliases"), F.coalesce("front.tags", none).alias("tags"),
        F.coalesce("parsed.headings", none).alias("headings"), text.sanitize_text(F.coalesce("parsed.body", "rest")).alias("body"),
        links.alias("links"),
        F.coalesce("front.diagnostics", F.array().cast("array<struct<line:int,message:string>>")).alias("diagnostics"),
    )


def write_pages(batches: Iterable[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Rows (at, whole) as files below root; how many."""
    store, base = fs.FileSystem.from_uri(f"file://{root}" if root.startswith("/") else root)
    for batch in batches:
        for at, whole in zip(batch.column("at").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            store.create_dir(f"{base}/{at}".rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{base}/{at}", compression=None) as out:
                out.write(whole.encode())
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["written"])


def build(spark: SparkSession, root: str, wiki: str = "main", **options) -> DataFrame:
    """All documents of a folder."""
    return documents(with_content(spark, scan(spark, root, wiki, **options), options.get("max_size", MAX_SIZE)))


def render(spark: SparkSession, source, markdown: bool = True) -> DataFrame:
    """(ord, kind, level, text, ...) blocks of one file by its path, or of an open text stream such as standard input."""
    whole = source.read() if hasattr(source, "read") else read_bytes(spark, source).decode("utf-8", "replace")
    row = spark.createDataFrame([(whole,)], "text string")
    if not markdown:
        return row.select(F.lit("text").alias("kind"), "text")
    return row.select(F.posexplode(markup.markdown_blocks(F.col("text"))).alias("ord", "block")).select("ord", "block.*")


def raw(docs_with_content: DataFrame, wiki: str, relative: str) -> DataFrame:
    """(content): a file's bytes as they are."""
    return docs_with_content.filter((F.col("wiki") == wiki) & (F.col("relative") == relative)).select("content")
