"""Reports over a corpus: tags, statistics, files, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import files, text

KINDS = ["markdown", "text", "code", "image", "binary"]


def tag_counts(docs: DataFrame) -> DataFrame:
    """(tag, pages); variants of case are tags of their own."""
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("pages"))


def tag_pages(docs: DataFrame) -> DataFrame:
    """(tag, wiki, relative): one row per page of each tag."""
    return docs.select(F.explode("tags").alias("tag"), "wiki", "relative")


def with_tag(docs: DataFrame, tag: str) -> DataFrame:
    """(wiki, relative, title) of pages with the tag, whatever its ASCII case."""
    return docs.filter(F.exists("tags", lambda t: text.ascii_lower(t) == text.ascii_lower(F.lit(tag)))).select("wiki", "relative", "title")


def wiki_stats(docs: DataFrame) -> DataFrame:
    """(wiki, files, one count per kind, bytes, pages, tags)"""
    distinct = docs.select("wiki", F.explode("tags").alias("tag")).distinct().groupBy("wiki").agg(F.count("*").alias("tags"))
    counts = docs.groupBy("wiki").agg(
        F.count("*").alias("files"), *[F.count_if(F.col("content_type") == k).alias(k) for k in KINDS], F.sum("size").alias("bytes"), F.count_if(files.is_page(F.col("content_type"))).alias("pages")
    )
    return counts.join(F.broadcast(distinct), "wiki", "left").fillna(0, ["tags"])  # one row per wiki


def list_files(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """(wiki, relative, content_type, size, human); aliases such as md are understood, an unknown kind filters nothing."""
    #: Other names of kinds.
    names = {"md": "markdown", "txt": "text", "img": "image", "tex": "latex", "bin": "binary", "source": "code"}
    kind = names.get((kind or "").lower(), (kind or "").lower())
    out = docs.filter(F.col("content_type") == kind) if kind in (*KINDS, "latex") else docs
    return out.select("wiki", "relative", "content_type", "size", files.human_size(F.col("size")).alias("human"))


def lint_links(docs: DataFrame) -> DataFrame:
    """(wiki, relative, target): links without a page whose path, less its extension, equals or ends in them; ASCII case is ignored."""
    whole = text.ascii_lower(F.regexp_replace("relative", r"(?<=[^/])\.[^./]*$", ""))
    parts = F.split(whole, "[/\\\\]")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))
    known = docs.filter(files.is_page(F.col("content_type"))).select("wiki", F.explode(endings).alias("name")).distinct()
    links = docs.select("wiki", "relative", F.explode("links").alias("target")).withColumn("name", text.ascii_lower(F.col("target")))
    return links.join(known, ["wiki", "name"], "left_anti").select("wiki", "relative", "target")


def lint_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("wiki").agg(F.count("*").alias("issues"))


def overview(docs: DataFrame) -> DataFrame:
    """(wiki, relative, title) of all pages."""
    return docs.filter(files.is_page(F.col("content_type"))).select("wiki", "relative", "title")


def table_widths(cells: DataFrame) -> DataFrame:
    """(column, width) of cells (row, column, text): the widest, at least 4."""
    return cells.groupBy("column").agg(F.greatest(F.lit(4), F.max(text.display_width("text"))).alias("width"))


def bounding_box(positions: DataFrame) -> DataFrame:
    return positions.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
