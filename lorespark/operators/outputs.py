"""Results as text, JSON lines and Graphviz, and pages written or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.errors import NotFound, UsageError
from lorespark.functions import text
from lorespark.operators import graph
from lorespark.sources import files as source

FORMATS = ("text", "json", "paths")


def lines(hits: DataFrame, form: str = "text") -> DataFrame:
    """hits(wiki, relative, title, ...) as (line): JSON objects, `wiki:relative` paths, or title and path."""
    if form not in FORMATS:
        raise UsageError(f"not a format: {form}")
    path = F.concat("wiki", F.lit(":"), "relative")
    line = {"json": F.to_json(F.struct(*hits.columns)), "paths": path, "text": F.concat("title", F.lit("  ("), path, F.lit(")"))}[form]
    return hits.select(line.alias("line"))


def dot(links: DataFrame, kept: DataFrame | None = None, depth: int = 1 << 30) -> DataFrame:
    """(ord, line): a Graphviz digraph, of the links whose ends are in kept(wiki, relative, depth) if that is given."""
    own = links if kept is None else graph.subgraph_edges(links, kept, depth)
    spark = links.sparkSession
    frame = spark.createDataFrame([(0, "digraph wiki {"), (2, "}")], "ord int, line string")
    return frame.unionByName(graph.dot_lines(own).select(F.lit(1).alias("ord"), "line"))


def numbered(docs: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(wiki, relative, number, line): lines of each body from first to last."""
    parts = F.split("body", "\n")
    some = F.slice(parts, first, F.greatest(F.lit(0), (F.lit(last) if last else F.size(parts)) - first + 1))
    return docs.select("wiki", "relative", F.posexplode(some).alias("number", "line")).withColumn("number", F.col("number") + first)


def starting(names: DataFrame, prefix: str) -> DataFrame:
    """names(name) that begin with the prefix."""
    return names.filter(F.startswith("name", F.lit(prefix)))


def new_page(spark: SparkSession, root: str, title: str, policy: str = "kebab") -> str:
    """Writes a page with a header block and a heading under the name that the policy gives; never over another."""
    name = spark.range(1).select(text.naming_path(F.lit(title), policy)).first()[0]
    if not name or ".." in name.split("/") or name.startswith("/"):
        raise UsageError(f"not a page name: {title}")
    fs, path = source.hadoop_path(spark, f"{root}/{name}.md")
    if fs.exists(path):
        raise FileExistsError(f"{name}.md")
    fs.mkdirs(path.getParent())
    stream = fs.create(path, False)
    stream.write(bytearray(f'---\ntitle: "{title}"\ntags: []\n---\n\n# {title}\n'.encode()))
    stream.close()
    return name + ".md"


def delete_page(root: str, relative: str, confirmed: bool = False) -> None:
    """Removes a page of a wiki, local or in any file system that Hadoop reaches."""
    if not confirmed:
        raise UsageError("deleting a page needs confirmation")
    if not source.inside(root, relative):
        raise UsageError(f"outside of the wiki: {relative}")
    fs, path = source.hadoop_path(SparkSession.active(), f"{root}/{relative}")
    if not fs.delete(path, False):
        raise NotFound(f"no page {relative}")
