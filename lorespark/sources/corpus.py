"""Documents as a table: the shape that every operator takes, and how the test tables get it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: wiki, relative, content_type, title, aliases, tags, headings, body, links, size
COLUMNS = ["doc_id", "wiki", "relative", "content_type", "title", "aliases", "tags", "headings", "body", "links", "size"]

CORPUS_SQL = """n AS (SELECT count(*) AS n FROM documents),
corpus AS (SELECT doc_id, lang AS wiki, source || '/page_' || printf('%06d', doc_id) || '.md' AS relative, 'markdown' AS content_type,
  'Document ' || printf('%06d', doc_id) || ' Topic ' || source AS title, ['Doc' || doc_id, 'Page' || doc_id] AS aliases,
  [lang, source, 'b' || (doc_id % 8)] AS tags, CAST([] AS VARCHAR[]) AS headings, coalesce(text, '') AS body,
  list_concat(['page_' || printf('%06d', (doc_id * 7) % n), 'page_' || printf('%06d', (doc_id * 13 + 5) % n)],
    CASE WHEN doc_id % 50 = 0 THEN ['missing_' || doc_id] ELSE [] END) AS links,
  CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents, n)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a linked corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.lit(docs.count())
    page = lambda c: F.concat(F.lit("page_"), F.format_string("%06d", c))
    text = lambda c: c.cast("string")
    i = F.col("doc_id")
    links = F.array(page(i * 7 % n), page((i * 13 + 5) % n))
    return docs.select(
        "doc_id",
        F.col("lang").alias("wiki"),
        F.concat("source", F.lit("/"), page(i), F.lit(".md")).alias("relative"),
        F.lit("markdown").alias("content_type"),
        F.concat(F.lit("Document "), F.format_string("%06d", i), F.lit(" Topic "), F.col("source")).alias("title"),
        F.array(F.concat(F.lit("Doc"), text(i)), F.concat(F.lit("Page"), text(i))).alias("aliases"),
        F.array("lang", "source", F.concat(F.lit("b"), text(i % 8))).alias("tags"),
        F.array().cast("array<string>").alias("headings"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.when(i % 50 == 0, F.array_append(links, F.concat(F.lit("missing_"), text(i)))).otherwise(links).alias("links"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    )


def markdown(docs: DataFrame) -> DataFrame:
    """doc_id and the same documents written out as Markdown with a header block."""
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = F.concat(
        F.lit("---\ntitle: "), quote(F.col("title")), F.lit("\naliases: ["), F.concat_ws(", ", "aliases"), F.lit("]\ntags:\n"),
        F.concat_ws("\n", F.transform("tags", lambda t: F.concat(F.lit("  - "), t))), F.lit("\n---\n# "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n\n"),
        F.concat_ws(" ", F.transform("links", lambda x: F.concat(F.lit("[["), x, F.lit("]]")))), F.lit("\n"),
    )
    return docs.select("doc_id", "wiki", "relative", body.alias("markdown"))


def generated(spark: SparkSession, count: int) -> DataFrame:
    """A synthetic corpus of pages with two tags, an alias pair and one link each, and an index page without links."""
    #: Directories and tags of the generator.
    dirs = ["security", "kernel", "languages/rust", "languages/c", "algorithms", "systems"]
    tags = ["security", "memory", "performance", "linux", "compiler", "network", "database", "concurrency"]
    i = F.col("id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    name = F.format_string("%06d", i)
    pages = spark.range(1, count + 1).select(
        i.alias("doc_id"), F.lit("main").alias("wiki"), F.concat(pick(dirs, i), F.lit("/page_"), i.cast("string"), F.lit(".md")).alias("relative"), F.lit("markdown").alias("content_type"),
        F.concat(F.lit("Document "), name, F.lit(" - Topic "), pick(tags, i)).alias("title"), F.array(F.concat(F.lit("Doc"), i.cast("string")), F.concat(F.lit("Page"), i.cast("string"))).alias("aliases"),
        F.array(pick(tags, i), pick(tags, i + 3)).alias("tags"), F.array(F.concat(F.lit("Document "), name)).alias("headings"),
        F.concat(F.lit("Text about "), pick(tags, i), F.lit(" and "), pick(tags, i + 3)).alias("body"), F.array(F.concat(F.lit("page_"), (i * 7 % count + 1).cast("string"))).alias("links"),
    )
    none = F.array().cast("array<string>")
    index = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit("main").alias("wiki"), F.lit("index.md").alias("relative"), F.lit("markdown").alias("content_type"), F.lit("Index").alias("title"), none.alias("aliases"), none.alias("tags"), none.alias("headings"), F.lit("").alias("body"), none.alias("links"))
    return pages.unionByName(index).withColumn("size", F.octet_length("body").cast("long"))
