"""The corpus pipeline: documents of low quality go, one document of each group of near duplicates stays, documents
that hold benchmark passages go, personal data become pseudonyms, and the rest is encoded.

Every stage takes the columns of `documents` and all rows its predecessor kept; all but the last return those columns.
Defined results: rows with a null doc_id have no duplicates and are judged by their text as all others; repeated rows (equal
doc_id) count as one document in the near-duplicate stage, of which one row stays (of different texts that are no copies of other documents, the longest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe, decontaminate, jaccard, pii, quality
from lorespark.llm.common import materialize, small_side, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, SIMILAR = 5, (80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; learns from the labelled documents of the corpus."""
    model = quality.fit(quality.labelled_rows(spark, sf_dir))
    return quality.keep(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays."""
    docs = docs.select(*COLUMNS)
    groups = materialize(jaccard.grouped(docs, WORDS, *SIMILAR).select("doc_id", "digest", F.expr("doc_id <> component_id").alias("gone")))
    gone = groups.filter("gone").select("doc_id", "digest").distinct()
    kept = docs.withColumn("digest", jaccard.text_digest()).join(small_side(gone), ["doc_id", "digest"], "left_anti").select(*COLUMNS)
    again = materialize(groups.filter("NOT gone").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    own = F.struct(F.char_length("text").alias("size"), *COLUMNS)
    one = kept.join(small_side(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(own).alias("own")).select(*[F.col(f"own.{c}").alias(c) for c in COLUMNS])
    return kept.join(small_side(again), "doc_id", "left_anti").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    docs = docs.select(*COLUMNS)
    # a text is judged alike in every row, so it stands for its rows, whatever their doc_id
    digest = F.xxhash64("text")
    hit = decontaminate.decontaminate(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("digest"))
    return docs.withColumn("digest", digest).join(small_side(materialize(hit)), "digest", "left_anti").select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format."""
    done = pii.pseudonymise(docs.select(*COLUMNS), pii.session_key(spark))
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    done = bpe.encode(docs)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("tokens", encode),
]
#: The classifier, the sketches and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is a checkpoint in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
