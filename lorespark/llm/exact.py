"""Exact duplicates by a heavy-hitter split.

Equal texts are texts that are identical after lower-casing A-Z. Rows meet by the 256-bit digest of that form. A Misra-Gries pass
finds the digests that may hold a large share of all rows; what they really hold and who wins there is counted in a second pass, and the
winners (at most 2 / SHARE of them) are broadcast, so the rows of large groups never move. All other rows are shuffled by digest.

Defined results: a null text counts as empty, and empty texts are equal to each other; of equal texts the row with the largest id stays, of
repeated rows of that id one; a null id is smaller than any other; an empty table gives no rows; columns of other names are left
alone by `drop_copies`, and the query returns none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import ascii_lower, materialize, table, text_or_empty

#: A digest with this share of all rows or more is certain to be found by the first pass.
SHARE = 1 / 1000
SUMMARY = "digest binary, estimate long"


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text)), 256))


def summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """The Misra-Gries summary of a column of digests: each count is too low by at most rows / (counters + 1)."""
    kept: dict[bytes, int] = {}
    for batch in batches:
        for x in pc.value_counts(batch.column(0)).to_pylist():
            kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
        if len(kept) > counters:
            less = sorted(kept.values(), reverse=True)[counters]
            kept = {k: n - less for k, n in kept.items() if n > less}
    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "estimate"])


def frequent(digests: DataFrame, rows: int, share: float = SHARE) -> DataFrame:
    """(digest): all that hold at least `share` of the rows, and no more than 2 / share in all."""
    counters = int(2 / share)
    found = digests.mapInArrow(lambda batches: summarise(batches, counters), SUMMARY)
    summed = found.groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    return summed.filter(F.col("estimate") >= max(1.0, rows * share / 2)).select("digest")


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size); `row` numbers rows."""
    return rows.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"), F.count("*").alias("group_size")
    )


def groups(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """rows (id, digest, row, ...) of a checkpoint, with keep_id, keep_row and group_size of their digest."""
    # bounded by 2 / share digests each, whatever the table holds
    heavy = F.broadcast(materialize(frequent(rows.select("digest"), rows.count(), share)))
    winners = F.broadcast(materialize(_winners(rows.join(heavy, "digest").select("digest", "id", "row"))))
    light = rows.join(heavy, "digest", "left_anti")
    return rows.join(winners, "digest").unionByName(light.join(_winners(light), "digest"))


def _numbered(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    return materialize(docs.select(F.col(id).alias("id"), digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row"), *more))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were."""
    own = _numbered(docs, id, text, F.struct("*").alias("own"))
    return groups(own, share).filter("row = keep_row").select("own.*")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(_numbered(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.expr("row = keep_row").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP13_SQL = """
WITH own AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM own WINDOW same AS (PARTITION BY text_sha256)
"""
