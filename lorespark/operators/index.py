"""The inverted index: one row for each word of a page, with its counts by field and its places in the body.

Three tables are written. `entries` (wiki, term, relative, tf_<field>, dl_<field>, level, at): `at` has the places of the word in the body, in
characters, each as the distance from the one before; `level` is high where the word counts for much, and each stretch of a
file, of some STRETCH bytes of text, is sorted by (wiki, term, level descending), so that a query finds its words by the statistics of the pages of files, and nothing is
shuffled. `sums` has, for each wiki, the number of pages and of words by field. `pages` has what hits show. `sums` add up: those of a page that goes are
counted off, so nothing else is read again when pages change.

`blocks` has, for each (wiki, term, level), how many pages there are and the best counts and lengths among them, from which a bound of their scores follows
whatever the statistics are. They are counted when a query asks for those of its words, from the entries of these words alone.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.functions.arrow import arrow_function

#: Boosts by field for bare words, and BM25's parameters.
BOOSTS = {"title": 5.0, "aliases": 3.0, "headings": 2.0, "body": 1.0}
K1, B = 1.2, 0.75
#: Words of a typical field, for levels alone, and levels for each unit of a score without its rarity.
TYPICAL, LEVELS = {"title": 5, "aliases": 5, "headings": 20, "body": 200}, 128
#: Rows of a page of a Parquet file of entries: what a query skips at least.
PAGE_ROWS = 4096
#: Bytes of a row group of documents: what the passes over their words are dealt out by.
GROUP_BYTES = 8 << 20
#: Bytes of text that are looked through together.
STRETCH = 4 << 20
WORD = regex.compile(r"[\p{L}\p{N}]+")
COUNTS = [f"{kind}_{f}" for kind in ("tf", "dl") for f in BOOSTS]
FOUND = f"wiki string, term string, relative string, {', '.join(f'{c} int' for c in COUNTS)}, level int, at array<int>"


def fields_of(docs: DataFrame) -> DataFrame:
    """(wiki, relative, title, aliases, headings, body) as strings."""
    joined = {"title": "title", "aliases": F.concat_ws(" ", "aliases"), "headings": F.concat_ws(" ", "headings"), "body": "body"}
    return docs.select("wiki", "relative", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias(f) for f, c in joined.items()])


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For every character whether words have it."""
    every = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        every[m.start() : m.end()] = True
    return every


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words of less than TOKEN_BYTES bytes, as `text.tokens` has them, of all texts in order: words, the text that each is of, and its place in it."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)
    inside = _letters()[chars]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    kept = chars[inside]
    data = kept.tobytes().decode("utf-32-le").encode()
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if len(data) > len(kept):  # characters of more than one byte
        ends = np.concatenate(([0], np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000))))[ends]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    short = np.diff(ends) < text.TOKEN_BYTES
    if not short.all():
        words, starts = words.filter(pa.array(short)), starts[short]
    first = np.cumsum([0, *(len(t) + 1 for t in low)])
    of = np.searchsorted(first, starts, side="right") - 1
    at = starts - first[of]
    for i, (t, own) in enumerate(zip(texts, low, strict=True)):
        if len(t) != len(own):  # some character has a longer lower case
            place = np.array([j for j, c in enumerate(t) for _ in range(len(c.lower()))])
            at[of == i] = place[at[of == i]]
    return words, of, at


def words_at(value: str) -> Iterator[tuple[str, int]]:
    """Words of one text with their places."""
    words, _, at = words_of([value])
    return zip(words.to_pylist(), at.tolist(), strict=True)


def _weight(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    """BM25 of one field without its rarity and boost."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, of about STRETCH bytes together: pages may be long."""
    size = reduce(pc.add, [pc.binary_length(c) for c in batch.columns[2:]]).to_numpy().cumsum()
    cuts = [0, *(np.flatnonzero(np.diff(size // STRETCH)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _ranks(values: pa.Array) -> np.ndarray:
    """For each value how many smaller ones there are; equal ones have equal ranks."""
    return pc.rank(values, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(BOOSTS)
    for batch in (own for whole in batches for own in _stretches(whole)):
        wiki, relative, *texts = batch.columns
        rows = batch.num_rows
        words, of, at = words_of([t for c in texts for t in c.to_pylist()])
        if not len(words):
            continue
        coded = words.dictionary_encode()
        field, page = np.divmod(of, rows)
        key = page * len(coded.dictionary) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # places in a body stay in order
        key, field, at = key[order], field[order], at[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        entry = np.cumsum(new) - 1
        page, term = np.divmod(key[new], len(coded.dictionary))
        counts = [np.bincount(entry[field == f], minlength=len(page)) for f in range(n)]
        lengths = [own[page] for own in np.bincount(of, minlength=n * rows).reshape(n, rows)]
        worth = sum(boost * _weight(tf, dl, TYPICAL[f]) / (K1 + 1) for (f, boost), tf, dl in zip(BOOSTS.items(), counts, lengths, strict=True))
        level = np.floor(worth * LEVELS).astype(np.int64)
        at, entry = at[field == n - 1], entry[field == n - 1]
        steps = np.where(np.diff(entry, prepend=-1) > 0, at, np.diff(at, prepend=0))
        ends = np.concatenate(([0], np.cumsum(counts[n - 1])))
        found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(steps.astype(np.int32)))
        # sorted as files have them
        rank = (_ranks(wiki)[page] * len(coded.dictionary) + _ranks(coded.dictionary)[term]) * (level.max() + 1) + level.max() - level
        order = np.argsort(rank, kind="stable")
        page, term = pa.array(page[order]), pa.array(term[order])
        columns = [wiki.take(page), coded.dictionary.take(term), relative.take(page)]
        columns += [pa.array(c[order].astype(np.int32)) for c in (*counts, *lengths, level)]
        yield pa.RecordBatch.from_arrays([*columns, found.take(pa.array(order))], ["wiki", "term", "relative", *COUNTS, "level", "at"])


def entries(docs: DataFrame) -> DataFrame:
    """All entries of documents, in one pass over their texts and without a shuffle; those of each stretch of documents are sorted as in files."""
    return fields_of(docs).mapInArrow(_entries, FOUND)


@arrow_function("array<long>")
def running(steps: pd.Series) -> pd.Series:
    """Sums of each list up to each of its values, so places from the steps between them."""
    if steps.empty:
        return steps
    ends = steps.map(len).to_numpy().cumsum()
    whole = np.concatenate([np.zeros(0, np.int64), *steps]).cumsum()
    cuts = ends[:-1]
    before = np.where(cuts > 0, whole[cuts - 1], 0) if len(whole) else np.zeros(len(cuts), np.int64)
    return pd.Series([own - last for own, last in zip(np.split(whole, cuts), [0, *before], strict=True)], dtype=object)


def places(found: DataFrame) -> DataFrame:
    """(wiki, relative, term, start): every place of a word in a body, from 0."""
    return found.select("wiki", "relative", "term", F.explode(running("at")).alias("start"))


def in_order(found: DataFrame) -> DataFrame:
    """Entries sorted as in their files, within partitions."""
    return found.sortWithinPartitions("wiki", "term", F.desc("level"), "relative")


def pages(docs: DataFrame) -> DataFrame:
    return docs.select("wiki", "relative", "title", "tags", "content_type")


def blocks(found: DataFrame, off: DataFrame | None = None) -> DataFrame:
    """(wiki, term, level, n, df_<field>, tf_<field> at most, dl_<field> at least where the word occurs); entries of `off` are counted off."""
    rows = found.withColumn("_n", F.lit(1))
    rows = rows if off is None else rows.unionByName(off.withColumn("_n", F.lit(-1)))
    has = {f: F.col(f"tf_{f}") > 0 for f in BOOSTS}
    return rows.groupBy("wiki", "term", "level").agg(
        F.sum("_n").alias("n"), *[F.sum(F.when(has[f], F.col("_n")).otherwise(0)).alias(f"df_{f}") for f in BOOSTS], *[F.max(f"tf_{f}").alias(f"tf_{f}") for f in BOOSTS],
        *[F.min(F.when(has[f], F.col(f"dl_{f}"))).alias(f"dl_{f}") for f in BOOSTS],
    )


def sums(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(wiki, n, len_<field>): pages and words; words of a field are those that its entries count."""
    own = docs.groupBy("wiki").agg(F.count("*").alias("n"), *[F.lit(0).cast("long").alias(f"len_{f}") for f in BOOSTS])
    words = found.groupBy("wiki").agg(F.lit(0).cast("long").alias("n"), *[F.sum(f"tf_{f}").alias(f"len_{f}") for f in BOOSTS])
    return merge_sums(own.unionByName(words))


def merge_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("wiki").agg(*[F.sum(c).alias(c) for c in ("n", *[f"len_{f}" for f in BOOSTS])])


def _off(rows: DataFrame, counts: list[str]) -> DataFrame:
    return rows.withColumns({c: -F.col(c) for c in counts})


#: A table, or what makes it from the tables of the same segment that were written before it.
Read = Callable[[str], DataFrame]
Tables = dict[str, DataFrame | Callable[[Read], DataFrame]]


def tables(docs: DataFrame | None = None, removed: bool = False) -> Tables:
    """The index of docs, or of the table `documents` of the same segment, in the order of writing; with `removed` the documents of that table are counted off."""
    own = lambda read: read("documents") if docs is None else docs
    length = [f"len_{f}" for f in BOOSTS]

    def own_entries(read: Read) -> DataFrame:
        # documents that were not written yet may lie in one file
        return entries(own(read) if docs is None else docs.repartition("wiki", "relative"))

    def own_sums(read: Read) -> DataFrame:
        now = sums(read("pages"), read("entries"))
        return merge_sums(now.unionByName(_off(sums(read("removed"), entries(read("removed"))), ["n", *length]))) if removed else now

    return {"entries": own_entries, "pages": lambda read: pages(own(read)), "sums": own_sums}


@dataclass(frozen=True)
class Index:
    """The tables of an index, as read, and its blocks."""

    entries: DataFrame
    pages: DataFrame
    blocks: DataFrame
    sums: DataFrame


def write_table(df: DataFrame, path: str, name: str) -> None:
    """A table of an index or a segment."""
    options = {"entries": {"parquet.page.row.count.limit": PAGE_ROWS}, "documents": {"parquet.block.size": GROUP_BYTES}}
    df.write.options(**options.get(name, {})).parquet(path)


def write_index(docs: DataFrame, path: str) -> None:
    """The tables of an index below path."""
    spark = docs.sparkSession
    for name, df in tables(docs).items():
        write_table(df if isinstance(df, DataFrame) else df(lambda t: _table(spark, path, t)), f"{path}/{name}", name)


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    found = spark.read
    return (found.schema(FOUND) if name == "entries" else found).parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> Index:
    found = {name: _table(spark, path, name) for name in ("entries", "pages", "sums")}
    return Index(found["entries"], found["pages"], blocks(found["entries"]), found["sums"])
