"""Suffix-array deduplication of repeated byte strings.

Every byte covered by a SPAN-byte string that also starts earlier (smaller doc_id, or same document and earlier start) goes.

1. Each SPAN-byte string owns an anchor: its K-byte string with the smallest hash, the first of equal ones. Equal strings have equal anchors at
   the same place, so strings need comparing only within an anchor. Consecutive strings with one anchor form a context; equal contexts
   met in one batch are reduced to the first before anything is shuffled, and those that come again to the first of the task.
2. Sorted by anchor and context, every context but the first of its equals holds only repeats. An anchor with one context is done.
3. Contexts of the other anchors (where repeats begin and end) are cut into stretches of at most WIDE strings that share a core of
   SPAN - WIDE + 1 bytes. Stretches are sorted by core as contexts by anchor: equal ones are repeats, a core with one stretch is done.
4. What differs around an equal core is decided by a suffix array, built by linear grouping, of the stretches with the core as one
   letter, cores together up to CHUNK letters at a time: strings with equal bytes begin suffixes with WIDE equal letters and lie next to each other,
   and all but the first in the corpus repeat it. A core with more than MANY stretches, which no task should gather, is decided string by string:
   what stands around the core is grouped over the cluster instead.
5. Runs are joined to their document by its place (doc_id, tie), merged and cut out.

Places: doc_id decides; where one doc_id (or null) comes with different texts, tie, a 64-bit digest of the text, orders them, else tie is 0. Rows with equal
doc_id and text are one place, and a place is not earlier than itself.

Contexts and stretches are told apart by 128 bits of hashes.

Defined results: a null or empty text has no bytes and no removed ones; texts of less than SPAN bytes are kept whole; texts are handled whole (one of 2^28 bytes or more is an error); a null
doc_id comes before all others; of different texts with one doc_id each loses only its own bytes, and one copy of what they share stays; rows with equal
doc_id and text are handled alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import materialize, short_batches, table
from lorespark.llm.suffixes import suffix_array

SPAN, K, WIDE, CHUNK, MANY, BROADCAST = 100, 32, 12, 100_000, 4096, 3_000_000
CORE = SPAN - WIDE + 1
#: BROADCAST: places in documents (a few bytes each) up to which they are broadcast to the documents; beyond it both are shuffled by doc_id.
STEP = SPAN - K  # starts of K-byte strings in a SPAN-byte one, less one
BATCH_BYTES = 1_000_000
#: Contexts that a task remembers; a text has less than 2 to the power of PLACE_BITS bytes.
SEEN, PLACE_BITS = 50_000, 28
NO_ID = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def _k_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte strings, by doubling."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < K:
        h = (h[:-width] * _M1) ^ (h[width:] * _M2)
        h ^= h >> np.uint64(29)
        width *= 2
    h = h * _M1
    return h ^ (h >> np.uint64(32))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def contexts_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts of less than 2^28 bytes in all: text number, start, count of strings, place of the anchor, hashes of anchor and context."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    if len(joined) < SPAN:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = _k_hashes(np.frombuffer(joined, np.uint8))
    packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    owner = (_window_min(packed, STEP + 1) & _LOW).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    ok = text_of[: len(owner)] == text_of[SPAN - 1 : SPAN - 1 + len(owner)]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (text_of[1 : len(owner)] != text_of[: len(owner) - 1])
    number = np.cumsum(fresh)[ok]
    starts = np.flatnonzero(ok)
    _, first, count = np.unique(number, return_index=True, return_counts=True)
    start, place = starts[first], owner[starts[first]]
    digest, rel = xxhash.xxh3_64_intdigest, (place - start) << 8 | count
    context = np.array([digest(joined[a : a + c + SPAN - 1], r) for a, c, r in zip(start.tolist(), count.tolist(), rel.tolist())], np.uint64)
    text = text_of[start]
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return text, start - offsets[text], count, place - start, h[place].view(np.int64), context.view(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Rows of (doc_id, tie, bytes) in parts of about BATCH_BYTES."""
    ids, ties, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end]) <= BATCH_BYTES):
            total += len(texts[end])
            end += 1
        yield ids[start:end], ties[start:end], texts[start:end]
        start = end


def _known(group: np.ndarray, own: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, own and place (doc, tie, start), equal places once, and in it: whether an equal one comes before."""
    order = np.lexsort((start, tie, doc, own, group))
    same = lambda *columns: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    order = order[np.concatenate(([True], ~same(group, own, doc, tie, start)))] if len(order) else order
    known = np.zeros(len(order), bool)
    known[1:] = same(group, own)
    return order, known


def _anywhere(known: np.ndarray, group: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """group, but what is known needs no partner and goes anywhere."""
    return np.where(known, (doc * 31 + tie + start).view(np.uint64) * _M1, group.view(np.uint64)).view(np.int64)


class _Seen:
    """Contexts that came again within a batch, and the first place of each so far: a line that fills the corpus is then sent on once a
    task, not once a batch. Bounded by SEEN."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.context, self.anchor, self.doc, self.tie, self.start = (np.zeros(0, np.int64) for _ in range(5))

    def earlier(self, *columns: np.ndarray) -> np.ndarray:
        """Of rows (anchor, context, doc, tie, start), whether an equal context was seen at an earlier place."""
        anchor, context, doc, tie, start = columns
        if not len(self.context) or not len(context):
            return np.zeros(len(context), bool)
        i = np.searchsorted(self.context, context).clip(max=len(self.context) - 1)
        same = (self.context[i] == context) & (self.anchor[i] == anchor)
        a, b, c = self.doc[i], self.tie[i], self.start[i]
        return same & ((a < doc) | (a == doc) & ((b < tie) | (b == tie) & (c < start)))

    def add(self, *columns: np.ndarray) -> None:
        """Keeps the first place of each context."""
        anchor, context, doc, tie, start = (np.concatenate((x, y)) for x, y in zip((self.anchor, self.context, self.doc, self.tie, self.start), columns))
        order = np.lexsort((start, tie, doc, context))
        first = np.ones(len(order), bool)
        first[1:] = context[order][1:] != context[order][:-1]
        kept = order[first]
        self.anchor, self.context, self.doc, self.tie, self.start = (x[kept] for x in (anchor, context, doc, tie, start))
        if len(kept) > SEEN:
            self.clear()


def contexts(docs: DataFrame) -> DataFrame:
    """(anchor, context, doc_id, tie, at: start, count, place of the anchor and whether an equal one comes earlier in the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for ids, ties, texts in _parts(batch):
                if any(len(x) >= 1 << PLACE_BITS for x in texts):
                    raise ValueError(f"a text of {1 << PLACE_BITS} bytes or more: cut it into documents")
                text, start, count, place, anchor, context = contexts_of(texts)
                doc, tie = (ids[text], ties[text]) if len(text) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                order, known = _known(anchor, context, doc, tie, start)
                anchor, context, doc, tie, start, count, place = (x[order] for x in (anchor, context, doc, tie, start, count, place))
                again = np.zeros(len(known), bool)
                again[:-1] = known[1:] & ~known[:-1]
                known |= seen.earlier(anchor, context, doc, tie, start)
                seen.add(*(x[again] for x in (anchor, context, doc, tie, start)))
                at = start << 16 | place << 8 | count << 1 | known
                yield pa.RecordBatch.from_arrays([pa.array(_anywhere(known, anchor, doc, tie, start)), pa.array(context), pa.array(doc), pa.array(tie), pa.array(at)], ["anchor", "context", "doc_id", "tie", "at"])

    return docs.mapInArrow(run, "anchor long, context long, doc_id long, tie long, at long")


def _stretches(data: bytes, start: int, place: int, count: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Of a context: (core, own hash, start, at: letters before the core and count, bytes around the core)."""
    digest, anchor = xxhash.xxh3_64_intdigest, start + place
    first = start
    while first < start + count:
        klass = (anchor - first) // WIDE  # by the anchor's place in the string; the last of a class has the smallest
        last = min(start + count - 1, anchor - klass * WIDE)
        core = anchor - klass * WIDE
        n, before = last - first + 1, core - first
        left, right = data[first:core], data[core + CORE : last + SPAN]
        around = left + right
        yield digest(data[core : core + CORE], klass), digest(around, before << 8 | n), first, before << 8 | n, around
        first = last + 1


def stretches(docs: DataFrame) -> DataFrame:
    """(core, own, doc_id, tie, start, at, around, known) from docs(doc_id, tie, data, wanted: contexts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                rows = [(doc, tie, *x) for doc, tie, data, wanted in zip(*(c.to_pylist() for c in batch.columns)) for w in wanted for x in _stretches(data, w >> 16, w >> 8 & 255, w >> 1 & 127)]
                doc, tie, core, own, start, at = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)))
                order, known = _known(core, own, doc, tie, start)
                core, own, doc, tie, start, at = (x[order] for x in (core, own, doc, tie, start, at))
                around = pa.array([b"" if gone else rows[i][6] for i, gone in zip(order.tolist(), known.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_anywhere(known, core, doc, tie, start)), pa.array(own.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(start), pa.array(at), around, pa.array(known)], ["core", "own", "doc_id", "tie", "start", "at", "around", "known"])

    return docs.mapInArrow(run, "core long, own long, doc_id long, tie long, start long, at long, around binary, known boolean")


def _decide(rows: list[tuple[int, int, int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(doc_id, tie, start) of the strings in rows (core, doc_id, tie, start, at, around) that have an equal one earlier among them."""
    text: list[int] = []
    owner: dict[int, tuple[int, int, int]] = {}
    letters: dict[int, int] = {}
    for core, doc, tie, start, at, around in rows:
        before = at >> 8
        for i in range(at & 255):
            owner[len(text) + i] = doc, tie, start + i
        text += around[:before]
        text.append(256 + letters.setdefault(core, len(letters)))
        text += around[before:]
    found, last, run = [], None, []
    for p in suffix_array(text):
        if p in owner:
            here = text[p : p + WIDE]
            if here != last:
                if len(run) > 1:
                    found += sorted(run)[1:]
                last, run = here, []
            run.append(owner[p])
    if len(run) > 1:
        found += sorted(run)[1:]
    return found


def by_suffix_array(rows: DataFrame) -> DataFrame:
    """(doc_id, tie, start, count) of repeated strings from rows (core, doc_id, tie, start, at, around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None

        def out() -> pa.RecordBatch:
            found = _decide(held)
            return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.int64()) for i in range(3)), pa.array([1] * len(found), pa.int64())], ["doc_id", "tie", "start", "count"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and total >= CHUNK:
                    yield out()
                    held.clear()
                    total = 0
                held.append(row)
                total += len(row[5]) + 1
                last = row[0]
        if held:
            yield out()

    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(run, "doc_id long, tie long, start long, count long")


def kinds(rows: DataFrame, group: str, own: str, known, *order: str) -> DataFrame:
    """rows, of those equal in own and order (the place) one, with kind: 0 for those that an equal one comes before, 1 for other ones of a group with different ones, 2 if those are more than MANY, else null."""
    by = Window.partitionBy(group)
    out = rows.withColumn("previous", F.lag(F.struct(own, *order)).over(by.orderBy(own, *order))).withColumn("low", F.min(own).over(by)).withColumn("high", F.max(own).over(by)).withColumn("n", F.count("*").over(by))
    again = known | F.coalesce(F.col("previous")[own] == F.col(own), F.lit(False))
    return out.filter(~F.col("previous").eqNullSafe(F.struct(own, *order))).withColumn("kind", F.when(again, 0).when(F.col("low") != F.col("high"), F.when(F.col("n") <= MANY, 1).otherwise(2))).filter("kind IS NOT NULL")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, start, count): runs of starts of repeated SPAN-byte strings of docs(doc_id, tie, data)."""
    rows = kinds(contexts(docs), "anchor", "context", F.col("at").bitwiseAND(1) == 1, "doc_id", "tie", "at")
    rows = materialize(rows.select("kind", "doc_id", "tie", "at"))
    whole = rows.filter("kind = 0").select("doc_id", "tie", F.shiftright("at", 16).alias("start"), F.shiftright("at", 1).bitwiseAND(127).alias("count"))

    open_ = rows.filter("kind > 0")
    wanted = open_.groupBy("doc_id", "tie").agg(F.collect_set("at").alias("wanted"))
    if open_.limit(BROADCAST + 1).count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    parts = kinds(stretches(docs.join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "data", "wanted")), "core", "own", F.col("known"), "doc_id", "tie", "start")
    parts = materialize(parts.select("kind", "core", "doc_id", "tie", "start", "at", "around"))
    count = F.col("at").bitwiseAND(255)
    equal = parts.filter("kind = 0").select("doc_id", "tie", "start", count.alias("count"))
    few = by_suffix_array(parts.filter("kind = 1").select("core", "doc_id", "tie", "start", "at", "around"))

    # each string of a large core by what stands around it
    i, before = F.col("i"), F.shiftright("at", 8).cast("int")
    each = parts.filter("kind = 2").withColumn("i", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    each = each.select("core", "doc_id", "tie", (F.col("start") + i).alias("start"), (before - i).alias("left"), F.substring("around", i + 1, F.lit(WIDE - 1)).alias("around"))
    first = each.groupBy("core", "left", "around").agg(F.min(F.struct("doc_id", "tie", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    many = each.join(first, ["core", "left", "around"]).filter(F.struct("doc_id", "tie", "start") != F.col("first")).select("doc_id", "tie", "start", F.lit(1).cast("long").alias("count"))
    return whole.unionByName(equal).unionByName(few).unionByName(many)


def merged(starts: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Covered byte ranges, apart and ascending."""
    out: list[list[int]] = []
    for a, c in sorted(zip(starts, counts)):
        b = a + c - 1 + SPAN
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def spans_of(runs: DataFrame) -> DataFrame:
    """(doc_id, tie, spans) from runs (doc_id, tie, start, count); a document's runs are as many as its length allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                spans = [[{"a": a, "b": b} for a, b in merged(*x)] for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPANS)], ["doc_id", "tie", "spans"])

    lists = runs.groupBy("doc_id", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    return lists.mapInArrow(run, "doc_id long, tie long, spans array<struct<a:long,b:long>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, spans (removed byte ranges), kept (the remaining bytes)."""
    short_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    digest = F.xxhash64("data")
    shared = own.select("doc_id", digest.alias("x")).groupBy("doc_id").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low <> high")
    own = own.select("doc_id", (F.lit(0).cast("long") if shared.isEmpty() else digest).alias("tie"), "data")
    spans = materialize(spans_of(repeated(own)))
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST:
        spans = F.broadcast(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                gone, kept, sizes = [], [], []
                for data, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    ranges = ranges or []
                    ends = [0, *(r["b"] for r in ranges)]
                    kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(r["a"] for r in ranges), len(data)])))
                    gone.append(ranges)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = own.join(spans, ["doc_id", "tie"], "left").select("doc_id", "data", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Plain definition: every string of 100 bytes (200 hexadecimal digits) by its digest, in order of its place.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, c, length(h) // 2 - 99 - c AS more, substr(h, 2 * c + 1, 1198) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 500)) AS c FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, c, piece, unnest(range(least(500, more))) AS j FROM x),
r AS (SELECT doc_id, c + j AS i FROM w QUALIFY row_number() OVER (PARTITION BY md5(substr(piece, 2 * j + 1, 200)) ORDER BY doc_id, c + j) > 1),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM s),
k AS (SELECT doc_id, any_value(n) AS n, any_value(gone) AS gone, string_agg(part, '' ORDER BY start) AS kept FROM (
    SELECT c.doc_id, start, substr(h, 2 * start + 1, 2 * (a - start)) AS part, 0 AS n, 0 AS gone FROM c JOIN d ON d.doc_id = c.doc_id
    UNION ALL SELECT d.doc_id, e, substr(h, 2 * e + 1), 0, 0 FROM d JOIN (SELECT doc_id, max(b) AS e FROM s GROUP BY doc_id) x ON x.doc_id = d.doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS gone FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
