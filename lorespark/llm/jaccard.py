"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its word n-grams. Every token flips one bit of a parity sketch, so two sketches
differ in at most as many bits as the sets' symmetric difference has tokens, and by the pigeonhole two documents whose
difference is at most d agree in one of d + 1 blocks of the sketch. Per band of sizes:

1. The sketch is cut into d + 1 + g blocks, d being the most that linked documents of the band may differ. g more blocks
   let a document leave out blocks with hardly a token, which say nothing. Linked documents agree in g + 1 blocks, so in
   `need` = g + 1 less those left out of the blocks that a document keeps. A block's key is the XOR of its tokens' hashes.
2. Documents with equal sets are one node. In each key that nodes share, all are compared with one of them, the one with
   the most shared keys: of a family of near copies that is the least edited. What may link by size and by the Hamming
   distance of whole sketches is verified on whole sets; components follow.
3. Keys that still hold different components are looked at again, for a link between components whose ends both differ
   from that one node. Both ends of such a link share `need` of these open keys, so a node with fewer leaves, and
   the others are only looked up in the rarest ones, all but need - 1 (the prefix of an overlap join). The nodes outside a
   key's largest component meet the others, once for all their keys, by size and sketch inside the join; what is left is
   verified. Nodes of one component are never compared, so a group of near copies costs links in proportion to its size
   and yet no link between components is lost.

A key that many nodes of one stretch of rows share is dealt out by node, and large open keys are cut in tiles.

Equal sets have equal 64-bit digests; digests of different sets are taken as different.

Defined results: words are what white space (20, 09-0D) separates after lower-casing A-Z; a text with fewer words than n
is one n-gram; null or empty texts have the empty set, link with nothing and are their own component; repeated rows are
each returned; different texts with one doc_id each look for partners, texts being told apart by doc_id and a 64-bit
digest; rows with a null doc_id link with nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import LOWER, UPPER, Scratch, materialize, short_batches, slices, small_side, table
from lorespark.llm.graphs import components

#: Ratio of the sizes within a band; nodes of a key that meet in one tile; keys by which a pair finds its first meeting.
RATIO, TILE, LISTED = 1.4, 2048, 16
#: Rows that are looked through together, how many of them make a key hot, and into how many groups a hot key is dealt.
SLICE, HOT, SALTS = 512, 32, 64
#: Words whose hashes, and nodes whose keys, a worker remembers.
WORDS, SEEN = 1 << 16, 1 << 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: The lowest byte of a key is its band, which is below SALTED.
BAND, SALTED = np.uint64(255), 128


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Hashes of words, looked up or made."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _M2 + h[i : len(h) - size + 1 + i])
    return np.unique(out)


@functools.lru_cache(4096)
def band_blocks(band: int, num: int, den: int) -> tuple[int, int, int]:
    """Of a band: blocks, how many may be left out, most tokens of a block that may be."""
    high = math.ceil(RATIO ** (band + 1)) - 1
    d = high * (den - num) // num
    light = 1 if 10 * num >= 9 * den else 0
    smallest, g = max(1.0, high / RATIO), 0
    while True:
        rate = smallest / (d + 1 + g)
        expected = (d + 1 + g) * math.exp(-rate) * (1 + rate * light)
        if g >= expected + 3 * math.sqrt(expected) or g > d + 8:
            return d + 1 + g, g, light
        g += 1


def band_of(size: float) -> int:
    """The band of sizes from RATIO ** band to below RATIO ** (band + 1)."""
    band = int(math.log(size) / math.log(RATIO) + 1e-9)
    while RATIO ** (band + 1) <= size:
        band += 1
    while RATIO**band > size:
        band -= 1
    return band


def block_keys(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """The keys under which a set looks for partners, and of each of its bands the keys it shares with any partner,
    as 256 times that number plus the band."""
    smallest = -(-len(tokens) * num // den)
    keys, needs = [], []
    for band in range(band_of(max(1, smallest)), band_of(len(tokens)) + 1):
        blocks, spare, light = band_blocks(band, num, den)
        at = (_mix(tokens + np.uint64(band)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=blocks)
        used = np.flatnonzero(counts)
        parity = np.zeros(blocks, np.uint64)
        parity[used] = np.bitwise_xor.reduceat(tokens[order], np.concatenate(([0], np.cumsum(counts[used])[:-1])))
        kept = np.flatnonzero(counts > light)
        needs.append(max(1, spare + 1 - (blocks - len(kept))) * 256 + band)
        if blocks - len(kept) > spare:
            kept = np.arange(blocks)
        own = _mix(parity[kept] + _mix(kept.astype(np.uint64) + (np.uint64(band) << np.uint64(40))))
        keys.append((own & ~BAND) | np.uint64(band))
    return np.concatenate(keys).view(np.int64), needs


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch in a power of two of bits, at least as many as there are tokens and 64."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    flips = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _node(tokens: np.ndarray) -> int:
    """Digest of a set, as a signed 64-bit number."""
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True)


NONE = np.zeros(0, np.int64)
SKETCHES = "doc_id long, digest long, node long, size long, needs array<long>, fold array<long>, keys array<long>, hot array<long>"


def sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of every row doc_id, digest, node (null for empty sets), size, needs, fold, and its keys.

    A node that a worker has seen lately has no keys again. Keys that HOT of SLICE rows share are listed as hot; the
    first of these rows has them in both lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text", SLICE):
            sets = [shingles(x, n) for x in part.column(2).to_pylist()]
            nodes = [_node(s) if len(s) else None for s in sets]
            keys, needs, folds = [NONE] * len(sets), [[]] * len(sets), [NONE] * len(sets)
            for i, (node, tokens, doc) in enumerate(zip(nodes, sets, part.column(0).to_pylist())):
                if node is None or doc is None:
                    continue
                folds[i] = sketch(tokens)
                own, needs[i] = block_keys(tokens, num, den)
                if node not in seen:
                    keys[i] = own
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
            hot = [NONE] * len(sets)
            every, first, counts = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            crowded = every[counts >= HOT]
            if len(crowded):
                ends = np.cumsum([len(k) for k in keys])
                marks = np.searchsorted(ends, first[counts >= HOT], side="right")
                for i, own in enumerate(keys):
                    where = np.searchsorted(crowded, own).clip(max=len(crowded) - 1)
                    common = crowded[where] == own
                    hot[i], keys[i] = own[common], own[~common | (marks[where] == i)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(needs, pa.list_(pa.int64())), _lists(folds), _lists(keys), _lists(hot),
                ],
                ["doc_id", "digest", "node", "size", "needs", "fold", "keys", "hot"],
            )

    return docs.select("doc_id", "digest", "text").mapInArrow(run, SKETCHES)


def token_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, tokens): sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            sets = [shingles(x, n).view(np.int64) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], ["node", "tokens"])

    return docs.select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, node) of the keys that different nodes share, each once.

    A hot key is another one for each of SALTS groups of its nodes, which its bits 7 to 14 tell. All of a hot key's rows are shared.
    """
    turn = F.shiftleft(F.pmod("node", F.lit(SALTS)) + 1, 8).bitwiseOR(F.lit(SALTED))
    own = rows.filter("node IS NOT NULL")
    hot = own.filter("size(hot) > 0").select("node", F.explode("hot").alias("key")).select("node", F.col("key").bitwiseXOR(turn).alias("key"))
    every = own.select("node", F.explode("keys").alias("key")).unionByName(hot)
    order = Window.partitionBy("key").orderBy("node")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    salted = F.col("key").bitwiseAND(F.lit(SALTED)) != 0
    found = every.select("key", "node", (F.min("node").over(whole) != F.max("node").over(whole)).alias("differ"), F.lag("node").over(order).alias("last"))
    found = found.filter((F.col("differ") | salted) & ~F.col("last").eqNullSafe(F.col("node")))
    found = found.select(F.when(salted, F.col("key").bitwiseXOR(turn)).otherwise(F.col("key")).alias("key"), "node")
    return found.distinct() if not own.filter("size(hot) > 0").isEmpty() else found  # a hot key's first row is in both lists


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """By sizes and sketches alone: false only if the two can't link. The wider sketch is folded to the other's width."""
    wide = f"least(size({x}.fold), size({y}.fold))"
    bits = [f"get({z}.fold, i) ^ if(size({z}.fold) > {wide}, get({z}.fold, i + {wide}), 0L)" for z in (x, y)]
    distance = f"aggregate(sequence(0, {wide} - 1), 0, (sum, i) -> sum + bit_count(({bits[0]}) ^ ({bits[1]})))"
    # intersection i and union u with i * den >= num * u, so (u - i) * (num + den) <= (a + b) * (den - num)
    near = F.expr(f"{distance} * {num + den}L <= ({x}.size + {y}.size) * {den - num}")
    return may_fit(x, y, num, den) & near


def may_fit(x: str, y: str, num: int, den: int) -> Column:
    return F.expr(f"least({x}.size, {y}.size) * {den} >= greatest({x}.size, {y}.size) * {num}")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) of nodes whose whole sets link."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    where = nodes.join(needed, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "digest")
    texts = docs.filter("text IS NOT NULL").join(small_side(materialize(where)), ["doc_id", "digest"])
    sets = materialize(token_sets(texts.select("node", "text"), n).dropDuplicates(["node"]))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(common * den >= union * num).select("a", "b")


def text_digest() -> Column:
    return F.xxhash64("text")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Documents link if den * intersection >= num * union.
    """
    return grouped(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def stars(members: DataFrame) -> DataFrame:
    """(key, first): of each key the node with the most shared keys."""
    weighed = members.join(members.groupBy("node").agg(F.count("*").alias("weight")), "node")
    return weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("first"))


def open_rows(members: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the keys that hold different components, where their nodes may still find partners."""
    labelled = members.filter("node <> first").join(parts.withColumnRenamed("id", "node"), "node", "left")
    labelled = labelled.select("key", "node", F.coalesce("component", "node").alias("component"))
    largest = labelled.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    largest = largest.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("m"), F.count("*").alias("parts"))
    rows = labelled.join(largest.filter("parts > 1").drop("parts"), "key")
    own = rows.groupBy("node", F.expr("key & 255").alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("m", "key", "main"))).alias("open"), F.first("component").alias("component")
    )
    need = F.expr("filter(needs, x -> x & 255 = band)[0] div 256").cast("int")
    own = own.join(nodes.select("node", "needs", F.struct("size", "fold").alias("of")), "node").withColumn("need", need)
    own = own.withColumn("open", F.expr("slice(open, 1, greatest(0, size(open) - need + 1))"))
    own = own.withColumn("listed", F.expr(f"transform(slice(open, 1, {LISTED}), x -> x.key)"))
    return own.select("node", "component", "of", "listed", F.explode("open").alias("at")).select("node", "component", "of", "listed", "at.*")


def open_pairs(found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share an open key and may link."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    side = lambda c: [F.col("node").alias(c), F.col("component").alias(f"part_{c}"), F.col("of").alias(f"of_{c}"), F.col("listed").alias(f"listed_{c}")]
    left = found.filter("component <> main").select("key", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), *side("a"))
    right = found.select("key", F.pmod(F.hash("node"), tiles).alias("tile"), "main", *side("b"))
    apart = F.expr("part_a <> part_b AND (a < b OR part_b = main)")
    met = F.array_min(F.array_intersect("listed_a", "listed_b"))
    once = met.isNull() | (met == F.col("key"))
    pairs = left.join(right, ["key", "tile"]).where(apart & may_fit("of_a", "of_b", num, den) & once & may_link("of_a", "of_b", num, den))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """near_duplicates with the digest of each row's text."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", text_digest().alias("digest"))
    short_batches(docs.sparkSession)
    wide = Scratch(sketches(docs, n, num, den))
    rows = materialize(wide.df.select("doc_id", "digest", "node", "size"))
    shared = materialize(shared_keys(wide.df))
    seen = wide.df.filter("size(fold) > 0").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node")
    attributes = [F.first(c).alias(c) for c in ("size", "needs", "fold")]
    nodes = materialize(seen.agg(F.min("doc_id").alias("rep"), F.min_by("digest", "doc_id").alias("digest"), *attributes))
    wide.drop()
    members = shared.join(materialize(stars(shared)), "key")

    named = lambda c: nodes.select(F.col("node").alias(c), F.struct("size", "fold").alias(f"of_{c}"))
    tries = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    tries = tries.join(named("a"), "a").join(named("b"), "b").filter(may_link("of_a", "of_b", num, den)).select("a", "b")
    links = materialize(verified(materialize(tries), nodes, docs, n, num, den))
    parts = components(links)
    more = materialize(open_pairs(materialize(open_rows(members, parts, nodes)), num, den))
    if not more.isEmpty():
        parts = components(links.unionByName(materialize(verified(more, nodes, docs, n, num, den))))

    # by nodes, so that texts that share no more than their doc_id do not link others
    own = rows.select("doc_id", "digest", "node", F.col("size").alias("n_shingles"))
    own = own.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = own.filter("part IS NOT NULL AND doc_id IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("least"))
    out = own.join(materialize(least), "part", "left")  # of plain shuffles, so that a large group's rows can be split
    return out.select("doc_id", "digest", "n_shingles", F.expr("if(doc_id IS NULL, NULL, coalesce(least, doc_id))").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


#: Plain definition: all pairs of documents that share a shingle, and what is reachable by links.
OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(3, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT id, min(reached) AS least FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""
