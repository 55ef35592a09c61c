"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns. Level by level, conversations that still share their node with another one are grouped by
(node, next turn); the smallest conversation of a group names the child. A conversation alone in its node shares nothing further
down: the rest of its nodes come from its turns in one pass. So there are as many levels as the longest shared beginning has turns. Leaves and savings
then roll up from the deepest shared level in one join a level. Levels are tables in the shared folder.

Texts never move: turns are compared by a 256-bit digest of role and text. Positions come from a range sort of all turns, counted in
each task and shifted by what earlier tasks hold, so that no conversation has to fit into a task.

Defined results: turns are ordered by turn (null first), equal turns by the digest of role and text; a null role or text is empty; rows
of a null conv_id belong to no conversation and are left out; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, _folder, materialize, placed, small_side, table, text_or_empty

#: Fixed values of the query: conversations of a hundred take up to five first turns from the hundred's first one.
HUNDRED, HEADS = 100, 6
#: Ids that are joined into one string before the strings of a node meet.
CHUNK = 4096


def turn_key() -> Column:
    role, text = text_or_empty("role"), text_or_empty("text")
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def positions(conversations: DataFrame) -> tuple[DataFrame, Scratch]:
    """(conv_id long, turn, key, chars, pos): every turn's place in its conversation, from 0; and the table they are read from."""
    own = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key().alias("key"), F.char_length(text_or_empty("text")).cast("long").alias("chars")
    )
    found, kept = placed(own, "conv_id", ["turn", "key"])
    return found.withColumnRenamed("_pos", "pos"), kept


def with_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of the rebuilt conversations, and their turns: the first h of the hundred's first conversation, then the own ones after h."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    first = F.col("conv_id") - F.col("conv_id") % HUNDRED
    based = sizes.filter(f"conv_id % {HUNDRED} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", "n", head, first.alias("base")).join(based, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "h", "base", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    # at most five turns of a base, for the (at most 199) conversations that begin with them
    heads = turns.filter(f"conv_id % {HUNDRED} = 0 AND pos < {HEADS - 1}").withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").filter("pos < h").select("conv_id", "pos", "key", "chars")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "chars")
    return convs.select("conv_id", "size"), taken.unionByName(own)


class _Levels(Scratch):
    """Tables by depth below a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{_folder(spark)}/lorespark-{uuid.uuid4().hex}"

    def write(self, name: str, depth: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}/depth={depth}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/depth={depth}")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, depth long").parquet(f"{self.path}/{name}")


NODES = "conv_id long, parent long, n long, chars long"
MEMBERS = "conv_id long, node long, size long"
ROLLED = f"{NODES}, n_children long, n_leaves long, saved long"


def build(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, size) with turns (conv_id, pos, key, chars)."""
    spark = sizes.sparkSession
    levels = _Levels(spark)
    sorted_turns = Scratch(turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"))
    by_depth = sorted_turns.df
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n"), F.lit(0).cast("long").alias("chars"))
    root = levels.write("shared", 0, root.filter("n > 0"))
    name = root.first()  # one row, none of an empty table
    live = levels.write("members", 0, sizes.select("conv_id", F.lit(name and name["conv_id"]).cast("long").alias("node"), "size"))
    depth = 0
    while not live.isEmpty():
        depth += 1
        following = by_depth.filter(F.col("pos") == depth - 1).select("conv_id", "key", "chars")
        step = materialize(live.filter(F.col("size") >= depth).join(following, "conv_id"))
        grouped = step.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.max("chars").alias("chars"))
        grouped = materialize(grouped)
        node = [F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n", "chars"]
        levels.write("alone", depth, grouped.filter("n = 1").select(*node))
        levels.write("shared", depth, grouped.filter("n > 1").select(*node))
        again = step.join(small_side(grouped.filter("n > 1").select("node", "key", "child")), ["node", "key"])
        live = levels.write("members", depth, again.select("conv_id", F.col("child").alias("node"), "size"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    empty = spark.createDataFrame([], ROLLED)
    below, alone = empty, levels.read("alone", NODES) if depth else spark.createDataFrame([], f"{NODES}, depth long")
    for d in range(depth, -1, -1):
        children = below.select("parent", "n_leaves", "saved")
        if d < depth:
            children = children.unionByName(alone.filter(F.col("depth") == d + 1).select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
        children = children.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        own = levels.read("shared", NODES).filter(F.col("depth") == d).drop("depth")
        own = own.join(children.withColumnRenamed("parent", "conv_id"), "conv_id", "left").fillna(0, ["n_children", "n_leaves", "saved"])
        own = own.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("chars"))
        below = levels.write("rolled", d, own.select("conv_id", "parent", "n", "chars", "n_children", "n_leaves", "saved"))
    ends = ends_of(levels.read("members", MEMBERS).filter("size = depth").select("depth", "node", "conv_id"))
    shared = levels.read("rolled", ROLLED).join(ends.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    shared = shared.select("conv_id", "depth", "parent", "n", "n_children", "n_leaves", "saved", F.coalesce("ends", none).alias("ends"))
    tops = alone.select("conv_id", "parent", "depth").join(sizes, "conv_id")
    below_top = by_depth.select("conv_id", (F.col("pos") + 1).alias("at")).join(tops, "conv_id").filter("at >= depth")
    is_end = F.col("at") == F.col("size")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = below_top.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent"), one.alias("n"),
        F.when(is_end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved"),
        F.when(is_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends"),
    )
    nodes = materialize(shared.unionByName(chains))
    sorted_turns.drop()
    levels.drop()
    return nodes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, conv_id) -> (depth, node, first, ids): up to CHUNK ids joined by commas."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out = []
        for (depth, node), own in groupby(rows, lambda r: r[:2]):
            ids = [r[2] for r in own]
            out += [(depth, node, ids[i], ",".join(map(str, ids[i : i + CHUNK]))) for i in range(0, len(ids), CHUNK)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["depth", "node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> (depth, node, ends): one running hash, whatever the number of ids."""
    place, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([state.hexdigest()])], ["depth", "node", "ends"])

    for batch in batches:
        for depth, node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, node) != place:
                if place is not None:
                    yield row()
                place, state = (depth, node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if place is not None:
        yield row()


def ends_of(enders: DataFrame) -> DataFrame:
    """(depth, node, ends): SHA-256 of the ids of (depth, node, conv_id), ascending and joined by commas."""
    order = ["depth", "node", "conv_id"]
    chunks = enders.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, node long, first long, ids string")
    streams = chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return streams.mapInArrow(_hashed, "depth long, node long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are, without borrowed heads; columns as in `build`."""
    turns, kept = positions(conversations)
    nodes = build(turns.groupBy("conv_id").agg(F.count("*").alias("size")), turns.select("conv_id", "pos", "key", "chars"))
    kept.drop()
    return nodes


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, kept = positions(table(spark, sf_dir, "conversations"))
    nodes = build(*with_heads(turns))
    kept.drop()
    return nodes.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
