"""Benchmark decontamination by winnowing.

Both sides hash every K-gram of words; of each SPAN consecutive hashes the smallest is kept (the last of
equal ones). What a window keeps depends on nothing but its words, so two equal runs of
WINDOW = K + SPAN - 1 words keep the same K-gram at the same place, and every shared run of that length is
found. Kept K-grams of the documents pass a bit table of the benchmark's (of fixed size, false hits only cost
time), carry the few words around them, and join the benchmark's on the hash; comparing words outwards
from the K-gram then gives the whole shared run around it. Items shorter than WINDOW words are one
window each: for every such length that occurs, the documents' runs of that length are hashed instead.

Native: DataFrame functions only. The carried context has a fixed size, hits are summed per document before
they meet, and no document is read twice.

Defined results: words are maximal runs of digits, letters a-z after lower-casing A-Z, and characters
beyond ASCII; null or empty texts have none; items without words never match; items with a null item_id hit words but are not listed; equal documents get
equal rows (a repeated doc_id is judged as the union of its rows' hits, over the longest of its texts);
other columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import ascii_lower, materialize, small_side, table, text_or_empty

K, SPAN = 5, 6
WINDOW = K + SPAN - 1
#: Longs of 32 bits each in the table that documents' hashes are held against before the join.
TABLE_LONGS = 4096
#: Low bits of a K-gram's value that hold its place, so that the smallest value of a window also says where it is.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def upto(n: Column) -> Column:
    """0 ... n - 1; empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def grams(n: int) -> Column:
    """Values of all runs of n words: the high bits of their hash, then the place, later ones smaller."""
    x = F.col("x")
    return F.transform(
        upto(F.size("x") - (n - 1)),
        lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(n)]).bitwiseAND(F.lit(~PLACE)).bitwiseOR((F.lit(PLACE) - i).bitwiseAND(F.lit(PLACE))),
    )


def winnowed(values: Column) -> Column:
    """The values that some window of SPAN of them keeps as its smallest."""
    return F.array_distinct(F.transform(upto(F.size(values) - (SPAN - 1)), lambda i: F.array_min(F.slice(values, i + 1, F.lit(SPAN)))))


def fingerprint(n: int, side: int, value: Column) -> list[Column]:
    """From (w, value): the hash and the words of a run of n, and up to `side` words to the left (from the run away) and right."""
    p = (F.lit(PLACE) - value.bitwiseAND(F.lit(PLACE))).cast("int")
    w = F.col("w")
    return [
        value.bitwiseAND(F.lit(~PLACE)).alias("hash"),
        p.alias("p"),
        F.reverse(F.slice(w, F.greatest(p - side, F.lit(0)) + 1, F.least(p, F.lit(side)))).alias("l"),
        F.slice(w, p + 1, F.lit(n)).alias("m"),
        F.slice(w, p + 1 + n, F.lit(side)).alias("r"),
    ]


def with_words(df: DataFrame, key: str) -> DataFrame:
    """(key, w: words, x: their hashes)."""
    return df.select(F.col(key), words(text_or_empty()).alias("w")).withColumn("x", F.transform("w", lambda v: F.xxhash64(v)))


def item_fingerprints(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(n, hash, m, il, ir, items), equal contexts once, and the lengths of items shorter than WINDOW; n is K or minus such a length."""
    items = with_words(benchmark, "item_id").filter("size(w) > 0")
    short = sorted(r.n for r in items.filter(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect())
    out = None
    for n, side, rows in [(K, SPAN - 1, items.filter(F.size("w") >= WINDOW))] + [(n, 0, items.filter(F.size("w") == n)) for n in short]:
        values = rows.withColumn("values", grams(n))
        kept = values.select("item_id", "w", F.explode(winnowed(F.col("values")) if side else F.col("values")).alias("value"))
        one = kept.select("item_id", *fingerprint(n, side, F.col("value"))).groupBy("hash", "m", F.col("l").alias("il"), F.col("r").alias("ir")).agg(F.collect_set("item_id").alias("items"))
        one = one.select(F.lit(n if side else -n).alias("n"), "hash", "m", "il", "ir", "items")
        out = one if out is None else out.unionByName(one)
    return materialize(out), short


def bit_table(keys: DataFrame) -> Column:
    """A literal array of longs with a bit set for each hash; its size is fixed."""
    place = F.pmod(F.shiftright("hash", PLACE_BITS), F.lit(TABLE_LONGS * 32))
    longs = [0] * TABLE_LONGS
    for row in keys.select((place / 32).cast("int").alias("i"), (place % 32).cast("int").alias("b")).distinct().collect():
        longs[row.i] |= 1 << row.b
    return F.from_json(F.lit(str(longs)), "array<bigint>")


def seen(bits: Column, value: Column) -> Column:
    place = F.pmod(F.shiftright(value, PLACE_BITS), F.lit(TABLE_LONGS * 32))
    return F.call_function("getbit", F.get(bits, (place / 32).cast("int")), (place % 32).cast("int")) == 1


def agreeing(a: str, b: str) -> Column:
    """How many leading words of two arrays agree."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def _places(runs: Column, n: int, fields: str) -> Column:
    return F.transform(runs, lambda v: F.struct(F.lit(-n).alias("n"), *fingerprint(n, 0, v)).cast(fields))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, n_words, hit (set of runs: first word a, the word after the last b), item_ids."""
    keys, short = item_fingerprints(benchmark)
    bits = bit_table(keys)
    own = with_words(docs, "doc_id").withColumn("n_words", F.size("w"))
    for n in {K, *short}:
        own = own.withColumn(f"values{n}", grams(n))
    fields = "struct<n:int,hash:bigint,p:int,l:array<string>,m:array<string>,r:array<string>>"
    found = [F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("p"), *[F.array().cast("array<string>").alias(c) for c in "lmr"]).cast(fields))]
    kept = F.filter(winnowed(F.col(f"values{K}")), lambda v: seen(bits, v))
    found.append(F.transform(kept, lambda v: F.struct(F.lit(K).alias("n"), *fingerprint(K, SPAN - 1, v)).cast(fields)))
    for n in short:
        runs = F.filter(F.col(f"values{n}"), lambda v: seen(bits, v))
        found.append(_places(runs, n, fields))
    rows = own.select("doc_id", "n_words", F.explode(F.concat(*found)).alias("f")).select("doc_id", "n_words", "f.*")
    both = rows.join(small_side(keys), ["n", "hash", "m"], "left")
    left, right = (F.when(F.col("n") > 0, agreeing(*x)).otherwise(0) for x in (("l", "il"), ("r", "ir")))
    both = both.withColumn("before", left).withColumn("after", right)
    ok = F.col("items").isNotNull() & ((F.col("n") < 0) | (F.col("before") + F.col("after") + K >= WINDOW))
    run = F.when(ok, F.struct((F.col("p") - F.col("before")).alias("a"), (F.col("p") + F.abs("n") + F.col("after")).alias("b")))
    return both.select("doc_id", "n_words", run.alias("run"), F.when(ok, F.col("items")).alias("items")).groupBy("doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set("run").alias("hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated."""
    covered = F.aggregate(
        F.array_sort("hit"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
    )["n"]
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return hits(docs, benchmark).select("doc_id", "n_words", covered.cast("long").alias("n_hit"), ids.alias("item_ids")).withColumn("contaminated", F.col("n_hit") > 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


#: Plain definition: the documents' runs of words joined with the items' windows, no fingerprints.
OP2_SQL = r"""
WITH it AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
