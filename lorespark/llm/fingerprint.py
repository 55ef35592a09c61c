"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its Unicode normalisation (NFC), full case folding, and single spaces for runs of
white space, trimmed. Its 128-bit fingerprint is two chained xxhash64 values; inside equal fingerprints
the canonical bytes are compared, and texts that differ there get an ordinal of their own.

Native: DataFrame functions only. ASCII texts and texts below U+0300 are normal already; only texts with
characters that normalisation may change take the longer way of decomposing, ordering marks and
composing, with tables made from the Unicode database at planning time.

Defined results: a null text counts as empty; equal texts have equal fingerprints; the likeness of two exact
digests is 1 if they are equal, else 0; a repeated doc_id is ordered by text; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import let, materialize, small_side, table, text_or_empty

#: Buckets of neighbouring doc_ids for each shuffle partition.
BUCKETS_EACH = 3
FIRST_KEY = -(1 << 63)


def one_of(points: set[int]) -> str:
    """A regular expression for one of some characters, which looks at the smallest first: most texts hold none as large."""
    ranges: list[list[int]] = []
    for p in sorted(points):
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    inner = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return rf"[\x{{{ranges[0][0]:X}}}-\x{{10FFFF}}&&[{inner}]]"


@functools.lru_cache(1)
def _unicode() -> tuple[str, list[str | None], list[tuple[str, str]], list[tuple[str, int]]]:
    """The class of characters that normalisation may change, decompositions by code point, compositions in order, and marks' classes."""
    pairs, whole, marks, unsure = [], {}, [], set()
    for point in range(0xA0, 0x2FA1E):
        c = chr(point)
        if rank := unicodedata.combining(c):
            marks.append((c, rank))
            unsure.add(point)
        if 0xAC00 <= point <= 0xD7A3 or not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        whole[point] = unicodedata.normalize("NFD", c)
        if unicodedata.normalize("NFC", c) != c:
            unsure.add(point)
        else:
            a, b = (chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
            pairs.append((len(whole[point]), a + b, c))
            unsure.add(ord(b))
    unsure |= {*range(0x1100, 0x1200)}
    chars = one_of(unsure)
    return chars, whole, [(x, c) for _, x, c in sorted(pairs)], marks


@functools.lru_cache(1)
def _folds() -> dict[str, str]:
    """What full case folding makes of characters from U+0100 that lower-casing leaves as they are."""
    every = (chr(p) for p in range(0x100, 0x1FFFF) if not 0xD800 <= p < 0xE000)
    return {c: c.casefold() for c in every if c == c.lower() != c.casefold()}


def _normal(text: Column) -> Column:
    """Normal form; texts without a character that may change have it."""
    return F.when(text.rlike(_unicode()[0]), normal_form(text)).otherwise(text)


def folded(text: Column) -> Column:
    """Full case folding of a text in normal form, in normal form again."""
    some = one_of({ord(c) for c in _folds()})
    table_of = F.from_json(F.lit(json.dumps(_folds())), "map<string,string>")
    full = lambda t: _rewrite(t, some, lambda m: F.element_at(table_of, m))
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))  # the only one that is frequent
    return let(let(low, lambda t: F.when(t.rlike(some), full(t)).otherwise(t)), _normal)


def _char(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _rewrite(text: Column, pattern: str, change) -> Column:
    """text with every match of the pattern replaced by change(match)."""
    found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
    return let(text, lambda t: F.concat_ws("", F.zip_with(F.split(t, pattern, -1), found(t), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))))


def normal_form(text: Column) -> Column:
    """NFC for texts of which some character may change; marks that do not compose stay in canonical order."""
    chars, whole, pairs, marks = _unicode()
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    table_of = literal({chr(p): d for p, d in whole.items()}, "map<string,string>")
    out = _rewrite(text, f"[{''.join(rf'\x{{{p:X}}}' for p in whole)}]", lambda m: F.element_at(table_of, m))
    rank = literal(dict(marks), "map<string,int>")
    ordered = lambda m: F.concat_ws("", F.transform(F.array_sort(F.transform(F.split(m, ""), lambda c, i: F.struct(F.element_at(rank, c).alias("k"), i.alias("i"), c.alias("c")))), lambda s: s["c"]))
    out = _rewrite(out, f"[{''.join(rf'\x{{{ord(c):X}}}' for c, _ in marks)}]{{2,}}", ordered)
    known = literal([{"a": a, "b": b} for a, b in pairs], "array<struct<a:string,b:string>>")
    out = F.aggregate(known, out, lambda t, p: F.when(F.contains(t, p["a"]), F.replace(t, p["a"], p["b"])).otherwise(t))
    at = lambda m, k: F.ascii(m.substr(k, 1))
    syllable = lambda m: _char(0xAC00 + ((at(m, 1) - 0x1100) * 21 + at(m, 2) - 0x1161) * 28 + F.when(F.length(m) > 2, at(m, 3) - 0x11A7).otherwise(0))
    out = _rewrite(out, r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?", syllable)
    tail = lambda m: F.when((at(m, 1) - 0xAC00) % 28 == 0, _char(at(m, 1) + at(m, 2) - 0x11A7)).otherwise(m)
    return _rewrite(out, r"[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]", tail)


def canonical(text: Column) -> Column:
    normal = let(text, _normal)
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded(normal)), r"[\s\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as hexadecimal digits."""
    word = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(word(1), word(2))


def collisions(docs: DataFrame) -> DataFrame:
    """(fingerprint, canon, ordinal from 2) of canonical texts that share a fingerprint with a smaller one; compares the bytes of all texts
    in fingerprints of more than one row."""
    own = docs.select(canonical(text_or_empty()).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    many = materialize(own.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    bounds = own.join(small_side(many), "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b")
    differ = materialize(bounds.select("fingerprint"))
    if differ.isEmpty():
        return None
    texts = own.join(small_side(differ), "fingerprint").distinct()
    return texts.withColumn("ordinal", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon"))).filter("ordinal > 1")


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text) with n_chars and fingerprint."""
    own = docs.select("doc_id", text_or_empty(text).alias("text")).withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon")))
    apart = collisions(docs)
    if apart is not None:
        own = own.join(apart, ["fingerprint", "canon"], "left").withColumn("fingerprint", F.concat_ws("-", "fingerprint", F.col("ordinal").cast("string"))).drop("ordinal")
    return own.drop("canon").withColumn("n_chars", F.char_length("text").cast("long"))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row with the next larger doc_id (after the last: of the first).

    Rows are dealt to buckets of neighbouring ids whose borders are ids that occur; the first row of a bucket also goes, as
    a guest, to the one before it, so each bucket knows the next of all its rows and nothing goes through one task.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST_KEY))
    n = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(key.alias("k")).agg(F.min("k").alias("first"), F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()
    if cuts.first is None:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns}).limit(0)
    cuts = sorted({cuts["first"], *cuts["cuts"]})
    borders = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    place = F.aggregate(  # how many borders are not above the key
        F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(borders, p + s - 1) <= F.col("_key")), p + s).otherwise(p)
    )
    rows = df.withColumn("_key", key).withColumn("_place", place - 1)
    at = F.col("_place")
    is_border = F.get(borders, at) == F.col("_key")
    guest = F.struct(F.when(at == 0, F.lit(len(cuts) - 1)).otherwise(at - 1).alias("bucket"), F.lit(1).alias("guest"))
    home = F.struct(at.alias("bucket"), F.lit(0).alias("guest"))
    dealt = rows.withColumn("_to", F.explode(F.when(is_border, F.array(home, guest)).otherwise(F.array(home)))).select("*", "_to.*")
    order = Window.partitionBy("bucket").orderBy("guest", "_key", *columns)
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.filter("guest = 0").drop("_key", "_place", "_to", "bucket", "guest")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fingerprints(table(spark, sf_dir, "documents"))
    rows = with_next(docs, ["text", "fingerprint"])
    k = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - k).cast("int")), F.substring("next_text", F.lit(1), k))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    out = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest(canonical(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
