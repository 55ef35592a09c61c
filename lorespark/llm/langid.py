"""Language identification by compression.

Per language, a sample of labelled texts, whole ones, is kept as a zstandard raw-content dictionary; a text belongs to the language whose
dictionary makes it smallest. The margin between the two smallest sizes gives the score, and a margin below `narrow` rejects the text
(`sure` false).

Training is bounded by PER_LANG texts a language (a parameter): those of at most LONG bytes come first, then those with the smallest hash,
so the choice does not depend on partitioning. Every language that is labelled is learned.

Defined results: a null or empty text, or one without letters, is `und` with score 0; ties go to the
language that sorts first; with no labelled row everything is `und`; equal texts of a language are learned once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import sample_of_each, short_batches, table

PER_LANG, LONG, LEVEL = 64, 8_000, 3
UNKNOWN = "und"
#: ASCII bytes that are not letters become spaces, so that case, digits and punctuation do not decide.
_LETTERS = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def folded(text: str) -> bytes:
    return text.lower().encode().translate(_LETTERS)


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> dict[str, bytes]:
    """Dictionary bytes by language from rows of (lang, text): per_lang whole texts of each."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    few = sample_of_each(rows.withColumn("kind", F.struct("lang", (F.octet_length("text") > LONG).alias("long"))), "kind", per_lang)
    one = few.groupBy("kind", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("kind.lang").orderBy("kind.long", "h")
    best = one.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in best.select("kind.lang", "n", "text").collect():
        texts.setdefault(row.lang, []).append((row.n, row.text))
    # the end of a dictionary is the nearest to the text, so what comes first by hash goes last
    return {lang: b" ".join(folded(x) for _, x in sorted(own, reverse=True)) for lang, own in texts.items()}


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.letter = regex.compile(r"\p{L}").search
        self.coders = []
        for lang in self.langs:
            own = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        if not text or not self.langs or not self.letter(text):
            return UNKNOWN, 0.0, False
        data = folded(text)
        sizes = sorted((len(c.compress(data)), lang) for c, lang in zip(self.coders, self.langs))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        margin = (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])
        return sizes[0][1], 0.5 + 0.5 * min(1.0, margin / 0.2), margin >= narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = 0.01) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, lang_pred, score (0 to 1), sure."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for batch in batches:
            found = [model.predict(x, narrow) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "sure": [x[2] for x in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, sure boolean")


def held_out(modulus: int, remainder: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit(docs.filter(~held_out(4, 2)))
    return identify(docs, dictionaries).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "sure")
