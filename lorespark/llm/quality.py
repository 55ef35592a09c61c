"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed terms (lower-cased words), of hashed one to three byte shapes (letters and digits folded) and of how
often words and lines repeat; a truncated singular value decomposition of a labelled sample gives the latent space. Every document
is projected, its exact cosine products with all labelled vectors are computed in blocks, and its
nearest labelled neighbours vote with their similarity as weight.

Training uses at most SAMPLE labelled texts (parameter), whole ones, those with the smallest hash of text and label, half of each label where
there are so many. Their features are made on the executors; the driver gets SAMPLE x BUCKETS numbers, and the broadcast model is
SAMPLE x DIMENSIONS floats plus the projection, whatever the corpus holds.

Defined results: a null or empty text has the zero vector and gets the label prior as its score; ties
among neighbours go to the one with the smaller hash; without labels every score is 0.5; labels
join on doc_id, each labelled document once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import sample_of_each, short_batches, table
from lorespark.llm.langid import held_out

SAMPLE, BUCKETS, DIMENSIONS, NEIGHBOURS, BLOCK = 2000, 4096, 48, 25, 256
#: The first buckets count shapes and repeats, the others terms, with this weight in the space.
SHAPES, TERM_WEIGHT = 2048, 0.5
THRESHOLD = 0.3
#: Shape of a text: punctuation, case and repetition tell prose from junk in any language.
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[97:123] = 97
_KEEP[65:91] = 65
_KEEP[48:58] = 48
_KEEP[128:] = 97


def _bucket(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - 11)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Square roots of relative hashed counts over the whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(BUCKETS, np.float32)
    if not len(data):
        return out
    shape = _KEEP[data]
    wide = shape.astype(np.uint32)
    for salt, grams in ((1, wide), (2, wide[:-1] << 8 | wide[1:]), (3, wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])):
        if len(grams):
            out += np.bincount(_bucket(grams, salt), minlength=BUCKETS).astype(np.float32)
    # words: repeated ones count as repeats, whatever they are
    words = text.split()
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    counts = np.fromiter(seen.values(), np.float32, len(seen))
    spread = np.bincount(np.minimum(np.log2(counts / max(1, len(words)) * 1000 + 1), 11).astype(np.int64), counts, 12) if len(counts) else np.zeros(12)
    lines = text.split("\n")
    extra = np.concatenate((spread, [len(words) - len(seen), len(lines) - len(set(lines))]))
    out /= np.float32(len(data))
    at = _bucket(np.arange(len(extra)), 77)
    out[at] += (extra / max(1, len(words))).astype(np.float32)
    terms = np.fromiter((crc32(w.lower().encode()) for w in seen), np.int64, len(seen)) % (BUCKETS - SHAPES)
    out[SHAPES:] = np.bincount(terms, counts, BUCKETS - SHAPES) / max(1, len(words))
    return np.sqrt(out)


def largest(gram: np.ndarray, count: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, `count` at least, and their vectors.

    Those of its restriction to a block Krylov space: all of them, as a decomposition of the whole matrix gives them, without that one's four matrices of
    double precision. Matrices that are not much larger than the space are decomposed whole.
    """
    block = count + 16
    if len(gram) <= 2 * block * steps // 3:
        return np.linalg.eigh(gram.astype(np.float64))
    basis = np.empty((len(gram), block * steps), np.float32)
    new = np.random.default_rng(0).standard_normal((len(gram), block)).astype(np.float32)
    for at in range(0, block * steps, block):
        for _ in range(2):  # once more against what rounding leaves
            new -= basis[:, :at] @ (basis[:, :at].T @ new)
            new = np.linalg.qr(new)[0]
        basis[:, at : at + block] = new
        new = gram @ new
    values, vectors = np.linalg.eigh((basis.T @ (gram @ basis)).astype(np.float64))
    return values[-count:], basis @ vectors[:, -count:].astype(np.float32)


class Model:
    """Projection, labelled vectors and labels; all of bounded size."""

    def __init__(self, rows: np.ndarray, labels: list[int]):
        """rows: features of the labelled texts, which this changes in place."""
        y = np.array(labels, np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        rows = rows if len(y) else np.zeros((1, BUCKETS), np.float32)
        self.mean = rows.mean(0)
        rows -= self.mean
        self.weight = 1 / (np.sqrt(np.einsum("ij,ij->j", rows, rows) / np.float32(len(rows))) + np.float32(0.02))
        self.weight[SHAPES:] *= np.float32(TERM_WEIGHT)
        rows *= self.weight
        values, vectors = largest(rows @ rows.T, DIMENSIONS)
        best = [i for i in np.argsort(values)[::-1][:DIMENSIONS] if values[i] > 1e-6]
        scaled = (vectors[:, best] / np.sqrt(values[best])).astype(np.float32)
        del vectors
        self.axes = rows.T @ scaled if best else np.zeros((BUCKETS, 1), np.float32)
        latent = rows @ self.axes
        self.vectors, self.labels = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9))[: len(y)], y

    def unit(self, rows: np.ndarray) -> np.ndarray:
        latent = ((rows - self.mean) * self.weight) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.unit(np.stack([features(x) for x in texts])) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        equal = near == least
        room = k - (near > least).sum(1, keepdims=True)
        chosen = (near > least) | equal & (np.cumsum(equal, axis=1) <= room)
        weights = np.where(chosen, np.maximum(near, 1e-6), 0) ** 4
        out = ((weights * self.labels).sum(1) + self.prior * 1e-6) / (weights.sum(1) + 1e-6)
        return np.where([bool(x) for x in texts], np.clip(out, 0, 1), self.prior)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: rows of (text, label 0 or 1), of which `sample` are learned from."""
    rows = labelled.filter("label IS NOT NULL AND text IS NOT NULL").select(F.col("label").cast("int"), "text", F.xxhash64("text", "label").alias("h"))
    few = sample_of_each(rows, "label", sample // 2).groupBy("label", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy("h")
    best = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": batch["h"], "label": batch["label"], "vector": [compress(features(x).tobytes(), 1) for x in batch["text"]]})

    found = sorted(best.select("h", "label", "text").mapInPandas(run, "h long, label int, vector binary").collect(), key=lambda r: (r.h, r.label))
    labels, vectors = [r.label for r in found], np.empty((len(found), BUCKETS), np.float32)
    for i in range(len(found)):  # one copy of the sample at a time on the driver
        vectors[i] = np.frombuffer(decompress(found[i].vector), np.float32)
        found[i] = None
    return Model(vectors, labels)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, score, predicted."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            scores = [shared.value.score(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = list(texts)
        parts = [shared.value.score(own[i : i + BLOCK]) for i in range(0, len(own), BLOCK)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(score(F.col(text)) >= threshold)


def labelled_rows(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Texts with labels that may be learned from: of each label about 4 * sample documents, those whose ids have the smallest hashes."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(5, 0)).filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    few = sample_of_each(labels, "label", sample).select("doc_id", "label")
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # about 8 * sample rows at most, as ids are distinct here


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(labelled_rows(spark, sf_dir))
    return classify(table(spark, sf_dir, "documents"), model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
