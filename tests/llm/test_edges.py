"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import bpe, decontaminate, fingerprint, jaccard, langid, licenses, pii, quality, repeats, urls
from tests.compare import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, h long, tokens string, node string, bits string, n int, part string, canon string, bucket int, _key string, _found string, component string, data string"
LONG = "word " * 60_000
ROWS = [(1, None), (2, ""), (3, LONG), (4, "same text of some words here"), (4, "same text of some words here"), (None, "a row without an id"), (7, "same text of some words here"), (8, " \n\t "), (9, "é́ ¡ 123")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None, *["x" if k == "string" else None for k in ["string", "string", "long", "string", "string", "string", "int", "string", "string", "int", "string", "string", "string", "string"]]) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "some words here", "x"), (3, "some words here", "x"), (None, "without an id", "x"), (5, "word " * 30, "x")], "item_id long, text string, w string")


def operators(spark, docs, benchmark):
    model = quality.Model(np.stack([quality.features(x) for x in ("good text of words", "bad!! | bad!! |")]), [1, 0])
    return {
        "licenses": lambda d: licenses.scan(d.select("doc_id", "text")),
        "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark),
        "repeats": repeats.remove_repeats,
        "pii": lambda d: pii.pseudonymise(d, "k"),
        "bpe": bpe.encode,
        "fingerprint": fingerprint.with_fingerprints,
        "next": lambda d: fingerprint.with_next(fingerprint.with_fingerprints(d), ["text"]),
        "jaccard": jaccard.near_duplicates,
        "langid": lambda d: langid.identify(d, {"en": b"the words", "de": b"und die"}),
        "quality": lambda d: quality.classify(d, model),
        "keep": lambda d: quality.keep(d, model),
        "urls": lambda d: urls.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), "key"), urls.RULES),
    }


NAMES = ["licenses", "decontaminate", "repeats", "pii", "bpe", "fingerprint", "next", "jaccard", "langid", "quality", "keep", "urls"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, benchmark, name):
    got = operators(spark, docs, benchmark)[name](docs).collect()
    if name == "decontaminate":
        by = {r.doc_id: r for r in got}
        assert len(got) == 8 and by[3].contaminated and by[4].item_ids == ["3"] and by[1].n_words == 0 and by[None].contaminated and by[None].item_ids == [] and not by[2].contaminated
    elif name != "keep":
        assert len(got) == len(ROWS)
    if name == "jaccard":
        assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (7, 4), (8, 8), (9, 9)]
    if name == "bpe":
        assert {r.doc_id: bytes(r.decoded) for r in got}[3] == LONG.encode()
    if name == "repeats":
        by = {r.doc_id: r for r in got}
        assert by[1].n_bytes == 0 and len(by[3].kept) < 200 and by[4].spans == []
    if name == "licenses":
        assert all(r.sentence_ids == [] and r.licenses == [] for r in got)
    if name == "pii":
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(ROWS, key=repr) and all(r.n_found == r.n_replaced == 0 for r in got)
    if name == "fingerprint":
        by = {r.doc_id: r for r in got}
        assert by[1].fingerprint == by[2].fingerprint == by[8].fingerprint and by[4].fingerprint == by[7].fingerprint and by[1].n_chars == 0
        assert len({r.fingerprint for r in got}) == 5 and by[3].n_chars == len(LONG)
    if name == "next":  # in ascending order of ids, null first, the last before the first
        assert sorted(((r.doc_id, r.next_text) for r in got), key=repr) == sorted(
            [(None, ""), (1, ""), (2, LONG), (3, ROWS[3][1]), (4, ROWS[3][1]), (4, ROWS[3][1]), (7, " \n\t "), (8, ROWS[8][1]), (9, ROWS[5][1])], key=repr
        )
    if name in ("quality", "keep"):
        scores = {r.doc_id: r.score for r in operators(spark, docs, benchmark)["quality"](docs).collect()}
        assert scores[1] == scores[2] == 0.5 and scores[4] == scores[7] and all(0 <= x <= 1 for x in scores.values())
        if name == "keep":
            assert {r.doc_id for r in got} == {i for i, x in scores.items() if x >= quality.THRESHOLD} and got[0].asDict().keys() == set(docs.columns)
    if name == "urls":
        assert all((r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow") for r in got)
    if name == "langid":
        assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 8)} == {1: "und", 2: "und", 8: "und"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, benchmark, name):
    assert operators(spark, docs, benchmark)[name](docs.limit(0)).count() == 0


def test_empty_benchmark_and_labels(spark, docs, benchmark):
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    none = spark.createDataFrame([], "text string, label int")
    assert [r.score for r in quality.classify(docs, quality.fit(none)).collect()] == [0.5] * len(ROWS)
    assert langid.fit(spark.createDataFrame([], "lang string, text string")) == {}


def test_extra_columns_stay(docs):
    assert set(docs.columns) <= set(pii.pseudonymise(docs, "k").columns)


def test_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() <= len(ROWS)
        if stage is not corpus_pipeline.encode:
            assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_judge_every_row(spark):
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    rows = lambda texts: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda stage, texts: sorted(((r.doc_id, r.text) for r in stage(spark, rows(texts), DATA).collect()), key=repr)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    texts = [(None, f"clean {passage} clean"), (None, a), (7, f"clean {passage}"), (7, a), (8, a), (8, a)]
    assert kept(corpus_pipeline.drop_contaminated, texts) == sorted([(None, a), (7, a), (8, a), (8, a)], key=repr)
    texts = [(1, a), (2, a), (2, b), (3, b + " end"), (4, c), (4, c), (5, c), (9, a + " end"), (9, d), (10, d + " end"), (None, a), (None, a)]
    assert kept(corpus_pipeline.drop_near_duplicates, texts) == sorted([(1, a), (2, b), (4, c), (9, d), (None, a), (None, a)], key=repr)
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(rows(texts)).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (5, 4), (9, 1), (9, 9), (10, 9), (None, None)}


def test_pipeline_equals_its_definition(spark):
    from tests.llm.test_operators import plain_components

    source = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, source, DATA).collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {i for i, _ in kept}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) >= 0.9 * len(labels)
    place = {i: k for k, (i, _) in enumerate(kept)}
    groups = plain_components([t for _, t in kept], 5, 80, 100)
    stay = [d for d in kept if groups[place[d[0]]][1] == place[d[0]]]
    hit = {r.doc_id for r in decontaminate.op2_decontaminate(spark, DATA).filter("contaminated").collect()}
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    clean = spark.createDataFrame([(i, t) for i, t in stay if i not in hit], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.pseudonymise(clean, pii.session_key(spark)).collect()}
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: (len(x := plain.encode_ordinary(t)), x, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
