"""The search index: kept by segments, read by levels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorespark.errors import IndexMissing
from lorespark.operators import delta, graph, index, search

DOCS = "wiki string, relative string, path string, size long, mtime long, content_hash string, content_type string, title string, aliases array<string>, tags array<string>, headings array<string>, body string"
TABLES = {"entries": ["wiki", "term", "relative", *index.COUNTS, "level", "at"], "pages": ["wiki", "relative", "title"], "sums": ["wiki", "n", *[f"len_{f}" for f in index.BOOSTS]]}


def page(wiki, name, body, title="", stamp=1):
    return (wiki, name, name, len(body), stamp, str(hash((body, title))), "markdown", title, [], ["t"], [], body)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_index_follows_random_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "FEW", 2)
    rng, words = random.Random(5), "anvil bellows clay dye ember flux glaze hearth".split()
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(12)))
    held = {("ab"[i % 2], f"p{i}.md"): (text(), rng.choice(words), 1) for i in range(40)}
    store = delta.Store(spark, str(tmp_path))
    with pytest.raises(IndexMissing):
        store.index()
    docs = lambda: spark.createDataFrame([page(*k, *v) for k, v in held.items()], DOCS)
    assert delta.follow(store, docs()) == ("rebuilt", {"reason": "absent", "documents": 40})
    kept = []
    for turn in range(2, 6):
        keys = sorted(held)
        gone, changed = rng.sample(keys, 2), rng.sample(keys, 3)
        for k in changed:
            held[k] = (text() + " anew", rng.choice(words), turn)
        touched = next(k for k in keys if k not in gone + changed)
        held[touched] = (*held[touched][:2], turn)
        for k in gone:
            del held[k]
        held["a", f"new{turn}.md"] = (text(), "new", turn)
        done, counts = delta.follow(store, docs())
        lost = set(changed) - set(gone)
        assert done == "updated" and counts == {"added": 1, "modified": len(lost), "deleted": 2}
        kept.append(len(store.meta()["segments"]))
        assert delta.follow(store, docs()) == ("current", {}) and store.meta()["document_count"] == len(held)
    assert max(kept) == delta.FEW and any(b < a for a, b in zip(kept, kept[1:], strict=False))  # some were merged
    found = {n: store.read(n) for n in TABLES}
    entries = index.entries(docs()).cache()
    assert rows(found["entries"], TABLES["entries"]) == rows(entries, TABLES["entries"])
    assert rows(found["pages"], TABLES["pages"]) == rows(index.pages(docs()), TABLES["pages"])
    assert rows(found["sums"], TABLES["sums"]) == rows(index.sums(docs(), entries), TABLES["sums"])
    counts = ["wiki", "term", "level", "n", *[f"df_{f}" for f in index.BOOSTS]]
    assert rows(store.read("blocks").filter("n <> 0"), counts) == rows(index.blocks(entries), counts)
    for q in ("glaze", "anew -dye", "title:new", "nothing"):
        assert rows(search.search(store.index(), q), ["wiki", "rank", "relative", "score"]) == rows(search.search(docs(), q), ["wiki", "rank", "relative", "score"])
    assert rows(store.read("state"), delta.STATE) == rows(docs(), delta.STATE)


def test_links_follow_random_changes(spark, tmp_path):
    """Edges equal a full resolution after adds, deletes, renames and new titles; only links whose meaning may have changed are resolved again."""
    rng = random.Random(9)
    names = [f"n{i}" for i in range(12)]
    some = lambda: (rng.choice(names), [rng.choice([*names, "sub/n3", "nowhere"]) for _ in range(3)])
    held = {(rng.choice("ab"), f"{rng.choice(['', 'sub/'])}{n}.md"): (*some(), 1) for n in names for _ in range(2)}
    held["a", "quiet.md"] = ("Quiet", ["quiet", "nowhere"], 1)
    store = delta.Store(spark, str(tmp_path))

    def docs():
        return spark.createDataFrame([(*page(w, r, "", t, s)[:5], f"{t}{links}", *page(w, r, "", t, s)[6:], links) for (w, r), (t, links, s) in held.items()], f"{DOCS}, links array<string>")

    columns = ["wiki", "relative", "kind", "pos", "target", "to_wiki", "to_relative", "broken"]
    delta.follow(store, docs())
    for turn in range(2, 5):
        keys = sorted(k for k in held if k != ("a", "quiet.md"))
        gone, renamed, changed = rng.sample(keys, 3)
        del held[gone]
        held[renamed[0], f"sub/{rng.choice(names)}.md"] = (*held.pop(renamed)[:2], turn)
        if changed in held:
            held[changed] = (*some(), turn)
        delta.follow(store, docs())
        assert rows(store.read("edges"), columns) == rows(graph.edges(docs()), columns)
        assert rows(store.read("names"), ["wiki", "relative", "name"]) == rows(graph.names(docs()), ["wiki", "relative", "name"])
        gone = store._part("gone", store.meta()["segments"][-1], store.meta()["schemas"])
        assert gone is None or gone.filter("relative = 'quiet.md'").isEmpty()  # merged, or left alone


def test_a_store_keeps_what_it_was_built_for(spark, tmp_path):
    """Links alone follow changes without a pass over the words of texts, the index without names and links; both as a store of all tables has them."""

    def docs(turn):
        text = {1: "reef coral", 2: "sand"}[turn]
        held = [("p0.md", text, "A", ["p1", "New"], turn), ("p1.md", "reef", "B", ["A"], 1), (f"q{turn}.md", "shoal reef", "New" if turn == 2 else "Old", [], turn)]
        return spark.createDataFrame([(*page("w", r, b, t, s), links) for r, b, t, links, s in held], f"{DOCS}, links array<string>")

    stores = {}
    for kept in (("links",), ("index",), (), delta.KEPT):
        store = stores[kept] = delta.Store(spark, str(tmp_path / "-".join(["s", *kept])))
        assert [delta.follow(store, docs(turn), kept)[0] for turn in (1, 2)] == ["rebuilt", "updated"]
        own = {"documents", "state"} | ({"entries", "pages", "sums"} if "index" in kept else set()) | ({"names", "edges"} if "links" in kept else set())
        assert [set(s["tables"]) for s in store.meta()["segments"]] == [own, own | {"gone"}]
        assert rows(store.read("state"), delta.STATE) == rows(docs(2), delta.STATE)
    edges = ["wiki", "relative", "pos", "target", "to_wiki", "to_relative", "broken"]
    for kept in (("links",), delta.KEPT):
        assert rows(stores[kept].read("edges"), edges) == rows(graph.edges(docs(2)), edges)
    for kept in (("index",), delta.KEPT):
        assert rows(stores[kept].read("entries"), TABLES["entries"]) == rows(index.entries(docs(2)), TABLES["entries"])
        assert rows(search.search(stores[kept].index(), "reef"), ["rank", "relative", "score"]) == rows(search.search(docs(2), "reef"), ["rank", "relative", "score"])
    with pytest.raises(IndexMissing):
        stores["links",].index()


def test_blocks_are_counted_from_the_entries_of_the_words_asked_for(spark, tmp_path):
    """Nothing is written for them, and a query's words reach the files of entries as filters, below the count and below what has gone."""
    store = delta.Store(spark, str(tmp_path))
    for turn in (1, 2):
        delta.follow(store, spark.createDataFrame([page("w", f"p{i}.md", "reef " * (i + turn), "Page", turn if i < 3 else 1) for i in range(9)], DOCS))
    assert not any("blocks" in s["tables"] for s in store.meta()["segments"])
    asked = store.index().blocks.filter(F.col("term").isin(["reef"]))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") >= 2 and plan.count("EqualTo(term,reef)") + plan.count("In(term, [reef])") >= 2 and plan.count("MapInArrow") == 0
    assert asked.agg(F.sum("n"), F.sum("df_body"), F.max("tf_body")).first() == (9, 9, 10)


def test_documents_of_one_file_are_dealt_out_to_several_tasks(spark, tmp_path, monkeypatch):
    """A file of documents has several row groups, so more than one task of the pass over their words has rows."""
    monkeypatch.setattr(index, "GROUP_BYTES", 1 << 18)
    body = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.md5(F.concat(F.col("id"), i).cast("string"))))
    none = F.array().cast("array<string>")
    docs = spark.range(0, 1500, 1, 1).select(
        F.lit("w").alias("wiki"), F.format_string("%05d.md", F.col("id")).alias("relative"), F.lit("").alias("title"), none.alias("aliases"), none.alias("headings"), body.alias("body")
    )
    index.write_table(docs, str(tmp_path / "d"), "documents")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        found = index.entries(spark.read.parquet(str(tmp_path / "d"))).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(found) > 2


@pytest.fixture(scope="module")
def frequent(spark):
    """3,000 pages: a word that two in three hold more or less often, one that a tenth holds, one that few do, some of it in titles."""
    i = F.col("id")
    body = F.concat_ws(" ", F.array_repeat(F.lit("tide"), F.when(i % 3 > 0, 1 + i * 7919 % 13).otherwise(0).cast("int")), F.array_repeat(F.lit("filler"), (20 + i * 104729 % 61).cast("int")), F.when(i % 10 == 0, "kelp"), F.when(i % 701 == 0, "pearl"))
    none = F.array().cast("array<string>")
    docs = spark.range(3000).select(
        F.when(i % 4 == 0, "b").otherwise("a").alias("wiki"), F.format_string("p%05d.md", i).alias("relative"), F.lit("markdown").alias("content_type"),
        F.when(i % 500 == 3, "Tide tables").otherwise("Page").alias("title"), none.alias("aliases"), F.array((i % 3).cast("string")).alias("tags"), none.alias("headings"), body.alias("body"),
    ).cache()
    entries = index.entries(docs).cache()
    return docs, index.Index(entries, index.pages(docs), index.blocks(entries).cache(), index.sums(docs, entries).cache())


@pytest.mark.parametrize("query", ["tide", "tide kelp", "tide pearl", '"pearl kelp" tide', "tide -kelp", "title:tide", "title:page tide tag:1", "tide tide", "absent tide"])
def test_levels_give_the_same_rows(frequent, query):
    docs, idx = frequent
    columns = ["wiki", "rank", "relative", "title", "score"]
    assert rows(search.search(idx, query, top=7, at_once=0), columns) == rows(search.search(docs, query, top=7), columns)


def test_levels_below_the_last_row_are_not_read(frequent):
    _, idx = frequent
    reading = search.Reading(idx, [(f, "tide") for f in index.BOOSTS], [(["tide"], index.BOOSTS, False)], 7)
    assert 2000 <= reading.read(reading.all()) <= 2006
    cuts = reading.cuts(idx.pages, at_once=0)
    assert reading.read(cuts) * 3 <= 2000
    # the bound holds for every entry that was left out
    for wiki in "ab":
        n, average, df = reading.wikis[wiki]
        assert n == (750 if wiki == "b" else 2250) and df[-1] == n * 2 // 3 and average["title"] > 0
        worst = search.search(idx, "tide", top=3000, at_once=10**9).filter(F.col("wiki") == wiki)
        below = idx.entries.filter((F.col("term") == "tide") & (F.col("wiki") == wiki) & (F.col("level") < cuts[wiki, "tide"]))
        assert worst.join(below, ["wiki", "relative"]).agg(F.max("score")).first()[0] <= reading._most(wiki, "tide", cuts) + 1e-4


def test_no_entry_is_worth_more_than_its_level_allows():
    rng = random.Random(4)
    for _ in range(3000):
        field, tf, average = rng.choice(list(index.BOOSTS)), rng.randrange(1, 30), rng.uniform(1, 900)
        dl = tf + rng.randrange(2000)
        reached = tf / (tf + index.K1 * (1 - index.B + index.B * dl / index.TYPICAL[field]))
        level = int(index.BOOSTS[field] * reached * index.LEVELS) + rng.choice([0, 0, 0, 5])
        own = tf * (index.K1 + 1) / (tf + index.K1 * (1 - index.B + index.B * dl / average))
        assert own <= search.heaviest(field, level, tf + rng.choice([0, 3]), max(0, dl - rng.choice([0, 50])), average) + 1e-9


def plain_snippet(body, words, width):
    """The first stretch with most words among those whose start is near enough for the longest word to fit."""
    at = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", body) if m.group().lower() in words]
    if not at:
        return None
    reach = width - max(map(len, words))
    n, back, end = max((sum(s <= x[0] <= s + reach for x in at), -s, max(x[1] for x in at if s <= x[0] <= s + reach)) for s, _ in at)
    room = max(0, (width - (end + back)) // 2)
    first = max(0, -back - room)
    return body[first : end + room].strip(" \n\t\r\f\v")


def test_snippets_of_places(spark):
    rng = random.Random(2)
    bodies = [" ".join(rng.choices(["Reef", "coral", "éclair", "sand\n", "shoal"], k=n)) for n in (0, 1, 5, 40, 400)] + ["İstanbul reef", "x" * 500 + " coral"]
    docs = spark.createDataFrame([page("w", f"{i}.md", b) for i, b in enumerate(bodies)], DOCS)
    hits = docs.select("wiki", "relative", F.lit(1).alias("rank"))
    want = {f"{i}.md": plain_snippet(b, ["coral", "reef"], 60) for i, b in enumerate(bodies)}
    for idx in (None, index.Index(index.entries(docs), None, None, None)):
        found = search.with_snippets(hits, docs, "reef coral", idx, 60).collect()
        assert {r.relative: r.snippet for r in found} == want and max(len(r.snippet or "") for r in found) <= 60


def test_words_of_many_texts_are_those_of_each():
    """Against the plain definition: one regex over each lower-case text, places counted back to the text itself."""
    rng = random.Random(6)
    texts = ["", "\n", "ΑΣ", "ΑΣ\nΣ b", "İ" * 25, "é" * 19 + " " + "é" * 20, "日本語 x𝟘y ²/Ⅻ", *["".join(rng.choices("aB é_İ\nΣ9-日𝟘", k=rng.randrange(80))) for _ in range(200)]]

    def plain(value):
        place = [i for i, c in enumerate(value) for _ in range(len(c.lower()))]
        return [(m.group(), place[m.start()]) for m in index.WORD.finditer(value.lower()) if len(m.group().encode()) < index.text.TOKEN_BYTES]

    words, of, at = index.words_of(texts)
    assert list(zip(of.tolist(), words.to_pylist(), at.tolist(), strict=True)) == [(i, *found) for i, t in enumerate(texts) for found in plain(t)]


def test_an_index_is_written_without_a_shuffle_of_entries(spark, frequent, tmp_path, monkeypatch):
    """One pass over the texts: entries are neither sampled nor sorted over all files, each stretch of a file is in order, and searches of it are right."""
    docs, idx = frequent
    monkeypatch.setattr(index, "STRETCH", 1 << 14)
    plan = index.tables(docs)["entries"](None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "rangepartitioning" not in plan and plan.find("Exchange") > plan.find("MapInArrow")  # below it: of documents alone
    index.write_index(docs, str(tmp_path / "i"))
    found = index.read_index(spark, str(tmp_path / "i"))
    assert rows(found.entries, TABLES["entries"]) == rows(idx.entries, TABLES["entries"])
    own = index.entries(docs.coalesce(1)).select("wiki", "term", "level").collect()
    keys = [(r.wiki, r.term, -r.level) for r in own]
    assert sum(a > b for a, b in zip(keys, keys[1:], strict=False)) < docs.selectExpr("sum(length(body) + length(title))").first()[0] // (1 << 14) + 2
    for q in ("tide kelp", "pearl -kelp"):
        assert rows(search.search(found, q, top=7, at_once=0), ["wiki", "rank", "relative", "score"]) == rows(search.search(docs, q, top=7), ["wiki", "rank", "relative", "score"])


def exchanges_above_the_pass(df):
    """Shuffles of what the one pass over the texts gives."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    return plan[: plan.find("MapInArrow")].count("Exchange")


def test_postings_and_places_are_not_shuffled(spark):
    """Each page gives its own rows; those of a name that several pages have are added up, as grouping by name does."""
    docs = spark.createDataFrame([page("w", "a.md", "Reef coral reef", "Reef"), page(None, "b.md", "sand"), page("w", "c.md", "")], DOCS)
    assert exchanges_above_the_pass(search.postings(docs)) == 0 and exchanges_above_the_pass(index.places(index.entries(docs))) == 0
    columns = ["wiki", "field", "term", "relative", "tf", "dl"]
    own = [("w", "title", "reef", "a.md", 1, 1), ("w", "body", "reef", "a.md", 2, 3), ("w", "body", "coral", "a.md", 1, 3), (None, "body", "sand", "b.md", 1, 1)]
    assert rows(search.postings(docs), columns) == sorted(own, key=repr)
    twice = docs.unionByName(docs.filter("relative <> 'a.md'"))
    assert rows(search.postings(twice), columns) == sorted([*own[:3], (None, "body", "sand", "b.md", 2, 1)], key=repr)
    found = {tuple(r) for r in index.places(index.entries(docs)).collect()}
    assert found == {("w", "a.md", "reef", 0), ("w", "a.md", "coral", 5), ("w", "a.md", "reef", 11), (None, "b.md", "sand", 0)}


def test_blocks_count_off_in_one_aggregation(spark):
    docs = spark.createDataFrame([page("w", f"{i}.md", "reef " * (1 + i % 2)) for i in range(6)], DOCS)
    found = index.entries(docs)
    left = index.blocks(found, found.filter("relative < '2'"))
    assert left._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    counts = ["wiki", "term", "level", "n", *[f"df_{f}" for f in index.BOOSTS]]
    assert rows(left.filter("n <> 0"), counts) == rows(index.blocks(found.filter("relative >= '2'")), counts)


def test_words_and_places():
    assert list(index.words_at("Ab, cÉ_1  " + "x" * 40 + " İx")) == [("ab", 0), ("cé", 4), ("1", 7), ("i", 51), ("x", 52)]
