import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.streaming import changes
from tests.compare import DATA

PAIRS = [(["create", "modify"], "create"), (["create", "delete"], "delete"), (["rename", "modify"], "rename"), (["delete", "create"], "modify"), (["delete", "modify"], "delete"), (["modify", "delete"], "delete"), (["modify"], "modify")]


@pytest.mark.parametrize("kinds, want", PAIRS)
def test_coalesce(spark, kinds, want):
    assert spark.range(1).select(changes.coalesced(F.array(*map(F.lit, kinds)))).first()[0] == want


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = changes.settled(changes.from_events(events), ["path"], "30 minutes")
    folder = str(tmp_path / "in")
    last = events.agg(F.max("ts")).first()[0]
    end = events.limit(1).withColumn("ts", F.lit(last + pd.Timedelta(days=2))).withColumn("user_id", F.lit(-1).cast("long"))
    ordered = events.orderBy("ts").coalesce(1)
    ordered.write.parquet(folder)
    end.select(events.columns).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    out = changes.settled(changes.watermarked(changes.from_events(stream), "1 hour"), ["path"], "30 minutes")
    query = out.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.path, r.start, r.end, r.n, r.kind) for r in df.filter("path <> '-1'").collect())
    assert key(spark.table("settled")) == key(batch)


def test_rename_pairs(spark, tmp_path):
    rows = [("w", "a", "rename_from", 0, 1), ("w", "b", "rename_to", 100, 2), ("w", "c", "rename_from", 1000, 3), ("w", "d", "rename_to", 5000, 4), ("w", "e", "modify", 5100, 5), ("v", "z", "rename_to", 50, 6)]
    frame = spark.createDataFrame([(w, p, k, None, pd.Timestamp(1_700_000_000_000 + ms, unit="ms").to_pydatetime(), s) for w, p, k, ms, s in rows], changes.CHANGES)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = changes.pair_renames(changes.watermarked(stream, "1 second"))
    query = out.writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.wiki, r.path, r.kind, r.from_path) for r in spark.table("paired").collect()}
    assert got == {("w", "b", "rename", "a"), ("w", "c", "delete", None), ("w", "d", "create", None), ("w", "e", "modify", None), ("v", "z", "create", None)}


def run_once(stream, name, checkpoint):
    query = stream.writeStream.format("parquet").queryName(name).option("checkpointLocation", checkpoint).option("path", f"{checkpoint}-out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_interleaved_renames_equal_a_plain_version_and_the_batch(spark, tmp_path):
    rng = random.Random(8)
    at = lambda ms: pd.Timestamp(1_700_000_000_000 + ms, unit="ms").to_pydatetime()
    rows, ms = [], 0
    for seq in range(120):
        ms += rng.choice([1, 50, 300, 900])
        rows.append((rng.choice("vw"), f"p{seq}", rng.choice(["rename_from", "rename_to", "modify"]), None, at(ms), seq, rng.randrange(3)))
    schema = f"{changes.CHANGES}, cookie int"
    for i in range(0, 120, 40):  # files in order of time; within one, rows in any order
        part = rows[i : i + 40]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    last = ("end", "late", "modify", None, at(ms + 10**6), 999, 0)
    spark.createDataFrame([last], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    time.sleep(1.1)
    spark.createDataFrame([("v", "too late", "rename_to", None, at(5), 1000, 0), ("end", "now", "modify", None, at(ms + 10**6 + 1), 1001, 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_once(changes.pair_renames(changes.watermarked(stream, "1 second")), "interleaved", str(tmp_path / "c"))
    key = lambda found: sorted(((r.wiki, r.path, r.kind, r.from_path, r.ts) for r in found if r.wiki != "end"), key=repr)
    got = key(spark.read.parquet(str(tmp_path / "c-out")).collect())
    open_, want = {}, []
    for wiki, path, kind, _, ts, _, cookie in sorted(rows, key=lambda r: (r[4], r[5])):
        source = open_.pop((wiki, cookie), None) if kind != "modify" else None
        near = source is not None and ts - source[1] <= pd.Timedelta(milliseconds=600)
        if source is not None and not (kind == "rename_to" and near):
            want.append((wiki, source[0], "delete", None, source[1]))
        if kind == "rename_from":
            open_[wiki, cookie] = (path, ts)
        elif kind == "rename_to":
            want.append((wiki, path, "rename", source[0], ts) if near else (wiki, path, "create", None, ts))
        else:
            want.append((wiki, path, kind, None, ts))
    want += [(wiki, s[0], "delete", None, s[1]) for (wiki, _), s in open_.items()]
    assert got == sorted(want, key=repr)
    assert key(changes.paired(spark.createDataFrame(rows, schema)).collect()) == got


def test_watcher_tells_each_change_once(spark, tmp_path):
    """Restarts from the checkpoint; the offset does not grow with the folder; a share that ran before gives the same rows again."""
    root, state = tmp_path / "wiki", str(tmp_path / "state")
    for i in range(30):
        (root / f"d{i % 5}" / f"e{i % 3}" / "f").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 5}" / f"e{i % 3}" / "f" / f"{i}.md").write_text("x")
    (root / "top.md").write_text("x")
    (root / ".git").mkdir()
    (root / ".git" / "index").write_text("x")

    def changed():
        run_once(changes.folder_stream(spark, str(root), state=state, shares=4), "watched", str(tmp_path / "c"))
        return sorted((r.path, r.kind) for r in spark.read.schema(changes.CHANGES).parquet(str(tmp_path / "c-out")).collect())

    first = changed()
    assert len(first) == 31 and {k for _, k in first} == {"create"} and ("top.md", "create") in first
    (root / "top.md").write_text("longer")
    (root / "d1" / "new.md").write_text("x")
    (root / "d0" / "e0" / "f" / "0.md").unlink()
    second = changed()
    assert sorted(set(second) - set(first)) == [("d0/e0/f/0.md", "delete"), ("d1/new.md", "create"), ("top.md", "modify")] and len(second) == 34
    assert changed() == second
    offsets = sorted((tmp_path / "c" / "offsets").glob("[0-9]*"))
    assert all(len(p.read_text().splitlines()[-1]) < 40 for p in offsets)
    reader = changes._Watcher({"path": str(root), "state": state, "shares": "4"})
    versions = sorted(int(p.name) for p in (tmp_path / "state").iterdir())
    share = changes._Share(0, versions[-1], versions[-1] + 1)
    (root / "d2" / "again.md").write_text("x")
    for part in (share, changes._Share(1, share.start, share.end), changes._Share(2, share.start, share.end), changes._Share(3, share.start, share.end)):
        once = list(reader.read(part))
        assert list(reader.read(part)) == once
    with pytest.raises(ValueError, match="has gone"):
        list(reader.read(changes._Share(0, 10**6, 10**6 + 1)))


def test_folder_source(spark, tmp_path):
    root = tmp_path / "wiki"
    root.mkdir()
    (root / "a.md").write_text("x")
    stream = changes.folder_stream(spark, str(root))
    query = stream.writeStream.format("memory").queryName("folder").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        for _ in range(100):
            if spark.table("folder").count() >= n:
                return
            time.sleep(0.2)

    wait(1)
    (root / "a.md").write_text("longer")
    wait(2)
    (root / "a.md").unlink()
    wait(3)
    query.stop()
    assert [r.kind for r in spark.table("folder").orderBy("seq").collect()] == ["create", "modify", "delete"]


def test_owners_and_ignored(spark):
    from lorespark.sources.files import ignore_rules

    events = spark.createDataFrame([("/w/a/x.md", "modify"), ("/w/a/b/y.log", "create"), ("/w/a/b/.git/z", "create"), ("/other/q", "create")], "path string, kind string")
    wikis = spark.createDataFrame([("a", "/w/a"), ("b", "/w/a/b/")], "name string, root string")
    own = changes.owned(events, wikis)
    assert sorted((r.wiki, r.relative) for r in own.collect()) == [("a", "x.md"), ("b", ".git/z"), ("b", "y.log")]
    assert [r.relative for r in changes.not_ignored(own, ignore_rules(["*.log"])).collect()] == ["x.md"]


def test_renames_of_unknown_sources(spark):
    paired = spark.createDataFrame([("w", "a.md", "rename", "tmp1"), ("w", "b.md", "rename", "old.md"), ("w", "c.md", "create", None)], "wiki string, path string, kind string, from_path string")
    tracked = spark.createDataFrame([("w", "old.md"), ("w", "old.md")], "wiki string, path string")
    got = [tuple(r) for r in changes.in_order(changes.known_sources(paired, tracked)).collect()]
    assert got == [("w", "a.md", "modify", None), ("w", "b.md", "rename", "old.md"), ("w", "c.md", "create", None)]
