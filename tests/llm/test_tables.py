"""Operators 11 to 13 against plain versions: on the given tables and on odd rows."""

import datetime as dt
import glob
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

from lorespark.llm import exact, generations, trie
from tests.compare import DATA, assert_same

EPOCH = dt.datetime(1970, 1, 1)


def read(path):
    found = ds.dataset(path).to_table()
    return found.column_names, list(zip(*[c.to_pylist() for c in found.columns], strict=True))


def write(folder, name, columns, rows, types):
    os.makedirs(folder, exist_ok=True)
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    pq.write_table(pa.Table.from_arrays(arrays, columns), f"{folder}/{name}.parquet")


# op11


def micros(x):
    return "" if x is None else str((x - EPOCH) // dt.timedelta(microseconds=1))


def plain_layout(columns, rows):
    at = {c: i for i, c in enumerate(columns)}
    key, sold, arrived, total = (at[c] for c in ("sale_id", "sold_at", "arrived_at", "total"))
    day = lambda r: -1 if r[sold] is None else (r[sold] - EPOCH).days
    late = lambda r: r[arrived] is None or r[arrived] >= dt.datetime(2024, 4, 10)
    every = []
    for r in rows:
        every.append(r)
        h = zlib.crc32(str(r[key]).encode())
        if r[key] is not None and h % 3 == 0 and day(r) % 7 == 0:
            copy = list(r)
            copy[total] = None if r[total] is None else r[total] + 1
            copy[sold] = r[sold] + dt.timedelta(days=h % 2)
            copy[arrived] = None if r[arrived] is None else r[arrived] + dt.timedelta(days=1 + h % 97)
            every.append(tuple(copy))

    def kept(some):
        best = {}
        for r in some:
            if r[key] not in best or (r[arrived] or EPOCH) > (best[r[key]][arrived] or EPOCH):
                best[r[key]] = r
        return best

    start, final = kept(r for r in every if not late(r)), kept(every)
    moved = [k for k, r in final.items() if late(r)]
    dirty = {day(final[k]) for k in moved} | {day(start[k]) for k in moved if k in start}
    by_day, out, size = defaultdict(list), {}, 1 + len(rows) // 700
    for r in final.values():
        by_day[day(r)].append(r)
    for d, own in by_day.items():
        own.sort(key=lambda r: (r[sold] is not None, r[sold] or EPOCH, r[key] is not None, r[key] or 0))
        for i in range(0, len(own), size):
            part = own[i : i + size]
            ids = ["" if r[key] is None else str(r[key]) for r in part]
            out[d, i // size] = (
                len(part), sum(math.floor(100 * r[total] + 0.5) for r in part if r[total] is not None),
                sum(zlib.crc32(f"{x}:{micros(r[sold])}:{micros(r[arrived])}".encode()) for x, r in zip(ids, part, strict=True)),
                ",".join(columns), hashlib.sha256(",".join(ids).encode()).hexdigest(), d in dirty,
            )
    return out


def files_below(path):
    return {p: open(p, "rb").read() for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def check_overwrite(spark, folder):
    found = generations.op11_late_overwrite(spark, folder).collect()
    got = {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.columns, r.ids_sha256, r.rewritten) for r in found}
    assert got == plain_layout(*read(f"{folder}/sales.parquet"))
    if found:
        paths = {r.path.removeprefix("file://") for r in found}
        assert set(files_below(os.path.dirname(os.path.dirname(min(paths))))) == paths
    return found


def test_overwrite_equals_a_plain_version(spark):
    found = check_overwrite(spark, DATA)
    assert {r.rewritten for r in found} == {True, False}


SALES = (["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"], [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.timestamp("us"), pa.timestamp("us"), pa.int32()])


def test_overwrite_of_odd_rows(spark, tmp_path):
    rng, at = random.Random(7), lambda days: dt.datetime(2024, 1, 1) + dt.timedelta(days=days, seconds=days * 37 % 86400)
    rows = []
    for i in range(400):
        sold = None if i % 37 == 0 else at(rng.randrange(60))
        arrived = None if i % 41 == 0 else at(rng.randrange(60, 160))
        rows.append((i if i % 53 else None if i == 53 else i, i % 5, None if i % 11 == 0 else "open", None if i % 13 == 0 else i / 7, sold, arrived, None))
    # rows of one sale, exact repeats, and a third of all rows at one instant
    rows += [(1, 0, "done", 5.0, at(3), at(200 + n), 1) for n in range(5)] + [rows[7]] * 3
    rows += [(1000 + n, 0, "hot", 1.0, at(10), at(5 + n % 150), 2) for n in range(200)]
    write(tmp_path / "odd", "sales", SALES[0], rows, SALES[1])
    check_overwrite(spark, str(tmp_path / "odd"))
    write(tmp_path / "none", "sales", SALES[0], [], SALES[1])
    assert check_overwrite(spark, str(tmp_path / "none")) == []


def test_further_generations_touch_dirty_days_alone(spark, tmp_path):
    schema = "id string, at timestamp_ntz, came timestamp_ntz, day int, _old string"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(f"k{i}", day(i % 6), day(10), i, "x") for i in range(60)]
    keys = generations.Keys("id", "at", "came", 4)
    layout = generations.lay_out(spark.createDataFrame(rows, schema), str(tmp_path / "t"), keys)
    before = files_below(tmp_path / "t")
    again = layout.absorb(spark.createDataFrame([("k0", day(1), day(11), 0, "y"), ("k2", day(3), day(9), 0, "too early")], schema))
    after = files_below(tmp_path / "t")
    first = dt.date(2024, 1, 1).toordinal() - dt.date(1970, 1, 1).toordinal()
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.split("day=")[1].split("/")[0] for p in set(before) - same} == {str(first), str(first + 1)}
    assert all("-g1" in p for p in set(after) - same)
    found = {r.id: (r["at"], r.day, r._old) for r in again.rows().collect()}
    assert len(found) == 60 and found["k0"] == (day(1), 0, "y") and found["k2"] == (day(2), 2, "x")
    third = again.absorb(spark.createDataFrame([], schema))
    assert files_below(tmp_path / "t") == after and third.generation == 2 and third.manifest().count() == again.manifest().count()
    # a task that runs again finds its file and leaves it
    written = min(p for p in after if "-g1" in p)
    place = dict(x.split("=") for x in written.split("/") if "=" in x)
    batch = pa.RecordBatch.from_arrays([pa.array([int(place["day"])]), pa.array([0]), pa.array(["k"])], ["_lore_day", "_lore_file", "id"])
    list(generations._write([batch], f"file://{tmp_path}/retry", 0))
    list(generations._write([batch], f"file://{tmp_path}/retry", 0))
    assert len(files_below(tmp_path / "retry")) == 1 and not os.listdir(tmp_path / "retry" / "_attempts")


# op12


def plain_trie(rows, heads=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = dict(turns)
    for c in turns if heads else ():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(int(c - math.fmod(c, 100)), [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children, rolled, out = Counter(k[:-1] for k in nodes if k), defaultdict(lambda: [0, 0]), []
    for k in sorted(nodes, key=len, reverse=True):
        leaves, saved = rolled[k]
        leaves, saved = leaves or 1, saved + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        if k:
            rolled[k[:-1]][0] += leaves
            rolled[k[:-1]][1] += saved
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(nodes[k]), len(k), parent, len(nodes[k]), children[k], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = (["conv_id", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()])


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_trie_equals_a_plain_version(spark):
    _, rows = read(f"{DATA}/conversations.parquet")
    assert rows_of(trie.op12_prefix_trie(spark, DATA), NODE) == plain_trie(rows)


def test_trie_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "long" * 50])) for c in [*range(-120, 20), 250, 251, 10**12] for t in range(rng.randrange(4))]
    rows += [(400, None, "user", "no turn"), (400, 0, "user", "0"), (400, 0, "user", "0"), (400, 0, "other", "0"), (None, 0, "user", "nobody's")]
    rows += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(9)] + [(700, t, "user", str(t)) for t in range(300)]
    write(tmp_path / "odd", "conversations", TURNS[0], rows, TURNS[1])
    assert rows_of(trie.op12_prefix_trie(spark, str(tmp_path / "odd")), NODE) == plain_trie(rows)
    write(tmp_path / "none", "conversations", TURNS[0], [], TURNS[1])
    assert rows_of(trie.op12_prefix_trie(spark, str(tmp_path / "none")), NODE) == []


def test_trie_without_borrowed_heads(spark):
    rows = [(c, t, "user", f"{c % 3 if t > 1 else 0}") for c in range(12) for t in range(c % 5)]
    found = trie.prefix_trie(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert rows_of(found, ["conv_id", "depth", "parent", "n", "n_children", "n_leaves", "saved", "ends"]) == [r for r in plain_trie([(*r,) for r in rows], heads=False)]


# op13


def test_exact_dedup_equals_sql(spark):
    assert_same(exact.op13_exact_dedup(spark, DATA), exact.OP13_SQL)


@pytest.mark.parametrize("counters", [1, 3, 10])
def test_summary_finds_what_is_frequent(counters):
    rng = random.Random(counters)
    for _ in range(30):
        values = [bytes([min(int(rng.expovariate(0.3)), 60)]) for _ in range(400)]
        batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 33], pa.binary())], ["digest"]) for i in range(0, 400, 33)]
        (found,) = exact.summarise(iter(batches), counters)
        kept = dict(zip(*(c.to_pylist() for c in found.columns), strict=True))
        assert len(kept) <= counters
        for value, n in Counter(values).items():
            assert n - 400 / (counters + 1) <= kept.get(value, 0) <= n


def test_exact_dedup_of_odd_rows(spark, tmp_path):
    long = "x" * 300_000
    rows = [(1, "Same"), (2, "same"), (3, "SAME"), (3, "sAME"), (None, "same"), (None, None), (None, ""), (5, ""), (6, long), (7, long.upper()), (8, "ÄB"), (9, "äb"), (10, "Äb"), (None, "alone")]
    rows += [(100 + i, "hot") for i in range(60)]
    write(tmp_path, "documents", ["doc_id", "text", "digest", "keep_id", "row"], [(*r, "own", 1, 2) for r in rows], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])
    folded = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    ids = defaultdict(list)
    for i, t in rows:
        ids[folded(t)].append(i)
    want = {t: (max((i for i in v if i is not None), default=None), len(v)) for t, v in ids.items()}
    found = exact.op13_exact_dedup(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter((i, *want[folded(t)], hashlib.sha256(folded(t).encode()).hexdigest()) for i, t in rows)
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in want)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for share in (1e-3, 0.5):
        left = exact.drop_copies(docs, share=share)
        assert left.columns == docs.columns and Counter((r.doc_id, folded(r.text), r.digest, r.row) for r in left.collect()) == Counter((want[t][0], t, "own", 2) for t in want)
    assert exact.drop_copies(docs.limit(0)).count() == 0
