"""Each operator against SQL or a plain version of its definition."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import bpe, decontaminate, fingerprint, jaccard, langid, licenses, pii, quality, queries, repeats, urls
from lorespark.llm.graphs import components
from lorespark.llm.suffixes import suffix_array
from tests.compare import DATA, assert_same

DOCS = "doc_id long, text string"


def docs_of(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(parts)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


def test_short_items_and_long_runs_equal_sql(spark, tmp_path):
    pick = random.Random(2)
    word = lambda: pick.choice(["a", "b", "c", "dé", "E"])
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 9, 10, 11, 30, 60, 0, 2, 9)] + ["x y", "x  Y!", "", None, "a a a a a a a a a a a a a a"]
    texts = [" ".join(word() for _ in range(pick.randrange(0, 80))) for _ in range(60)] + [items[7], items[8] + " " + items[8], "q X-y q", "", None, "a " * 50]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert_same(decontaminate.op2_decontaminate(spark, str(tmp_path)), decontaminate.OP2_SQL, str(tmp_path))


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small_side", lambda df: df)
    assert_same(decontaminate.op2_decontaminate(spark, DATA), decontaminate.OP2_SQL)


def plain_repeats(texts, span=100):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            s = data[i : i + span]
            if s in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [4096, 2])
def test_repeats(spark, monkeypatch, tmp_path, many):
    monkeypatch.setattr(repeats, "MANY", many)
    pick = random.Random(5)
    passage = ["".join(pick.choice("abcdé \n") for _ in range(n)) for n in (90, 99, 100, 130, 400)]
    texts = ["".join(pick.choice([*passage, *(pick.choice("xyz") * pick.randrange(1, 9) for _ in range(6))]) for _ in range(pick.randrange(0, 9))) for _ in range(60)]
    texts += ["ab" * 300, "ab" * 301, "", None, texts[3], texts[3], "a" * 99, "a" * 100, "a" * 101, "\0" * 250]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[1:] for r in repeats.op3_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == plain_repeats(texts)


@pytest.mark.parametrize("many", [4096, 2])
def test_repeats_in_rows_of_one_id(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    pick = random.Random(9)
    own = ["".join(pick.choice("abcdé \n") for _ in range(300)) for _ in range(9)]
    rows = [(None, own[0]), (None, own[1] + own[2]), (None, own[3]), (None, own[3]), (1, own[4]), (1, own[4]), (2, own[5] + own[6]), (2, own[6] + own[7]), (3, own[2] + own[8]), (4, own[4])]
    for parts in (1, 4):
        got = [(r.doc_id, bytes(r.kept).decode()) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()]
        assert sorted(k for i, k in got if i is None) == sorted(t for i, t in rows if i is None)
        assert [k for i, k in got if i == 1] == [own[4]] * 2 and [k for i, k in got if i == 4] == [""]
        assert sorted(k for i, k in got if i == 2) in (sorted([own[5] + own[6], own[7]]), sorted([own[5], own[6] + own[7]])) and [k for i, k in got if i == 3] == [own[8]]


def test_repeats_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST", 0)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in repeats.op3_suffix_dedup(spark, DATA).orderBy("doc_id").collect()] == plain_repeats([r.text for r in rows])


def test_suffix_array():
    pick = random.Random(1)
    for _ in range(1500):
        s = bytes(pick.choice(b"abc"[: pick.randint(1, 3)]) for _ in range(pick.randint(0, 40)))
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_bpe_is_exact_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(3)
    texts = ["".join(pick.choice(["a", "the ", "é", "日本", "\n", "🦀", "1", "  ", "!!", "ß", "\0", "zz", "\u0085", "\x1c", "'s"]) for _ in range(pick.randint(0, 60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ["a" * 50_000, "", None, "<|endoftext|>"]
    for r in bpe.encode(docs_of(spark, texts)).collect():
        own = texts[r.doc_id] or ""
        assert r.ids == plain.encode_ordinary(own) and bytes(r.decoded) == own.encode()


def test_fingerprints(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = fingerprint.op6_fingerprints(spark, DATA).orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    canon = lambda t: " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()).split())
    for i, r in enumerate(got):
        n, after = len(texts[i]) // 4, texts[(i + 1) % len(texts)]
        edited = texts[i][: len(texts[i]) - n] + after[:n]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == float(canon(texts[i]) == canon(after)) and r.near_edited == float(canon(texts[i]) == canon(edited))
    groups, want = {}, {}
    for i, r in enumerate(got):
        groups.setdefault(r.fingerprint, []).append(i)
        want.setdefault(canon(texts[i]), []).append(i)
    assert sorted(groups.values()) == sorted(want.values())


def test_normal_forms_meet(spark):
    pick = random.Random(5)
    some = ["é", "é", "A", "̂", "̣", "ế", "가", "가", "ᆨ", "Å", "Å", "ﬁ", " ", "日", "̈́", "ß", "ཱི", "̈́"]
    texts = ["".join(pick.choice(some) for _ in range(pick.randint(0, 12))) for _ in range(150)]
    every = [f(t) for f in (str, lambda t: unicodedata.normalize("NFD", t), lambda t: unicodedata.normalize("NFC", t)) for t in texts]
    got = {r.doc_id: r.c for r in docs_of(spark, every).select("doc_id", fingerprint.canonical(F.col("text")).alias("c")).collect()}
    assert all(got[i] == got[i + 150] == got[i + 300] for i in range(150))


def test_case_folding(spark):
    texts = ["STRASSE", "straße", "Straẞe", "ΟΔΟΣ", "οδοσ", "οδος", "ſ", "S", "ᏸ", "Ᏸ", "ﬃ", "FFI", "İ", "i̇", "ΐ", "Ϊ́", "ᾳ", "ΑΙ", "K", "k"]
    got = [r.c for r in docs_of(spark, texts).orderBy("doc_id").select(fingerprint.canonical(F.col("text")).alias("c")).collect()]
    fold = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
    groups = lambda values: [values.index(v) for v in values]
    assert groups(got) == groups([fold(t) for t in texts]) and len(set(got)) < len(texts) - 8


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.substring(F.sha2(c, 256), 1, 1))
    got = fingerprint.with_fingerprints(docs_of(spark, [f"text {i % 40}" for i in range(80)])).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == 40


def plain_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * den >= num * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, num, den, tile, hot", [(3, 90, 100, 2048, 32), (5, 80, 100, 2048, 2), (1, 60, 100, 4, 3), (3, 80, 100, 3, 32)])
def test_jaccard_join(spark, monkeypatch, n, num, den, tile, hot):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "HOT", hot)
    pick = random.Random(n * num)
    base = [[f"w{pick.randrange(900)}" for _ in range(pick.choice([2, 6, 30, 120, 300]))] for _ in range(12)]
    texts = ["", None, "one", "ONE", "one two", " x"]
    for words in base:
        for _ in range(12):
            own = list(words)
            for _ in range(pick.choice([0, 0, 1, 2, 5, 12])):
                own[pick.randrange(len(own))] = f"v{pick.randrange(900)}"
            texts.append(" ".join(own))
    pick.shuffle(texts)
    got = [(r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts), n, num, den).orderBy("doc_id").collect()]
    assert got == plain_components(texts, n, num, den)


def test_jaccard_join_of_long_texts_near_the_bound(spark):
    pick = random.Random(4)
    texts = []
    for size in (2_700, 3_400):
        words = [f"w{pick.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0.005, 0.012, 0.02, 0.03, 0.04, 0.05, 0.3):
            own = list(words)
            for i in pick.sample(range(size), int(share * size)):
                own[i] = f"v{pick.randrange(10**6)}"
            texts.append(" ".join(own))
    got = [(r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts), 5, 80, 100).orderBy("doc_id").collect()]
    assert got == plain_components(texts, 5, 80, 100) and len({c for _, c in got}) < len(texts)


def test_links_between_components_of_a_key(spark):
    """Families whose members are near the bound, so that what the star of a key does not link is found by the open keys."""
    pick = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        own = list(base)
        for i in pick.sample(range(60), pick.randrange(2, 9)):
            own[i] = f"x{pick.randrange(6)}"
        texts.append(" ".join(own))
    for num in (70, 80, 90):
        got = [(r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts), 1, num, 100).orderBy("doc_id").collect()]
        assert got == plain_components(texts, 1, num, 100)


def test_need_is_a_lower_bound():
    """Any two sets that link share `need` of their keys in a band of both."""
    pick = np.random.default_rng(3)
    for num in (60, 80, 90):
        for size in (3, 12, 40, 150, 700):
            for _ in range(30):
                common = pick.integers(0, 2**63, size, dtype=np.uint64)
                extra = pick.integers(0, 2**63, int(size * (100 - num) / num), dtype=np.uint64)
                cut = pick.integers(0, len(extra) + 1)
                a, b = (np.unique(np.concatenate((common, x))) for x in (extra[:cut], extra[cut:]))
                (ka, na), (kb, nb) = jaccard.block_keys(a, num, 100), jaccard.block_keys(b, num, 100)
                band = jaccard.band_of(min(len(a), len(b)))
                shared = sum(int(k) & 255 == band for k in set(ka.tolist()) & set(kb.tolist()))
                need = [x >> 8 for x in (*na, *nb) if x & 255 == band]
                assert len(need) == 2 and shared >= max(need)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i * 7919 % 200, (i + 1) * 7919 % 200) for i in range(150)] + [(500, 501)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    path = [i * 7919 % 200 for i in range(151)]
    assert got == {**{i: min(path) for i in path}, 500: 500, 501: 500}


def test_licences(spark):
    texts = [
        "Code.\nLicensed under the Apache License, Version 2.0.", "LICENSED UNDER THE MIT LICENSE", "nothing about it", None, "",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {0: ["Apache-2.0"], 1: ["MIT"], 2: [], 3: [], 4: [], 5: ["GPL-3.0-or-later"]}


def test_licence_tables(spark):
    import re

    assert all(re.search(licenses.HINT, x) for x in licenses.SENTENCES) and all(x == " ".join(re.sub("[^a-z0-9]+", " ", x).split()) for x in licenses.SENTENCES)
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES.values())
    texts = [
        "SPDX-License-Identifier: MPL-2.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Released under the BSD 3-Clause License",
        "This is free and unencumbered software released into the public domain.", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "Licensed under CC BY 4.0\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software",
    ]
    got = [r.licenses for r in licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["MPL-2.0"], ["CC-BY-SA-4.0"], ["BSD-3-Clause"], ["Unlicense"], ["ISC"], ["CC-BY-4.0"]]


def test_licences_with_slots_and_expressions(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
    end = "THIS SOFTWARE IS PROVIDED BY {} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    name = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    texts = {
        bsd + name.format("the University") + end.format("THE REGENTS AND CONTRIBUTORS"): ["BSD-3-Clause"], bsd + name.format("Example, Inc.") + end.format("EXAMPLE, INC."): ["BSD-3-Clause"],
        bsd + end.format("JANE DOE"): ["BSD-2-Clause"], "// SPDX-License-Identifier: MIT OR Apache-2.0\nx": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: LGPL-3.0-only": ["LGPL-3.0-only"],
        "SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause)": ["GPL-2.0-or-later", "BSD-3-Clause"], "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0-only"], "MIT Licensed": ["MIT"], "License: MIT": ["MIT"],
        "Dual-licensed under MIT and Apache-2.0.": ["Apache-2.0", "MIT"], "This project is licensed under either of the MIT License or the Apache License 2.0": ["Apache-2.0", "MIT"],
        "License: MIT and something else": [], "She is licensed": [], "licensed under pressure": [],
    }
    got = [r.licenses for r in licenses.scan(docs_of(spark, list(texts))).orderBy("doc_id").collect()]
    assert got == list(texts.values())


def test_licences_of_both_cuts(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    texts = [f"# Licensed under the MIT License\nimport os\n\n{gpl}\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the\nimplied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "All  Rights  Reserved", "all rights\nreserved"]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {0: (["MitRef", "Gpl3Later", "GplWarranty"], ["GPL-3.0-or-later", "MIT"]), 1: (["Reserved"], ["All-rights-reserved"]), 2: (["Reserved"], ["All-rights-reserved"])}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    texts = ["card 4111 1111 1111 1111, again 4111111111111111 not 4111111111111112", "mail a.72@mail3.example.com ip 10.0.0.1 and 256.1.1.1", "born 1999-12-31, 31/12/1999, never 31/02/2020", "ssn 123-45-6789 or 000-12-3456", "+1 (017) 555-7713", "iban DE89 3704 0044 0532 0130 00", 'token = "3c4226790fc3f802230000ff"', "version 1.2.3 in 2024", None, ""]
    got = {r.doc_id: r for r in pii.pseudonymise(docs_of(spark, texts), "k").collect()}
    text = {i: got[i].text for i in got}
    cards = [text[0][5:24].replace(" ", ""), text[0][32:48]]
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0]) and text[0].endswith("not 4111111111111112") and text[0][9] == " "
    assert text[1].endswith("256.1.1.1") and "@mail3.example.com" in text[1] and "10.0.0.1" not in text[1] and "a.72@" not in text[1]
    y, m, d = text[2][5:15].split("-")
    assert text[2][17:27] == f"{d}/{m}/{y}" and y[:2] == "19" and text[2].endswith("never 31/02/2020")
    assert text[3].endswith("or 000-12-3456") and "123-45-6789" not in text[3] and text[4] != texts[4] and len(text[4]) == len(texts[4])
    flat = text[5][5:].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 and flat[:2] == "DE" and text[5] != texts[5]
    assert len(text[6]) == len(texts[6]) and text[6] != texts[6] and text[7] == texts[7] and text[8] is None and text[9] == ""


def plain_prf(key, *parts):
    import hmac

    block = hashlib.sha256(key.encode()).digest()  # HMAC pads it to its block itself
    return int(hmac.new(block, "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:15], 16)


def plain_feistel(a, b, size_a, size_b, key, tweak):
    for i in range(pii.ROUNDS):
        a, b = b, (a + plain_prf(key, i, tweak, b)) % (size_a if i % 2 == 0 else size_b)
    return a, b


def plain_digits(digits, key, tweak):
    n, u = len(digits), len(digits) // 2
    a, b = plain_feistel(int(digits[:u]), int(digits[u:]), 10**u, 10 ** (n - u), key, f"{tweak}{n}")
    return f"{a:0{u}d}{b:0{n - u}d}"


def plain_fill(layout, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in layout)


def test_pseudonyms_equal_a_plain_feistel(spark):
    """Value by value: phones of every layout, cards, social security numbers, addresses and dates of either order."""
    import datetime

    phones = {"555-123-4567": "", "415.555.0123": "", "+14155550123": "+141", "+49 (0)30 123456": "+49", "0044 20 7946 0958": "0044", "(017) 555-7713": "", "1-415-555-0123": "1"}
    want = {p: head + plain_fill(p[len(head) :], plain_digits("".join(filter(str.isdigit, p[len(head) :])), "k", "phone")) for p, head in phones.items()}
    core = plain_digits("411111111111111", "k", "card")
    want["4111 1111 1111 1111"] = plain_fill("4111 1111 1111 1111", next(f"{core}{d}" for d in range(10) if luhn(f"{core}{d}")))
    a, b = plain_feistel(122, 44 * 9999 + 6788, 898, 99 * 9999, "k", "ssn")
    want["123-45-6789"] = f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    a, b = plain_feistel(10 * 256, 1, 65536, 65536, "k", "ip")
    want["10.0.0.1"] = f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    for value, day, layout in (("1999-12-31", (1999, 12, 31), "%Y-%m-%d"), ("12/31/1999", (1999, 12, 31), "%m/%d/%Y"), ("10/12/1999", (1999, 12, 10), "%d/%m/%Y"), ("29.02.2024", (2024, 2, 29), "%d.%m.%Y")):
        first, size = (datetime.date(2000, 1, 1), (75, 487)) if day[0] >= 2000 else (datetime.date(1900, 1, 1), (92, 397))
        a, b = plain_feistel(*divmod((datetime.date(*day) - first).days, size[1]), *size, "k", first.year)
        want[value] = (first + datetime.timedelta(days=a * size[1] + b)).strftime(layout)
    got = [r.text for r in pii.pseudonymise(docs_of(spark, [f"see {v} there" for v in want]), "k").orderBy("doc_id").collect()]
    assert got == [f"see {v} there" for v in want.values()] and all(a != b for a, b in want.items())
    more = ["at 2001:db8:0:1:2:3:4:5 and fe80::1ff:fe23:4567:890a", "password: hunter2hunter2", "password: please tell", "at 12:30:45 we met", "v1.2.3-4 of 2024"]
    got = [r.text for r in pii.pseudonymise(docs_of(spark, more), "k").orderBy("doc_id").collect()]
    assert got[2:] == more[2:] and [len(x) for x in got] == [len(x) for x in more] and got[1][:10] == "password: " and got[1] != more[1]
    assert [c if c in ": " else "x" for c in got[0][3:]] == [c if c in ": " else "x" for c in more[0][3:]] and "db8" not in got[0] and "fe80" not in got[0]
    assert pii.KEY.endswith("secret")


def test_values_inside_longer_candidates(spark):
    texts = ["4111 1111 1111 1111 123", "4111111111111111 7 items", "12 4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332 AND", "_john@x.com", "(000) 000-0000"]
    got = [r.text for r in pii.pseudonymise(docs_of(spark, texts), "k").orderBy("doc_id").collect()]
    card = got[0][:19].replace(" ", "")
    assert luhn(card) and card != "4111111111111111" and got[0][19:] == " 123" and got[1] == f"{card} 7 items" and got[2][:3] == "12 " and got[2][3:].replace(" ", "") == card
    assert got[3][:2] == "ES" and got[3][-4:] == " AND" and got[3] != texts[3] and got[4][0] == "_" and got[4] != texts[4] and got[5] == texts[5]


def test_pseudonyms_depend_on_the_whole_value_and_the_key(spark):
    long = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{long}@x.com", f"{long[:-1]}q@x.com", f"{long.upper()}@x.com"]
    one, other = ([r.text.split("@")[0] for r in pii.pseudonymise(docs_of(spark, texts), k).orderBy("doc_id").collect()] for k in ("k", "l"))
    assert one[2] == one[0].upper() and one[0] != other[0] and sum(a == b for a, b in zip(one[0], one[1])) < 8
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) >= 32


def test_every_match_is_judged_as_a_plain_version_does(spark):
    import datetime
    import re

    import regex

    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r for r in pii.op4_pii(spark, DATA).collect()}
    for r in rows:
        found = regex.findall(pii.ANY, r.text or "")  # look-behinds of any width
        assert len(found) == got[r.doc_id].n_found
        assert len(found) >= got[r.doc_id].n_found >= got[r.doc_id].n_replaced
        if not re.search(pii.PATTERNS["ipv4"], r.text):  # octets may grow
            assert re.sub("[0-9A-Za-z]", "x", got[r.doc_id].text) == re.sub("[0-9A-Za-z]", "x", r.text)
        for m in re.findall(r"(?<![0-9/.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9/-]|\.[0-9])", r.text):
            try:
                datetime.date.fromisoformat(m)
            except ValueError:
                assert m in got[r.doc_id].text


def test_feistel_is_a_permutation(spark):
    got = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x")).distinct()
    assert got.count() == 1000 and got.filter("length(x) <> 3").count() == 0
    names = spark.range(2600).select(F.concat(F.char(97 + F.col("id") % 26), F.lit("."), F.lpad(F.floor(F.col("id") / 26).cast("string"), 2, "0")).alias("s")).select(pii.permute_classes(F.col("s"), "k", "t").alias("x")).distinct()
    assert names.count() == 2600 and names.filter("NOT x RLIKE '^[a-z][.][0-9]{2}$'").count() == 0
    hexes = spark.range(4096).select(pii.permute_hex(F.lower(F.lpad(F.hex("id"), 3, "0")), "k").alias("x")).distinct()
    assert hexes.count() == 4096
    days = spark.sql("SELECT explode(sequence(DATE'1900-01-01', DATE'1999-12-31')) AS d").select(pii.permute_date(F.col("d"), "k").alias("x"))
    assert days.distinct().count() == 36524 and days.filter("year(x) NOT BETWEEN 1900 AND 1999").count() == 0


def test_urls(spark):
    rows = [(1, "https://A.Example.org/es/1", None), (2, "http://x.com/fr/2?a", ""), (3, "http://com/de/", None), (4, None, None), (5, "no", None), (6, "https://example.org/en/123#x", None), (7, "//x.org/", None), (8, "ftp://good.net?x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:5] for r in urls.filter_urls(pages, urls.RULES).collect()}
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("x.com", "/fr/2", "com/fr/", "allow"), 3: ("com", "/de/", "com/de/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("example.org", "/en/123", "example.org/en/1", "block"), 7: ("", "", None, "allow"), 8: ("good.net", "", None, "allow"),
    }


def test_trust_and_distrust_flow(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/">x</a>' for h in hosts)
    rows = [(1, "https://good.org/", link("friend.net")), (2, "https://friend.net/", None), (3, "https://farm.net/", link("bad.com", "bad.com")), (4, "https://bad.com/de/x", None), (5, "https://lone.net/", link("other.net"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in urls.filter_urls(pages, urls.RULES).collect()}
    assert got["friend.net"].verdict == "allow" and got["friend.net"].trust > 0 and got["farm.net"].verdict == "block" and got["lone.net"].verdict == "allow"


def plain_ranks(edges, seeds, damping, turns):
    """Dangling mass goes back to the seeds in every turn."""
    whole = sum(seeds.values())
    start = {h: s / whole for h, s in seeds.items()}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    hosts = {*seeds, *(h for e in edges for h in e)}
    ranks = {h: start.get(h, 0.0) for h in hosts}
    for _ in range(turns):
        lost = sum(r for h, r in ranks.items() if h not in out)
        new = {h: (1 - damping + damping * lost) * start.get(h, 0.0) for h in hosts}
        for (a, b), n in edges.items():
            new[b] += damping * ranks[a] * n / out[a]
        ranks = new
    return {h: r * whole for h, r in ranks.items()}


def test_ranks_reach_their_limit_at_the_shipped_setting(spark):
    rank = lambda edges, seeds: {r.host: r["rank"] for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, seed double")).collect()}
    both = rank([("a", "b", 1), ("b", "a", 1)], [("a", 1.0)])
    assert abs(both["a"] - 1 / (1 + urls.DAMPING)) < 1e-5 and abs(sum(both.values()) - 1) < 1e-9
    chain = [(f"h{i}", f"h{i + 1}", 2) for i in range(30)]
    got, want = rank(chain, [("h0", 3.0)]), plain_ranks({(a, b): n for a, b, n in chain}, {"h0": 3.0}, urls.DAMPING, 300)
    assert len(got) == 31 and max(abs(got[h] - want[h]) for h in want) < 1e-5


def test_rules_equal_sql(spark):
    assert_same(urls.url_rules(spark, DATA), urls.RULES_SQL)


def test_ranks_equal_a_plain_version(spark):
    pick = random.Random(8)
    edges = {(f"h{pick.randrange(20)}", f"h{pick.randrange(25)}"): pick.randrange(1, 5) for _ in range(50)}
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    seeds = {"h1": 3.0, "h2": 1.0, "h24": 6.0}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {r.host: r["rank"] for r in urls.propagate(frame, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    want = plain_ranks(edges, seeds, urls.DAMPING, 300)
    assert abs(sum(got.values()) - 10) < 1e-9 and all(abs(got.get(h, 0.0) - r) < 1e-3 for h, r in want.items())


def test_hosts_are_judged_by_their_own_pages(spark):
    rows = [(i, f"https://com/{'de' if i < 3 else 'fr'}/{i}", None) for i in range(13)] + [(99, "https://com/x", None)] + [(100 + i, f"https://other.com/de/{i}", None) for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.filter_urls(pages, urls.RULES).collect()}
    assert got[99].verdict == "allow" and (got[99].trust, got[99].distrust) == (10.0, 3.0)


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_language_held_out_accuracy(spark):
    data = DATA.replace("0.001", "0.01")
    got = langid.op9_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in got)
    out = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(out) / len(out) > 0.93 and all(0 <= r.score <= 1 for r in got)


def test_quality_held_out_accuracy(spark):
    data = DATA.replace("0.001", "0.01")
    got = quality.op10_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.9


def test_language_equals_a_plain_version(spark):
    import zstandard

    words = {"en": "the of and to in is that for it with as was", "de": "der die und das nicht mit ist von sich auf dem ein", "fr": "le la les des et une est que dans pour qui sur"}
    pick = random.Random(6)
    text = lambda lang, n: " ".join(pick.choice(words[lang].split()) for _ in range(n))
    learned = [(lang, text(lang, pick.randrange(20, 200))) for lang in words for _ in range(30)]
    dictionaries = langid.fit(spark.createDataFrame([*learned, *learned, (None, "x"), ("en", None)], "lang string, text string"), per_lang=12)
    assert set(dictionaries) == set(words)
    for lang, own in dictionaries.items():  # twelve whole texts of the language
        rest = own.decode()
        parts = [langid.folded(t).decode() for k, t in learned if k == lang and langid.folded(t).decode() in rest]
        assert len(own) == sum(map(len, parts)) + len(parts) - 1 and len(parts) == 12
    asked = [text(pick.choice(list(words)), pick.randrange(5, 60)) for _ in range(60)]

    def size(lang, t):
        own = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=langid.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress(langid.folded(t)))

    got = [r.lang_pred for r in langid.identify(docs_of(spark, asked), dictionaries).orderBy("doc_id").collect()]
    assert got == [min(sorted(words), key=lambda lang: size(lang, t)) for t in asked]


def test_quality_votes_equal_a_plain_version(spark):
    pick = random.Random(7)
    good = lambda: " ".join(pick.choice(["Some", "plain", "words", "of", "prose,", "that", "ends."]) for _ in range(pick.randrange(5, 60)))
    bad = lambda: "|".join(pick.choice(["$$$", "BUY", "now!!", "http://x", "#1"]) for _ in range(pick.randrange(5, 60)))
    learned = [(good(), 1) for _ in range(40)] + [(bad(), 0) for _ in range(30)]
    model = quality.fit(spark.createDataFrame([*learned, learned[0], (None, 1), ("x", None)], "text string, label int"))
    assert len(model.labels) == len(set(learned))
    asked = [good() for _ in range(20)] + [bad() for _ in range(20)] + [good() + bad(), "", None]
    got = [r.score for r in quality.classify(docs_of(spark, asked), model).orderBy("doc_id").collect()]
    for text, score in zip(asked, got):
        if not text:
            assert abs(score - model.prior) < 1e-6
            continue
        latent = ((quality.features(text) - model.mean) * model.weight) @ model.axes
        near = sorted(((-float(v @ latent) / float(np.linalg.norm(latent)), i) for i, v in enumerate(model.vectors)))[: quality.NEIGHBOURS]
        weights = [max(-c, 1e-6) ** 4 for c, _ in near]
        plain = (sum(w * model.labels[i] for w, (_, i) in zip(weights, near)) + model.prior * 1e-6) / (sum(weights) + 1e-6)
        assert abs(plain - score) < 1e-3
    assert all(s > 0.5 for s in got[:20]) and all(s < 0.5 for s in got[20:40])


def test_neighbours_that_tie_go_by_place():
    rows = np.stack([quality.features(x) for x in ["a b c. d"] * 40 + ["| | !!"] * 40])
    model = quality.Model(rows.copy(), [1, 0] * 40)
    assert abs(model.score(["a b c. d"])[0] - 13 / 25) < 1e-3  # the first 25 of the 40 equal ones


def test_latent_axes_without_a_whole_decomposition():
    """The leading vectors are those of a full decomposition, in much less memory on the driver."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((1500, 400)) * 0.99 ** np.arange(400)).astype(np.float32)
    gram = rows @ rows.T
    want, vectors = np.linalg.eigh(gram.astype(np.float64))
    tracemalloc.start()
    values, found = quality.largest(gram, 48)
    assert tracemalloc.get_traced_memory()[1] < 1.5 * gram.nbytes * 2  # one matrix of doubles and a half
    tracemalloc.stop()
    assert np.allclose(values, want[-48:], rtol=1e-4) and np.allclose(found @ (found.T @ rows), vectors[:, -48:] @ (vectors[:, -48:].T @ rows), atol=0.02)
    small, _ = quality.largest(gram[:40, :40], 48)
    assert len(small) == 40
