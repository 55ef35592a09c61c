import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lorespark.errors import ConfigError, IndexMissing, LoreError, NotFound, NotSearchable, UnclosedQuote
from lorespark.functions import files, markup, text
from lorespark.operators import delta, fuzzy, graph, pages, reports, resolve, search
from lorespark.plans.query import Term, parse
from lorespark.sources import files as source
from lorespark.sources import folders
from lorespark.sources.corpus import generated
from lorespark.sources.registry import Registry, Wiki, environment, expand, layered, settings_of
from lorespark.streaming import changes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_query_language():
    assert parse("heap exploitation") == [Term("text", "heap"), Term("text", "exploitation")]
    assert parse('title:"memory management"') == [Term("title", "memory management")]
    assert parse("tag:security -tag:web heap") == [Term("tag", "security"), Term("tag", "web", True), Term("text", "heap")]
    assert parse('"tag:web"') == [Term("tag", "web")]
    assert parse("foo:bar - x") == [Term("text", "foo:bar"), Term("text", "-"), Term("text", "x")]
    with pytest.raises(UnclosedQuote):
        parse('title:"unclosed')


DOC = "doc_id long, wiki string, relative string, content_type string, title string, aliases array<string>, tags array<string>, headings array<string>, body string, links array<string>, size long"


def docs_of(spark, rows):
    full = [(i, r.get("wiki", "main"), r["relative"], r.get("kind", "markdown"), r.get("title", ""), r.get("aliases", []), r.get("tags", []), [], r.get("body", ""), r.get("links", []), len(r.get("body", ""))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DOC)


@pytest.fixture(scope="module")
def small(spark):
    return docs_of(spark, [
        {"relative": "index.md", "title": "Home", "tags": ["home"], "links": ["about", "broken"]},
        {"relative": "about.md", "title": "About", "tags": ["info", "home"], "links": ["index"]},
        {"relative": "logo.png", "kind": "image", "title": "Logo"},
    ]).withColumn("images", F.when(F.col("relative") == "about.md", F.array(F.lit("logo.png"))).otherwise(F.array().cast("array<string>")))


def test_graph(spark, small):
    links = graph.edges(small, "images")
    assert tuple(graph.stats(graph.nodes(small), links).first()) == (3, 4, 1)
    assert graph.outgoing(links, "main", "index.md").count() == 2
    assert [r.relative for r in graph.backlinks(links, "main", "about.md").collect()] == ["index.md"]
    best = graph.related(small, links, "main", "index.md").first()
    assert (best.relative, best.score) == ("about.md", 23.0)
    assert graph.neighborhood(graph.nodes(small), links, "main", "none.md").count() == 0
    assert "logo.png" in [r.to_relative for r in links.filter("kind = 'embeds'").collect()]


def test_graph_cycle_and_cap(spark):
    pair = docs_of(spark, [{"relative": "a.md", "links": ["b"]}, {"relative": "b.md", "links": ["a"]}])
    assert graph.neighborhood(graph.nodes(pair), graph.edges(pair), "main", "a.md", 5).count() == 2
    hub = docs_of(spark, [{"relative": "hub.md", "links": [f"leaf{i:02}" for i in range(50)]}, *[{"relative": f"leaf{i:02}.md"} for i in range(50)]])
    got = [r.relative for r in graph.neighborhood(graph.nodes(hub), graph.edges(hub), "main", "hub.md", 2, 10).collect()]
    assert len(got) == 10 and "hub.md" in got and set(got) == {"hub.md", *[f"leaf{i:02}.md" for i in range(9)]}


def test_capped_walk_equals_plain_walk(spark):
    pick = random.Random(4)
    rows = [{"relative": f"p{i:02}.md", "links": [f"p{pick.randrange(30):02}" for _ in range(3)]} for i in range(30)]
    docs = docs_of(spark, rows)
    out = {r["relative"]: [x + ".md" for x in r["links"]] for r in rows}
    back = {r: [(s, i) for s in sorted(out) for i, t in enumerate(out[s]) if t == r] for r in out}
    for most in (3, 9, 17):
        seen, queue = ["p00.md"], [("p00.md", 0)]
        while queue and len(seen) < most:
            node, depth = queue.pop(0)
            for to in [*out[node], *[s for s, _ in back[node]]] if depth < 3 else []:
                if to not in seen and len(seen) < most:
                    seen.append(to)
                    queue.append((to, depth + 1))
        got = {r.relative for r in graph.neighborhood(graph.nodes(docs), graph.edges(docs), "main", "p00.md", 3, most).collect()}
        assert got == set(seen)


def test_search(spark):
    docs = docs_of(spark, [
        {"relative": "A.md", "title": "Page Alpha", "tags": ["alpha"], "body": "heap allocation"},
        {"relative": "B.md", "title": "Page Beta", "body": "memory exploitation of memory"},
        {"relative": "C.md", "title": "Page Gamma", "body": "networking"},
    ])
    names = lambda q, **o: [r.relative for r in search.search(docs, q, **o).orderBy("rank").collect()]
    assert names("allocation") == ["A.md"] and names("page memory") == ["B.md"] and names('"heap networking"') == ["C.md", "A.md"]
    assert names("-tag:alpha page") == ["B.md", "C.md"] and names("-heap page") == ["B.md", "C.md"] and len(names("-heap page", strict=False)) == 3
    assert names("") == ["A.md", "B.md", "C.md"] and names("-tag:alpha") == [] and names("beta") == ["B.md"]
    with pytest.raises(NotSearchable):
        names("linksto:A")
    assert [r.snippet for r in search.with_snippets(search.search(docs, "memory"), docs, "memory").collect()] == ["memory exploitation of memory"]


def test_fuzzy():
    assert fuzzy.score("hp", "heap")[1] == [0, 3] and fuzzy.score("sh", "security/heap.md")[1] == [0, 9]
    assert fuzzy.score("hp", "HeapPointer")[1] == [0, 3] and fuzzy.score("字漢", "漢字") is None and fuzzy.score("", "x") == (0, [])
    assert fuzzy.score("heap", "Heap")[0] > fuzzy.score("heap", "Heap Exploitation Techniques")[0]
    began = time.time()
    for _ in range(20_000):
        fuzzy.score("heapexp", "security/exploitation/heap-exploitation-techniques-2024.md")
    assert time.time() - began < 2


def test_fuzzy_operators(spark):
    own = lambda atom, hay: fuzzy.atom_score(atom, hay) is not None
    assert own("hp", "Heap") and own("Hp", "Heap") and not own("hP", "heap") and own("'ea", "Heap") and not own("'hp", "heap")
    assert own("^he", "Heap") and not own("^ea", "heap") and own("ap$", "heap") and not own("ea$", "heap") and own("^heap$", "Heap") and not own("^hea$", "heap")
    assert own("!x", "heap") and not own("!ea", "heap") and own("!^ea", "heap") and fuzzy.atom_score("!x", "heap") == 0
    docs = docs_of(spark, [{"relative": "Heap.md", "title": "Heap"}, {"relative": "sub/Heapsort.md", "title": "Heap sort"}, {"relative": "x.md", "title": "Pile", "aliases": ["Heap"]}])
    names = lambda q: [r.relative for r in fuzzy.find(docs, q).collect()]
    assert names("heap") == ["Heap.md", "sub/Heapsort.md", "x.md"] and names("^heap$") == ["Heap.md", "x.md"] and names("hp !sort") == ["Heap.md", "x.md"] and names("zz") == []


def test_pages_by_name(spark, small):
    assert [r.target for r in pages.of_page(small, "Home", "links").orderBy("pos").collect()] == ["about", "broken"]
    assert [r.relative for r in pages.of_page(small, "about", "backlinks").collect()] == ["index.md"]
    assert pages.of_page(small, "index", "related").first().relative == "about.md" and pages.of_page(small, "index", "neighborhood", depth=1).count() == 2
    with pytest.raises(NotFound):
        pages.of_page(small, "nowhere at all", "links")


def test_layouts_of_few_nodes(spark):
    docs = docs_of(spark, [{"relative": f"p{i:03}.md", "links": [f"p{i + 1:03}"]} for i in range(210)])
    links, near = graph.edges(docs), lambda n: graph.neighborhood(graph.nodes(docs), graph.edges(docs), "main", "p000.md", n)
    assert graph.layout(near(2).limit(0), links).count() == 0 and tuple(graph.layout(near(0), links).first()) == ("main", "p000.md", 0.0, 0.0)
    assert graph.layout(near(3), links).count() == 4
    ordered = [(r.y, r.x) for r in graph.drawing_order(graph.layout(near(3), links)).collect()]
    assert ordered == sorted(ordered)


def test_image_links_of_any_length(spark):
    docs = docs_of(spark, [{"relative": r, "kind": "image"} for r in ("img/a-very-long-name.png", "img/b.png", "x/b.png")] + [{"relative": "p.md"}])
    docs = docs.withColumn("images", F.when(F.col("relative") == "p.md", F.array(*map(F.lit, ["b.png", "a-very-long-name.png", "img/a", "none.gif", ".png"]))).otherwise(F.array().cast("array<string>")))
    got = {r.target: r.to_relative for r in graph.edges(docs, "images").filter("kind = 'embeds'").collect()}
    assert got == {"b.png": "img/b.png", "a-very-long-name.png": "img/a-very-long-name.png", "img/a": "img/a-very-long-name.png", "none.gif": None, ".png": "img/a-very-long-name.png"}


def test_settings_and_registry_files(tmp_path):
    (tmp_path / "a.toml").write_text('[index]\nignore = ["x"]\nhidden = true\n')
    (tmp_path / "b.toml").write_text('[index]\nignore = ["y"]\nhidden = false\n')
    s = settings_of(str(tmp_path / "a.toml"), str(tmp_path / "none.toml"), str(tmp_path / "b.toml"), env={"LORESPARK_CODE": "0"})
    assert s.ignore == ("x", "y") and not s.hidden and not s.code
    (tmp_path / "c.toml").write_text("[")
    with pytest.raises(ConfigError):
        settings_of(str(tmp_path / "c.toml"), env={})
    r = Registry([Wiki("a", "/w/\"q\"", ["b"]), Wiki("b", "~/x")], "b")
    r.save(str(tmp_path / "r.toml"))
    again = Registry.load((tmp_path / "r.toml").read_text())
    assert again.wikis == r.wikis and again.default == "b" and again.get("b").root == expand("~/x") and expand("~", "/h") == "/h" and expand("~u/x", "/h") == "~u/x"


def test_paths_stay_inside(tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "out").symlink_to(tmp_path)
    root = str(tmp_path / "w")
    assert source.inside(root, "a/../b.md") and not source.inside(root, "../x") and not source.inside(root, "/x") and not source.inside(root, "out/x") and source.inside("hdfs://x/w", "a/b")


def test_markdown_tree():
    found = markup.blocks("a[^1] ~~old~~ $x$\n\n[^1]: note\n    more\n\n$$\ny = 1\n$$\n\n> > deep\n\n- a\n    - b")
    assert [(b["kind"], b["text"], b["depth"], b["lang"]) for b in found[1:]] == [("footnote", "note\nmore", 0, "1"), ("math", "y = 1", 0, None), ("quote", "deep", 1, None), ("item", "a", 0, None), ("item", "b", 1, None)]
    tree = [(s["depth"], s["kind"], s["text"]) for s in markup.spans("**b _i_** ~~s~~ $m$ `c` [[P|x]] [t](u)[^n] z")]
    assert tree == [
        (0, "strong", "b _i_"), (1, "text", "b "), (1, "emphasis", "i"), (2, "text", "i"), (0, "text", " "), (0, "strike", "s"), (1, "text", "s"), (0, "text", " "), (0, "math", "m"), (0, "text", " "), (0, "code", "c"),
        (0, "text", " "), (0, "wiki", "P|x"), (0, "text", " "), (0, "link", "t"), (1, "text", "t"), (0, "note", "n"), (0, "text", " z"),
    ]


def test_suggestions(spark):
    names = spark.createDataFrame([(x,) for x in ("Heap", "Heap Exploitation", "Heap Allocator", "Compiler", "Analysis", "heap")], "name string")
    got = [r.name for r in fuzzy.suggestions(names, "heep").collect()]
    assert got[0] == "Heap" and "heap" not in got
    assert one(spark, text.bounded_levenshtein(F.col("a"), F.col("b"), 9), a="kitten", b="sitting") == 3
    assert one(spark, text.bounded_levenshtein(F.col("a"), F.col("b"), 2), a="aaaaaaaa", b="bbbbbbbb") == 3
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="", b="") == 1.0


def test_text_functions(spark):
    slug = lambda s: one(spark, text.heading_slug(F.col("s")), s=s)
    assert [slug(x) for x in ("Memory allocator", "C++ and Rust", "Größe", "###")] == ["memory-allocator", "c-and-rust", "größe", ""]
    assert one(spark, text.sanitize_line(F.col("s")), s="before\x1b]52;c;ZWNobyBwd25lZAo=\x07after") == "before]52;c;ZWNobyBwd25lZAo=after"
    assert one(spark, text.sanitize_line(F.col("s")), s="a\tb") == "a   b"
    assert one(spark, text.sanitize_text(F.col("s")), s="é\n\tx") == "é\n    x"
    width = lambda s: one(spark, text.display_width("s"), s=s)
    assert [width(x) for x in ("🦀", "🦀 Rust Knowledge Base", "日本語のタイトル", "Größe und Speicher")] == [2, 22, 16, 18]
    assert text.truncate_to("日本語のタイトル", 8) == "日本語…" and text.wrap_text("aa bb cc", 5) == ["aa bb", "cc"]
    assert one(spark, text.naming(F.col("s"), "slug"), s=" Heap Exploitation! ") == "heap-exploitation"
    assert one(spark, text.visible(F.col("s")), s="a\x07‮") == "a␇�"
    assert one(spark, text.safe_hyperlink(F.col("s")), s="javascript:x") is None and one(spark, text.safe_hyperlink(F.col("s")), s="https://x.org")


def test_sanitize_is_idempotent(spark):
    pick = random.Random(3)
    rows = [("".join(chr(pick.choice([9, 10, 13, 27, 65, 0x85, 0x202E, 0xFEFF, 0x1F980, 233])) for _ in range(20)),) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string").withColumn("a", text.sanitize_line(F.col("s"))).withColumn("b", text.sanitize_line(F.col("a")))
    assert df.filter("a <> b").count() == 0 and df.filter(text.is_forbidden(F.col("a"))).count() == 0


def test_file_functions(spark):
    kind = lambda p, c: one(spark, files.classify(F.col("p"), F.col("c")), p=p, c=bytearray(c))
    assert kind("a.md", b"text") == "markdown" and kind("a.md", b"\0") == "binary" and kind("a.png", b"\0") == "image" and kind("x", b"\xff\xfe") == "binary"
    assert kind("x", ("é" * 4096).encode()[1:] + b"z" * 9000) == "binary" and kind("y.txt", b"a" + ("é" * 5000).encode()) == "text"
    assert one(spark, files.human_size(F.col("n")), n=16 * 1024 * 1024) == "16.0 MiB" and one(spark, files.parse_size(F.col("s")), s="16 MiB") == 16 * 1024 * 1024
    assert one(spark, files.stem(F.col("p")), p="a/.gitignore") == ".gitignore" and one(spark, files.extension(F.col("p")), p="a.b/c") is None
    assert one(spark, files.escapes_root(F.col("p")), p="a/../../b") and not one(spark, files.escapes_root(F.col("p")), p="a/../b")
    assert files.sniff_image(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (5).to_bytes(4, "big")) == ("png", 3, 5)
    assert one(spark, files.language_for_tag(F.col("t")), t="rust,no_run") == "Rust" and one(spark, files.language(F.col("p")), p="x/CMakeLists.txt") == "CMake"


def test_links(spark):
    link = lambda s: one(spark, markup.parse_link(F.col("s")), s=s)
    assert link("rust::Ownership").asDict() | {"kind": 0} == {"kind": 0, "wiki": "rust", "name": "Ownership", "anchor": None, "line_start": None, "line_end": None, "label": None}
    assert (link("Heap#Tcache").name, link("Heap#Tcache").anchor, link("Stack|the stack").label) == ("Heap", "Tcache", "the stack")
    got = link("file:src/a.rs#L55-L30")
    assert (got.kind, got.name, got.line_start, got.line_end) == ("file", "src/a.rs", 30, 55)
    assert link("file:a#weird").name == "a#weird" and link(" | x") is None and link("a/b::c").wiki is None and link("symbol:run").kind == "symbol"
    assert one(spark, markup.page_links(F.col("s")), s="- [[One]]\n> [[Two]] |[[Three]]| [[open\n]]") == ["One", "Two", "Three"]


def test_frontmatter():
    got = markup.parse_frontmatter('---\ntitle: "a: b"\naliases: [X, y, x]\ntags:\n  - "#one"\n  - two\nstatus: ok # why\n---\nbody')
    assert (got["title"], got["aliases"], got["tags"], got["extra"], got["diagnostics"]) == ("a: b", ["X", "y"], ["one", "two"], {"status": ["ok"]}, [])
    assert got["body_line_offset"] == 8 and not markup.parse_frontmatter("no")["present"]
    notes = lambda s: [d["message"] for d in markup.parse_frontmatter(s)["diagnostics"]]
    assert "never closed" in notes("---\ntitle: x\n")[0] and "duplicate" in notes("---\na: 1\nA: 2\n---\n")[0] and "expected" in notes("---\ngarbage\n---\n")[0]
    assert "list item" in notes("---\n- x\n---\n")[0] and "single value" in notes("---\ntitle:\n---\n")[0] and markup.parse_frontmatter("---\r\ntitle: x\r\n---\r\n")["title"] == "x"


def test_header_lines_and_entries():
    parse = markup.parse_frontmatter
    got = parse("\ufeff---\na:\n  b: 1\n  - c\n-\n: x\n- y\n# why\n'k: 1': v\nTags: [ '#A', a, b # c ]\nalias: one\nTITLE: t\n...\nrest")
    assert got["extra"] == {"a": ["c"], "'k: 1'": ["v"]} and (got["title"], got["tags"], got["aliases"]) == ("t", ["A", "b"], ["one"])
    assert [d["line"] for d in got["diagnostics"]] == [3, 5, 6, 7] and got["body_line_offset"] == 13 and "rest" == "\ufeff---\na:\n  b: 1\n  - c\n-\n: x\n- y\n# why\n'k: 1': v\nTags: [ '#A', a, b # c ]\nalias: one\nTITLE: t\n...\nrest".encode()[got["body_offset"] :].decode()
    assert parse("---\nt: 'a' b\nu: \"\nv: ''\n---")["extra"] == {"t": ["'a' b"], "u": ['"'], "v": [""]}
    assert parse("--- \nx: 1\n---\n")["present"] is False and parse("---\n---")["present"] and parse("")["diagnostics"] == []
    assert "…" in parse("---\n" + "g" * 50 + "\n---\n")["diagnostics"][0]["message"]


def test_equal_events_keep_their_owners(spark):
    events = spark.createDataFrame([("/a/x", 1), ("/a/x", 1), ("/a/b/y", 2), ("/c", 3)], "path string, n int")
    roots = spark.createDataFrame([("outer", "/a"), ("inner", "/a/b/")], "name string, root string")
    found = sorted(map(tuple, changes.owned(events, roots).collect()))
    assert found == [("/a/b/y", 2, "inner", "y"), ("/a/x", 1, "outer", "x"), ("/a/x", 1, "outer", "x")]


def test_shared_characters_leave_no_suggestion_out(spark):
    rng = random.Random(12)
    names = sorted({"".join(rng.choices("abcdE é", k=rng.randrange(1, 12))) for _ in range(400)})
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    stored = fuzzy.grams(frame).cache()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for q in ("abcd", "E", "dcba dé", "aaaa"):
        alike = {n: round(1 - edits(q.lower(), n.lower()) / max(len(q), len(n)), 4) for n in names}
        want = {n: x if x >= 0.55 else 0.54 for n, x in alike.items() if x >= 0.55 or q.lower() in n.lower()}
        order, last = [], None
        for n in sorted(want, key=lambda n: (-want[n], n)):
            if text_fold(n) != last:
                order.append(n)
            last = text_fold(n)
        assert [r.name for r in fuzzy.suggestions(frame, q, 1000, stored).collect()] == order
        scored = fuzzy.near_names(stored, q)
        assert set(want) <= {r.name for r in scored.collect()} and scored.count() < len(names)


def text_fold(name):
    return "".join(c.lower() if c.isascii() else c for c in name)


def test_names_that_are_not_neighbours_stay(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.name for r in fuzzy.suggestions(names("Heap", "Zeap", "heap"), "xeap").collect()] == ["Heap", "Zeap", "heap"]
    assert [r.name for r in fuzzy.suggestions(names("Heap", "heap", "heaP"), "xeap").collect()] == ["Heap"]
    assert len(fuzzy.suggestions(names(*(f"h{i:02}p" for i in range(90))), "h00p", 7).collect()) == 7


def test_markdown():
    got = markup.parse_markdown("# Head `code`\n\nSome **bold** [link](x) text\n\n```rust\nlet a;\n```\n\nSetext\n======\n- [x] done\n[[Page#a|l]]")
    assert got["headings"] == ["Head code", "Setext"] and got["links"] == ["Page"] and "let a;" in got["body"] and "bold link text" in got["body"]
    assert [b["kind"] for b in markup.blocks("> [!NOTE] x\n\n|a|b|\n|-|-|\n|1|2|\n\n---\n1. i")] == ["callout", "table_row", "table_row", "rule", "item"]


def test_resolution(spark):
    docs = docs_of(spark, [{"relative": "Heap-Exploitation.md", "title": "Heap"}, {"relative": "Security/index.md"}, {"relative": "sub/Heap.md", "aliases": ["Pile"]}, {"relative": "Heap.txt", "kind": "text"}])
    find = lambda n: tuple(resolve.resolve(docs, n).first() or ())
    assert find("Heap Exploitation") == ("main", "Heap-Exploitation.md", "exact_stem") and find("Security") == ("main", "Security/index.md", "exact_stem")
    assert find("heap-exploitation") == ("main", "Heap-Exploitation.md", "case_insensitive") and find("Pile") == ("main", "sub/Heap.md", "alias") and find("nothing") == ()
    assert find("Heap.txt") == ("main", "Heap.txt", "exact_path")


def test_registry():
    r = Registry.load('default_wiki = "a"\n[[wikis]]\nname = "a"\nroot = "/w/a"\nmounts = ["b"]\n[[wikis]]\nname = "b"\nroot = "/w/a/b"\nmounts = ["a", "c"]\n')
    assert [w.name for w in r.search_order("a")] == ["a", "b"] and r.missing_mounts() == [("b", "c")] and r.owner("/w/a/b/x.md").name == "b"
    r.rename("b", "z")
    assert r.get("a").mounts == ["z"]
    r.remove("z")
    assert r.get("a").mounts == [] and [w.name for w in r.select()] == ["a"]
    with pytest.raises(NotFound):
        r.get("z")
    with pytest.raises(ConfigError):
        Registry([Wiki("a", "/"), Wiki("a", "/")])
    s = layered({"ignore": ["a"]}, {"ignore": ["b"], "hidden": True}, environment(env={"LORESPARK_WIDTH": "80"}))
    assert s.ignore == ("a", "b") and s.hidden and s.width == 80
    with pytest.raises(ConfigError):
        layered({"nope": 1})


def write_files(root, pages):
    for name, body in pages.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def test_index_lifecycle(spark, tmp_path):
    wiki, store = tmp_path / "wiki", delta.Store(spark, str(tmp_path / "index"))
    write_files(wiki, {
        "Kiln.md": "---\ntitle: Firing a kiln\ntags: [clay]\n---\nglazes melt [[Loom]]", "Loom.md": "warp and weft", "Forge.md": "anvils",
        ".git/x.md": "no", ".gitignore": "*.log\n", "x.log": "no",
    })
    read = []

    def update(**options):
        def documents(files):
            read.append(sorted(r.relative for r in files.collect()))
            return source.documents(source.with_content(spark, files))

        return delta.reconcile(store, source.scan(spark, str(wiki)), documents, **options)

    hits = lambda q: sorted(r.relative for r in search.search(store.read("documents"), q).collect())
    with pytest.raises(IndexMissing):
        store.read("documents")
    assert delta.state(store) == "absent" and update() == ("rebuilt", {"reason": "absent", "documents": 3}) and hits("glazes") == ["Kiln.md"]
    assert store.read("documents").filter("relative = 'Kiln.md'").select("title", "tags", "links").first() == ("Firing a kiln", ["clay"], ["Loom"])
    assert update() == ("current", {}) and len(read) == 1  # nothing is read, and no more is asked
    write_files(wiki, {"Loom.md": "shuttles fly to and fro"})
    assert update() == ("updated", {"added": 0, "modified": 1, "deleted": 0}) and hits("shuttles") == ["Loom.md"] and read[-1] == ["Loom.md"]
    (wiki / "Forge.md").unlink()
    (wiki / "Kiln.md").rename(wiki / "Oven.md")
    assert update() == ("updated", {"added": 1, "modified": 0, "deleted": 2}) and hits("anvils") == [] and hits("glazes") == ["Oven.md"]
    os.utime(wiki / "Loom.md", (1, 1))
    assert update() == ("updated", {"added": 0, "modified": 0, "deleted": 0}) and update() == ("current", {}) and read[-1] == ["Loom.md"] and len(read) == 4
    other = delta.Store(spark, store.root)
    assert other.lock() and update() == ("busy", {}) and not store.lock()
    store.unlock()
    assert update() == ("busy", {})
    other.unlock()
    assert update(rebuild=True) == ("rebuilt", {"reason": "asked", "documents": 2}) and update(auto_update=False) == ("as_stored", {})
    meta = store.meta()
    assert delta.status(store)["document_count"] == 2 and len(meta["segments"]) == len(meta["before"]) == 1
    assert {p.name for p in (tmp_path / "index").glob("v*")} == {meta["segments"][0]["id"], *meta["before"][0]}


def test_walks_are_handed_on(spark, tmp_path):
    """The same files whether the driver walks alone or leaves most to executors; no symbolic link, no ignored folder is opened."""
    pages = {f"{a}/{b}/p{i}.md": "x" for a in "abc" for b in ("x", "y", "_z", ".h") for i in range(3)}
    write_files(tmp_path / "w", pages | {"top.md": "x", ".gitignore": "*.log\n/b/x/\n", "a/.loreignore": "y/\n!keep.log\n", "a/x/keep.log": "x", "c/no.log": "x", "c/x/.gitignore": "!deep.log\n", "c/x/deep.log": "x"})
    (tmp_path / "w" / "link.md").symlink_to(tmp_path / "w" / "top.md")
    (tmp_path / "w" / "loop").symlink_to(tmp_path / "w")
    want = sorted([p for p in pages if "/.h/" not in p and not p.startswith(("b/x/", "a/y/"))] + ["top.md", "a/x/keep.log", "c/x/deep.log"])
    opened = []

    class Watched(folders.Folder):
        def entries(self, relative):
            opened.append(relative)
            return super().entries(relative)

    assert sorted(r[1] for r in folders.walk(Watched(str(tmp_path / "w")), [("", {})], [], False) if not r[1].startswith("a/.lore")) == want
    assert not {"b/x/", "a/y/", "a/.h/", "loop/"} & set(opened)
    for most in (1, 5, 10_000):
        found = folders.listing(spark, str(tmp_path / "w"), [], False, most)
        assert sorted(r.relative for r in found.collect()) == want
    rows = list(folders.walk(folders.Folder(str(tmp_path / "w")), [("", {})], [], False, 1))
    assert {r[1] for r in rows if r[0]} == {"a/", "b/", "c/"} and [r[1] for r in rows if not r[0]] == ["top.md"]
    assert folders.Folder(str(tmp_path / "w")).read("link.md") is None and folders.Folder(str(tmp_path)).entries("nowhere/") == []


def test_left_lock_and_broken_pointer(spark, tmp_path, monkeypatch):
    store = delta.Store(spark, str(tmp_path))
    assert store.lock()
    other = delta.Store(spark, str(tmp_path))
    assert not other.lock()
    monkeypatch.setattr(delta, "LOCK_SECONDS", -1)
    assert other.lock()
    (tmp_path / "CURRENT").write_text("{")
    assert delta.state(store) == "unreadable"
    empty = lambda: {"documents": spark.createDataFrame([], "wiki string")}
    assert delta.status(delta.open_or_create(spark, str(tmp_path), empty))["document_count"] == 0
    (tmp_path / "file").write_text("x")
    with pytest.raises(LoreError, match="nor create"):
        delta.open_or_create(spark, str(tmp_path / "file"), empty)


def test_files_that_go_or_are_too_large(spark, tmp_path):
    write_files(tmp_path, {"a.md": "# One\nfirst", "b.md": "second", "c.md": "x" * 50, "_u.md": "under", "d/_v/e.md": "deep"})
    listed = source.scan(spark, str(tmp_path), max_size=40).cache()
    assert sorted(r.relative for r in listed.collect()) == ["_u.md", "a.md", "b.md", "c.md", "d/_v/e.md"]
    (tmp_path / "b.md").unlink()
    read = source.with_content(spark, listed, 40).cache()
    assert sorted(tuple(r) for r in source.skipped(read).collect()) == [("main", "b.md", "gone"), ("main", "c.md", "too large")]
    got = {r.relative: r for r in source.documents(read).collect()}
    assert {k: (r.title, r.body) for k, r in got.items()} == {"a.md": ("One", "first"), "c.md": ("c", ""), "_u.md": ("_u", "under"), "d/_v/e.md": ("e", "deep")}
    assert got["c.md"].content_hash != hashlib.sha256(b"").hexdigest()
    assert {r.relative: r.content_hash for r in source.documents(read, compat=True).collect()}["c.md"] == hashlib.sha256(b"").hexdigest()
    assert [r.relative for r in source.should_index(listed).filter("relative LIKE 'c%'").collect()] == []


def names(spark, root, **options):
    return sorted(r.relative for r in source.scan(spark, str(root), **options).collect())


def test_ignore_files(spark, tmp_path):
    write_files(tmp_path, {
        ".gitignore": "out/\n*.o\n!keep.o\n.cache/\n!.shown.md\n", "out/a.md": "x", "b.o": "x", "keep.o": "x", "sub/out/c.md": "x", "sub/d.md": "x",
        "sub/.gitignore": "/d.md\n!e.o\n", "sub/e.o": "x", "sub/deep/d.md": "x", ".loreignore": "captures/\n!b.o\n", "captures/f.md": "x",
        ".hidden.md": "x", ".shown.md": "x", ".dir/g.md": "x", ".git/info/exclude": "h.md\n", "h.md": "x", "lorespark.toml": "x", "i [1].md": "x", "_j.md": "x",
    })
    seen = [".shown.md", "_j.md", "b.o", "i [1].md", "keep.o", "sub/deep/d.md", "sub/e.o"]
    assert names(spark, tmp_path) == seen
    assert names(spark, tmp_path, hidden=True) == sorted([*seen, ".dir/g.md", ".gitignore", ".hidden.md", "sub/.gitignore"])
    assert names(spark, tmp_path, ignore=["sub/", "*.o"]) == [".shown.md", "_j.md", "i [1].md"]
    assert [r.content for r in source.with_content(spark, source.scan(spark, str(tmp_path)).filter("relative = 'i [1].md'")).collect()] == [b"x"]


def test_render_and_raw(spark, tmp_path):
    import io

    write_files(tmp_path, {"a.md": "# T\n\ntext"})
    kinds = lambda df: [r.kind for r in df.orderBy("ord").collect()]
    assert kinds(source.render(spark, str(tmp_path / "a.md"))) == kinds(source.render(spark, io.StringIO("# T\n\ntext"))) != []
    assert source.raw(source.with_content(spark, source.scan(spark, str(tmp_path))), "main", "a.md").first().content == b"# T\n\ntext"


def test_scan_rules():
    import re

    fits = lambda g, p: bool(re.search(source.glob_regex(g), p))
    assert fits("*.log", "a/b.log") and not fits("/a.log", "x/a.log") and fits("build/", "x/build/y") and fits("a/**/b", "a/x/y/b") and not fits("?.md", "ab.md")


def test_generated(spark):
    got = generated(spark, 20)
    assert got.count() == 21 and graph.edges(got).filter("broken").count() == 0


def test_lint_and_tables(spark, small):
    assert [r.target for r in reports.lint_links(small).collect()] == ["broken"]
    cells = spark.createDataFrame([(0, 0, "日本語"), (1, 0, "a"), (0, 1, "b")], "row int, column int, text string")
    assert sorted(tuple(r) for r in reports.table_widths(cells).collect()) == [(0, 6), (1, 4)]


def test_pages(spark, tmp_path):
    from lorespark.errors import UsageError
    from lorespark.operators import outputs

    assert outputs.new_page(spark, str(tmp_path), "Notes/Heap Exploitation") == "Notes/Heap-Exploitation.md"
    with pytest.raises(FileExistsError):
        outputs.new_page(spark, str(tmp_path), "Notes/Heap Exploitation")
    with pytest.raises(UsageError):
        outputs.delete_page(str(tmp_path), "Notes/Heap-Exploitation.md")
    with pytest.raises(UsageError):
        outputs.delete_page(str(tmp_path), "../x", True)
    outputs.delete_page(str(tmp_path), "Notes/Heap-Exploitation.md", True)
    assert not (tmp_path / "Notes/Heap-Exploitation.md").exists()


def test_home_and_suggestions(spark):
    docs = docs_of(spark, [{"relative": "README.md"}, {"relative": "index.md"}, {"relative": "Heap.md"}])
    assert resolve.home(docs).first().relative == "index.md" and resolve.home(docs, "Heap.md").first().relative == "Heap.md"
    assert [r.name for r in resolve.or_suggestions(docs, "Heep")[1].collect()] == ["Heap"] and resolve.or_suggestions(docs, "Heap")[1] is None


def test_tabs_expand_line_by_line():
    """Against one look at each character; widths are only asked of cells before a tab that are not ASCII, so long texts with one tab are not looked through."""
    rng = random.Random(8)

    def plain(line):
        out = ""
        for c in line:
            out += " " * (4 - text._width(out) % 4) if c == "\t" else "" if ord(c) < 32 or 0x7F <= ord(c) < 0xA0 or c in "\u202a\u202e\u2066\u2069\ufeff" else c
        return out

    for _ in range(500):
        value = "".join(rng.choices("ab\t\n\r\x0b\x1b\x85\u2028\u202e\ufeff日é\u0301 ", k=rng.randrange(30)))
        assert text.expand_tabs_in(value) == "\n".join(map(plain, value.split("\n")))


def test_tabs_do_not_cost_a_look_at_every_character(monkeypatch):
    seen = []
    width = text._width
    monkeypatch.setattr(text, "_width", lambda t: (seen.append(len(t)), width(t))[1])
    assert text.expand_tabs_in("é" * 10_000 + "\nab\té\tc\n" + "x" * 10_000 + "\ty").count(" ") == 2 + 3 + 4
    assert sum(seen) == 1
