import math
import re

import pytest

from lorespark import catalog
from lorespark.operators import graph
from lorespark.sources.corpus import corpus, markdown
from tests.compare import DATA, assert_same

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(catalog.queries()[name](spark, DATA), ORACLE[name])


def rows_of(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def test_every_other_query_has_a_test_here():
    assert set(catalog.queries()) - set(ORACLE) == {"neighborhood_capped", "force_layout", "markdown_outline"}


def test_snippets(spark):
    bodies = {(r.wiki, r.relative): r.body for r in corpus(spark, DATA).collect()}
    found = rows_of(spark, "snippets")
    assert found
    for r in found:
        body = bodies[r.wiki, r.relative]
        at = [m.start() for m in re.finditer(r"(?i)\bloser\b", body)]
        if not at:  # the word is in the title alone
            assert r.snippet is None
            continue
        most = max(sum(a <= b and b + 5 <= a + 150 for b in at) for a in at)
        assert r.snippet in body and len(r.snippet) <= 160 and len(re.findall(r"(?i)\bloser\b", r.snippet)) >= most


def test_capped_neighbourhood(spark):
    docs = corpus(spark, DATA)
    links = graph.edges(docs).filter("NOT broken").orderBy("pos").collect()
    key = lambda w, r: (w, r.split("/"))
    centre = docs.filter("doc_id = 1").select("wiki", "relative").first()
    found = {(r.wiki, r.relative): r.depth for r in rows_of(spark, "neighborhood_capped")}
    seen, queue = {tuple(centre): 0}, [tuple(centre)]
    while queue and len(seen) < len(found):
        node = queue.pop(0)
        out = [(e.to_wiki, e.to_relative) for e in links if (e.wiki, e.relative) == node]
        back = [(e.wiki, e.relative) for e in sorted(links, key=lambda e: key(e.wiki, e.relative)) if (e.to_wiki, e.to_relative) == node]
        for to in [*out, *back]:
            if to not in seen and len(seen) < len(found):
                seen[to] = seen[node] + 1
                queue.append(to)
    assert seen == found


def test_force_layout(spark):
    found = rows_of(spark, "force_layout")
    near = {(r.wiki, r.relative) for r in rows_of(spark, "neighborhood_2")}
    assert {(r.wiki, r.relative) for r in found} == near and len({(r.x, r.y) for r in found}) == len(found)
    assert all(math.isfinite(r.x) and math.isfinite(r.y) for r in found) and rows_of(spark, "force_layout") == found


def test_outline(spark):
    texts = {r.doc_id: r.markdown.split("\n") for r in markdown(corpus(spark, DATA)).collect()}
    found = {}
    for r in rows_of(spark, "markdown_outline"):
        found.setdefault(r.doc_id, []).append((r.level, r.text, r.line))
    for i, lines in texts.items():
        atx = [(len(m[1]), m[2].rstrip("# ").strip(), n + 1) for n, line in enumerate(lines) if (m := re.match(r"^ {0,3}(#{1,6})[ \t]+(.*)$", line))]
        assert set(atx) <= set(found[i])
        for level, text, line in set(found[i]) - set(atx):  # underlined ones, such as the header block's end
            assert level in (1, 2) and re.match(r"^ {0,3}(=+|-+)\s*$", lines[line - 1 + len(text.split("\n"))])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
