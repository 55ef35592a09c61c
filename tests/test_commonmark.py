"""Examples of the public CommonMark specification, and the extensions."""

import random

import pytest

from lorespark.functions import commonmark, markup


def flat(text):
    return [(b["kind"], b["depth"], b["text"]) for b in markup.blocks(text)]


BLOCKS = [
    ("\tfoo\tbaz\t\tbim", [("code", 0, "foo\tbaz\t\tbim")]),
    ("  - foo\n\n\tbar", [("item", 0, "foo"), ("paragraph", 1, "bar")]),
    ("- foo\n\n\t\tbar", [("item", 0, "foo"), ("code", 1, "  bar")]),
    ("***\n---\n___", [("rule", 0, "")] * 3),
    ("+++", [("paragraph", 0, "+++")]),
    ("- foo\n***\n- bar", [("item", 0, "foo"), ("rule", 0, ""), ("item", 0, "bar")]),
    ("Foo\n***\nbar", [("paragraph", 0, "Foo"), ("rule", 0, ""), ("paragraph", 0, "bar")]),
    ("# foo\n####### foo\n#5 bolt", [("heading", 0, "foo"), ("paragraph", 0, "####### foo\n#5 bolt")]),
    ("## foo ##\n  ###   bar    ###\n#\n### foo # b", [("heading", 0, "foo"), ("heading", 0, "bar"), ("heading", 0, ""), ("heading", 0, "foo # b")]),
    ("Foo *bar*\n=========\n\nFoo\nbar\n---", [("heading", 0, "Foo *bar*"), ("heading", 0, "Foo\nbar")]),
    ("> foo\n-----", [("quote", 0, "foo"), ("rule", 0, "")]),
    ("- Foo\n---", [("item", 0, "Foo"), ("rule", 0, "")]),
    ("> foo\nbar\n===", [("quote", 0, "foo\nbar\n===")]),
    ("    a simple\n      indented code block", [("code", 0, "a simple\n  indented code block")]),
    ("    chunk1\n\n    chunk2\n  \n \n \n    chunk3", [("code", 0, "chunk1\n\nchunk2\n\n\n\nchunk3")]),
    ("Foo\n    bar", [("paragraph", 0, "Foo\nbar")]),
    ("```\n<\n >\n```", [("code", 0, "<\n >")]),
    ("````\naaa\n```\n``````", [("code", 0, "aaa\n```")]),
    ("> ```\n> aaa\n\nbbb", [("quote", 0, ""), ("code", 1, "aaa"), ("paragraph", 0, "bbb")][1:]),
    ("~~~~    ruby startline=3 $%@#$\ndef foo(x)\n~~~~~~~", [("code", 0, "def foo(x)")]),
    ("foo\n```\nbar\n```\nbaz", [("paragraph", 0, "foo"), ("code", 0, "bar"), ("paragraph", 0, "baz")]),
    ("<table>\n  <tr>\n</table>\n\nokay.", [("html", 0, "<table>\n  <tr>\n</table>"), ("paragraph", 0, "okay.")]),
    ("<!-- Foo\n\nbar\n   baz -->\nokay", [("html", 0, "<!-- Foo\n\nbar\n   baz -->"), ("paragraph", 0, "okay")]),
    ("[foo]: /url \"title\"\n\n[foo]", [("paragraph", 0, "[foo]")]),
    ("[foo]: /url\n===\n[foo]", [("paragraph", 0, "===\n[foo]")]),
    ("> # Foo\n> bar\n> baz", [("heading", 1, "Foo"), ("paragraph", 1, "bar\nbaz")]),
    ("> bar\nbaz\n> foo", [("quote", 0, "bar\nbaz\nfoo")]),
    ("> - foo\n- bar", [("item", 1, "foo"), ("item", 0, "bar")]),
    ("> foo\n\n> bar", [("quote", 0, "foo"), ("quote", 0, "bar")]),
    ("> foo\n>\n> bar", [("quote", 0, "foo"), ("paragraph", 1, "bar")]),
    ("> > > foo\nbar", [("quote", 2, "foo\nbar")]),
    ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.", [("item", 0, "A paragraph\nwith two lines."), ("code", 1, "indented code"), ("quote", 1, "A block quote.")]),
    ("- one\n\n two", [("item", 0, "one"), ("paragraph", 0, "two")]),
    ("-one\n\n2.two", [("paragraph", 0, "-one"), ("paragraph", 0, "2.two")]),
    ("- a\n  - b\n    - c\n- d", [("item", 0, "a"), ("item", 1, "b"), ("item", 2, "c"), ("item", 0, "d")]),
    ("-\n  foo\n-\n  ```\n  bar\n  ```", [("item", 0, "foo"), ("item", 0, ""), ("code", 1, "bar")]),
    ("-\n\n  foo", [("item", 0, ""), ("paragraph", 0, "foo")]),
    ("foo\n*\n\nfoo\n1.", [("paragraph", 0, "foo\n*"), ("paragraph", 0, "foo\n1.")]),
    ("The number is\n14.  doors", [("paragraph", 0, "The number is\n14.  doors")]),
    ("The number is\n1.  doors", [("paragraph", 0, "The number is"), ("item", 0, "doors")]),
    ("  1.  A paragraph\nwith lazy lines.", [("item", 0, "A paragraph\nwith lazy lines.")]),
    ("> 1. > Blockquote\ncontinued here.", [("item", 1, ""), ("quote", 2, "Blockquote\ncontinued here.")]),
    ("- foo\n  - bar\n\n\n      baz", [("item", 0, "foo"), ("item", 1, "bar"), ("paragraph", 2, "baz")]),
    ("- [x] done\n- [ ] open\n- [] no", [("task", 0, "done"), ("task", 0, "open"), ("item", 0, "[] no")]),
    ("| a | b |\n| - | :-: |\n| 1 | x \\| y |\n| 2 |\n\nend", [("table_row", 0, "a\tb"), ("table_row", 0, "1\tx | y"), ("table_row", 0, "2\t"), ("paragraph", 0, "end")]),
    ("a | b\nno", [("paragraph", 0, "a | b\nno")]),
    ("text[^1]\n\n[^1]: note\n    more\n\n    second", [("paragraph", 0, "text[^1]"), ("footnote", 0, "note\nmore"), ("paragraph", 1, "second")]),
    ("> [!NOTE] Heed\n> this", [("callout", 0, "Heed\nthis")]),
    ("$$\na + b\n$$\n$$c$$", [("math", 0, "a + b"), ("math", 0, "c")]),
    ("", []),
]


@pytest.mark.parametrize("text, want", BLOCKS)
def test_blocks(text, want):
    assert flat(text) == want


def tree(spans):
    return "".join(s.text if s.kind == "text" else f"<{s.kind}{' ' + s.target if s.target is not None else ''}>{s.text or tree(s.children)}</>" for s in spans)


SPANS = [
    ("*foo bar*", "<emphasis>foo bar</>"), ("a * foo bar*", "a * foo bar*"), ('a*"foo"*', 'a*"foo"*'), ("foo*bar*", "foo<emphasis>bar</>"), ("_foo bar_", "<emphasis>foo bar</>"),
    ("foo_bar_", "foo_bar_"), ("foo-_(bar)_", "foo-<emphasis>(bar)</>"), ("*(*foo*)*", "<emphasis>(<emphasis>foo</>)</>"), ("_foo_bar_baz_", "<emphasis>foo_bar_baz</>"),
    ("**foo bar**", "<strong>foo bar</>"), ("foo__bar__", "foo__bar__"), ("**Gomphocarpus (*Gomphocarpus physocarpus*, syn.)**", "<strong>Gomphocarpus (<emphasis>Gomphocarpus physocarpus</>, syn.)</>"),
    ("*foo**bar**baz*", "<emphasis>foo<strong>bar</>baz</>"), ("*foo**bar*", "<emphasis>foo**bar</>"), ("***foo** bar*", "<emphasis><strong>foo</> bar</>"), ("*foo **bar***", "<emphasis>foo <strong>bar</></>"),
    ("foo***bar***baz", "foo<emphasis><strong>bar</></>baz"), ("**foo*", "*<emphasis>foo</>"), ("*foo**", "<emphasis>foo</>*"), ("****foo****", "<strong><strong>foo</></>"), ("***foo***", "<emphasis><strong>foo</></>"),
    ("*foo _bar* baz_", "<emphasis>foo _bar</> baz_"), ("**foo **bar baz**", "**foo <strong>bar baz</>"), ("*[bar*](/url)", "*<link /url>bar*</>"), ("*a `*`*", "<emphasis>a <code>*</></>"),
    ("`foo`", "<code>foo</>"), ("`` foo ` bar ``", "<code>foo ` bar</>"), ("`  ``  `", "<code> `` </>"), ("`foo\\`bar`", "<code>foo\\</>bar`"), ("```foo``", "```foo``"),
    ("\\*not emphasized*", "*not emphasized*"), ("&amp; &copy; &#35;", "& © #"), ("<http://foo.bar.baz>", "<link http://foo.bar.baz>http://foo.bar.baz</>"), ("a <b>c</b>", "a <html><b></>c<html></b></>"),
    ('[link](/uri "title")', "<link /uri>link</>"), ("[link]()", "<link >link</>"), ("[link](</my uri>)", "<link /my uri>link</>"), ("[link](foo(and(bar)))", "<link foo(and(bar))>link</>"),
    ("[link [bar](/uri)](/uri)", "[link <link /uri>bar</>](/uri)"), ("![foo *bar*](train.jpg)", "<image train.jpg>foo <emphasis>bar</></>"), ("[foo][bar]", "<link /url>foo</>"), ("[Foo\nBAR][]", "[Foo\nBAR][]"),
    ("[bar]", "<link /url>bar</>"), ("[BaR][]", "<link /url>BaR</>"), ("[foo][nope]", "[foo][nope]"), ("[bar](not a link)", "<link /url>bar</>(not a link)"), ("~~gone~~ ~one~", "<strike>gone</> <strike>one</>"),
    ("[[Page#a|shown]] [^n] $x_1$ cost $5", "<wiki Page#a|shown>shown</> <note>n</> <math>x_1</> cost $5"),
]


@pytest.mark.parametrize("text, want", SPANS)
def test_spans(text, want):
    assert tree(commonmark.inline(text, {"bar": ("/url", None)})) == want


def test_reference_links_and_levels():
    got = markup.parse_markdown("Title\n===\n\nsee [the *page*][p] and `code`\n\n> - quoted **item**\n\n    raw *code*\n\n[p]: <x y> 'T'\n## `fn` two\n<div>\n*no*\n</div>")
    assert got["headings"] == ["Title", "fn two"] and got["body"] == "see the page and code quoted item raw *code* fn"
    assert [(h["level"], h["line"]) for h in markup.blocks("# a\n\nb\nc\n---\n### d") if h["kind"] == "heading"] == [(1, 1), (2, 3), (3, 6)]


def test_any_text_is_parsed():
    rng = random.Random(6)
    pieces = ["> ", "- ", "1. ", "    ", "```", "\n", "\n\n", "*", "**", "_", "[", "](x)", "]", "| a |", "|-|", "<div>", "<!--", "$$", "[^1]: ", "\\", "`", "&amp;", "word", " ", "\t", "#", "===", "---", "[!NOTE]", "~~", "[a]: b"]
    for _ in range(1500):
        text = "".join(rng.choices(pieces, k=rng.randrange(40)))
        found = markup.parse_markdown(text)
        assert all(1 <= b["line"] <= text.count("\n") + 1 for b in markup.blocks(text)), text
        assert isinstance(found["body"], str)
    deep = "> " * 300 + "x\n" + "- " * 200 + "y\n" + "*a " * 500 + "[" * 500
    assert markup.blocks(deep)
