"""Links, header blocks and Markdown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions import commonmark, header
from lorespark.functions.arrow import arrow_function
from lorespark.functions.header import frontmatter  # noqa: F401
from lorespark.functions.text import ascii_lower, dedupe_ci

LINK = r"\[\[([^\n]*?)\]\]"
PAGE, FILE, SYMBOL = "page", "file", "symbol"
MARKDOWN = "headings array<string>, body string, links array<string>"
BLOCK = "array<struct<ord:int,depth:int,kind:string,level:int,text:string,lang:string,line:int>>"


def link_spans(body: Column) -> Column:
    """What stands between [[ and the first ]] of the same line."""
    return F.regexp_extract_all(body, F.lit(LINK), F.lit(1))


def parse_link(inner: Column) -> Column:
    """STRUCT kind, wiki, name, anchor, line_start, line_end, label; null for an empty target."""
    empty = F.lit("")
    has_label = F.contains(inner, F.lit("|"))
    target = F.trim(F.when(has_label, F.substring_index(inner, "|", 1)).otherwise(inner))
    label = F.when(has_label, F.nullif(F.trim(F.regexp_extract(inner, r"(?s)^[^|]*\|(.*)$", 1)), empty))
    is_file = ascii_lower(F.substring(target, 1, 5)) == "file:"
    is_symbol = ascii_lower(F.substring(target, 1, 7)) == "symbol:"
    rest = F.trim(F.when(is_file, F.substring(target, 6, 1 << 30)).when(is_symbol, F.substring(target, 8, 1 << 30)).otherwise(target))
    lines = r"(?s)^(.*)#\s*[Ll]?([0-9]{1,9})\s*(?:-\s*[Ll]?([0-9]{1,9})\s*)?$"
    ranged = is_file & rest.rlike(lines)
    a = F.nullif(F.regexp_extract(rest, lines, 2), empty).cast("int")
    b = F.coalesce(F.nullif(F.regexp_extract(rest, lines, 3), empty).cast("int"), a)
    path = F.when(ranged, F.regexp_extract(rest, lines, 1)).otherwise(rest)
    prefixed = r"(?s)^([^/]+?)::\s*(.+)$"
    has_wiki = ~is_symbol & path.rlike(prefixed) & (F.trim(F.regexp_extract(path, prefixed, 1)) != "")
    wiki = F.when(has_wiki, F.trim(F.regexp_extract(path, prefixed, 1)))
    after = F.when(has_wiki, F.regexp_extract(path, prefixed, 2)).otherwise(path)
    anchored = ~is_file & ~is_symbol & F.contains(after, F.lit("#"))
    name = F.when(anchored, F.trim(F.substring_index(after, "#", 1))).when(is_file, after).otherwise(F.trim(after))
    anchor = F.when(anchored, F.nullif(F.trim(F.regexp_extract(after, r"(?s)^[^#]*#(.*)$", 1)), empty))
    kind = F.when(is_file, FILE).when(is_symbol, SYMBOL).otherwise(PAGE)
    valid = (target != "") & ((name != "") | (~is_file & ~is_symbol & anchor.isNotNull()))
    return F.when(
        valid,
        F.struct(kind.alias("kind"), wiki.alias("wiki"), name.alias("name"), anchor.alias("anchor"), F.when(ranged, F.least(a, b)).alias("line_start"), F.when(ranged, F.greatest(a, b)).alias("line_end"), label.alias("label")),
    )


def link_text(link: Column) -> Column:
    """What a link shows."""
    page = F.concat(F.when(link["wiki"].isNotNull(), F.concat(link["wiki"], F.lit("::"))).otherwise(""), link["name"], F.when(link["anchor"].isNotNull(), F.concat(F.lit("#"), link["anchor"])).otherwise(""))
    return F.coalesce(link["label"], page)


def parse_frontmatter(text: str) -> dict:
    return vars(header.parse(text))


def page_links(body: Column) -> Column:
    """Names of the pages that a text links to, in order; wiki and anchor are not part of a name."""
    parsed = F.transform(link_spans(body), parse_link)
    return F.transform(F.filter(parsed, lambda x: x["kind"] == PAGE), lambda x: x["name"])


def link_class(target: Column) -> Column:
    """heading, external, file or wiki"""
    return F.when(F.startswith(target, F.lit("#")), "heading").when(target.rlike("(?i)^([a-z][a-z0-9+.-]*://|mailto:)"), "external").when(target.rlike(r"(?i)^file:|/|\.[a-z0-9]+$"), "file").otherwise("wiki")


def blocks(text: str) -> list[dict]:
    """Blocks of a page as a flat list, see `commonmark.rows`."""
    return commonmark.rows(text)[0]


def spans(text: str, links: dict | None = None) -> list[dict]:
    """The inline tree of a block's text as a flat list of (depth, kind, text): code, images (alt), wiki links, footnote marks, links, strong, struck and
    emphasised text, mathematics, HTML, and plain text between them; what a node holds follows one deeper."""
    out: list[dict] = []

    def walk(nodes: list[commonmark.Span], depth: int) -> None:
        for s in nodes:
            own = s.target if s.kind == "wiki" else s.text or "".join(c.shown() if s.kind == "image" else c.source() for c in s.children)
            out.append({"depth": depth, "kind": "alt" if s.kind == "image" else s.kind, "text": own})
            if s.kind != "image":
                walk(s.children, depth + 1)

    walk(commonmark.inline(text, links), 0)
    return out


@arrow_function("array<struct<depth:int,kind:string,text:string>>")
def markdown_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([spans(t or "") for t in texts], dtype="object")


def inline_text(text: str, links: dict | None = None) -> str:
    """Visible text of a block: marks of emphasis, code and links dropped."""
    return commonmark.shown(text, links)


@arrow_function("string")
def plain_text(texts: pd.Series) -> pd.Series:
    """Visible text of blocks."""
    return pd.Series([None if t is None else inline_text(t) for t in texts], dtype="object")


def parse_markdown(text: str) -> dict:
    """Headings, all visible text joined by spaces, and linked page names."""
    headings, body, links = [], [], []
    rows, known = commonmark.rows(text)
    for b in rows:
        if b["kind"] in ("rule", "html"):
            continue
        shown = b["text"] if b["kind"] in ("code", "math") else inline_text(b["text"], known)
        if b["kind"] == "heading":
            headings.append(re.sub(r"\s+", " ", shown).strip())
            body += [s.text for s in commonmark.inline(b["text"], known) if s.kind == "code"]
        elif shown:
            body.append(re.sub(r"\s*\n\s*", " ", shown))
    for inner in re.findall(LINK, text):
        target = inner.split("|")[0].strip()
        if target and not re.match("(?i)file:|symbol:", target):
            name = re.sub(r"^([^/]+?)::\s*(?=.)", "", target).split("#")[0].strip()
            links.append(name)
    return {"headings": headings, "body": " ".join(body), "links": links}


@arrow_function(MARKDOWN)
def markdown(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_markdown(t or "") for t in texts], columns=["headings", "body", "links"])


@arrow_function(BLOCK)
def markdown_blocks(texts: pd.Series) -> pd.Series:
    return pd.Series([blocks(t or "") for t in texts], dtype="object")


def outline(text: Column) -> Column:
    """ARRAY<STRUCT<level, text, line>> of headings."""
    return F.transform(F.filter(markdown_blocks(text), lambda b: b["kind"] == "heading"), lambda b: F.struct(b["level"].alias("level"), b["text"].alias("text"), b["line"].alias("line")))


def first_heading(text: Column) -> Column:
    """The first `# ` heading outside fences within 400 lines, or null."""
    lines = F.transform(F.slice(F.split(text, "\r?\n"), 1, 400), lambda line: F.trim(line))
    start = F.struct(F.lit(False).alias("fence"), F.lit(None).cast("string").alias("title"))

    def step(s: Column, line: Column) -> Column:
        mark = line.rlike("^(```|~~~)")
        title = F.nullif(F.trim(F.regexp_replace(F.trim(F.substring(line, 3, 1 << 30)), "#+$", "")), F.lit(""))
        found = F.when(~mark & ~s["fence"] & F.startswith(line, F.lit("# ")), title)
        return F.struct(F.when(mark, ~s["fence"]).otherwise(s["fence"]).alias("fence"), F.coalesce(s["title"], found).alias("title"))

    return F.aggregate(lines, start, step)["title"]


def clean_tags(tags: Column) -> Column:
    return dedupe_ci(F.transform(tags, lambda t: F.trim(F.regexp_replace(t, "^#+", ""))))
