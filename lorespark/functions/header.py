"""Header blocks of pages: lines are sorted into kinds, grouped into entries, and applied to fields by a table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd

from lorespark.functions.arrow import arrow_function

SCHEMA = "title string, aliases array<string>, tags array<string>, extra map<string,array<string>>, body_offset int, body_line_offset int, present boolean, diagnostics array<struct<line:int,message:string>>"
#: Where keys go, in lower case; any other key is kept as extra.
FIELDS = {"title": "title", "alias": "aliases", "aliases": "aliases", "tag": "tags", "tags": "tags"}
SHOWN = 40
BLOCK = re.compile("\\A\ufeff?---\r?\n(?P<lines>(?:(?!(?:---|\\.\\.\\.)\r*(?:\n|\\Z)).*\n)*)(?P<end>(?:---|\\.\\.\\.)\r*(?:\n|\\Z))?")
#: Kinds of lines; a key ends at the first colon outside of quotes.
LINE = re.compile(
    r"""\s*\Z | \s*\#.* | \s*(?P<item>-(?:[ ].*)?)\Z
    | (?P<nested>[ \t])?\s*(?P<key>(?:[^:"']|"[^"]*"|'[^']*')*):(?P<value>.*) | \s*(?P<other>.+)""",
    re.X,
)
PROBLEMS = {
    "open": "the header block is never closed",
    "other": "expected a key and a value, not `{0}`",
    "nested": "keys below other keys are not read",
    "key": "the key is missing",
    "orphan": "this list item belongs to no key",
    "item": "this list item is empty",
    "again": "duplicate of the key `{0}` on line {1}",
    "title": "`title` takes a single value",
}


@dataclass
class Entry:
    line: int
    key: str
    values: list[str]
    is_list: bool
    takes_items: bool


@dataclass
class Header:
    title: str | None = None
    aliases: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    extra: dict[str, list[str]] = field(default_factory=dict)
    body_offset: int = 0
    body_line_offset: int = 0
    present: bool = False
    diagnostics: list[dict] = field(default_factory=list)

    def problem(self, line: int, kind: str, *about) -> None:
        self.diagnostics.append({"line": line, "message": PROBLEMS[kind].format(*about)})


def scalar(value: str) -> str:
    """Without quotes around it, or without a comment behind it."""
    value = value.strip()
    quoted = re.fullmatch(r"""(["'])(.*)\1""", value, re.S)
    return quoted[2] if quoted and len(value) > 1 else re.sub(r"\s#.*\Z", "", value, flags=re.S).rstrip()


def ascii_fold(value: str) -> str:
    return value.translate({i: i + 32 for i in range(65, 91)})


def distinct(values: list[str]) -> list[str]:
    """The first of values that differ in ASCII case alone; none that is empty."""
    found: dict[str, str] = {}
    for v in filter(None, values):
        found.setdefault(ascii_fold(v), v)
    return list(found.values())


def entries(lines: list[str], header: Header) -> list[Entry]:
    """Lines from the second of the file on as entries; an item belongs to the last key above it, if that has no value of its own."""
    out: list[Entry] = []
    for number, m in enumerate(map(LINE.match, (x.rstrip() for x in lines)), 2):
        kind = m.lastgroup
        if m["item"]:
            value, owner = scalar(m["item"][1:]), out[-1] if out and out[-1].takes_items else None
            if owner and value:
                owner.values.append(value)
            else:
                header.problem(number, "item" if owner else "orphan")
        elif m["other"]:
            shown = m["other"].strip()
            header.problem(number, "other", shown if len(shown) <= SHOWN else f"{shown[:SHOWN]}…")
        elif kind and m["nested"]:
            header.problem(number, "nested")
        elif kind:
            key, value = m["key"].strip(), m["value"].strip()
            listed = re.fullmatch(r"\[(.*)\]", value, re.S)
            values = [v for v in map(scalar, listed[1].split(",")) if v] if listed else [scalar(value)] if value else []
            out.append(Entry(number, key, values, bool(listed) or not value, bool(key) and not value))
            if not key:
                header.problem(number, "key")
    return [e for e in out if e.key]


def parse(text: str) -> Header:
    """The header block of a page: fields, where the body starts, and what is wrong with it."""
    header = Header()
    block = BLOCK.match(text)
    if not block:
        return header
    if block["end"] is None:
        header.problem(1, "open")
        return header
    lines = block["lines"].split("\n")[:-1]
    header.present, header.body_offset, header.body_line_offset = True, len(block.group().encode()), len(lines) + 2
    first: dict[str, int] = {}
    for e in entries(lines, header):
        low = ascii_fold(e.key)
        if low in first:
            header.problem(e.line, "again", e.key, first[low])
        first.setdefault(low, e.line)
        match FIELDS.get(low):
            case "title" if e.is_list:
                header.problem(e.line, "title")
            case "title":
                header.title = e.values[0]
            case None:
                header.extra[e.key] = e.values
            case name:
                getattr(header, name).extend(e.values)
    header.aliases = distinct([a.strip() for a in header.aliases])
    header.tags = distinct([t.lstrip("#").strip() for t in header.tags])
    header.diagnostics.sort(key=lambda d: d["line"])
    return header


@arrow_function(SCHEMA)
def frontmatter(texts: pd.Series) -> pd.DataFrame:
    """Header blocks of a batch of texts."""
    return pd.DataFrame([vars(parse(t or "")) for t in texts], columns=[f.split()[0] for f in SCHEMA.split(", ")])
