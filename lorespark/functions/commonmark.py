"""Markdown as a tree of blocks and of inline spans, after the public CommonMark specification, with tables, footnotes, task items, callouts,
struck text, mathematics and wiki links.

Blocks are found line by line: a line first continues the containers that are open (quotes, list items, notes), then opens new ones, and what is left of it
belongs to a leaf; a paragraph takes lines that continue none of its containers (lazy lines). Inline text is a list of nodes in which runs of `*`, `_` and
`~` are matched afterwards, by what stands on either side of them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
TAG = r"(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)"
#: How HTML blocks begin and end; those with no end last to an empty line, and the last kind does not interrupt a paragraph.
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r"<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile(r"<![A-Za-z]"), re.compile(">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{TAGS.replace(' ', '|')})(?:\s|/?>|$)", re.I), None), (re.compile(rf"{TAG}\s*$"), None),
]
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
TASK = re.compile(r"\[([ xX])\][ \t]+(?=\S)")
NOTE = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*")
CALLOUT = re.compile(r"\[!(\w+)\][+-]?[ \t]*([^\n]*)(?:\n|$)")
DELIMITER_ROW = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
TITLE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"
DESTINATION = r"<(?:[^<>\n\\]|\\.)*>|(?!<)(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))+"
DEFINITION = re.compile(rf"[ ]{{0,3}}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*({DESTINATION})(?:[ \t]*(?:[ \t]|\n)[ \t]*({TITLE}))?[ \t]*(?:\n|$)")


@dataclass
class Block:
    kind: str
    line: int
    level: int = 0
    lang: str | None = None
    indent: int = 0
    lines: list[str] = field(default_factory=list)
    children: list[Block] = field(default_factory=list)
    fence: str = ""
    end: re.Pattern | None = None

    def text(self) -> str:
        return "\n".join(self.lines)


CONTAINERS = ("document", "quote", "item", "footnote")


def _spread(line: str) -> str:
    """Tabs of the indentation as spaces."""
    rest = line.lstrip(" \t")
    return line[: len(line) - len(rest)].expandtabs(4) + rest


class Parser:
    """The blocks of a text; `links` are its reference definitions."""

    def __init__(self, text: str):
        self.links: dict[str, tuple[str, str | None]] = {}
        self.document = Block("document", 1)
        self.open = [self.document]
        for number, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
            self._line(_spread(line), number)
        while self.open:
            self._close()

    def _close(self) -> None:
        block = self.open.pop()
        if block.kind == "paragraph":
            text = block.text()
            while m := DEFINITION.match(text):
                self.links.setdefault(_label(m[1]), (_unescaped(m[2].strip("<>") if m[2][0] == "<" else m[2]), m[3] and _unescaped(m[3][1:-1])))
                block.line += m.group().count("\n")
                text = text[m.end() :]
            block.lines = text.split("\n") if text.strip() else []
            if not block.lines:
                self.open[-1].children.remove(block)
        elif block.kind == "code" and not block.fence:
            while block.lines and not block.lines[-1].strip():
                block.lines.pop()

    def _add(self, block: Block) -> Block:
        while self.open[-1].kind not in CONTAINERS:
            self._close()
        self.open[-1].children.append(block)
        self.open.append(block)
        return block

    def _continued(self, line: str) -> tuple[int, str]:
        """How many open containers a line continues, and what is left of it."""
        held = 0
        for block in self.open:
            if block.kind not in CONTAINERS:
                break
            indent = len(line) - len(line.lstrip(" "))
            if block.kind == "quote":
                if indent > 3 or not line.lstrip(" ").startswith(">"):
                    break
                line = _after_quote(line)
            elif block.kind in ("item", "footnote"):
                if line.strip():
                    if indent < block.indent:
                        break
                    line = line[block.indent :]
                elif not block.children:  # an item may begin with one empty line
                    break
            held += 1
        return held, line

    def _line(self, line: str, number: int) -> None:
        held, line = self._continued(line)
        containers = sum(b.kind in CONTAINERS for b in self.open)
        leaf = self.open[-1] if self.open[-1].kind not in CONTAINERS else None
        whole = held == containers
        if leaf and whole and leaf.kind in ("code", "html", "math") and self._goes_on(leaf, line):
            return
        leaf = self.open[-1] if self.open[-1].kind not in CONTAINERS else None
        paragraph = leaf if leaf and leaf.kind == "paragraph" else None
        opened = False
        while True:
            indent, rest = len(line) - len(line.lstrip(" ")), line.strip()
            if not rest:
                break
            may_lazy = paragraph is not None and not opened
            if indent > 3:
                if may_lazy:
                    break
                self._shut(held, opened)
                if not (leaf and leaf.kind == "code" and whole):
                    self._add(Block("code", number))
                self.open[-1].lines.append(line[4:])
                return
            if may_lazy and whole and re.fullmatch(r"=+|-+", rest) and (text := self._text_of(paragraph)):
                paragraph.kind, paragraph.level, paragraph.lines = "heading", 1 if rest[0] == "=" else 2, text
                self.open.pop()
                return
            if rest[0] == ">":
                self._shut(held, opened)
                self._add(Block("quote", number))
                line, opened = _after_quote(line), True
                continue
            marker = MARKER.match(rest)
            if marker and not RULE.match(rest) and not (may_lazy and whole and (not rest[marker.end() :].strip() or (marker[2] and marker[2] != "1"))):
                self._shut(held, opened)
                after = rest[marker.end() :].expandtabs(4)
                space = len(after) - len(after.lstrip(" "))
                space = 1 if space > 4 or not after.strip() else space
                # lines of a following item of the same list are its own
                item = self._add(Block("item", number, indent=indent + marker.end() + space, lang=marker[1] if marker[2] is None else "1" + marker[1][-1]))
                line, opened = after[space:], True
                if task := TASK.match(line):
                    item.kind, item.level = "item", int(task[1] != " ")
                    item.fence, line = "task", line[task.end() :]
                continue
            if (note := NOTE.match(rest)) and not may_lazy:
                self._shut(held, opened)
                self._add(Block("footnote", number, indent=4, lang=note[1]))
                line, opened = rest[note.end() :], True
                continue
            if self._leaf(rest, line, number, held, opened, may_lazy, paragraph if whole else None):
                return
            break
        if not line.strip():
            while len(self.open) > 1 and (sum(b.kind in CONTAINERS for b in self.open) > held and not opened or self.open[-1].kind in ("paragraph", "table", "html") and self.open[-1].end is None):
                if self.open[-1].kind in CONTAINERS and self.open[-1].kind != "quote" and not self.open[-1].children and self.open[-1].line == number:
                    break
                self._close()
            return
        if paragraph is not None and not opened:  # lazy or not, it goes on
            paragraph.lines.append(line.strip(" \t") if not line.endswith("  ") else line.lstrip(" \t"))
            return
        self._shut(held, opened)
        if self.open[-1].kind == "table":
            self.open[-1].lines.append(line.strip())
            return
        self._add(Block("paragraph", number)).lines.append(line.lstrip(" \t"))

    def _text_of(self, paragraph: Block) -> list[str]:
        """A paragraph's lines without the definitions at its head."""
        text = paragraph.text()
        while m := DEFINITION.match(text):
            text = text[m.end() :]
        return text.split("\n") if text.strip() else []

    def _shut(self, held: int, opened: bool) -> None:
        """Closes what the line does not continue."""
        if not opened:
            while sum(b.kind in CONTAINERS for b in self.open) > held:
                self._close()
            if self.open[-1].kind == "paragraph":
                self._close()

    def _goes_on(self, leaf: Block, line: str) -> bool:
        """Whether a line belongs to the open code, mathematics or HTML, or ends it."""
        rest = line.strip()
        if leaf.kind == "math":
            inner, mark, _ = line.partition("$$")
            if inner.strip() or not mark:
                leaf.lines.append(inner)
            if mark:
                self._close()
            return True
        if leaf.kind == "code" and leaf.fence:
            if len(line) - len(line.lstrip(" ")) < 4 and len(rest) >= len(leaf.fence) and set(rest) == {leaf.fence[0]}:
                self._close()
            else:
                leaf.lines.append(re.sub(f"^ {{0,{leaf.indent}}}", "", line))
            return True
        if leaf.kind == "code":
            if not rest:
                leaf.lines.append(line[4:])
                return True
            if line.startswith("    "):
                leaf.lines.append(line[4:])
                return True
            self._close()
            return False
        if leaf.end is None and not rest:
            return False
        leaf.lines.append(line)
        if leaf.end is not None and leaf.end.search(line):
            self._close()
        return True

    def _leaf(self, rest: str, line: str, number: int, held: int, opened: bool, may_lazy: bool, paragraph: Block | None) -> bool:
        """Opens a leaf that begins on this line, if one does."""
        indent = len(line) - len(line.lstrip(" "))
        if m := FENCE.match(rest):
            self._shut(held, opened)
            self._add(Block("code", number, fence=m[1] or m[3], indent=indent, lang=_unescaped((m[2] or m[4] or "").strip()) or None))
        elif m := ATX.match(rest):
            self._shut(held, opened)
            self._add(Block("heading", number, len(m[1]))).lines.append((m[2] or "").strip())
            self._close()
        elif RULE.match(rest):
            self._shut(held, opened)
            self._add(Block("rule", number))
            self._close()
        elif rest.startswith("$$"):
            self._shut(held, opened)
            block = self._add(Block("math", number))
            inner, mark, _ = rest[2:].partition("$$")
            block.lines += [inner] if inner.strip() else []
            if mark:
                self._close()
        elif paragraph is not None and may_lazy and "|" in paragraph.lines[-1] and DELIMITER_ROW.match(rest) and len(_cells(rest)) == len(_cells(paragraph.lines[-1])):
            head = paragraph.lines.pop()
            if not paragraph.lines:
                self.open.pop()
                self.open[-1].children.remove(paragraph)
            self._add(Block("table", number - 1)).lines.append(head)
        elif rest[0] == "<" and (kind := next((i for i, (start, _) in enumerate(HTML) if start.match(rest) and not (may_lazy and i == len(HTML) - 1)), None)) is not None:
            self._html(kind, rest, line, number, held, opened)
        else:
            return False
        return True

    def _html(self, kind: int, rest: str, line: str, number: int, held: int, opened: bool) -> None:
        self._shut(held, opened)
        self._add(Block("html", number, end=HTML[kind][1])).lines.append(line)
        if HTML[kind][1] is not None and HTML[kind][1].search(rest):
            self._close()


def _after_quote(line: str) -> str:
    rest = line.lstrip(" ")[1:]
    return _spread(rest[1:] if rest[:1] in (" ", "\t") else rest)


def _cells(row: str) -> list[str]:
    inner = re.sub(r"^\||(?<!\\)\|$", "", row.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def _label(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold()


def _unescaped(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def rows(text: str) -> tuple[list[dict], dict]:
    """The blocks as a flat list (ord, depth, kind, level, text, lang, line), and the reference definitions.

    A quote or an item stands for its first paragraph; what else it holds follows one deeper. Cells of a table row are joined by tabs, and level 1 marks its head.
    """
    parser, out = Parser(text), []

    def add(block: Block, kind: str, text: str, depth: int, line: int | None = None, level: int | None = None, lang: str | None = None) -> None:
        out.append({"ord": len(out), "depth": depth, "kind": kind, "level": block.level if level is None else level, "text": text, "lang": lang, "line": line or block.line})

    def walk(block: Block, depth: int) -> None:
        if block.kind == "table":
            head = _cells(block.lines[0])
            for i, row in enumerate(block.lines):
                cells = (_cells(row) + [""] * len(head))[: len(head)]
                add(block, "table_row", "\t".join(cells), depth, block.line + i + (i > 0), int(i == 0))
        elif block.kind in ("quote", "item", "footnote"):
            rest, first = block.children, ""
            if rest and rest[0].kind == "paragraph":
                first, rest = rest[0].text(), rest[1:]
            call = CALLOUT.match(first) if block.kind == "quote" else None
            if call:
                add(block, "callout", (call[2] + "\n" + first[call.end() :]).strip("\n"), depth, lang=call[1].lower())
            elif first or not rest or block.kind != "quote":
                add(block, "task" if block.fence == "task" else block.kind, first, depth, lang=block.lang if block.kind == "footnote" else None)
            for child in rest:
                walk(child, depth + 1)
        else:
            shown = block.text().strip() if block.kind in ("paragraph", "math", "heading") else block.text()
            add(block, block.kind, shown, depth, lang=block.lang)

    for child in parser.document.children:
        walk(child, 0)
    return out, parser.links


# inline


@dataclass
class Span:
    kind: str
    text: str = ""
    children: list[Span] = field(default_factory=list)
    target: str | None = None
    mark: str = ""
    # of a run of marks
    opens: bool = False
    closes: bool = False
    run: int = 0

    def shown(self) -> str:
        return self.text if self.kind in ("text", "code", "math", "wiki") else "" if self.kind in ("note", "html") else "".join(c.shown() for c in self.children)

    def source(self) -> str:
        """The node as it could be written."""
        inner = self.text or "".join(c.source() for c in self.children)
        return {
            "code": f"`{inner}`", "math": f"${inner}$", "wiki": f"[[{self.target}]]", "note": f"[^{inner}]", "link": f"[{inner}]({self.target})", "image": f"![{inner}]({self.target})",
        }.get(self.kind, f"{self.mark}{inner}{self.mark}")


AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
INLINE_HTML = re.compile(rf"{TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z].*?>|<!\[CDATA\[.*?\]\]>", re.S)
TARGET = re.compile(rf"\(\s*(?:({DESTINATION})(?:\s+({TITLE}))?)?\s*\)")
PLAIN = re.compile(r"[^\\`<!\[\]*_~$&\n]+")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def _is_mark(c: str) -> bool:
    return bool(c) and not c.isalnum() and not c.isspace()


def inline(text: str, links: dict | None = None) -> list[Span]:
    """The inline tree of a block's text."""
    links, out, i, brackets = links or {}, [], 0, []
    while i < len(text):
        c = text[i]
        if m := PLAIN.match(text, i):
            out.append(Span("text", m.group()))
            i = m.end()
        elif c == "\\" and i + 1 < len(text) and re.match(r"[!-/:-@\[-`{-~\n]", text[i + 1]):
            out.append(Span("text", text[i + 1]))
            i += 2
        elif c == "`":
            run = re.compile("`+").match(text, i).group()
            m = re.compile(rf"(?<!`){run}(?!`)").search(text, i + len(run))
            if m:
                inner = text[i + len(run) : m.start()].replace("\n", " ")
                out.append(Span("code", inner[1:-1] if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip() else inner))
                i = m.end()
            else:
                out.append(Span("text", run))
                i += len(run)
        elif c == "<" and (m := AUTO.match(text, i)):
            out.append(Span("link", target=m[1], children=[Span("text", m[1])]))
            i = m.end()
        elif c == "<" and (m := INLINE_HTML.match(text, i)):
            out.append(Span("html", m.group()))
            i = m.end()
        elif c == "&" and (m := ENTITY.match(text, i)):
            out.append(Span("text", html.unescape(m.group())))
            i = m.end()
        elif m := re.compile(r"\[\[([^\]\n]+)\]\]").match(text, i):
            out.append(Span("wiki", m[1].rpartition("|")[2], target=m[1]))
            i = m.end()
        elif m := re.compile(r"\[\^([^\]\s]+)\]").match(text, i):
            out.append(Span("note", m[1]))
            i = m.end()
        elif c == "$" and (m := re.compile(r"\$(?![\s$])((?:[^$\\\n]|\\.)+?)(?<!\s)\$(?![\d$])").match(text, i)):
            out.append(Span("math", m[1]))
            i = m.end()
        elif c == "[" or text.startswith("![", i):
            brackets.append([len(out), c == "!", i + 1 + (c == "!"), True])
            out.append(Span("text", "![" if c == "!" else "["))
            i += 1 + (c == "!")
        elif c == "]" and brackets:
            i = _bracket(text, i, out, brackets, links)
        elif c in "*_~":
            run = re.compile(re.escape(c) + "+").match(text, i).group()
            before, after = text[i - 1 : i], text[i + len(run) : i + len(run) + 1]
            left = bool(after) and not after.isspace() and (not _is_mark(after) or not before or before.isspace() or _is_mark(before))
            right = bool(before) and not before.isspace() and (not _is_mark(before) or not after or after.isspace() or _is_mark(after))
            opens, closes = (left, right) if c != "_" else (left and (not right or _is_mark(before)), right and (not left or _is_mark(after)))
            out.append(Span("marks", run, opens=opens, closes=closes, run=len(run)))
            i += len(run)
        else:
            out.append(Span("text", c))
            i += 1
    return _merged(_matched(out))


def _bracket(text: str, i: int, out: list[Span], brackets: list, links: dict) -> int:
    """A closing bracket: an image or link of what is inside, if it has a target."""
    start, image, begin, active = brackets.pop()
    label, end, found = text[begin:i], i + 1, None
    if m := TARGET.match(text, i + 1):
        found, end = _unescaped((m[1] or "").strip("<>")), m.end()
    elif m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, i + 1):
        found, end = links.get(_label(m[1] or label), (None,))[0], m.end()
    if found is None and not text.startswith(("(", "["), i + 1) or found is None and _label(label) in links and end == i + 1:
        found, end = links.get(_label(label), (None,))[0], i + 1
    if found is None or not (active or image):
        out.append(Span("text", "]"))
        return i + 1
    inner = _merged(_matched(out[start + 1 :]))
    del out[start:]
    out.append(Span("image" if image else "link", children=inner, target=found))
    if not image:  # links hold no links
        for b in brackets:
            b[3] = b[1] and b[3]
    return end


def _matched(spans: list[Span]) -> list[Span]:
    """Runs of marks paired from the inside out; what stays unpaired is text."""
    out: list[Span] = []
    for s in spans:
        out.append(s)
        while s.kind == "marks" and s.closes and s.text:
            c = s.text[0]
            at = next((k for k in range(len(out) - 2, -1, -1) if out[k].kind == "marks" and out[k].opens and out[k].text[:1] == c and _fits(out[k], s)), None)
            if at is None:
                break
            opener = out[at]
            n = 2 if len(opener.text) >= 2 and len(s.text) >= 2 else 1
            if c == "~":
                n = len(s.text)
            opener.text, s.text = opener.text[n:], s.text[n:]
            kind = "strike" if c == "~" else "strong" if n == 2 else "emphasis"
            node = Span(kind, children=_merged([_plain(x) for x in out[at + 1 : -1]]), mark=c * n)
            out[at + 1 :] = [node, s]
            if not opener.text:
                del out[at]
        if s.kind == "marks" and not s.text:
            out.remove(s)
    return [_plain(s) for s in out]


def _fits(opener: Span, closer: Span) -> bool:
    if opener.text[0] == "~":
        return len(opener.text) == len(closer.text) <= 2
    # a run that can do both pairs only with runs whose lengths do not add up to a multiple of three
    both = opener.closes or closer.opens
    return not (both and (opener.run + closer.run) % 3 == 0 and (opener.run % 3 or closer.run % 3))


def _plain(s: Span) -> Span:
    return Span("text", s.text) if s.kind == "marks" else s


def _merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if s.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Span("text", out[-1].text + s.text)
        elif s.kind != "text" or s.text:
            out.append(s)
    return out


def shown(text: str, links: dict | None = None) -> str:
    """The visible text of a block."""
    return "".join(s.shown() for s in inline(text, links))
