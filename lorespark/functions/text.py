"""Scalar functions over text, as columns; all of them stay in the JVM unless said otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.arrow import arrow_function

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Control characters, bidirectional overrides and the byte order mark; the second class keeps line feeds.
FORBIDDEN = r"[\x00-\x1F\x7F\x{80}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
FORBIDDEN_TEXT = r"[\x00-\x09\x0B-\x1F\x7F\x{80}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
TOKEN_BYTES = 40


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of less than TOKEN_BYTES bytes."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) < TOKEN_BYTES))


def is_forbidden(c: Column) -> Column:
    return c.rlike(FORBIDDEN)


def sanitize_line(c: Column) -> Column:
    """Without control characters and line ends; tabs go to the next of the stops every 4 columns."""
    return F.when(F.contains(c, F.lit("\t")), expand_tabs(F.regexp_replace(c, r"[\r\n]", ""))).otherwise(F.regexp_replace(c, FORBIDDEN, ""))


def sanitize_text(c: Column) -> Column:
    """As sanitize_line, line by line: line feeds stay."""
    return F.when(F.contains(c, F.lit("\t")), expand_tabs(c)).otherwise(F.regexp_replace(c, FORBIDDEN_TEXT, ""))


def visible(c: Column) -> Column:
    """Control characters as pictures, other forbidden ones as the replacement character."""
    controls = "".join(map(chr, range(32)))
    shown = F.translate(c, controls + "\x7f", "".join(chr(0x2400 + i) for i in range(32)) + "␡")
    return F.regexp_replace(shown, FORBIDDEN, "�")


def lossy_utf8(c: Column) -> Column:
    """Bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(c.cast("string"))


def safe_hyperlink(c: Column) -> Column:
    ok = (F.octet_length(c) <= 2048) & ~c.rlike(r"[\x00-\x20\x7F]|" + FORBIDDEN) & c.rlike("(?i)^(https?|mailto|file|ftp):")
    return F.when(ok, c)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@arrow_function("int")
def display_width(texts: pd.Series) -> pd.Series:
    """Columns that a terminal uses; needs Unicode tables, so Arrow batches."""
    return texts.map(lambda t: _width(t or "")).astype("int32")


def truncate_to(text: str, width: int) -> str:
    """text, cut with an ellipsis to fit."""
    if _width(text) <= width:
        return text
    out, used = "", 0
    for c in text:
        w = _width(c)
        if used + w > width - 1:
            break
        out, used = out + c, used + w
    return out + "…" if width > 0 else ""


def truncate(c: Column, width: int) -> Column:
    cut = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else truncate_to(t, width)), "string")
    return F.when(F.char_length(c) * 2 <= width, c).otherwise(cut(c))


def pad(c: Column, width: int) -> Column:
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - display_width(c))))


def wrap_text(text: str, width: int) -> list[str]:
    lines, line, used = [], "", 0
    for word in text.split():
        w = _width(word)
        if line and used + 1 + w > width:
            lines.append(line)
            line, used = word, w
        else:
            line, used = (f"{line} {word}", used + 1 + w) if line else (word, w)
    return lines + [line] if line or not lines else lines


def wrap(c: Column, width: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: wrap_text(t or "", width)), "array<string>")(c)


#: What tabs and line feeds are kept among; lines that have tabs.
_DROPPED = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\u202a-\u202e\u2066-\u2069\ufeff]")
_TABBED = re.compile(r"[^\n\t]*\t[^\n]*")


def _expand_line(found: re.Match) -> str:
    column, parts = 0, []
    *cells, last = found.group().split("\t")
    for cell in cells:
        column += len(cell) if cell.isascii() else _width(cell)
        n = 4 - column % 4
        parts += [cell, " " * n]
        column += n
    return "".join([*parts, last])


def expand_tabs_in(text: str) -> str:
    return "\n".join(_TABBED.sub(_expand_line, line) if "\t" in line else line for line in _DROPPED.sub("", text).split("\n"))


@arrow_function("string")
def expand_tabs(texts: pd.Series) -> pd.Series:
    """Only for texts with tabs: stops depend on display width."""
    return texts.map(lambda t: None if t is None else expand_tabs_in(t))


def heading_slug(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\-_\s]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\-_\s]+", "-"), "^-|-$", "")


def naming(c: Column, policy: str) -> Column:
    """preserve, kebab, snake or slug; only slug changes case."""
    c = F.trim(c)
    if policy == "preserve":
        return c
    sign = "_" if policy == "snake" else "-"
    words = F.concat_ws(sign, F.array_remove(F.split(c, r"[^\p{L}\p{N}]+"), ""))
    return F.lower(words) if policy == "slug" else words


def naming_path(c: Column, policy: str) -> Column:
    return F.concat_ws("/", F.transform(F.split(c, "/"), lambda s: naming(s, policy)))


def cache_component(c: Column) -> Column:
    """A name as one directory of the index."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def dedupe_ci(c: Column) -> Column:
    """Without empty entries and without those that an earlier one equals but for ASCII case."""
    kept = F.filter(c, lambda x: x != "")
    folded = F.transform(kept, lambda x: ascii_lower(x))
    return F.filter(kept, lambda x, i: F.array_position(folded, ascii_lower(x)) == i + 1)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, case folded."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 beyond `most`."""
    return F.when(F.levenshtein(a, b, most) == -1, most + 1).otherwise(F.levenshtein(a, b, most))


def ellipsis(c: Column, n: int = 40) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def strip_prefix_ci(c: Column, prefix: str) -> Column:
    return F.when(ascii_lower(F.substring(c, 1, len(prefix))) == prefix.lower(), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def unquote(c: Column) -> Column:
    return F.when(c.rlike(r"""(?s)^("(.*)"|'(.*)')$""") & (F.char_length(c) >= 2), c.substr(F.lit(2), F.char_length(c) - 2)).otherwise(F.regexp_replace(c, r"\s#.*$", ""))
