"""The filter language of search: text to terms."""

from __future__ import annotations

from dataclasses import dataclass

from lorespark.errors import UnclosedQuote

KEYS = {"tag": "tag", "wiki": "wiki", "type": "type", "ext": "ext", "path": "path", "title": "title", "linksto": "linksto", "backlink": "backlink"}


@dataclass(frozen=True)
class Term:
    """kind is `text` or one of KEYS."""

    kind: str
    value: str
    negated: bool = False


def parse(query: str) -> list[Term]:
    """Terms, all of which must hold. Quotes may stand anywhere in a word and keep its spaces; a key before the first colon makes a filter, also
    where the whole word was quoted; an unknown key leaves the word as text; a leading minus negates, alone it is text."""
    words, word, quoted, open_ = [], "", False, False
    for c in query:
        if c == '"':
            open_ = not open_
            quoted = True
        elif c.isspace() and not open_:
            if word or quoted:
                words.append(word)
            word, quoted = "", False
        else:
            word += c
    if open_:
        raise UnclosedQuote(f"unclosed quote in: {query}")
    if word or quoted:
        words.append(word)
    terms = []
    for w in words:
        if not w:
            continue
        negated = len(w) > 1 and w[0] == "-"
        w = w[1:] if negated else w
        key, colon, value = w.partition(":")
        kind = KEYS.get(key.lower()) if colon else None
        terms.append(Term(kind or "text", value if kind else w, negated))
    return terms
