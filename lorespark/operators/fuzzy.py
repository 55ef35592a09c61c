"""Fuzzy finding and spelling suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import files, text

#: Scores of the subsequence matcher, bonuses of fields and limits of suggestions.
BOUNDARY, CAMEL, CONSECUTIVE, FIRST, SAME_CASE, GAP_START, GAP_MORE = 16, 14, 12, 24, 2, -6, -2
SEPARATORS = set("/\\_-. :,()[]#")
TITLE, ALIAS, LEAST, SUBSTRING = 200, 150, 0.55, 0.54


def score(needle: str, hay: str) -> tuple[int, list[int]] | None:
    """Score and places of the first-come subsequence match, or None."""
    folded = [(c.lower() or c)[0] for c in hay]
    total, at, places = 0, 0, []
    for c in needle:
        try:
            found = folded.index((c.lower() or c)[0], at)
        except ValueError:
            return None
        if found > at:
            total += GAP_START + GAP_MORE * (found - at - 1)
        total += 1 + (SAME_CASE if hay[found] == c else 0)
        if found == 0:
            total += FIRST
        elif hay[found - 1] in SEPARATORS:
            total += BOUNDARY
        elif hay[found - 1].islower() and hay[found].isupper():
            total += CAMEL
        if places and places[-1] == found - 1:
            total += CONSECUTIVE
        places.append(found)
        at = found + 1
    return (total - len(hay) // 16 if needle else 0), places


def scorer(needle: str):
    """An Arrow UDF: a column's score and places against the needle, null where it is no subsequence."""

    @F.pandas_udf("score int, positions array<int>")
    def run(hays: pd.Series) -> pd.DataFrame:
        found = [score(needle, h or "") for h in hays]
        return pd.DataFrame({"score": pd.array([f and f[0] if f else None for f in found], dtype="Int32"), "positions": [f[1] if f else None for f in found]})

    return run


def atom_score(atom: str, hay: str) -> int | None:
    """Score of one word of a query: !x must not occur, 'x must occur as it is, ^x begins and x$ ends the text; other words are subsequences.
    Capital letters in a word make it mind case."""
    negated = atom.startswith("!") and len(atom) > 1
    word = atom[1:] if negated else atom
    begin, end = word.startswith("^") and len(word) > 1, word.endswith("$") and len(word) > 1
    exact = word.startswith("'") and len(word) > 1
    word = word[begin or exact : len(word) - end]
    if not (negated or begin or end or exact):
        return (found := score(word, hay)) and found[0] if word.islower() or word == word.lower() else _cased(word, hay)
    own, text_ = (word, hay) if word != word.lower() else (word.lower(), hay.lower())
    hit = text_ == own if begin and end else text_.startswith(own) if begin else text_.endswith(own) if end else own in text_
    if negated:
        return None if hit else 0
    return score(word, hay[-len(word) :] if end and not begin else hay)[0] if hit and word else 0 if hit else None


def _cased(word: str, hay: str) -> int | None:
    """The subsequence score where all characters of the word occur in their case."""
    at = 0
    for c in word:
        at = hay.find(c, at) + 1
        if not at:
            return None
    found = score(word, hay)
    return found and found[0]


def _plain(word: str) -> bool:
    return word[0] not in "!'^" and not (word.endswith("$") and len(word) > 1)


def find(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(wiki, relative, title, score): best of title + 200, path and aliases + 150, over 0; each word of the query (see atom_score) must match
    the field. Rows that lack the letters of a plain word are left out before Python sees them."""
    words = query.split()
    if not words:
        return docs.orderBy("wiki", F.split("relative", "/")).limit(limit).select("wiki", "relative", "title", F.lit(0).alias("score"))

    @F.pandas_udf("int")
    def best(titles: pd.Series, paths: pd.Series, aliases: pd.Series) -> pd.Series:
        def one(hay: str) -> int | None:
            own = [atom_score(w, hay or "") for w in words]
            return None if None in own else sum(own)

        out = []
        for title, path, names in zip(titles, paths, aliases):
            scores = [(one(title), TITLE), (one(path), 0), *((one(a), ALIAS) for a in (names if names is not None else []))]
            out.append(max((s + bonus for s, bonus in scores if s is not None), default=0))
        return pd.Series(out, dtype="int32")

    hay = F.lower(F.concat_ws("\n", "title", "relative", "aliases"))
    for word in words:
        if _plain(word):  # letters in order, of any field
            docs = docs.filter(hay.rlike("(?s)" + ".*?".join(rf"\x{{{ord(c):X}}}" for c in word.lower() if c.isascii())))
    scored = docs.select("wiki", "relative", "title", best("title", "relative", "aliases").alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "wiki", F.split("relative", "/")).limit(limit)


def grams(names: DataFrame) -> DataFrame:
    """(name, size, gram) of distinct names(name): an index of their characters, the second `a` of a name being `a2`. To be stored where names are many."""
    own = names.select("name").distinct().withColumn("letters", F.split(F.lower("name"), ""))
    nth = F.transform("letters", lambda c, i: F.concat(c, F.size(F.filter(F.slice("letters", F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return own.select("name", F.char_length(F.lower("name")).alias("size"), F.explode(nth).alias("gram"))


def near_names(indexed: DataFrame, query: str) -> DataFrame:
    """(name): of names as `grams` has them those that may be similar enough or hold the query.

    Strings with so many edits between them share all but as many characters of the longer one; a name that holds the query has all its characters.
    """
    low, seen, asked = query.lower(), {}, []
    for c in low:
        seen[c] = seen.get(c, 0) + 1
        asked.append(f"{c}{seen[c]}")
    common = indexed.filter(F.col("gram").isin(asked)).groupBy("name", "size").agg(F.count("*").alias("common"))
    longer = F.greatest("size", F.lit(len(low)))
    return common.filter((longer - F.col("common") <= (1 - LEAST + 0.00005) * longer) | (F.col("common") == len(low))).select("name")


def suggestions(names: DataFrame, query: str, limit: int = 5, indexed: DataFrame | None = None) -> DataFrame:
    """(name, similarity) for names(name): close ones, or ones that hold the query; neighbours equal but for case count once. Edits are counted for names
    alone that share enough characters with the query; `indexed` is what `grams` gives for the names, if it is stored."""
    low = query.lower()
    alike = F.round(text.similarity(F.lit(query), F.col("name")), 4)
    near = near_names(grams(names) if indexed is None else indexed, query).select("name", alike.alias("similarity"))
    near = near.withColumn("similarity", F.when(F.col("similarity") >= LEAST, F.col("similarity")).when(F.contains(F.lower("name"), F.lit(low)) & F.lit(bool(low)), SUBSTRING)).filter("similarity IS NOT NULL").distinct()
    # a name falls away behind an equal one in the whole order: of equal similarity, names that differ in case alone are not always neighbours
    best = near.orderBy(F.desc("similarity"), "name")
    order = Window.orderBy(F.desc("similarity"), "name")
    shown = 4 * limit
    while True:
        top = best.limit(shown + 1)
        folded = text.ascii_lower(F.col("name"))
        kept = top.withColumn("same", F.coalesce(folded == F.lag(folded).over(order), F.lit(False)))  # over a bounded list
        kept = kept.filter("NOT same").orderBy(F.desc("similarity"), "name").limit(limit).select("name", "similarity")
        if kept.count() == limit or top.count() <= shown:
            return kept
        shown *= 4


def page_stems(docs: DataFrame) -> DataFrame:
    return docs.filter(files.is_page(F.col("content_type"))).select(files.stem(F.col("relative")).alias("name"))
