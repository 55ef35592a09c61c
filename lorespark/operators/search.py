"""Full-text search: inverted index, BM25 with field boosts, filters, ranking within each wiki and snippets.

Every wiki is an index of its own (statistics, ranking), as every wiki is a directory of its own. `search` takes documents, whose words it
counts in one scan, or an `Index` (`operators/index.py`): of its entries a query reads those of its few words, the best levels first, and
stops where no further one can be among the best. Both give the same rows.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.errors import NotSearchable
from lorespark.functions import files, text
from lorespark.operators.index import BOOSTS, K1, LEVELS, TYPICAL, B, Index, entries, places, read_index, write_index  # noqa: F401
from lorespark.plans.query import Term, parse

#: The boost of the title filter, and rows per wiki.
TITLE_FILTER, TOP = 10.0, 50
#: Entries of a word that are read first, for each row that is wanted; then FURTHER times as many. A search of fewer entries reads them at once.
FIRST, FURTHER, AT_ONCE = 8, 8, 20_000


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs with t_<field>: the token list of each searchable field."""
    joined = {"title": F.col("title"), "aliases": F.concat_ws(" ", "aliases"), "headings": F.concat_ws(" ", "headings"), "body": F.col("body")}
    return docs.withColumns({f"t_{f}": text.tokens(c) for f, c in joined.items()})


def postings(docs: DataFrame) -> DataFrame:
    """(wiki, field, term, relative, tf, dl): the inverted index, to be written partitioned by wiki and clustered by term.

    Entries by field; only pages of which there are several of one name are added up, so others are not shuffled.
    """

    def by_field(rows: DataFrame) -> DataFrame:
        fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"tf_{f}").alias("tf"), F.col(f"dl_{f}").alias("dl")) for f in BOOSTS])
        return entries(rows).select("wiki", "relative", "term", F.explode(F.filter(fields, lambda x: x["tf"] > 0)).alias("f")).select("wiki", "f.field", "term", "relative", "f.tf", "f.dl")

    again = docs.groupBy("wiki", "relative").count().filter("count > 1").select(F.col("wiki").alias("w"), F.col("relative").alias("r"))
    if again.isEmpty():
        return by_field(docs)
    same = F.col("wiki").eqNullSafe(F.col("w")) & F.col("relative").eqNullSafe(F.col("r"))
    several = by_field(docs.join(again, same, "left_semi")).groupBy("wiki", "field", "term", "relative").agg(F.sum("tf").cast("int").alias("tf"), F.max("dl").alias("dl"))
    return by_field(docs.join(again, same, "left_anti")).unionByName(several)


def _lengths() -> list[Column]:
    return [F.size(f"t_{f}").alias(f"dl_{f}") for f in BOOSTS]


def _stats(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("wiki").agg(F.count("*").alias("n"), *[F.avg(f"dl_{f}").alias(f"avg_{f}") for f in BOOSTS], *more)


def _filter(term: Term, strict: bool) -> Column | None:
    """The predicate of a filter term; None for bare words and title filters."""
    if term.kind in ("linksto", "backlink"):
        raise NotSearchable(f"{term.kind}: is only supported in graph queries")
    own = {
        "tag": lambda v: F.array_contains("tags", v),
        "wiki": lambda v: F.col("wiki") == v,
        "type": lambda v: F.col("content_type") == v,
        "ext": lambda v: F.regexp_extract(files.file_name(F.col("relative")), r"(?<=.)\.([^.]+)$", 1) == v,
        "path": lambda v: F.col("relative") == v,
    }
    if term.kind not in own:
        return None
    found = own[term.kind](term.value)
    if not term.negated:
        return found
    return ~found if strict or term.kind == "tag" else F.lit(True)


def search(docs: DataFrame | Index, query: str, top: int = TOP, strict: bool = True, rounded: int = 4, at_once: int = AT_ONCE, compat: bool = False) -> DataFrame:
    """(wiki, rank, relative, title, score): the best `top` of each wiki.

    All terms must hold; a quoted group holds if one of its words occurs. strict=False drops negations other than -tag:,
    as compatible behaviour; negative terms alone then find nothing in either mode. compat=True counts lengths of fields as an index that keeps
    one byte for each does (see one_byte).
    """
    terms = parse(query)
    at_once = sys.maxsize if compat else at_once  # bounds of levels are those of whole lengths
    filters = [f for f in (_filter(t, strict) for t in terms) if f is not None]
    groups: list[tuple[list[str], dict[str, float], bool]] = []
    for t in terms:
        if t.kind == "text":
            if not t.negated or strict:
                groups.append((text_words(t.value), BOOSTS, t.negated))
        elif t.kind == "title" and (not t.negated or strict):
            groups.append(([t.value.lower()], {"title": TITLE_FILTER}, t.negated))
    pairs = sorted({(f, w) for words, fields, _ in groups for w in words for f in fields})
    kept = reduce(lambda a, b: a & b, filters, F.lit(True))
    wanted = any(not n for _, _, n in groups)
    rows, stats = _indexed(docs, pairs, groups, kept, wanted, top, rounded, at_once) if isinstance(docs, Index) else _scanned(docs, pairs, kept)
    total: Column = F.lit(0.0)
    scored = rows.join(F.broadcast(stats), "wiki") if pairs else rows  # one row per wiki
    for words, fields, negated in groups:
        at = [(pairs.index((f, w)), f, boost) for w in words for f, boost in fields.items()]
        hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i, _, _ in at], F.lit(False))
        scored = scored.filter(~hit if negated else hit)
        if not negated:
            total = reduce(lambda a, b: a + b, [boost * bm25(i, f, compat) for i, f, boost in at], total)
    positive = any(not t.negated for t in terms)
    if terms and not positive and any(t.kind == "tag" or strict for t in terms):
        scored = scored.limit(0)
    score = total if wanted else F.lit(1.0)
    ranked = scored.select("wiki", "relative", "title", F.round(score, rounded).alias("score"))
    order = Window.partitionBy("wiki").orderBy(F.desc("score"), F.split("relative", "/"))
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("wiki", "rank", "relative", F.coalesce(F.nullif("title", F.lit("")), "relative").alias("title"), "score")


def _scanned(docs: DataFrame, pairs: list[tuple[str, str]], kept: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with tf<i> of each pair (field, word) and dl_<field>, and the statistics of the wikis, by a scan."""
    counts = [_count(f, w).alias(f"tf{i}") for i, (f, w) in enumerate(pairs)]
    rows = with_tokens(docs).select("wiki", "relative", "title", "tags", "content_type", *_lengths(), *counts)
    stats = _stats(rows, *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(pairs))])
    return rows.filter(kept), stats


Groups = list[tuple[list[str], dict[str, float], bool]]


def _indexed(
    index: Index, pairs: list[tuple[str, str]], groups: Groups, kept: Column, wanted: bool, top: int, rounded: int, at_once: int
) -> tuple[DataFrame, DataFrame]:
    """The same from an index; wanted: a page without any of the words can't be a hit."""
    pages = index.pages.filter(kept)
    if not pairs:
        return pages, index.sums
    reading = Reading(index, pairs, groups, top)
    cuts = reading.cuts(pages, rounded, at_once) if wanted else reading.all()
    rows = pages.join(_counts(index, pairs, cuts), ["wiki", "relative"], "inner" if wanted else "left")
    return rows.fillna(0, [f"tf{i}" for i in range(len(pairs))]), reading.stats


def _counts(index: Index, pairs: list[tuple[str, str]], cuts: Cuts) -> DataFrame:
    """(wiki, relative, tf<i>, dl_<field>) from the entries at or above the cuts; tf<i> is null where the word was not read."""
    asked = [(F.col("wiki") == wiki) & (F.col("term") == word) & (F.col("level") >= level) for (wiki, word), level in sorted(cuts.items())]
    found = index.entries.filter(reduce(lambda a, b: a | b, asked, F.lit(False)))
    return found.groupBy("wiki", "relative").agg(
        *[F.max(F.when(F.col("term") == w, F.col(f"tf_{f}"))).alias(f"tf{i}") for i, (f, w) in enumerate(pairs)], *[F.max(f"dl_{f}").alias(f"dl_{f}") for f in BOOSTS]
    )


def heaviest(field: str, level: int, tf: int, dl: int, average: float) -> float:
    """The most that BM25 gives in a field, without rarity and boost, to an entry of a level with tf occurrences at most and dl words at least.

    BM25 is (K1 + 1) / (1 + a + b * TYPICAL / average) with a = K1 (1 - B) / tf and b = K1 B dl / (TYPICAL tf), of which the level says that a + b is
    not below some r: the sum is least with as much as can be in a if fields are shorter than is typical, else in b.
    """
    reached = min(1.0, (level + 1) / LEVELS / BOOSTS[field])
    r, stretch = (1 - reached) / reached, TYPICAL[field] / average if average else 1.0
    least_a, least_b = K1 * (1 - B) / tf, K1 * B * dl / (TYPICAL[field] * tf)
    if stretch >= 1:
        b = max(least_b, r - K1 * (1 - B))
        a = max(least_a, r - b)
    else:
        a = least_a
        b = max(least_b, r - a)
    return (K1 + 1) / (1 + a + b * stretch)


#: For (wiki, word) the lowest level that is read.
Cuts = dict[tuple[str, str], int]


class Reading:
    """How much of an index a search has to read: levels of its words, best first, until no entry below can reach the rows that are wanted.

    What it holds on the driver is one row for each wiki, word of the query and level.
    """

    def __init__(self, index: Index, pairs: list[tuple[str, str]], groups: Groups, top: int):
        self.index, self.pairs, self.groups, self.top = index, pairs, groups, top
        words = sorted({w for _, w in pairs})
        rows = index.blocks.filter(F.col("term").isin(words))
        fields = list(BOOSTS)
        rows = rows.groupBy("wiki", "term", "level").agg(
            F.sum("n").alias("n"), *[F.sum(f"df_{f}").alias(f"df_{f}") for f in fields], *[F.max(f"tf_{f}").alias(f"tf_{f}") for f in fields], *[F.min(f"dl_{f}").alias(f"dl_{f}") for f in fields]
        )
        self.levels: dict[tuple[str, str], list] = {}
        for r in rows.filter("n > 0").collect():
            self.levels.setdefault((r.wiki, r.term), []).append(r)
        for found in self.levels.values():
            found.sort(key=lambda r: -r.level)
        count = {k: {f: sum(r[f"df_{f}"] for r in found) for f in fields} for k, found in self.levels.items()}
        self.wikis = {}
        for r in index.sums.groupBy("wiki").agg(*[F.sum(c).alias(c) for c in ("n", *[f"len_{f}" for f in fields])]).collect():
            average = {f: r[f"len_{f}"] / r.n if r.n > 0 else 0.0 for f in fields}
            self.wikis[r.wiki] = (r.n, average, [count.get((r.wiki, w), {}).get(f, 0) for f, w in pairs])
        names = ["wiki string", "n long", *[f"avg_{f} double" for f in fields], *[f"df{i} long" for i in range(len(pairs))]]
        own = [(wiki, n, *average.values(), *df) for wiki, (n, average, df) in self.wikis.items()]
        self.stats = index.sums.sparkSession.createDataFrame(own, ", ".join(names))

    def all(self) -> Cuts:
        return {k: found[-1].level for k, found in self.levels.items()}

    def read(self, cuts: Cuts) -> int:
        """Entries at or above the cuts."""
        return sum(r.n for k, found in self.levels.items() for r in found if k in cuts and r.level >= cuts[k])

    def _most(self, wiki: str, word: str, cuts: Cuts) -> float:
        """The most that an entry of the word below its cut can add to a score."""
        rest = [r for r in self.levels.get((wiki, word), []) if r.level < cuts[wiki, word]]
        n, average, df = self.wikis[wiki]
        boosts: dict[str, float] = {}
        for words, fields, negated in self.groups:
            if word in words and not negated:
                for f, boost in fields.items():
                    boosts[f] = boosts.get(f, 0.0) + boost * words.count(word)

        def of(r) -> float:
            total = 0.0
            for f, boost in boosts.items():
                if r[f"tf_{f}"]:
                    d = df[self.pairs.index((f, word))]
                    worth = heaviest(f, r.level, r[f"tf_{f}"], r[f"dl_{f}"] or 0, average[f])
                    total += boost * math.log(1 + max(0.0, n - d + 0.5) / (d + 0.5)) * worth
            return total

        return max(map(of, rest), default=0.0)

    def _first(self, rows: int) -> Cuts:
        """Cuts with at least so many entries of each word (all, if a group of it is negated)."""
        never = {w for words, _, negated in self.groups if negated for w in words}
        cuts = {}
        for (wiki, word), found in self.levels.items():
            held = 0
            for r in found:
                cuts[wiki, word] = r.level
                held += r.n
                if held >= rows and word not in never:
                    break
        return cuts

    def cuts(self, pages: DataFrame, rounded: int = 4, at_once: int = AT_ONCE) -> Cuts:
        """Cuts below which nothing can be among the best `top` of a wiki: the last of the best `pages` read so far has a score beyond all that is not read."""
        everything = self.all()
        total, rows = self.read(everything), FIRST * self.top
        if total <= at_once:
            return everything
        words = sorted({w for ws, _, negated in self.groups if not negated for w in ws})
        open_wikis, done = sorted({wiki for wiki, _ in self.levels}), {}
        while open_wikis:
            cuts = {k: v for k, v in self._first(rows).items() if k[0] in open_wikis}
            if 2 * self.read(cuts | done) > total:
                return everything | done
            below = {(wiki, w): self._most(wiki, w, cuts) if (wiki, w) in cuts else 0.0 for wiki in open_wikis for w in words}
            last = self._last(pages, cuts, below, words)
            for wiki in list(open_wikis):
                unread = sum(below[wiki, w] for w in words)
                best, doubtful = last.get(wiki, (None, None))
                if unread == 0 or best is not None and max(unread, doubtful or 0.0) + 2 * 10.0**-rounded < best:
                    done |= {k: v for k, v in cuts.items() if k[0] == wiki}
                    open_wikis.remove(wiki)
            rows *= FURTHER
        return done

    def _last(self, pages: DataFrame, cuts: Cuts, below: dict, words: list[str]) -> dict[str, tuple[float | None, float | None]]:
        """For each wiki the score of its last wanted row, as far as entries were read, and the most that a page can have of which some were not."""
        found = pages.select("wiki", "relative").join(_counts(self.index, self.pairs, cuts), ["wiki", "relative"]).join(F.broadcast(self.stats), "wiki")
        score, hit, missing = F.lit(0.0), F.lit(True), F.lit(0.0)
        for ws, fields, negated in self.groups:
            at = [(self.pairs.index((f, w)), f, boost) for w in ws for f, boost in fields.items()]
            own = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"tf{i}") > 0, F.lit(False)) for i, _, _ in at], F.lit(False))
            if negated:
                found = found.filter(~own)
                continue
            hit = hit & own
            score = reduce(lambda a, b: a + b, [boost * bm25(i, f) for i, f, boost in at], score)
        for w in words:
            seen = F.col(f"tf{next(i for i, p in enumerate(self.pairs) if p[1] == w)}").isNotNull()
            most = reduce(lambda a, b: a.when(F.col("wiki") == b[0][0], b[1]), [(k, v) for k, v in below.items() if k[1] == w], F.when(F.lit(False), 0.0)).otherwise(0.0)
            missing = missing + F.when(seen, 0.0).otherwise(most)
        own = found.select("wiki", "relative", score.alias("score"), hit.alias("hit"), missing.alias("missing"))
        place = F.row_number().over(Window.partitionBy("wiki").orderBy(F.desc("hit"), F.desc("score")))
        placed = own.withColumn("place", place)
        out = placed.groupBy("wiki").agg(F.max(F.when(F.col("hit") & (F.col("place") == self.top), F.col("score"))).alias("best"), F.max(F.when(F.col("missing") > 0, F.col("score") + F.col("missing"))).alias("doubtful"))
        return {r.wiki: (r.best, r.doubtful) for r in out.collect()}


def _count(field: str, word: str) -> Column:
    return F.size(F.filter(f"t_{field}", lambda x: x == word))


def text_words(value: str) -> list[str]:
    """The words of a query term as the index has them."""
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", value.lower()) if w and len(w.encode()) < text.TOKEN_BYTES]


def one_byte(length: Column) -> Column:
    """A length as one byte keeps it: up to 40 as it is, beyond that the next lower one of which, less 24, only the four leading bits are set."""
    over = length - 24
    bits = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(over, F.lit(1)))).cast("int") - 3)
    step = F.pow(F.lit(2.0), bits)
    return F.when(over < 16, length).otherwise(24 + F.floor(over / step) * step)


def bm25(i: int, field: str, compat: bool = False) -> Column:
    n, df, tf, dl = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col(f"dl_{field}")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * (one_byte(dl) if compat else dl) / F.col(f"avg_{field}"))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)


#: `query` is another name of `search`.
query = search


def scan_search(docs: DataFrame, query: str) -> DataFrame:
    """(wiki, relative) by substring in title, body or path, case-insensitive filters and general negation; no ranking. `backlink:` is
    for graph queries."""
    out = docs
    for t in parse(query):
        if t.kind == "backlink":
            raise NotSearchable("backlink: is only supported in graph queries")
        low = t.value.lower()
        found = {
            "text": lambda: F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("body"), F.lit(low)) | F.contains(F.lower("relative"), F.lit(low)),
            "tag": lambda: F.exists("tags", lambda x: F.lower(x) == low),
            "wiki": lambda: F.lower("wiki") == low,
            "type": lambda: F.lower("content_type") == low,
            "ext": lambda: files.extension(F.col("relative")) == low,
            "path": lambda: F.contains(F.lower("relative"), F.lit(low)),
            "title": lambda: F.contains(F.lower("title"), F.lit(low)),
            "linksto": lambda: F.exists("links", lambda x: F.lower(x) == low),
        }.get(t.kind, lambda: F.lit(False))()
        found = F.coalesce(found, F.lit(False))
        out = out.filter(~found if t.negated else found)
    return out.select("wiki", "relative")


#: Characters of a snippet.
SNIPPET = 150


def with_snippets(hits: DataFrame, docs: DataFrame, query: str, index: Index | None = None, width: int = SNIPPET) -> DataFrame:
    """hits (wiki, relative, ...) with `snippet`: the stretch of at most `width` characters with most of the query's words, the first of equal ones, and
    as much text around it; null where the body has none of them.

    The words' places come from the index; without one, from the ranked pages. Bodies are read for ranked pages alone.
    """
    words = sorted({w for t in parse(query) if t.kind == "text" and not t.negated for w in text_words(t.value)})
    ranked = hits.select("wiki", "relative")
    bodies = docs.select("wiki", "relative", "body").join(ranked, ["wiki", "relative"], "left_semi")
    found = index.entries if index else entries(docs.join(ranked, ["wiki", "relative"], "left_semi"))
    found = places(found.filter(F.col("term").isin(words)).join(ranked, ["wiki", "relative"], "left_semi"))
    placed = found.select("wiki", "relative", F.char_length("term").alias("size"), "start")
    reach = max(0, width - max(map(len, words), default=0))
    near = Window.partitionBy("wiki", "relative").orderBy("start").rangeBetween(0, reach)
    stretch = placed.select("wiki", "relative", "start", F.count("*").over(near).alias("n"), F.max(F.col("start") + F.col("size")).over(near).alias("end"))
    best = stretch.groupBy("wiki", "relative").agg(F.max(F.struct("n", (-F.col("start")).alias("back"), "end")).alias("best"))
    start, end = -F.col("best.back"), F.col("best.end")
    room = F.greatest(F.lit(0), F.floor((width - (end - start)) / 2))
    first = F.greatest(F.lit(0), start - room)
    shown = F.substring("body", (first + 1).cast("int"), (end + room - first).cast("int"))
    own = bodies.join(best, ["wiki", "relative"]).select("wiki", "relative", F.regexp_replace(shown, r"^\s+|\s+$", "").alias("snippet"))
    return hits.join(own, ["wiki", "relative"], "left")


def in_page(docs: DataFrame, needle: str) -> DataFrame:
    """(wiki, relative, line): the first line of each page that holds the needle, from 1, case-insensitive."""
    lines = F.transform(F.split("body", "\n"), lambda x: F.contains(F.lower(x), F.lit(needle.lower())))
    return docs.select("wiki", "relative", F.array_position(lines, True).cast("int").alias("line")).filter("line > 0")


def token_stats(docs: DataFrame) -> DataFrame:
    """(wiki, n_docs, n_tokens, longest): of bodies."""
    own = docs.select("wiki", F.size(text.tokens(F.col("body"))).alias("n"))
    return own.groupBy("wiki").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").cast("long").alias("longest"))


def doc_freq(docs: DataFrame, least: int = 1) -> DataFrame:
    """(term, df): in how many bodies, of terms in at least so many."""
    own = docs.select(F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("term"))
    return own.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)
