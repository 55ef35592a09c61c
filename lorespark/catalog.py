"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import files, markup, text
from lorespark.operators import delta, fuzzy, graph, index, outputs, pages, reports, resolve, search
from lorespark.session import shared_folder
from lorespark.sources import files as source
from lorespark.sources.corpus import CORPUS_SQL, corpus, markdown
from lorespark.streaming import changes

UP, LOW = text.UPPER, text.LOWER
TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND octet_length(encode(t)) < 40)"
CENTRE = 1  # the document that graph queries start from
SPAN = "30 minutes"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def on_corpus(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query over the corpus; sql may use the relation `corpus`."""
    query(name, f"WITH {CORPUS_SQL} {sql}" if sql else None)(lambda spark, sf_dir: f(corpus(spark, sf_dir)))


# search


def _search_sql(groups: list[tuple[list[str], dict[str, float], bool]], where: str = "TRUE", top: int = 50) -> str:
    """Plain SQL for ranked search: groups of (words, boosts, negated)."""
    fields = {"title": "title", "aliases": "array_to_string(aliases, ' ')", "headings": "array_to_string(headings, ' ')", "body": "body"}
    own = ", ".join(f"{TOKENS.format(e)} AS t_{f}" for f, e in fields.items())
    pairs = sorted({(f, w) for words, boosts, _ in groups for w in words for f in boosts})
    tf = "".join(f", len(list_filter(t_{f}, lambda x: x = '{w}')) AS tf{i}" for i, (f, w) in enumerate(pairs))
    df = "".join(f", count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(pairs)))
    score, conditions = [], [where]
    for words, boosts, negated in groups:
        at = [(pairs.index((f, w)), f, b) for w in words for f, b in boosts.items()]
        hit = " OR ".join(f"tf{i} > 0" for i, _, _ in at)
        conditions.append(f"NOT ({hit})" if negated else f"({hit})")
        if not negated:
            score += [f"{b} * CASE WHEN tf{i} > 0 THEN ln(1 + (s.n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t_{f}) / avg_{f})) ELSE 0 END" for i, f, b in at]
    return f""", tk AS (SELECT *, {own} FROM corpus), r AS (SELECT *{tf} FROM tk),
s AS (SELECT wiki, count(*) AS n, {', '.join(f'avg(len(t_{f})) AS avg_{f}' for f in fields)}{df} FROM r GROUP BY wiki),
h AS (SELECT r.wiki, relative, title, round({' + '.join(score) or '1.0'}, 4) AS score FROM r JOIN s ON r.wiki = s.wiki WHERE {' AND '.join(conditions).replace(' wiki ', ' r.wiki ')}),
k AS (SELECT wiki, CAST(row_number() OVER (PARTITION BY wiki ORDER BY score DESC, string_split(relative, '/')) AS INTEGER) AS rank, relative, title, CAST(score AS DOUBLE) AS score FROM h)
SELECT * FROM k WHERE rank <= {top}"""


BOOSTS = search.BOOSTS
WORD, OTHER = "the", "und"


@functools.lru_cache(16)
def _index_path(application: str, folder: str, sf_dir: str) -> str:
    return f"{folder}/lorespark-index-{application}-{uuid.uuid4().hex}"


def index_of(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the corpus, written to the shared folder when a session first searches it."""
    path = _index_path(spark.sparkContext.applicationId, shared_folder(spark), sf_dir)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sums/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        search.write_index(corpus(spark, sf_dir), path)
    return search.read_index(spark, path)


def _search(name: str, text_query: str, sql: str, **options) -> None:
    query(name, f"WITH {CORPUS_SQL} {sql}")(lambda spark, sf_dir: search.search(index_of(spark, sf_dir), text_query, **options))


_search("search_single_term", WORD, _search_sql([([WORD], BOOSTS, False)]))
_search("search_and_terms", "the that", _search_sql([(["the"], BOOSTS, False), (["that"], BOOSTS, False)]))
_search("search_quoted_or", '"und que"', _search_sql([(["und", "que"], BOOSTS, False)]))
_search("search_tag_filter", "tag:src3 the", _search_sql([(["the"], BOOSTS, False)], "list_contains(tags, 'src3')"))
_search("search_not_tag", "the -tag:src3", _search_sql([(["the"], BOOSTS, False)], "NOT list_contains(tags, 'src3')"))
_search("search_not_word", "the -that", _search_sql([(["the"], BOOSTS, False), (["that"], BOOSTS, True)]))
_search("search_wiki_type_ext", "wiki:de type:markdown ext:md und", _search_sql([(["und"], BOOSTS, False)], " wiki = 'de' AND content_type = 'markdown' AND ends_with(relative, '.md')"))
_search("search_path", "path:src5/page_000005.md", _search_sql([], "relative = 'src5/page_000005.md'"))
_search("search_title_boost", "title:src7 the", _search_sql([(["src7"], {"title": 10.0}, False), (["the"], BOOSTS, False)]))
_search("search_alias", "doc77", _search_sql([(["doc77"], BOOSTS, False)]))
_search("search_match_all", "", _search_sql([]))
_search("search_topk_per_wiki", "de", _search_sql([(["de"], BOOSTS, False)], top=10), top=10)
on_corpus("scan_search", "SELECT wiki, relative FROM corpus WHERE (contains(lower(title), 'loser') OR contains(lower(body), 'loser') OR contains(lower(relative), 'loser')) AND NOT (len(list_filter(tags, lambda t: lower(t) = 'src1')) > 0)", lambda c: search.scan_search(c, "LOSER -tag:SRC1"))
on_corpus("token_stats", f"SELECT wiki, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(n) AS BIGINT) AS longest FROM (SELECT wiki, len({TOKENS.format('body')}) AS n FROM corpus) GROUP BY wiki", search.token_stats)
on_corpus("doc_freq", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('body')})) AS term FROM corpus) GROUP BY term", search.doc_freq)
on_corpus(
    "postings",
    f"""SELECT wiki, field, term, relative, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(dl) AS INTEGER) AS dl FROM (SELECT wiki, relative, field, len(t) AS dl, unnest(t) AS term FROM (
SELECT wiki, relative, 'title' AS field, {TOKENS.format('title')} AS t FROM corpus UNION ALL SELECT wiki, relative, 'aliases', {TOKENS.format("array_to_string(aliases, ' ')")} FROM corpus UNION ALL SELECT wiki, relative, 'body', {TOKENS.format('body')} FROM corpus)) GROUP BY wiki, field, term, relative""",
    search.postings,
)
on_corpus("in_page_search", "SELECT wiki, relative, CAST(list_position(l, true) AS INTEGER) AS line FROM (SELECT wiki, relative, list_transform(string_split(body, chr(10)), lambda x: contains(lower(x), 'license')) AS l FROM corpus) WHERE list_contains(l, true)", lambda c: search.in_page(c, "License"))
_search("search_not_in_strict_mode", "the -that", _search_sql([(["the"], BOOSTS, False)]), strict=False)
on_corpus("search_by_scan", _search_sql([(["the"], BOOSTS, False), (["that"], BOOSTS, True)]), lambda c: search.search(c, "the -that"))
_search("search_by_levels", WORD, _search_sql([([WORD], BOOSTS, False)], top=5), top=5, at_once=0)
_search("search_and_by_levels", "the that", _search_sql([(["the"], BOOSTS, False), (["that"], BOOSTS, False)], top=5), top=5, at_once=0)
PLACES = r""", piece AS (SELECT wiki, relative, unnest(ps) AS term, unnest(range(len(ps))) AS i FROM (SELECT wiki, relative, regexp_extract_all(lower(body), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS ps FROM corpus)),
placed AS (SELECT wiki, relative, term, CAST(sum(length(term)) OVER (PARTITION BY wiki, relative ORDER BY i) - length(term) AS BIGINT) AS start FROM piece),
spot AS (SELECT * FROM placed WHERE regexp_matches(term, '^[\p{L}\p{N}]') AND octet_length(encode(term)) < 40)"""
on_corpus(
    "word_places", f"{PLACES} SELECT wiki, relative, term, string_agg(start, ',' ORDER BY start) AS places FROM spot GROUP BY ALL",
    lambda c: index.entries(c).filter("tf_body > 0").select("wiki", "relative", "term", F.array_join(F.transform(index.running("at"), lambda x: x.cast("string")), ",").alias("places")),
)
query(
    "snippets",
    f"""WITH {CORPUS_SQL} {_search_sql([(["loser"], BOOSTS, False)], top=10)[:-len("SELECT * FROM k WHERE rank <= 10")].rstrip()} {PLACES},
near AS (SELECT wiki, relative, start, count(*) OVER w AS n, max(start + 5) OVER w AS stop FROM spot WHERE term = 'loser' WINDOW w AS (PARTITION BY wiki, relative ORDER BY start RANGE BETWEEN CURRENT ROW AND 145 FOLLOWING)),
one AS (SELECT *, greatest(0, (150 - (stop - start)) // 2) AS room FROM near QUALIFY row_number() OVER (PARTITION BY wiki, relative ORDER BY n DESC, start) = 1),
cut AS (SELECT o.wiki, o.relative, regexp_replace(substr(body, greatest(0, start - room) + 1, stop + room - greatest(0, start - room)), '^[\\s]+|[\\s]+$', '', 'g') AS snippet FROM one o JOIN corpus c ON c.wiki = o.wiki AND c.relative = o.relative)
SELECT k.*, snippet FROM k LEFT JOIN cut ON cut.wiki = k.wiki AND cut.relative = k.relative WHERE rank <= 10""",
)(lambda spark, sf_dir: search.with_snippets(search.search(index_of(spark, sf_dir), "loser", top=10), corpus(spark, sf_dir), "loser", index_of(spark, sf_dir)))

_JSON = "SELECT '{\"wiki\":\"' || wiki || '\",\"relative\":\"' || relative || '\",\"title\":\"' || title || '\"}' AS line FROM corpus WHERE list_contains(tags, 'src4')"
on_corpus("output_json_lines", _JSON, lambda c: outputs.lines(reports.with_tag(c, "src4"), "json"))
on_corpus("output_paths", "SELECT wiki || ':' || relative AS line FROM corpus WHERE list_contains(tags, 'src4')", lambda c: outputs.lines(reports.with_tag(c, "src4"), "paths"))
on_corpus("numbered_lines", "SELECT wiki, relative, CAST(i AS INTEGER) AS number, l[i] AS line FROM (SELECT wiki, relative, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT wiki, relative, string_split(body, chr(10)) AS l FROM corpus))", outputs.numbered)
on_corpus("name_prefix", "SELECT DISTINCT 'page_' || printf('%06d', doc_id) AS name FROM corpus WHERE doc_id < 100", lambda c: outputs.starting(fuzzy.page_stems(c), "page_0000").distinct())

# reports

on_corpus("tag_counts", "SELECT tag, count(*) AS pages FROM (SELECT unnest(tags) AS tag FROM corpus) GROUP BY tag", reports.tag_counts)
on_corpus("tag_pages", "SELECT unnest(tags) AS tag, wiki, relative FROM corpus", reports.tag_pages)
on_corpus("tag_lookup_ci", f"SELECT wiki, relative, title FROM corpus WHERE len(list_filter(tags, lambda t: translate(t, '{UP}', '{LOW}') = 'src4')) > 0", lambda c: reports.with_tag(c, "SRC4"))
on_corpus(
    "wiki_stats",
    """, t AS (SELECT wiki, count(*) AS tags FROM (SELECT DISTINCT wiki, unnest(tags) AS tag FROM corpus) GROUP BY wiki)
SELECT c.wiki, count(*) AS files, count(*) FILTER (content_type = 'markdown') AS markdown, count(*) FILTER (content_type = 'text') AS text, count(*) FILTER (content_type = 'code') AS code, count(*) FILTER (content_type = 'image') AS image,
count(*) FILTER (content_type = 'binary') AS binary, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (content_type IN ('markdown', 'text')) AS pages, any_value(t.tags) AS tags FROM corpus c JOIN t ON c.wiki = t.wiki GROUP BY c.wiki""",
    reports.wiki_stats,
)
HUMAN = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f KiB', {0} / 1024.0) ELSE printf('%.1f MiB', {0} / 1048576.0) END"
on_corpus("files_by_type", f"SELECT wiki, relative, content_type, size, {HUMAN.format('size')} AS human FROM corpus WHERE content_type = 'markdown'", lambda c: reports.list_files(c, "md"))
on_corpus("overview", "SELECT wiki, relative, title FROM corpus WHERE content_type IN ('markdown', 'text')", reports.overview)
KNOWN = f", known AS (SELECT DISTINCT wiki, unnest([translate(regexp_replace(relative, '\\.[^./]*$', ''), '{UP}', '{LOW}'), translate(regexp_replace(string_split(relative, '/')[-1], '\\.[^./]*$', ''), '{UP}', '{LOW}')]) AS name FROM corpus), issues AS (SELECT wiki, relative, target FROM (SELECT wiki, relative, unnest(links) AS target FROM corpus) l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.wiki = l.wiki AND k.name = translate(l.target, '{UP}', '{LOW}')))"
on_corpus("lint_broken_links", f"{KNOWN} SELECT wiki, relative, target FROM issues", reports.lint_links)
on_corpus("lint_summary", f"{KNOWN} SELECT wiki, count(*) AS issues FROM issues GROUP BY wiki", lambda c: reports.lint_summary(reports.lint_links(c)))

# graph

EDGES = """, nm AS (SELECT name, min({'w': wiki, 'p': string_split(relative, '/')}) AS k FROM (SELECT wiki, relative, regexp_replace(string_split(relative, '/')[-1], '\\.[^.]*$', '') AS name FROM corpus UNION ALL SELECT wiki, relative, title FROM corpus) GROUP BY name),
lk AS (SELECT wiki, relative, unnest(range(len(links))) AS pos, unnest(links) AS target FROM corpus),
edges AS (SELECT lk.wiki, lk.relative, 'links_to' AS kind, CAST(pos AS INTEGER) AS pos, target, coalesce(x.wiki, nm.k.w) AS to_wiki, coalesce(x.relative, array_to_string(nm.k.p, '/')) AS to_relative, x.relative IS NULL AND nm.k IS NULL AS broken
FROM lk LEFT JOIN corpus x ON x.wiki = lk.wiki AND x.relative = lk.target || '.md' LEFT JOIN nm ON nm.name = lk.target)"""
MINE = f"(SELECT wiki, relative, tags FROM corpus WHERE doc_id = {CENTRE})"


def _centre(c: DataFrame) -> tuple[str, str]:
    row = c.filter(F.col("doc_id") == CENTRE).select("wiki", "relative").first()
    return (row.wiki, row.relative) if row else ("", "")


def _near(depth: int) -> str:
    hops = [f"d0 AS (SELECT wiki, relative, 0 AS depth FROM {MINE}), st AS (SELECT wiki, relative, to_wiki, to_relative FROM edges WHERE NOT broken UNION SELECT to_wiki, to_relative, wiki, relative FROM edges WHERE NOT broken)"]
    for i in range(1, depth + 1):
        hops.append(f"d{i} AS (SELECT * FROM d{i - 1} UNION SELECT to_wiki, to_relative, {i} FROM d{i - 1} d JOIN st USING (wiki, relative))")
    return f", {', '.join(hops)}, near AS (SELECT wiki, relative, min(depth) AS depth FROM d{depth} GROUP BY ALL)"


def _neighbours(depth: int, most: int | None = None):
    def run(c: DataFrame) -> DataFrame:
        return graph.neighborhood(graph.nodes(c), graph.edges(c), *_centre(c), depth, most)

    return run


on_corpus("graph_nodes", "SELECT wiki, relative, 'page' AS kind, title, array_to_string(tags, ',') AS tags FROM corpus", lambda c: graph.nodes(c).withColumn("tags", F.concat_ws(",", "tags")))
on_corpus("graph_edges", f"{EDGES} SELECT * FROM edges", graph.edges)
on_corpus("outgoing_links", f"{EDGES} SELECT edges.* FROM edges JOIN {MINE} m USING (wiki, relative)", lambda c: graph.outgoing(graph.edges(c), *_centre(c)).select("wiki", "relative", "kind", "pos", "target", "to_wiki", "to_relative", "broken"))
SQL["outgoing_links"] = f"WITH {CORPUS_SQL} {EDGES} SELECT e.* FROM edges e SEMI JOIN {MINE} m ON e.wiki = m.wiki AND e.relative = m.relative"
on_corpus("backlinks", f"{EDGES} SELECT DISTINCT e.wiki, e.relative FROM edges e JOIN {MINE} m ON e.to_wiki = m.wiki AND e.to_relative = m.relative", lambda c: graph.backlinks(graph.edges(c), *_centre(c)))
on_corpus("broken_links", f"{EDGES} SELECT wiki, relative, target FROM edges WHERE broken", lambda c: graph.broken(graph.edges(c)))
on_corpus("graph_stats", f"{EDGES} SELECT (SELECT count(*) FROM corpus) AS nodes, count(*) AS edges, count(*) FILTER (broken) AS broken_edges FROM edges", lambda c: graph.stats(graph.nodes(c), graph.edges(c)))
on_corpus(
    "degrees",
    f"{EDGES} SELECT c.wiki, c.relative, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM corpus c LEFT JOIN (SELECT wiki, relative, count(*) AS n FROM edges GROUP BY ALL) o ON o.wiki = c.wiki AND o.relative = c.relative LEFT JOIN (SELECT to_wiki, to_relative, count(*) AS n FROM edges WHERE NOT broken GROUP BY ALL) i ON i.to_wiki = c.wiki AND i.to_relative = c.relative",
    lambda c: graph.degrees(graph.nodes(c), graph.edges(c)),
)
for _depth in (1, 2, 3):
    on_corpus(f"neighborhood_{_depth}", f"{EDGES} {_near(_depth)} SELECT wiki, relative, CAST(depth AS INTEGER) AS depth FROM near", _neighbours(_depth))
on_corpus("neighborhood_capped", None, _neighbours(3, 12))
on_corpus(
    "neighborhood_edges",
    f"""{EDGES} {_near(2)} SELECT e.* FROM edges e JOIN near a ON a.wiki = e.wiki AND a.relative = e.relative LEFT JOIN near b ON b.wiki = e.to_wiki AND b.relative = e.to_relative
WHERE (e.broken OR b.depth IS NOT NULL) AND least(a.depth, coalesce(b.depth, a.depth)) < 2""",
    lambda c: graph.subgraph_edges(graph.edges(c), _neighbours(2)(c), 2).select("wiki", "relative", "kind", "pos", "target", "to_wiki", "to_relative", "broken"),
)
on_corpus(
    "related_pages",
    f"""{EDGES}, m AS {MINE}, o AS (SELECT e.to_wiki AS wiki, e.to_relative AS relative FROM edges e SEMI JOIN m ON e.wiki = m.wiki AND e.relative = m.relative WHERE NOT e.broken), i AS (SELECT e.wiki, e.relative FROM edges e JOIN m ON e.to_wiki = m.wiki AND e.to_relative = m.relative),
ev AS (SELECT wiki, relative, 10.0 AS s, 'Direct link' AS reason FROM o UNION ALL SELECT wiki, relative, 8.0, 'Backlink' FROM i
UNION ALL SELECT c.wiki, c.relative, 5.0, 'Shared tag: ' || t.tag FROM (SELECT wiki, relative, unnest(tags) AS tag FROM corpus) t JOIN corpus c USING (wiki, relative) WHERE t.tag IN (SELECT unnest(tags) FROM m)
UNION ALL SELECT c.wiki, c.relative, 3.0, 'Same directory' FROM corpus c, m WHERE string_split(c.relative, '/')[1] = string_split(m.relative, '/')[1]
UNION ALL SELECT wiki, relative, 2.0 * n, n || ' shared outgoing links' FROM (SELECT e.wiki, e.relative, count(DISTINCT (e.to_wiki, e.to_relative)) AS n FROM edges e SEMI JOIN o ON e.to_wiki = o.wiki AND e.to_relative = o.relative GROUP BY ALL)
UNION ALL SELECT wiki, relative, 2.0 * n, n || ' shared incoming links' FROM (SELECT e.to_wiki AS wiki, e.to_relative AS relative, count(DISTINCT (e.wiki, e.relative)) AS n FROM edges e SEMI JOIN i ON e.wiki = i.wiki AND e.relative = i.relative WHERE NOT broken GROUP BY ALL))
SELECT ev.wiki, ev.relative, any_value(c.title) AS title, CAST(sum(s) AS DOUBLE) AS score, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM ev JOIN corpus c ON c.wiki = ev.wiki AND c.relative = ev.relative WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.wiki = ev.wiki AND m.relative = ev.relative)
GROUP BY ev.wiki, ev.relative ORDER BY score DESC, title, ev.wiki, string_split(ev.relative, '/') LIMIT 10""",
    lambda c: graph.related(c, graph.edges(c), *_centre(c)).withColumn("reasons", F.concat_ws("; ", "reasons")),
)
on_corpus("dot_edges", f"""{EDGES} SELECT '  "' || wiki || ':' || relative || '" -> "' || to_wiki || ':' || to_relative || '";' AS line FROM edges WHERE NOT broken""", lambda c: graph.dot_lines(graph.edges(c)))
on_corpus("dot_subgraph", f"""{EDGES} {_near(1)}, sub AS (SELECT e.* FROM edges e JOIN near a ON a.wiki = e.wiki AND a.relative = e.relative JOIN near b ON b.wiki = e.to_wiki AND b.relative = e.to_relative WHERE least(a.depth, b.depth) < 1)
SELECT 0 AS ord, 'digraph wiki {{' AS line UNION ALL SELECT 2, '}}' UNION ALL SELECT 1, '  "' || wiki || ':' || relative || '" -> "' || to_wiki || ':' || to_relative || '";' FROM sub""", lambda c: outputs.dot(graph.edges(c), _neighbours(1)(c), 1))
on_corpus(
    "ring_layout",
    f"""{EDGES} {_near(2)} SELECT wiki, relative, round(15.0 * depth * cos(a), 4) + 0.0 AS x, round(15.0 * depth * sin(a), 4) + 0.0 AS y FROM (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY depth ORDER BY wiki, string_split(relative, '/')) - 1) / count(*) OVER (PARTITION BY depth) AS a FROM near)""",
    lambda c: graph.ring_layout(_neighbours(2)(c)).select("wiki", "relative", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")),
)
on_corpus("force_layout", None, lambda c: graph.force_layout(_neighbours(2)(c), graph.edges(c)))
on_corpus(
    "layout_bounds",
    f"""{EDGES} {_near(2)} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM (SELECT round(15.0 * depth * cos(a), 4) + 0.0 AS x, round(15.0 * depth * sin(a), 4) + 0.0 AS y
FROM (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY depth ORDER BY wiki, string_split(relative, '/')) - 1) / count(*) OVER (PARTITION BY depth) AS a FROM near))""",
    lambda c: reports.bounding_box(graph.ring_layout(_neighbours(2)(c)).select("wiki", "relative", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))),
)

# names

on_corpus(
    "resolve_candidates",
    """, b AS (SELECT doc_id, title AS b FROM corpus), e AS (SELECT unnest(['md', 'markdown', 'txt', 'rst', 'org', 'tex', 'rs', 'py', 'c', 'h', 'go', 'sh']) AS e, unnest(range(12)) AS i),
h AS (SELECT unnest(['index.md', 'README.md', 'Home.md', 'home.md']) AS h, unnest(range(4)) AS i), named AS (SELECT doc_id, unnest([replace(b, ' ', '-'), replace(b, ' ', '_'), lower(replace(b, ' ', '-'))]) AS n, unnest(range(3)) AS i FROM b),
a AS (SELECT doc_id, i AS o, b || '.' || e AS relative FROM b, e UNION ALL SELECT doc_id, 100 + i, b || '/' || h FROM b, h UNION ALL SELECT doc_id, 200 + 2 * i, n || '.md' FROM named UNION ALL SELECT doc_id, 201 + 2 * i, n || '.markdown' FROM named UNION ALL SELECT doc_id, 300, b FROM b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS pos, relative FROM a""",
    lambda c: resolve.candidates_of(c.select("doc_id", F.col("title").alias("name"))).select("doc_id", "pos", "relative"),
)
on_corpus("resolve_shallow", "SELECT wiki, relative, 'exact_stem' AS kind FROM corpus WHERE relative = 'src5/page_000005.md'", lambda c: resolve.shallow(c, "src5/page_000005"))
on_corpus("resolve_listed", "SELECT wiki, relative, 'case_insensitive' AS kind FROM corpus WHERE lower(relative) = 'src5/page_000005.md'", lambda c: resolve.listed(c, "src5/PAGE_000005"))
on_corpus(
    "resolve_ranked",
    """SELECT * FROM (SELECT wiki, relative, CASE WHEN relative = 'page12' THEN 'exact_path' WHEN lower(title) = 'page12' THEN 'title' WHEN list_contains(list_transform(aliases, lambda a: lower(a)), 'page12') THEN 'alias' END AS kind,
CASE WHEN list_contains(list_transform(aliases, lambda a: lower(a)), 'page12') THEN 6 END AS kind_rank, CAST(len(string_split(relative, '/')) AS INTEGER) AS depth FROM corpus) WHERE kind IS NOT NULL""",
    lambda c: resolve.ranked(c, "PAGE12"),
)
on_corpus(
    "suggestions",
    """, nm AS (SELECT DISTINCT regexp_replace(string_split(relative, '/')[-1], '\\.[^.]*$', '') AS name FROM corpus), s AS (SELECT name, round(1.0 - levenshtein('page_00012', name) / CAST(greatest(10, length(name)) AS DOUBLE), 4) AS similarity FROM nm)
SELECT name, CAST(similarity AS DOUBLE) AS similarity FROM s WHERE similarity >= 0.55 ORDER BY similarity DESC, name LIMIT 5""",
    lambda c: fuzzy.suggestions(fuzzy.page_stems(c), "page_00012"),
)
on_corpus(
    "suggestions_in_order",
    """, stem AS (SELECT doc_id, regexp_replace(string_split(relative, '/')[-1], '\\.[^.]*$', '') AS name FROM corpus), nm AS (SELECT name FROM stem UNION SELECT upper(name) FROM stem WHERE doc_id % 2 = 0 UNION SELECT 'Q' || name FROM stem WHERE doc_id % 2 = 1 UNION SELECT 'q' || name FROM stem),
s AS (SELECT name, round(1.0 - levenshtein('page_00012', lower(name)) / CAST(greatest(10, length(name)) AS DOUBLE), 4) AS close FROM nm), r AS (SELECT name, CASE WHEN close >= 0.55 THEN close WHEN contains(lower(name), 'page_00012') THEN 0.54 END AS similarity FROM s),
l AS (SELECT *, lag(lower(name)) OVER (ORDER BY similarity DESC, name) AS last FROM r WHERE similarity IS NOT NULL)
SELECT name, CAST(similarity AS DOUBLE) AS similarity FROM l WHERE last IS NULL OR last <> lower(name) ORDER BY similarity DESC, name LIMIT 40""",
    lambda c: fuzzy.suggestions(
        c.select(F.explode(F.array(files.stem(F.col("relative")), F.when(F.col("doc_id") % 2 == 0, F.upper(files.stem(F.col("relative")))).otherwise(F.concat(F.lit("Q"), files.stem(F.col("relative")))), F.concat(F.lit("q"), files.stem(F.col("relative"))))).alias("name")),
        "page_00012", 40),
)
on_corpus("levenshtein_sim", "SELECT doc_id, CASE WHEN levenshtein(title, 'Document 000500 Topic src0') > 4 THEN 5 ELSE levenshtein(title, 'Document 000500 Topic src0') END AS distance, round(1.0 - levenshtein(lower(title), 'document 000500 topic src0') / CAST(greatest(length(title), 26) AS DOUBLE), 4) AS similarity FROM corpus", lambda c: c.select("doc_id", text.bounded_levenshtein(F.col("title"), F.lit("Document 000500 Topic src0"), 4).cast("long").alias("distance"), F.round(text.similarity(F.col("title"), F.lit("Document 000500 Topic src0")), 4).alias("similarity")))


def _fuzzy_sql(rows: str, chars: int) -> str:
    """Scores of first-come subsequence matches of w in hay, from a relation with these columns and `id`; w has so many characters."""
    query_ = f"SELECT *, 0 AS nxt, 0 AS total, -1 AS last, CAST([] AS INTEGER[]) AS places FROM {rows}"
    for i in range(1, chars + 1):
        found = f"SELECT *, nxt + nullif(strpos(lower(substr(hay, nxt + 1)), lower(substr(w, {i}, 1))), 0) - 1 AS p FROM ({query_})"
        bonus = (
            "CASE WHEN p > nxt THEN -6 - 2 * (p - nxt - 1) ELSE 0 END + 1 + CASE WHEN substr(hay, p + 1, 1) = substr(w, %d, 1) THEN 2 ELSE 0 END"
            " + CASE WHEN p = 0 THEN 24 WHEN regexp_matches(substr(hay, p, 1), '[/\\\\_. :,()\\[\\]#-]') THEN 16 WHEN regexp_matches(substr(hay, p, 1), '[a-z]') AND regexp_matches(substr(hay, p + 1, 1), '[A-Z]') THEN 14 ELSE 0 END"
            " + CASE WHEN last >= 0 AND last = p - 1 THEN 12 ELSE 0 END" % i
        )
        query_ = f"SELECT * EXCLUDE (p) REPLACE (p + 1 AS nxt, CAST(total + {bonus} AS INTEGER) AS total, CAST(p AS INTEGER) AS last, list_append(places, CAST(p AS INTEGER)) AS places) FROM ({found}) WHERE p IS NOT NULL"
    return f"SELECT *, CAST(total - length(hay) // 16 AS INTEGER) AS score FROM ({query_})"


on_corpus(
    "fuzzy_find",
    f""", hays AS (SELECT doc_id AS id, 'title' AS field, 200 AS bonus, title AS hay FROM corpus UNION ALL SELECT doc_id, 'path', 0, relative FROM corpus UNION ALL SELECT doc_id, 'a' || i, 150, aliases[i] FROM corpus, (SELECT unnest([1, 2]) AS i)),
asked AS (SELECT *, unnest(['src7', '0042']) AS w FROM hays), scored AS ({_fuzzy_sql('asked', 4)}), fields AS (SELECT id, field, sum(score) + any_value(bonus) AS score FROM scored GROUP BY id, field HAVING count(*) = 2),
best AS (SELECT id, CAST(max(score) AS INTEGER) AS score FROM fields GROUP BY id HAVING max(score) > 0)
SELECT wiki, relative, title, score FROM best JOIN corpus ON doc_id = id ORDER BY score DESC, wiki, string_split(relative, '/') LIMIT 20""",
    lambda c: fuzzy.find(c, "src7 0042"),
)
on_corpus(
    "fuzzy_positions",
    f", asked AS (SELECT doc_id AS id, title AS hay, 'dts7' AS w FROM corpus), scored AS ({_fuzzy_sql('asked', 4)}) SELECT doc_id, score, coalesce(array_to_string(places, ','), '') AS positions FROM corpus LEFT JOIN scored ON id = doc_id",
    lambda c: c.select("doc_id", fuzzy.scorer("dts7")("title").alias("m")).select("doc_id", "m.score", F.concat_ws(",", F.col("m.positions").cast("array<string>")).alias("positions")),
)

# text and files

on_corpus("heading_slug", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(title || ' (' || wiki || ')'), '[^\p{L}\p{N}\-_\s]', '', 'g'), '[\-_\s]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM corpus", lambda c: c.select("doc_id", text.heading_slug(F.concat("title", F.lit(" ("), "wiki", F.lit(")"))).alias("slug")))
on_corpus(
    "naming_policy",
    r"SELECT doc_id, array_to_string(list_filter(string_split_regex(title, '[^\p{L}\p{N}]+'), lambda x: x <> ''), '-') AS kebab, array_to_string(list_filter(string_split_regex(title, '[^\p{L}\p{N}]+'), lambda x: x <> ''), '_') AS snake, lower(array_to_string(list_filter(string_split_regex(title, '[^\p{L}\p{N}]+'), lambda x: x <> ''), '-')) AS slug FROM corpus",
    lambda c: c.select("doc_id", *[text.naming(F.col("title"), p).alias(p) for p in ("kebab", "snake", "slug")]),
)
on_corpus(
    "sanitize_text",
    r"SELECT doc_id, sha256(regexp_replace(body || chr(27) || '[31m' || chr(8238) || 'x' || chr(7), '[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g') || chr(10) || 'a' || repeat(' ', 3) || 'bc' || repeat(' ', 2) || repeat(' ', 4) || 'd') AS digest FROM corpus",
    lambda c: c.select("doc_id", F.sha2(text.sanitize_text(F.concat("body", F.lit("\x1b[31m\u202ex\x07\na\tbc\t\td"))), 256).alias("digest")),
)
on_corpus("human_size", f"SELECT doc_id, {HUMAN.format('(size * 37)')} AS human FROM corpus", lambda c: c.select("doc_id", files.human_size(F.col("size") * 37).alias("human")))
on_corpus("content_hash", "SELECT doc_id, sha256(body) AS digest FROM corpus", lambda c: c.select("doc_id", files.content_hash(F.col("body")).alias("digest")))
on_corpus(
    "classify_ext",
    "SELECT doc_id, path, CASE WHEN e IN ('rs', 'py') OR path LIKE '%CMakeLists.txt' THEN 'code' WHEN e = 'md' THEN 'markdown' WHEN e = 'txt' THEN 'text' WHEN e = 'png' THEN 'image' WHEN e = 'tex' THEN 'latex' END AS kind, CASE WHEN path LIKE '%CMakeLists.txt' THEN 'CMake' WHEN e = 'rs' THEN 'Rust' WHEN e = 'py' THEN 'Python' END AS language FROM (SELECT doc_id, path, CASE WHEN path LIKE '%/.gitignore' THEN NULL ELSE nullif(regexp_extract(path, '\\.([^./]+)$', 1), '') END AS e FROM (SELECT doc_id, replace(relative, '.md', ['.md', '.rs', '.txt', '.png', '.tex', '.py', '.zzz', '/CMakeLists.txt', '/.gitignore'][1 + doc_id % 9]) AS path FROM corpus))",
    lambda c: c.withColumn("path", F.replace(F.col("relative"), F.lit(".md"), F.get(F.array(*map(F.lit, [".md", ".rs", ".txt", ".png", ".tex", ".py", ".zzz", "/CMakeLists.txt", "/.gitignore"])), (F.col("doc_id") % 9).cast("int")))).select("doc_id", "path", files.classify_extension(F.col("path")).alias("kind"), files.language(F.col("path")).alias("language")),
)
query("format_timestamp", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", files.format_timestamp(F.unix_timestamp("ts")).alias("at")))

# markup

LINKED = "(SELECT doc_id, '[[' || links[1] || ']] [[en::' || links[2] || '#Part ' || doc_id || '|see]] [[file:a/b.rs#L' || (doc_id % 90 + 20) || '-L7]] [[ |x]] [[Symbol: run ]] [[#Top]] [[open' || chr(10) || ']]' AS s FROM corpus)"


def _linked(c: DataFrame) -> DataFrame:
    i = F.col("doc_id").cast("string")
    return c.select("doc_id", F.concat(F.lit("[["), F.get("links", 0), F.lit("]] [[en::"), F.get("links", 1), F.lit("#Part "), i, F.lit("|see]] [[file:a/b.rs#L"), (F.col("doc_id") % 90 + 20).cast("string"), F.lit("-L7]] [[ |x]] [[Symbol: run ]] [[#Top]] [[open\n]]")).alias("s"))


on_corpus("link_extract", f"SELECT doc_id, unnest(range(6)) AS pos, unnest(regexp_extract_all(s, '\\[\\[([^\\n]*?)\\]\\]', 1)) AS inner_text FROM {LINKED}", lambda c: _linked(c).select("doc_id", F.posexplode(markup.link_spans(F.col("s"))).alias("pos", "inner_text")).withColumn("pos", F.col("pos").cast("long")))
on_corpus(
    "link_parse",
    """SELECT doc_id, pos, kind, wiki, name, anchor, CAST(line_start AS VARCHAR) AS line_start, CAST(line_end AS VARCHAR) AS line_end, label FROM (
SELECT doc_id, 0 AS pos, 'page' AS kind, NULL AS wiki, links[1] AS name, NULL AS anchor, CAST(NULL AS INTEGER) AS line_start, CAST(NULL AS INTEGER) AS line_end, NULL AS label FROM corpus
UNION ALL SELECT doc_id, 1, 'page', 'en', links[2], 'Part ' || doc_id, NULL, NULL, 'see' FROM corpus UNION ALL SELECT doc_id, 2, 'file', NULL, 'a/b.rs', NULL, 7, CAST(doc_id % 90 + 20 AS INTEGER), NULL FROM corpus
UNION ALL SELECT doc_id, 4, 'symbol', NULL, 'run', NULL, NULL, NULL, NULL FROM corpus UNION ALL SELECT doc_id, 5, 'page', NULL, '', 'Top', NULL, NULL, NULL FROM corpus)""",
    lambda c: _linked(c).select("doc_id", F.posexplode(F.transform(markup.link_spans(F.col("s")), markup.parse_link)).alias("pos", "x")).filter("x IS NOT NULL").select("doc_id", "pos", "x.*").withColumns({x: F.col(x).cast("string") for x in ("line_start", "line_end")}),
)
on_corpus("page_links", "SELECT doc_id, array_to_string(links, ',') AS links FROM corpus", lambda c: markdown(c).select("doc_id", F.concat_ws(",", markup.page_links(F.col("markdown"))).alias("links")))
on_corpus("frontmatter_parse", "SELECT doc_id, title, array_to_string(aliases, ',') AS aliases, array_to_string(list_filter(tags, lambda t, i: list_position(tags, t) = i), ',') AS tags, 0 AS problems FROM corpus", lambda c: markdown(c).withColumn("f", markup.frontmatter("markdown")).select("doc_id", "f.title", F.concat_ws(",", "f.aliases").alias("aliases"), F.concat_ws(",", "f.tags").alias("tags"), F.size("f.diagnostics").alias("problems")))
on_corpus("first_heading", "SELECT doc_id, title AS heading FROM corpus", lambda c: markdown(c).select("doc_id", markup.first_heading(F.col("markdown")).alias("heading")))
on_corpus("markdown_outline", None, lambda c: markdown(c).select("doc_id", F.explode(markup.outline(F.col("markdown"))).alias("h")).select("doc_id", "h.level", "h.text", "h.line"))
PAGE_PARTS = ["Of ", "\n===\n\n> ## In a quote: ", "\n\n- # Item ", "\n  - deeper\n\n      ### Deep ", "\n\n```\n# not\n```\n\n    # nor\n\n<div>\n# nor\n</div>\n\n# Last [", "][r] #\n\n[r]: /x\n"]
on_corpus(
    "outline_structures",
    """SELECT doc_id, unnest([1, 2, 1, 3, 1]) AS level, unnest(['Of ' || doc_id, 'In a quote: ' || title, 'Item ' || wiki, 'Deep ' || doc_id, 'Last [' || title || '][r]']) AS text, unnest([1, 4, 6, 9, 21]) AS line FROM corpus""",
    lambda c: c.select("doc_id", F.explode(markup.outline(F.concat(F.lit(PAGE_PARTS[0]), F.col("doc_id").cast("string"), F.lit(PAGE_PARTS[1]), "title", F.lit(PAGE_PARTS[2]), "wiki", F.lit(PAGE_PARTS[3]), F.col("doc_id").cast("string"), F.lit(PAGE_PARTS[4]), "title", F.lit(PAGE_PARTS[5])))).alias("h")).select("doc_id", "h.level", "h.text", "h.line"),
)
query("pages_href_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")))

# changes

STATE_SQL = """now AS (SELECT wiki, relative, size, 1000 + doc_id AS mtime, sha256(body) AS content_hash, doc_id FROM corpus),
was AS (SELECT wiki, relative, CASE WHEN doc_id % 10 = 7 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 10 IN (5, 7) THEN 1 ELSE mtime END AS mtime, CASE WHEN doc_id % 10 = 7 THEN 'other' ELSE content_hash END AS content_hash FROM now WHERE doc_id % 10 <> 3
 UNION ALL SELECT 'en', 'gone/page_' || i || '.md', 1, 1, 'x' FROM range(5) t(i)),
delta AS (SELECT coalesce(a.wiki, b.wiki) AS wiki, coalesce(a.relative, b.relative) AS relative, CASE WHEN b.relative IS NULL THEN 'added' WHEN a.relative IS NULL THEN 'deleted' WHEN (a.size = b.size AND a.mtime = b.mtime) OR a.content_hash = b.content_hash THEN 'unchanged' ELSE 'modified' END AS change,
 coalesce(NOT (a.size = b.size AND a.mtime = b.mtime) AND a.content_hash = b.content_hash, FALSE) AS touched FROM now a FULL JOIN was b ON a.wiki = b.wiki AND a.relative = b.relative)"""


def states(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current files and a previous state: a tenth added, modified and touched each, and five deleted."""
    now = c.select("doc_id", "wiki", "relative", "size", (F.col("doc_id") + 1000).alias("mtime"), F.sha2("body", 256).alias("content_hash"))
    digit = F.col("doc_id") % 10
    was = now.filter(digit != 3).select("wiki", "relative", F.when(digit == 7, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(digit.isin(5, 7), F.lit(1)).otherwise(F.col("mtime")).alias("mtime"), F.when(digit == 7, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    gone = c.sparkSession.range(5).select(F.lit("en").alias("wiki"), F.concat(F.lit("gone/page_"), F.col("id").cast("string"), F.lit(".md")).alias("relative"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.lit("x").alias("content_hash"))
    return now.drop("doc_id"), was.unionByName(gone)


on_corpus("delta_classify", f", {STATE_SQL} SELECT * FROM delta", lambda c: delta.changes(*states(c)))
on_corpus("delta_summary", f", {STATE_SQL} SELECT change, count(*) AS n FROM delta GROUP BY change", lambda c: delta.summary(delta.changes(*states(c))))
on_corpus("apply_delta_equals_rebuild", f", {STATE_SQL} SELECT wiki, relative, CASE WHEN touched THEN 1 ELSE mtime END AS mtime, content_hash FROM now JOIN delta USING (wiki, relative)", lambda c: delta.apply(states(c)[1], delta.changes(*states(c)), states(c)[0]).select("wiki", "relative", "mtime", "content_hash"))


def dated(c: DataFrame) -> DataFrame:
    """The corpus with the columns of a state."""
    return c.withColumns({"mtime": F.col("doc_id") + 1000, "content_hash": F.sha2("body", 256), "path": F.col("relative"), "diagnostics": F.array().cast("array<struct<line:int,message:string>>")})


def earlier(c: DataFrame) -> DataFrame:
    """The documents of `states`' previous state: what is modified had other words and another name."""
    digit, now = F.col("doc_id") % 10, dated(c).filter("doc_id % 10 <> 3")
    gone = dated(c).filter("doc_id < 5").withColumn("relative", F.concat(F.lit("gone/"), "relative"))
    old = now.withColumns({
        "body": F.when(digit == 7, F.concat(F.lit("the former "), F.substring("body", 1, 300))).otherwise(F.col("body")), "title": F.when(digit == 7, "Former").otherwise(F.col("title")),
        "size": F.when(digit == 7, F.col("size") + 1).otherwise(F.col("size")), "mtime": F.when(digit.isin(5, 7), F.lit(1).cast("long")).otherwise(F.col("mtime")),
        "content_hash": F.when(digit == 7, "other").otherwise(F.col("content_hash")),
    })
    return old.unionByName(gone)


@functools.lru_cache(16)
def _store_path(application: str, folder: str, sf_dir: str, kept: tuple[str, ...]) -> str:
    return f"{folder}/lorespark-store-{application}-{uuid.uuid4().hex}"


def _followed(spark: SparkSession, sf_dir: str, *kept: str) -> delta.Store:
    """A store of the earlier documents that was brought up to date with the corpus, when a session first asks for it; it keeps the index or the links."""
    store, c = delta.Store(spark, _store_path(spark.sparkContext.applicationId, shared_folder(spark), sf_dir, kept)), corpus(spark, sf_dir)
    if store.meta() is None:
        assert delta.follow(store, earlier(c), kept)[0] == "rebuilt"
    if len(store.meta()["before"]) == 0:
        assert delta.follow(store, dated(c), kept)[0] == "updated"
    return store


_FIELD_SQL = {"title": "title", "aliases": "array_to_string(aliases, ' ')", "headings": "array_to_string(headings, ' ')", "body": "body"}
query(
    "index_after_delta",
    f"""WITH {CORPUS_SQL}, tk AS (SELECT wiki, relative, {', '.join(f"{TOKENS.format(e)} AS t_{f}" for f, e in _FIELD_SQL.items())} FROM corpus), w AS (SELECT wiki, relative, unnest(list_distinct(list_concat(t_title, t_aliases, t_headings, t_body))) AS term FROM tk)
SELECT wiki, term, relative, {', '.join(f"CAST(len(list_filter(t_{f}, lambda x: x = term)) AS INTEGER) AS tf_{f}" for f in _FIELD_SQL)}, {', '.join(f"CAST(len(t_{f}) AS INTEGER) AS dl_{f}" for f in _FIELD_SQL)} FROM w JOIN tk USING (wiki, relative)""",
)(lambda spark, sf_dir: _followed(spark, sf_dir, "index").read("entries").drop("at", "level"))
query("search_after_delta", f"WITH {CORPUS_SQL} {_search_sql([([WORD], BOOSTS, False)])}")(lambda spark, sf_dir: search.search(_followed(spark, sf_dir, "index").index(), WORD))
query("edges_after_delta", f"WITH {CORPUS_SQL} {EDGES} SELECT * FROM edges")(lambda spark, sf_dir: _followed(spark, sf_dir, "links").read("edges"))
query("documents_after_delta", f"WITH {CORPUS_SQL} SELECT wiki, relative, title, array_to_string(tags, ',') AS tags, sha256(body) AS digest FROM corpus")(lambda spark, sf_dir: _followed(spark, sf_dir, "links").read("documents").select("wiki", "relative", "title", F.concat_ws(",", "tags").alias("tags"), F.sha2("body", 256).alias("digest")))
query("state_after_delta", f"WITH {CORPUS_SQL} SELECT wiki, relative, size, 1000 + doc_id AS mtime, sha256(body) AS content_hash FROM corpus")(lambda spark, sf_dir: _followed(spark, sf_dir, "links").read("state"))
query("index_status", f"WITH {CORPUS_SQL} SELECT TRUE AS ready, count(*) AS document_count, 4 AS schema_version FROM corpus")(lambda spark, sf_dir: spark.createDataFrame([{k: v for k, v in delta.status(_followed(spark, sf_dir, "index")).items() if k != "built_at"}], "ready boolean, document_count long, schema_version int"))
EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'modify' END AS kind FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS session FROM g)"
FOLD = "list_reduce(list(kind ORDER BY ts, event_id), lambda s, k: CASE WHEN s = 'create' AND k = 'modify' THEN 'create' WHEN s = 'create' AND k = 'delete' THEN 'delete' WHEN s = 'rename' AND k = 'modify' THEN 'rename' WHEN s = 'delete' AND k = 'create' THEN 'modify' WHEN s = 'delete' AND k = 'modify' THEN 'delete' ELSE k END)"


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes.settled(changes.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")), ["path"], SPAN)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


query("change_sessions", f"WITH {EVENTS} SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS \"end\", count(*) AS n FROM s GROUP BY path, session")(lambda spark, sf_dir: _settled(spark, sf_dir).drop("kind"))
query("change_coalesce", f"WITH {EVENTS} SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, {FOLD} AS kind FROM s GROUP BY path, session")(lambda spark, sf_dir: _settled(spark, sf_dir).select("path", "start", "kind"))


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as files, written where its rows are: a third with a header block, a third with a first heading, a third with neither; some are ignored."""
    root = f"{shared_folder(spark)}/lorespark-pages-{uuid.uuid4().hex}"
    c = corpus(spark, sf_dir)
    i = F.col("doc_id")
    linked = F.concat(F.lit("[["), F.get("links", 0), F.lit("]]\n"))
    whole = F.when(i % 3 == 0, F.concat(F.lit('---\ntitle: "'), "title", F.lit('"\ntags: ['), F.concat_ws(", ", "tags"), F.lit("]\n---\n"), linked)).when(i % 3 == 1, F.concat(F.lit("# "), "title", F.lit(" #\n\n"), linked)).otherwise(linked)
    at = F.concat(F.when(i % 11 == 0, ".hidden/").when(i % 11 == 1, "cache/").otherwise("_pages/"), "wiki", F.lit("/"), "relative", F.when(i % 7 == 0, ".log").otherwise(""))
    rules = spark.createDataFrame([(".gitignore", "*.log\n/cache/\n"), ("_pages/.gitignore", "!0.md.log\n!*0.md.log\n")], "at string, whole string")
    wrote = c.select(at.alias("at"), whole.alias("whole")).unionByName(rules).mapInArrow(functools.partial(source.write_pages, root=root), "written long")
    wrote.agg(F.sum("written")).collect()
    return root


AS_FILES = f"""WITH {CORPUS_SQL}, f AS (SELECT *, '_pages/' || wiki || '/' || relative || CASE WHEN doc_id % 7 = 0 THEN '.log' ELSE '' END AS place FROM corpus WHERE doc_id % 11 > 1 AND (doc_id % 7 <> 0 OR ends_with(relative, '0.md')))"""
query("scanned_files", f"{AS_FILES} SELECT place AS relative, CASE WHEN doc_id % 7 = 0 THEN 'text' ELSE 'markdown' END AS content_type FROM f")(lambda spark, sf_dir: source.scan(spark, _page_files(spark, sf_dir)).select("relative", "content_type"))
query(
    "built_documents",
    f"""{AS_FILES} SELECT place AS relative, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(relative, '^.*/', '') WHEN doc_id % 3 = 2 THEN regexp_replace(regexp_replace(relative, '^.*/', ''), '\\.md$', '') ELSE title END AS title,
CASE WHEN doc_id % 7 = 0 OR doc_id % 3 > 0 THEN '' ELSE array_to_string(tags, ',') END AS tags, CASE WHEN doc_id % 7 = 0 THEN '' ELSE links[1] END AS links FROM f""",
)(lambda spark, sf_dir: source.build(spark, _page_files(spark, sf_dir)).select("relative", "title", F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "links").alias("links")))
on_corpus("sanitized_lines", "SELECT doc_id, title || repeat(' ', 4 - length(title) % 4) || wiki || 'xy' AS line FROM corpus", lambda c: c.select("doc_id", text.sanitize_line(F.concat("title", F.lit("\t"), "wiki", F.lit("x\r\n\x1b"), F.lit("y"))).alias("line")))
on_corpus("inline_plain_text", "SELECT doc_id, title || ' ' || wiki || ' ' || doc_id || ' see ' || relative || '*' AS shown FROM corpus", lambda c: c.select("doc_id", markup.plain_text(F.concat(F.lit("**"), "title", F.lit("** ["), "wiki", F.lit("](x \"t\") `"), F.col("doc_id").cast("string"), F.lit("` ~~_see_~~[^1] [[p|"), "relative", F.lit("]]\\*"))).alias("shown")))
on_corpus(
    "image_sizes", "SELECT doc_id, 'png' AS format, CAST(doc_id % 5000 + 1 AS INTEGER) AS width, CAST(size AS INTEGER) AS height FROM corpus",
    lambda c: c.select("doc_id", files.image_info(F.concat(F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), *[F.unhex(F.lpad(F.hex(n), 8, "0")) for n in (F.col("doc_id") % 5000 + 1, F.col("size"))])).alias("i")).select("doc_id", "i.*"),
)
on_corpus("search_untitled", _search_sql([(["loser"], BOOSTS, False)]).replace("tk AS (SELECT *,", "c2 AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN '' ELSE title END AS title) FROM corpus), tk AS (SELECT *,").replace("FROM corpus), r AS", "FROM c2), r AS").replace("relative, title, CAST(score", "relative, CASE WHEN title = '' THEN relative ELSE title END AS title, CAST(score"), lambda c: search.search(c.withColumn("title", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("title"))), "loser"))
_search("search_only_negative", "-tag:src3", _search_sql([], "FALSE"))
_search("search_quoted_filter", 'tag:"src3" the', _search_sql([(["the"], BOOSTS, False)], "list_contains(tags, 'src3')"))
query("query_alias", f"WITH {CORPUS_SQL} {_search_sql([(['loser'], BOOSTS, False)])}")(lambda spark, sf_dir: search.query(index_of(spark, sf_dir), "loser"))
ONE_BYTE = "(CASE WHEN {0} < 40 THEN {0} ELSE 24 + floor(({0} - 24) / pow(2, greatest(0, floor(log2({0} - 24)) - 3))) * pow(2, greatest(0, floor(log2({0} - 24)) - 3)) END)"
_search("search_one_byte_lengths", WORD, re.sub(r"len\(t_(\w+)\) / avg", lambda m: ONE_BYTE.format(f"len(t_{m[1]})") + " / avg", _search_sql([([WORD], BOOSTS, False)])), compat=True)


#: Purchases are sources and sign-ups targets of moves; a user's moves share a cookie.
MOVES = "m AS (SELECT event_id AS seq, ts, CAST(user_id % 50 AS VARCHAR) AS path, user_id % 7 AS cookie, CASE event_type WHEN 'purchase' THEN 'rename_from' WHEN 'signup' THEN 'rename_to' WHEN 'error' THEN 'delete' ELSE 'modify' END AS kind FROM events)"


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("purchase", "rename_from", "signup", "rename_to", "error", "delete")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.lit("main").alias("wiki"), (F.col("user_id") % 50).cast("string").alias("path"), (F.col("user_id") % 7).alias("cookie"), F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("modify")).alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


query(
    "paired_renames",
    f"""WITH {MOVES}, r AS (SELECT *, lead(kind) OVER w AS k2, lead(ts) OVER w AS t2, lag(kind) OVER w AS k0, lag(ts) OVER w AS t0, lag(path) OVER w AS p0 FROM m WHERE starts_with(kind, 'rename_') WINDOW w AS (PARTITION BY cookie ORDER BY ts, seq)),
o AS (SELECT path, CASE WHEN kind = 'rename_from' THEN 'delete' WHEN k0 = 'rename_from' AND epoch_ms(ts) - epoch_ms(t0) <= 3600000 THEN 'rename' ELSE 'create' END AS kind, p0, ts FROM r WHERE NOT coalesce(kind = 'rename_from' AND k2 = 'rename_to' AND epoch_ms(t2) - epoch_ms(ts) <= 3600000, FALSE)
 UNION ALL SELECT path, kind, NULL, ts FROM m WHERE NOT starts_with(kind, 'rename_'))
SELECT path, kind, CASE WHEN kind = 'rename' THEN p0 END AS from_path, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM o""",
)(lambda spark, sf_dir: changes.paired(moves(spark, sf_dir), 3_600_000).select("path", "kind", "from_path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")))

# more of the inventory: one query for each function that the ones above do not reach

PAGES = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet")
query(
    "safe_hyperlinks",
    r"SELECT page_id, CASE WHEN octet_length(encode(url)) <= 2048 AND NOT regexp_matches(url, '[\x00-\x20\x7F]') AND regexp_matches(lower(url), '^(https?|mailto|file|ftp):') THEN url END AS safe FROM pages",
)(lambda spark, sf_dir: PAGES(spark, sf_dir).select("page_id", text.safe_hyperlink(F.col("url")).alias("safe")))
query(
    "link_classes",
    r"""SELECT page_id, href, CASE WHEN starts_with(href, '#') THEN 'heading' WHEN regexp_matches(lower(href), '^([a-z][a-z0-9+.-]*://|mailto:)') THEN 'external' WHEN regexp_matches(lower(href), '^file:|/|\.[a-z0-9]+$') THEN 'file' ELSE 'wiki' END AS kind
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""",
)(lambda spark, sf_dir: PAGES(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).withColumn("kind", markup.link_class(F.col("href"))))
on_corpus("link_labels", "SELECT doc_id, links[1] AS a, 'see' AS b, 'en::' || links[2] || '#Part ' || doc_id AS c FROM corpus", lambda c: c.select("doc_id", *[
    markup.link_text(markup.parse_link(x)).alias(n) for n, x in (("a", F.get("links", 0)), ("b", F.concat(F.lit("en::"), F.get("links", 1), F.lit("|see"))), ("c", F.concat(F.lit("en::"), F.get("links", 1), F.lit("#Part "), F.col("doc_id").cast("string"))))
]))
on_corpus("visible_controls", "SELECT doc_id, sha256('x' || chr(9223) || chr(9229) || chr(9225) || chr(65533) || chr(9249) || replace(replace(replace(body, chr(10), chr(9226)), chr(9), chr(9225)), chr(13), chr(9229))) AS digest FROM corpus", lambda c: c.select("doc_id", F.sha2(text.visible(F.concat(F.lit("x\x07\r\t\u202e\x7f"), "body")), 256).alias("digest")))
on_corpus("display_widths", "SELECT doc_id, CAST(length(title) + 4 AS INTEGER) AS width, substr(title, 1, 11) || chr(8230) AS short FROM corpus", lambda c: c.select("doc_id", text.display_width(F.concat("title", F.lit("日本"))).alias("width"), text.truncate(F.col("title"), 12).alias("short")))
on_corpus("lossy_text", "SELECT doc_id, sha256(body || chr(65533) || '.') AS digest FROM corpus", lambda c: c.select("doc_id", F.sha2(text.lossy_utf8(F.concat(F.encode("body", "UTF-8"), F.lit(b"\xff."))), 256).alias("digest")))
on_corpus("cache_components", "SELECT doc_id, regexp_replace(title || wiki, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM corpus", lambda c: c.select("doc_id", text.cache_component(F.concat("title", "wiki")).alias("name")))
on_corpus("ellipsis_and_prefix", "SELECT doc_id, substr(title, 1, 10) || chr(8230) AS short, substr(title, 10) AS bare FROM corpus", lambda c: c.select("doc_id", text.ellipsis(F.col("title"), 10).alias("short"), text.strip_prefix_ci(F.col("title"), "document ").alias("bare")))
on_corpus("unquoted", "SELECT doc_id, title AS a, relative AS b FROM corpus", lambda c: c.select("doc_id", text.unquote(F.concat(F.lit('"'), "title", F.lit('"'))).alias("a"), text.unquote(F.concat("relative", F.lit(" # why"))).alias("b")))
on_corpus("tags_deduped", "SELECT doc_id, array_to_string(list_filter(tags, lambda t, i: list_position(tags, t) = i), ',') AS tags FROM corpus", lambda c: c.select("doc_id", F.concat_ws(",", text.dedupe_ci(F.concat("tags", F.transform("tags", F.upper), F.array(F.lit(""))))).alias("tags")))
on_corpus("parsed_sizes", "SELECT doc_id, size * 1024 AS a, CAST(size * 1.5 * 1048576 AS BIGINT) AS b FROM corpus", lambda c: c.select("doc_id", files.parse_size(F.concat(F.col("size").cast("string"), F.lit(" KiB"))).alias("a"), files.parse_size(F.concat((F.col("size") * 1.5).cast("string"), F.lit("m"))).alias("b")))
on_corpus("fence_languages", "SELECT doc_id, ['Rust', 'Shell', 'C++', NULL][1 + doc_id % 4] AS language FROM corpus", lambda c: c.select("doc_id", files.language_for_tag(F.get(F.array(*map(F.lit, ["rust,no_run", "console", "C++", "none"])), (F.col("doc_id") % 4).cast("int"))).alias("language")))
on_corpus("classified_contents", "SELECT doc_id, ['markdown', 'binary', 'binary', 'image'][1 + doc_id % 4] AS kind FROM corpus", lambda c: c.select("doc_id", files.classify(
    F.when(F.col("doc_id") % 4 == 3, "a.png").otherwise(F.col("relative")), F.concat(F.encode("title", "UTF-8"), F.get(F.array(*map(F.lit, [b"", b"\0", b"\xff\xfe", b"\0"])), (F.col("doc_id") % 4).cast("int")))).alias("kind")))
ESCAPES = ["", "../..", "../../..", "x/../../../..", "/etc"]
on_corpus("escaping_paths", "SELECT doc_id, doc_id % 5 >= 2 AS escapes FROM corpus", lambda c: c.select("doc_id", files.escapes_root(
    F.when(F.col("doc_id") % 5 == 4, "/etc").otherwise(F.concat("relative", F.lit("/"), F.get(F.array(*map(F.lit, ESCAPES)), (F.col("doc_id") % 5).cast("int"))))).alias("escapes")))
on_corpus("vcs_paths", "SELECT doc_id, doc_id % 3 = 1 AS internal FROM corpus", lambda c: c.select("doc_id", files.is_vcs_internal(F.concat(F.get(F.array(*map(F.lit, ["a/", "a/.git/", "a/.gitx/"])), (F.col("doc_id") % 3).cast("int")), "relative")).alias("internal")))
on_corpus("ignored_paths", "SELECT wiki, relative FROM corpus WHERE NOT (regexp_matches(relative, '^src1[^/]*/') OR (ends_with(relative, '3.md') AND NOT regexp_matches(relative, '^src7/')))", lambda c: changes.not_ignored(c.select("wiki", "relative"), source.ignore_rules(["*3.md", "!/src7/", "/src1*/"])))
on_corpus("indexable_files", "SELECT wiki, relative FROM corpus WHERE size <= 1000 AND doc_id % 5 <> 0", lambda c: source.should_index(
    c.withColumn("too_large", F.col("size") > 1000).withColumn("content_type", F.when(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 2 == 0, "image").otherwise("binary")).otherwise(F.col("content_type")))).select("wiki", "relative"))
on_corpus("homes", "SELECT wiki, min(relative) AS relative FROM corpus WHERE relative IN (SELECT min(relative) FROM corpus GROUP BY wiki) GROUP BY wiki", lambda c: _homes(c))
on_corpus("suspect_files", f", {STATE_SQL} SELECT a.wiki, a.relative FROM now a LEFT JOIN was b ON a.wiki = b.wiki AND a.relative = b.relative AND a.size = b.size AND a.mtime = b.mtime WHERE b.relative IS NULL", lambda c: delta.suspects(*states(c)).select("wiki", "relative"))
on_corpus("owners", "SELECT path, wiki, substr(path, length('/w/' || wiki) + 2) AS relative FROM (SELECT '/w/' || wiki || '/' || relative AS path, CASE WHEN relative LIKE 'src1/%' THEN wiki || '/src1' ELSE wiki END AS wiki, unnest(range(1 + doc_id % 3)) FROM corpus)", lambda c: changes.owned(
    c.select(F.concat(F.lit("/w/"), "wiki", F.lit("/"), "relative").alias("path"), F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("_n")).select("path"),
    c.select("wiki").distinct().select(F.explode(F.array(F.col("wiki"), F.concat("wiki", F.lit("/src1")))).alias("name")).withColumn("root", F.concat(F.lit("/w/"), "name"))))
on_corpus("unknown_renames", "SELECT wiki, relative AS path, CASE WHEN doc_id % 3 = 0 THEN 'rename' ELSE 'modify' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'old/' || relative END AS from_path FROM corpus", lambda c: changes.known_sources(
    c.select("wiki", F.col("relative").alias("path"), F.lit("rename").alias("kind"), F.concat(F.lit("old/"), "relative").alias("from_path")),
    c.filter("doc_id % 3 = 0").select("wiki", F.concat(F.lit("old/"), "relative").alias("path"))))
on_corpus(
    "image_edges",
    """, t AS (SELECT wiki, relative, 'page_' || printf('%06d', doc_id % 90) || '.m' AS target FROM corpus), k AS (SELECT target, min({'w': c.wiki, 'p': string_split(c.relative, '/')}) AS k FROM (SELECT DISTINCT target FROM t) JOIN corpus c ON contains(c.relative, target) GROUP BY target)
SELECT t.wiki, t.relative, t.target, k.k.w AS to_wiki, array_to_string(k.k.p, '/') AS to_relative FROM t LEFT JOIN k USING (target)""",
    lambda c: graph.edges(c.withColumn("images", F.array(F.concat(F.lit("page_"), F.format_string("%06d", F.col("doc_id") % 90), F.lit(".m")))), "images").filter("kind = 'embeds'").select("wiki", "relative", "target", "to_wiki", "to_relative"),
)
on_corpus("backlinks_by_name", f"{EDGES} SELECT DISTINCT e.wiki, e.relative FROM edges e JOIN {MINE} m ON e.to_wiki = m.wiki AND e.to_relative = m.relative", lambda c: pages.of_page(c, "PAGE_000001", "backlinks"))
on_corpus("links_by_name", f"{EDGES} SELECT e.target FROM edges e SEMI JOIN {MINE} m ON e.wiki = m.wiki AND e.relative = m.relative", lambda c: pages.of_page(c, "page_000001", "links").select("target"))
on_corpus("table_widths", "SELECT CAST(doc_id % 3 AS INTEGER) AS \"column\", CAST(greatest(4, max(length(CASE doc_id % 3 WHEN 0 THEN wiki WHEN 1 THEN title ELSE relative END))) AS INTEGER) AS width FROM corpus GROUP BY doc_id % 3", lambda c: reports.table_widths(
    c.select(F.col("doc_id").alias("row"), (F.col("doc_id") % 3).cast("int").alias("column"), F.when(F.col("doc_id") % 3 == 0, F.col("wiki")).when(F.col("doc_id") % 3 == 1, F.col("title")).otherwise(F.col("relative")).alias("text"))))
on_corpus("first_bytes_links", "SELECT wiki, relative, array_to_string(links, ',') AS links FROM corpus", lambda c: source.first_links(
    markdown(c).select("wiki", "relative", F.lit("markdown").alias("content_type"), F.encode("markdown", "UTF-8").alias("content"))).withColumn("links", F.concat_ws(",", "links")))


def _homes(c: DataFrame) -> DataFrame:
    first = [r.relative for r in c.groupBy("wiki").agg(F.min("relative").alias("relative")).collect()]  # one row per wiki
    found = None
    for name in sorted(set(first), reverse=True):
        own = resolve.home(c, name)
        found = own if found is None else found.unionByName(own)
    return found.groupBy("wiki").agg(F.min("relative").alias("relative"))
