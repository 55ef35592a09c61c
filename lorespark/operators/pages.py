"""Commands on one page: its name is resolved, then a graph operator works on what it means."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lorespark.errors import NotFound, UsageError
from lorespark.operators import graph, resolve

WHAT = ("links", "backlinks", "related", "neighborhood")


def of_page(docs: DataFrame, name: str, what: str, **options) -> DataFrame:
    """links, backlinks, related pages or neighbourhood of the page that a name means; an unknown name is an error."""
    if what not in WHAT:
        raise UsageError(f"not one of {', '.join(WHAT)}: {what}")
    page = resolve.resolve(docs, name).first()
    if page is None:
        raise NotFound(f"no page `{name}`")
    links = graph.edges(docs)
    at = (page.wiki, page.relative)
    if what == "links":
        return graph.outgoing(links, *at)
    if what == "backlinks":
        return graph.backlinks(links, *at)
    if what == "related":
        return graph.related(docs, links, *at, **options)
    return graph.neighborhood(graph.nodes(docs), links, *at, **options)
