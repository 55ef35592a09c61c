"""The link graph: nodes, edges, neighbourhoods, related pages, exports and layouts.

Nodes are keyed by (wiki, relative) and ordered by wiki, then path components; "first" in a resolution is the smallest in that order, so no
global numbering is needed and every step is a join or an aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import files
from lorespark.session import checkpointed

#: What each kind of evidence is worth for related pages.
DIRECT, BACK, TAG, FOLDER, SHARED = 10.0, 8.0, 5.0, 3.0, 2.0
FORCE_NODES, RING = 200, 15.0
#: Characters of an image link by whose end paths are looked up.
TAIL = 12


def place(wiki: str = "wiki", relative: str = "relative") -> Column:
    """A node's sort key."""
    return F.struct(F.col(wiki).alias("wiki"), F.split(relative, "/").alias("parts"))


def _path(key: Column) -> Column:
    return F.when(key.isNotNull(), F.concat_ws("/", key["parts"]))


def nodes(docs: DataFrame) -> DataFrame:
    """(wiki, relative, kind, title, tags)"""
    kind = F.when(F.col("content_type") == "markdown", "page").when(F.col("content_type") == "code", "code").otherwise("asset")
    return docs.select("wiki", "relative", kind.alias("kind"), "title", "tags")


def _tail(c: str) -> Column:
    return F.right(F.col(c), F.lit(TAIL))


def _grams(c: str, n: int) -> Column:
    """All substrings of length n; of length 0 the empty one."""
    starts = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def page_links(docs: DataFrame) -> DataFrame:
    """(wiki, relative, pos, target)"""
    return docs.select("wiki", "relative", F.posexplode("links").alias("pos", "target"))


def names(docs: DataFrame) -> DataFrame:
    """(wiki, relative, name): stem and title of every page, by which links may mean it."""
    return docs.select("wiki", "relative", F.explode(F.array_distinct(F.array(files.stem(F.col("relative")), F.col("title")))).alias("name"))


def resolved(links: DataFrame, known: DataFrame) -> DataFrame:
    """Edges without `broken` of links (wiki, relative, pos, target), by known names of all pages."""
    exact = known.select(F.col("wiki").alias("w"), F.col("relative").alias("r")).distinct()
    first = known.select("name", place().alias("key")).groupBy("name").agg(F.min("key").alias("key"))
    found = links.join(exact, (F.col("w") == F.col("wiki")) & (F.col("r") == F.concat("target", F.lit(".md"))), "left").join(first, F.col("name") == F.col("target"), "left")
    return found.select("wiki", "relative", F.lit("links_to").alias("kind"), "pos", "target", F.coalesce("w", "key.wiki").alias("to_wiki"), F.coalesce("r", _path(F.col("key"))).alias("to_relative"))


def changed_names(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name) and (wiki, relative) that pages gained or lost, from the names of changed pages before and after: no other link can mean another page now."""
    row, key = ["wiki", "relative", "name"], ["wiki", "relative"]
    both = lambda columns: before.join(after, columns, "left_anti").unionByName(after.join(before, columns, "left_anti"))
    return both(row).select("name").distinct(), both(key).select(*key).distinct()


def links_to_resolve(old: DataFrame, changed: DataFrame, name: DataFrame, path: DataFrame) -> DataFrame:
    """Of old edges those of unchanged pages (not in changed(wiki, relative)) whose target is such a name or path."""
    own = old.join(changed, ["wiki", "relative"], "left_anti")
    by_name = own.join(name.select(F.col("name").alias("target")), "target", "left_semi")
    by_path = own.join(path.select("wiki", F.regexp_replace("relative", r"\.md$", "").alias("target")).filter("target <> ''"), ["wiki", "target"], "left_semi")
    return by_name.select("wiki", "relative", "pos", "target").unionByName(by_path.select("wiki", "relative", "pos", "target")).distinct()


def resolved_again(links: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of a few links: only the names and paths that they ask for are looked at."""
    asked = links.select("wiki", "target").distinct()
    some = known.join(asked.select(F.col("target").alias("name")), "name", "left_semi")
    at = known.join(asked.select("wiki", F.concat("target", F.lit(".md")).alias("relative")), ["wiki", "relative"], "left_semi")
    return resolved(links, some.select("wiki", "relative", "name").unionByName(at.select("wiki", "relative", "name")).distinct()).withColumn("broken", F.col("to_relative").isNull())


def edges(docs: DataFrame, images: str | None = None) -> DataFrame:
    """(wiki, relative, kind, pos, target, to_wiki, to_relative, broken): one per link; to_ is null if broken.

    A link means the page of its own wiki at <link>.md, else the first node of any wiki whose stem or title equals it. Image links (the array column
    `images`) mean the first node whose path contains them.
    """
    out = resolved(page_links(docs), names(docs))
    if images:
        pics = docs.select("wiki", "relative", F.posexplode(images).alias("pos", "target"))
        targets = pics.select("target", _tail("target").alias("gram")).distinct()
        # a path holds a target if it holds the target's end: an equality over the few lengths that occur, then the whole target
        sizes = sorted(r.n for r in targets.select(F.length("gram").alias("n")).distinct().collect())
        every = docs.select(place().alias("key"), F.col("relative").alias("r"))
        grams = every.select("key", "r", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("r", n) for n in sizes] or [F.array().cast("array<string>")])))).alias("gram"))
        hit = targets.join(grams, "gram").filter(F.contains(F.col("r"), F.col("target"))).groupBy("target").agg(F.min("key").alias("key"))
        out = out.unionByName(pics.join(hit, "target", "left").select("wiki", "relative", F.lit("embeds").alias("kind"), "pos", "target", F.col("key.wiki").alias("to_wiki"), _path(F.col("key")).alias("to_relative")))
    return out.withColumn("broken", F.col("to_relative").isNull())


def outgoing(links: DataFrame, wiki: str, relative: str) -> DataFrame:
    return links.filter((F.col("wiki") == wiki) & (F.col("relative") == relative))


def backlinks(links: DataFrame, wiki: str, relative: str) -> DataFrame:
    """(wiki, relative): distinct sources."""
    return links.filter((F.col("to_wiki") == wiki) & (F.col("to_relative") == relative)).select("wiki", "relative").distinct()


def broken(links: DataFrame) -> DataFrame:
    return links.filter("broken").select("wiki", "relative", "target")


def stats(all_nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(nodes, edges, broken_edges)"""
    count = links.agg(F.count("*").alias("edges"), F.count_if("broken").alias("broken_edges"))
    return all_nodes.agg(F.count("*").alias("nodes")).join(count)  # one row each


def degrees(all_nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(wiki, relative, n_out, n_in); broken links count as outgoing."""
    out = links.select("wiki", "relative", F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = links.filter("NOT broken").select(F.col("to_wiki").alias("wiki"), F.col("to_relative").alias("relative"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    none = all_nodes.select("wiki", "relative", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return none.unionByName(out).unionByName(back).groupBy("wiki", "relative").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def _steps(links: DataFrame) -> DataFrame:
    """Both directions of links that lead somewhere: (wiki, relative, side 0 out or 1 in, pos, from's key for in, n_wiki, n_relative)."""
    whole = links.filter("NOT broken")
    out = whole.select("wiki", "relative", F.lit(0).alias("side"), place().alias("by"), "pos", F.col("to_wiki").alias("n_wiki"), F.col("to_relative").alias("n_relative"))
    back = whole.select(F.col("to_wiki").alias("wiki"), F.col("to_relative").alias("relative"), F.lit(1).alias("side"), place().alias("by"), "pos", F.col("wiki").alias("n_wiki"), F.col("relative").alias("n_relative"))
    return out.unionByName(back)


def neighborhood(all_nodes: DataFrame, links: DataFrame, wiki: str, relative: str, depth: int = 2, most: int | None = None) -> DataFrame:
    """(wiki, relative, depth): nodes within so many links in either direction, nearest first up to `most`; empty for an unknown centre.

    One join per hop, of the hop's new nodes only. With a cap, a hop's new nodes are taken in the order in which a breadth-first walk meets them: by their
    first discoverer, its outgoing links before its incoming ones.
    """
    steps = _steps(links)
    found = all_nodes.filter((F.col("wiki") == wiki) & (F.col("relative") == relative)).select("wiki", "relative", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("turn"))
    edge, count = found, 1
    for hop in range(1, depth + 1):
        met = edge.select("wiki", "relative", "turn").join(steps, ["wiki", "relative"]).groupBy(F.col("n_wiki").alias("wiki"), F.col("n_relative").alias("relative")).agg(F.min(F.struct("turn", "side", "by", "pos")).alias("met"))
        new = met.join(found.select("wiki", "relative"), ["wiki", "relative"], "left_anti")
        if most is None:
            new = new.select("wiki", "relative", F.lit(hop).alias("depth"), F.lit(0).cast("long").alias("turn"))
        else:
            best = new.orderBy("met").limit(max(0, most - count))  # a walk that is capped holds at most `most` nodes
            new = best.withColumn("turn", F.row_number().over(Window.orderBy("met")).cast("long")).select("wiki", "relative", F.lit(hop).alias("depth"), "turn")
            rows = new.collect()  # of a walk that is capped, at most `most` rows
            count += len(rows)
            new = new.sparkSession.createDataFrame(rows, new.schema)
        edge, found = new, found.unionByName(new)
    return found.select("wiki", "relative", "depth")


def subgraph_edges(links: DataFrame, kept: DataFrame, depth: int) -> DataFrame:
    """Edges that touch a node nearer than `depth` and whose ends are all in kept(wiki, relative, depth); broken ones of such nodes too."""
    a = kept.select("wiki", "relative", F.col("depth").alias("d_from"))
    b = kept.select(F.col("wiki").alias("to_wiki"), F.col("relative").alias("to_relative"), F.col("depth").alias("d_to"))
    both = links.join(a, ["wiki", "relative"]).join(b, ["to_wiki", "to_relative"], "left")
    near = F.least(F.col("d_from"), F.coalesce("d_to", F.col("d_from")))
    return both.filter((F.col("broken") | F.col("d_to").isNotNull()) & (near < depth)).drop("d_from", "d_to")


def related(docs: DataFrame, links: DataFrame, wiki: str, relative: str, limit: int = 10) -> DataFrame:
    """(wiki, relative, title, score, reasons): by links, shared tags, directory and shared neighbours of the centre."""
    is_centre = (F.col("wiki") == wiki) & (F.col("relative") == relative)
    centre = docs.filter(is_centre)
    whole = links.filter("NOT broken")
    to = (F.col("to_wiki") == wiki) & (F.col("to_relative") == relative)
    row = lambda score, reason: [F.lit(score).alias("score"), F.lit(reason).alias("reason")]
    out = whole.filter(is_centre).select(F.col("to_wiki").alias("wiki"), F.col("to_relative").alias("relative"))
    back = whole.filter(to).select("wiki", "relative")
    parts = [out.select("*", *row(DIRECT, "Direct link")), back.select("*", *row(BACK, "Backlink"))]
    mine = centre.select(F.explode(F.array_distinct("tags")).alias("tag"))
    parts.append(docs.select("wiki", "relative", F.explode("tags").alias("tag")).join(mine, "tag").select("wiki", "relative", F.lit(TAG).alias("score"), F.concat(F.lit("Shared tag: "), "tag").alias("reason")))
    folder = files.parent(F.lit(relative))
    known = centre.select(F.lit(1).alias("one")).limit(1)
    parts.append(docs.filter((files.parent(F.col("relative")) == folder) & (folder != "")).join(known, how="left_semi").select("wiki", "relative", *row(FOLDER, "Same directory")))
    for mine, a, b, name in (
        (out.distinct(), ("to_wiki", "to_relative"), ("wiki", "relative"), "outgoing"),
        (back.distinct(), ("wiki", "relative"), ("to_wiki", "to_relative"), "incoming"),
    ):
        pair = whole.select(F.col(a[0]).alias("x"), F.col(a[1]).alias("y"), F.col(b[0]).alias("wiki"), F.col(b[1]).alias("relative")).distinct()
        n = pair.join(mine.toDF("x", "y"), ["x", "y"]).groupBy("wiki", "relative").count()
        parts.append(n.select("wiki", "relative", (F.col("count") * SHARED).alias("score"), F.concat(F.col("count").cast("string"), F.lit(f" shared {name} links")).alias("reason")))
    evidence = parts[0]
    for p in parts[1:]:
        evidence = evidence.unionByName(p)
    summed = evidence.filter(~is_centre).groupBy("wiki", "relative").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list("reason")).alias("reasons"))
    return summed.join(docs.select("wiki", "relative", "title"), ["wiki", "relative"]).orderBy(F.desc("score"), "title", "wiki", F.split("relative", "/")).limit(limit).select("wiki", "relative", "title", "score", "reasons")


def dot_lines(links: DataFrame) -> DataFrame:
    """(line): Graphviz edges; broken ones are left out."""
    quoted = lambda w, r: F.concat(F.lit('"'), F.replace(F.concat(F.col(w), F.lit(":"), F.col(r)), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return links.filter("NOT broken").select(F.concat(F.lit("  "), quoted("wiki", "relative"), F.lit(" -> "), quoted("to_wiki", "to_relative"), F.lit(";")).alias("line"))


def numbered(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """rows with `place`, from 0, and `size` of their group: all are sorted by ranges and counted range by range, so no group has to fit into a task."""
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    kept = checkpointed(spread.withColumn("_part", F.shiftright("_id", 33)))
    ranges = kept.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)  # one row for each range
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    return kept.join(ranges, [group, "_part"]).select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias("place"), "size")


def ring_layout(kept: DataFrame) -> DataFrame:
    """(wiki, relative, x, y) of kept(wiki, relative, depth): rings of radius 15 per link from the centre, equal angles in node order."""
    own = numbered(kept.select("wiki", "relative", "depth"), "depth", "wiki", F.split("relative", "/"))
    own = own.withColumn("angle", 2 * np.pi * F.col("place") / F.col("size"))
    return own.select("wiki", "relative", F.round(RING * F.col("depth") * F.cos("angle"), 4).alias("x"), F.round(RING * F.col("depth") * F.sin("angle"), 4).alias("y"))


def force_layout(kept: DataFrame, links: DataFrame, iterations: int = 100) -> DataFrame:
    """(wiki, relative, x, y) by repulsion k^2/d and attraction d^2/k; for graphs of at most FORCE_NODES nodes, others get rings."""
    few = kept.orderBy(place()).limit(FORCE_NODES + 1)
    if few.count() > FORCE_NODES:
        return ring_layout(kept)
    mine = kept.select("wiki", "relative")
    inside = links.filter("NOT broken").join(mine, ["wiki", "relative"]).join(mine.toDF("to_wiki", "to_relative"), ["to_wiki", "to_relative"])
    out = inside.groupBy("wiki", "relative").agg(F.collect_list(F.struct("to_wiki", "to_relative")).alias("to"))
    rows = kept.select("wiki", "relative").join(out, ["wiki", "relative"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pdf.wiki[i], pdf.relative[i].split("/")))
        pdf = pdf.iloc[order].reset_index(drop=True)
        n = len(pdf)
        at = {(w, r): i for i, (w, r) in enumerate(zip(pdf.wiki, pdf.relative))}
        ends = [(i, at[t["to_wiki"], t["to_relative"]]) for i, to in enumerate(pdf.to) if to is not None for t in to if at[t["to_wiki"], t["to_relative"]] != i]
        turn = 2 * np.pi * np.arange(n) / max(1, n)
        xy, k = np.stack((10 * np.cos(turn), 10 * np.sin(turn)), 1), 10.0 / np.sqrt(max(1, n))
        for _ in range(iterations):
            gap = xy[:, None] - xy[None]
            d = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
            force = (gap / d[..., None] * (k * k / d)[..., None]).sum(1)
            for i, j in ends:
                v = xy[i] - xy[j]
                pull = v * np.linalg.norm(v) / k
                force[i] -= pull
                force[j] += pull
            size = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
            xy = xy + 0.1 * force / size * np.minimum(size, 5.0)
        return pd.DataFrame({"wiki": pdf.wiki, "relative": pdf.relative, "x": xy[:, 0], "y": xy[:, 1]})

    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(lambda p: run(p), "wiki string, relative string, x double, y double")  # FORCE_NODES rows at most


def layout(kept: DataFrame, links: DataFrame) -> DataFrame:
    """(wiki, relative, x, y): nothing for no node, the origin for one, forces for fewer than FORCE_NODES, else rings."""
    few = kept.limit(FORCE_NODES).count()
    if few <= 1:
        return kept.select("wiki", "relative", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return force_layout(kept, links) if few < FORCE_NODES else ring_layout(kept)


def drawing_order(positions: DataFrame) -> DataFrame:
    """Rows from top to bottom, then from left to right, then in node order."""
    return positions.orderBy("y", "x", place())
