"""URL filters: rules, and link-graph propagation for what no rule decides.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the
longest fitting rule wins. For the rest, hosts are judged: trust flows as personalised PageRank from hosts
with allowed pages along links; distrust flows from hosts with blocked pages against the direction of links, so
a host that leads to blocked ones inherits it. Both are counted in pages, as much in all as there are seed pages, so what a
corpus holds elsewhere does not tip a host; mass that reaches a host without links goes back to the seeds. A host whose distrust
makes up more than `limit` of both is blocked, every other one allowed.

Native: DataFrame functions only. Edges are counted per pair of hosts before they meet, ranks are one row per host,
iterations are cut at checkpoints, and go on until ranks stand still: until what is left to come is below TOLERANCE of all mass, however
long the paths are.

Defined results: a null url or one without `://` has an empty host and path, no rule and verdict `allow`;
hosts without links keep what their own pages' rules give; repeated pages count as often as they occur;
null html has no links; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import ascii_lower, materialize, small_side, table

#: The rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING, LIMIT = 0.85, 0.8
#: The part of all mass that may still move when iteration ends; turns between checkpoints.
TOLERANCE, EVERY = 1e-6, 5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"(?i)href\s*=\s*[\x22']?((?:[a-z][a-z0-9+.-]*:)?//[^\x22'\s>]+)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (n, rule, verdict), or null. The list of rules is part of the plan."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    all_rules = F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(all_rules, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["n"].alias("n"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.filter("html IS NOT NULL AND host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    dst = parts(F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href")))[0]
    return links.select("src", dst.alias("dst")).filter("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, rank) from edges (src, dst, n) and seeds (host, seed); ranks add up to what the seeds do.

    A turn shrinks what is left to come by `damping`, so from the change over a few turns follows how far the ranks are from their limit. Handing the mass
    of hosts without links back to the seeds only scales all ranks, so it is done once, at the end.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    whole = seeds.agg(F.sum("seed")).first()[0] or 0.0
    again = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    ranks = materialize(seeds.select("host", F.col("seed").cast("double").alias("rank")))
    shrunk = damping**EVERY
    while True:
        before = ranks
        for _ in range(EVERY):
            came = share.join(ranks, share.src == ranks.host).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
            ranks = came.unionByName(again).groupBy("host").agg(F.sum("rank").alias("rank"))
        ranks = materialize(ranks)
        moved = ranks.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("moved"))
        if (moved.agg(F.sum("moved")).first()[0] or 0.0) * shrunk / (1 - shrunk) <= tolerance * whole:
            break
    mass = ranks.agg(F.sum("rank")).first()[0] or 0.0
    return ranks.select("host", (F.col("rank") * (whole / mass if mass else 1.0)).alias("rank"))


def judge_hosts(pages: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, trust, distrust, blocked) from pages (host, html, hit: the rule's struct)."""
    seeds = materialize(pages.filter("hit IS NOT NULL AND host <> ''").groupBy("host", F.col("hit.verdict").alias("verdict")).count())
    edges = materialize(host_edges(pages))
    found = []
    for verdict, own in (("allow", edges), ("block", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        start = seeds.filter(F.col("verdict") == verdict).select("host", F.col("count").cast("double").alias("seed"))
        ranks = start.withColumnRenamed("seed", "rank") if edges.isEmpty() else propagate(own, start)
        found.append(ranks.withColumn("kind", F.lit(verdict)))
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    both = found[0].unionByName(found[1]).groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") > limit * (F.col("trust") + F.col("distrust")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], limit: float = LIMIT) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    host, path = parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = materialize(judge_hosts(own, limit))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return own.drop("html").join(small_side(hosts), "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every url."""
    host, path = parts(F.col("url"))
    own = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return own.withColumn("hit", rule_of(F.col("host"), F.col("path"), RULES)).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))


RULES_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, start) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)})
SELECT page_id, host, path, (SELECT arg_max(h || start, length(h || start)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)) AS rule,
(SELECT arg_max(verdict, length(h || start)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)) AS verdict FROM p
"""
