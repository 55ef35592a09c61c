"""Names to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import files, text
from lorespark.operators import fuzzy

#: Extensions and home pages that are tried, in order.
EXTENSIONS = ["md", "markdown", "txt", "rst", "org", "tex", "rs", "py", "c", "h", "go", "sh"]
HOMES = ["index.md", "README.md", "Home.md", "home.md"]
KINDS = ["exact_path", "exact_stem", "case_insensitive", "normalized", "title", "alias"]
POLICIES = ["kebab", "snake", "slug"]


def candidates_of(names: DataFrame) -> DataFrame:
    """names(name, ...) with (pos, relative): the paths that each may mean, most likely first; none for an empty name."""
    based = names.withColumn("_base", F.regexp_replace(F.trim("name"), r"^(\./)+", "")).filter("_base <> ''")
    base = F.col("_base")
    known = files.classify_extension(base).isNotNull()
    out = [F.when(known, base), *[F.concat(base, F.lit(f".{e}")) for e in EXTENSIONS], *[F.concat(base, F.lit(f"/{h}")) for h in HOMES]]
    for policy in POLICIES:
        other = text.naming_path(base, policy)
        out += [F.when(other != base, F.concat(other, F.lit(f".{e}"))) for e in ("md", "markdown")]
    out.append(F.when(~known, base))
    return based.select(*names.columns, F.posexplode(F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))).alias("pos", "relative"))


def candidates(spark: SparkSession, name: str) -> DataFrame:
    """(pos, relative): the paths that a name may mean, most likely first."""
    return candidates_of(spark.range(1).select(F.lit(name).alias("name"))).select("pos", "relative")


def shallow(docs: DataFrame, name: str) -> DataFrame:
    """(wiki, relative, kind): per wiki the first candidate that exists."""
    found = docs.select("wiki", "relative").join(F.broadcast(candidates(docs.sparkSession, name)), "relative")  # tens of rows
    best = found.groupBy("wiki").agg(F.min_by("relative", "pos").alias("relative"))
    return best.withColumn("kind", F.when(F.col("relative") == name, "exact_path").otherwise("exact_stem"))


def listed(docs: DataFrame, name: str) -> DataFrame:
    """(wiki, relative, kind): per wiki the entry of the name's directory that fits but for case and naming, Markdown first."""
    name = name.strip()
    folder, _, last = name.rpartition("/")
    low = F.lower(F.lit(last))
    entry, own = F.lower(files.file_name(F.col("relative"))), F.lower(files.stem(F.col("relative")))
    fits = (entry == low) | (own == low)
    for p in POLICIES:
        fits |= own == text.naming(low, p)
    found = docs.filter((files.parent(F.col("relative")) == folder) & fits)
    rank = F.struct((F.col("content_type") != "markdown").alias("other"), F.split("relative", "/").alias("parts"))
    return found.groupBy("wiki").agg(F.min_by("relative", rank).alias("relative")).withColumn("kind", F.lit("case_insensitive"))


def ranked(docs: DataFrame, name: str) -> DataFrame:
    """(wiki, relative, kind, kind_rank, depth): every document that the name may mean; order by kind_rank, depth, path components."""
    needle = F.lower(F.trim(F.lit(name)))
    path = F.lower("relative")
    bare = F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(path)
    stem = F.lower(files.stem(F.col("relative")))
    other = [F.lower(text.naming(needle, p)) for p in POLICIES]
    page = files.is_page(F.col("content_type"))
    kind = (
        F.when((path == needle) | (bare == needle), "exact_path")
        .when(stem == needle, "exact_stem")
        .when(stem.isin(*other) | bare.isin(*other), "normalized")
        .when(page & (F.lower("title") == needle), "title")
        .when(page & F.exists("aliases", lambda a: F.lower(a) == needle), "alias")
    )
    out = docs.select("wiki", "relative", kind.alias("kind")).filter("kind IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return out.select("wiki", "relative", "kind", rank.alias("kind_rank"), F.size(F.split("relative", "/")).alias("depth"))


def resolve(docs: DataFrame, name: str) -> DataFrame:
    """(wiki, relative, kind): the best match, the cheaper ways first."""
    for found in (shallow(docs, name), listed(docs, name)):
        if not found.isEmpty():
            return found.orderBy("wiki").limit(1)
    return ranked(docs, name).orderBy("kind_rank", "depth", F.split("relative", "/"), "wiki").limit(1).select("wiki", "relative", "kind")


def home(docs: DataFrame, configured: str | None = None) -> DataFrame:
    """(wiki, relative): each wiki's home page, the configured one before the usual names."""
    names = [*([configured] if configured else []), *HOMES]
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("relative"))
    return docs.filter(F.col("relative").isin(names)).groupBy("wiki").agg(F.min_by("relative", rank).alias("relative"))


def or_suggestions(docs: DataFrame, name: str, limit: int = 5) -> tuple[DataFrame, DataFrame | None]:
    """The best match, or where there is none also names like it."""
    found = resolve(docs, name)
    if not found.isEmpty():
        return found, None
    return found, fuzzy.suggestions(fuzzy.page_stems(docs), name, limit)
