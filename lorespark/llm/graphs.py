"""Connected components over links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import materialize, small_side


def components(links: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) for every id in links (a, b).

    Labels of neighbours hook the labels' own trees and are then shortened, so the number of rounds grows with the logarithm of the
    longest path; each round is a few joins on the links, cut at a checkpoint.
    """
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = materialize(links.select("a", "b").unionByName(back).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        named = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
        ends = edges.join(named("a"), "a").join(named("b"), "b")
        # the same offer to the end itself and to its label
        offers = ends.select(F.explode(F.array("a", "label_a")).alias("id"), F.col("label_b").alias("offer"))
        offers = offers.groupBy("id").agg(F.min("offer").alias("offer"))
        hooked = labels.join(offers, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        hooked = materialize(hooked)
        # all of a large component share a label: the few labels that moved are broadcast, many are plain shuffles that can be split
        up = hooked.filter("label <> id").select(F.col("id").alias("label"), F.col("label").alias("higher"))
        up = up.join(hooked.select("label").distinct(), "label", "left_semi")
        after = hooked.join(small_side(up), "label", "left").select("id", "old", F.coalesce("higher", "label").alias("label"))
        after = materialize(after)
        labels = after.select("id", "label")
        if after.filter("old <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
