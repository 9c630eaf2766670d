"""What a crawl still has to fetch and may keep: membership, repeated shapes, link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.codec import fnv1a
from webloom.functions.lang import german_url
from webloom.functions.urls import query_shape
from webloom.session import materialise

MOST_LINKS = 300_000


def not_seen(pages: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose address hash is not in `seen`(hash); equal addresses once."""
    hashed = pages.withColumn("hash", fnv1a(F.col(url))).dropDuplicates(["hash"])
    return hashed.join(seen.select("hash"), "hash", "left_anti")


def merge_seen(*runs: DataFrame) -> DataFrame:
    """One sorted, distinct set of hashes from several."""
    whole = runs[0].select("hash")
    for run in runs[1:]:
        whole = whole.union(run.select("hash"))
    return whole.distinct().repartitionByRange("hash").sortWithinPartitions("hash")


def mark_repeated_shapes(pages: DataFrame, order: str, url: str = "url", site: str = "site") -> DataFrame:
    """`repeated`: another page of the site with the same path and parameter names came before."""
    shape = query_shape(F.col(url))
    before = F.row_number().over(W.partitionBy(site, "shape").orderBy(order)) > 1
    return pages.withColumn("shape", shape).withColumn("repeated", F.when(F.col("shape").isNull(), False).otherwise(before))


def german_frontier(links: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """(site, url): all links of German sites, of others the German part, or its usual folder if no link leads there."""
    own = german_url(F.concat(F.col(site), F.lit("/")))
    kept = links.where(own | german_url(F.col(url))).select(site, url)
    without = links.select(site).distinct().join(kept.select(site).distinct(), site, "left_anti")
    return kept.unionByName(without.select(site, F.concat(site, F.lit("/de/")).alias(url)))


def first_pages(pages: DataFrame, per_site: int, order: str, site: str = "site") -> DataFrame:
    return pages.withColumn("__nth", F.row_number().over(W.partitionBy(site).orderBy(order))).where(F.col("__nth") <= per_site).drop("__nth")


def reachable(start: DataFrame, edges: DataFrame, rounds: int, allowed: Column | None = None) -> DataFrame:
    """(url, depth): breadth-first over landed links, at most `rounds` steps. Each round is written, so a lost executor costs one round."""
    found = frontier = materialise(start.select("url", F.lit(0).alias("depth")).distinct(), "reached")
    for depth in range(1, rounds + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        step = step if allowed is None else step.where(allowed)
        frontier = materialise(step.join(found, "url", "left_anti").select("url", F.lit(depth).alias("depth")), "step")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found
