"""Host statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import short
from webloom.operators.index import Index


def host_pages(index: Index) -> DataFrame:
    return index.docs.groupBy("host").agg(F.count("*").alias("pages"))


def top_hosts(index: Index, k: int) -> DataFrame:
    return host_pages(index).orderBy(F.desc("pages"), "host").limit(k)


def pages_of(index: Index, host: str, any_www: bool = False) -> DataFrame:
    """(pages) of a host, with its www. form if `any_www`."""
    names = [host, "www." + host] if any_www else [host]
    return index.docs.where(F.col("host").isin(names)).agg(F.count("*").alias("pages"))


def hosts_with_suffix(index: Index, domain: str) -> DataFrame:
    """(hosts, pages) of a domain and all below it."""
    return totals(host_pages(index).where((F.col("host") == domain) | F.col("host").endswith("." + domain)))


def totals(hosts: DataFrame) -> DataFrame:
    return hosts.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def hosts_where(index: Index, keep: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(totals, top k) of the hosts for which `keep`, a condition on column host, holds."""
    kept = host_pages(index).where(keep)
    return totals(kept), kept.orderBy(F.desc("pages"), "host").limit(k)


def recent_pages(index: Index, k: int = 8, title: int = 90) -> DataFrame:
    """(doc_id, title, host, url) of the pages that came last."""
    return index.docs.orderBy(F.desc("doc_id")).limit(k).select("doc_id", short(F.col("title"), title).alias("title"), "host", "url")
