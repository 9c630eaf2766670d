"""Page weight and cost, flagged communities, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.html import asset_links, resolved_links

#: Linked files of a page that are counted, least communities seen and share of a flagged host.
MOST_ASSETS = 25
LEAST_SEEN, LEAST_SHARE = 5, 0.8


def round_half_up(value: Column, places: int = 4) -> Column:
    return F.floor(value * 10**places + 0.5) / 10**places


def page_assets(links: Column, most: int = MOST_ASSETS) -> Column:
    """The first distinct links in order of their spelling."""
    return F.slice(F.array_sort(F.array_distinct(links)), 1, most)


def page_weight(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, page, html_bytes, assets, bytes_per_visit) from pages(host, page, html_bytes, asset_urls) and sizes(url, bytes); `page`
    names a page; sizes of 0 do not count."""
    linked = pages.select("host", "page", "html_bytes", F.explode_outer("asset_urls").alias("url")).join(sizes.where("bytes > 0"), "url", "left")
    return linked.groupBy("host", "page", "html_bytes").agg(F.count("bytes").alias("assets"), (F.first("html_bytes") + F.coalesce(F.sum("bytes"), F.lit(0))).alias("bytes_per_visit"))


def measure_pages(pages: DataFrame, sizes: DataFrame, egress: float, visits: int, most: int = MOST_ASSETS) -> DataFrame:
    """Weight and cost of landed front pages(host, url, html): their bytes and those of the first linked files, by sizes(url, bytes)."""
    linked = page_assets(resolved_links(F.col("url"), asset_links(F.col("html"))), most)
    read = pages.select("host", F.col("url").alias("page"), F.octet_length("html").cast("bigint").alias("html_bytes"), linked.alias("asset_urls"))
    return site_cost(page_weight(read, sizes), egress, visits)


def browser_weight(responses: DataFrame, kinds: DataFrame) -> DataFrame:
    """(host, bytes_per_visit, js_bytes, requests): received sizes with their kinds; a size without a kind counts."""
    joined = responses.join(kinds, ["host", "request_id"], "left")
    return joined.groupBy("host").agg(F.sum("bytes").alias("bytes_per_visit"), F.coalesce(F.sum(F.when(F.col("kind") == "Script", F.col("bytes"))), F.lit(0)).alias("js_bytes"), F.count("*").alias("requests"))


def site_cost(weights: DataFrame, egress: float, visits: int) -> DataFrame:
    """Dollars for traffic: of 1000 visits, an hour, ten hours."""
    one = F.col("bytes_per_visit") / 1e9 * egress
    return weights.select("*", round_half_up(one * 1000).alias("usd_per_1000_visits"), round_half_up(one * visits).alias("usd_per_hour"), round_half_up(one * visits * 10).alias("usd_per_10_hours"))


def measured_sites(measured: DataFrame, page_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measured, unreachable): rows without and with an error, each with the site's number of indexed pages, 0 if none is known."""
    told = measured.join(page_counts.select("host", F.col("pages").alias("pages_indexed")), "host", "left").withColumn("pages_indexed", F.coalesce("pages_indexed", F.lit(0)))
    failed = F.coalesce("error", F.lit("")) != ""
    return told.where(~failed), told.where(failed)


#: What a crawl counts.
COUNTED = ("emitted", "sent", "failed", "errors", "skipped", "sites_started", "sites_done", "foreign")


def crawl_counters(log: DataFrame, kind: str = "kind", ts: str = "ts", seconds: int = 5) -> DataFrame:
    """(window_start, one total for each of COUNTED up to the window's end, pages_per_second emitted in it) from a log of what happened."""
    every = log.where(F.col(kind).isin(*COUNTED)).groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("window_start"))
    counts = every.agg(*(F.count_if(F.col(kind) == name).alias(name) for name in COUNTED))
    # One row a window: the log's length in time, not its rows.
    so_far = W.orderBy("window_start").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select("window_start", *(F.sum(name).over(so_far).alias(name) for name in COUNTED), (F.col("emitted") / seconds).alias("pages_per_second"))


def cost_report_lines(costs: DataFrame) -> DataFrame:
    """(line) of a Markdown table, costliest first."""
    in_browser = F.col("basis") == "browser"
    js = F.when(in_browser, F.format_string("%d KB", F.floor(F.col("js_bytes") / 1024).cast("bigint"))).otherwise("n/a")
    requests = F.when(in_browser, F.col("requests")).otherwise(F.col("assets") + 1)
    line = F.format_string("| %s | %d KB | %s | %d | %.4f | %.4f | %.4f |", "host", F.floor(F.col("bytes_per_visit") / 1024).cast("bigint"), js, requests, "usd_per_1000_visits", "usd_per_hour", "usd_per_10_hours")
    return costs.orderBy(F.desc("usd_per_hour"), "host").select(line.alias("line"))


def latest_page_counts(*sources: DataFrame) -> DataFrame:
    """(host, pages): of several lists the last that has a host counts."""
    whole = None
    for n, source in enumerate(sources):
        one = source.select("host", "pages", F.lit(n).alias("at"))
        whole = one if whole is None else whole.unionByName(one)
    return whole.groupBy("host").agg(F.max_by("pages", F.struct("at", "pages")).alias("pages"))


def flagged_hosts(communities: DataFrame, host: str, item: str, flagged: Column, least: int = LEAST_SEEN, share: float = LEAST_SHARE) -> DataFrame:
    """(host, seen, flagged, is_flagged): distinct items and flagged items of each host, and whether most are flagged."""
    counts = communities.groupBy(F.col(host).alias("host")).agg(F.count_distinct(item).alias("seen"), F.count_distinct(F.when(flagged, F.lower(F.col(item).cast("string")))).alias("flagged"))
    return counts.withColumn("is_flagged", (F.col("seen") >= least) & (F.col("flagged") / F.col("seen") >= share))


def flagged_totals(hosts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One report row: hosts, items, flagged items, and the failures as a map from host to message."""
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("seen").alias("seen"), F.sum("flagged").alias("flagged"), F.count_if("is_flagged").alias("flagged_hosts"))
    if failed is None:
        return sums
    told = failed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", F.substring("message", 1, 60)))))).scalar()
    return sums.withColumn("failed", told)


def write_sorted_names(names: DataFrame, path: str, header: str) -> None:
    """One text file of distinct names in order under a comment line."""
    body = names.select(names.columns[0]).distinct().orderBy(names.columns[0]).select(F.col(names.columns[0]).alias("value"))
    head = names.sparkSession.createDataFrame([(f"# {header}",)], "value string")
    head.unionByName(body).coalesce(1).write.mode("overwrite").text(path)
