"""Landed crawl responses to pages: routing by content type, discovery, stored pages. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.codec import stored_text
from webloom.functions.html import html_fields, unescape_each
from webloom.functions.text import is_textual, page_text, page_title
from webloom.session import materialise
from webloom.sources.lists import STORED_PAGE, first_found, is_sitemap_index, llms_links, sitemap_locs

#: Sitemaps of a site that are begun with.
ROOTS = 5


def _blank(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).rlike(r"(?U)^\s*$")


def content_pages(responses: DataFrame, method: str = "html") -> DataFrame:
    """(url, title, description, text, source) from (url, ctype, body): HTML is scanned, plain text and Markdown give their first line
    as title, other types and pages without title and text are left out. No type counts as HTML; a null body is empty."""
    ctype, body = F.lower(F.coalesce("ctype", F.lit(""))), F.coalesce("body", F.lit(""))
    is_html = (ctype == "") | ctype.contains("html")
    kept = responses.where(is_textual(ctype) & (is_html | ctype.contains("text") | ctype.contains("markdown")))
    read = kept.select("url", is_html.alias("h"), body.alias("body"), html_fields(F.when(is_html, body)).alias("f"))
    pages = read.select(
        "url",
        F.when(F.col("h"), F.col("f.title")).otherwise(page_title(F.col("body"))).alias("title"),
        F.when(F.col("h"), F.col("f.description")).otherwise("").alias("description"),
        F.when(F.col("h"), F.col("f.text")).otherwise(page_text(F.col("body"))).alias("text"),
        F.lit(method).alias("source"),
    )
    return pages.where(~_blank(F.col("title"), F.col("text")))


def stored_pages(lines: DataFrame, value: str = "value", dictionary: bytes = b"") -> DataFrame:
    """(url, title, description, text) of stored-page lines, on a stream too; `dictionary` is the one that texts were packed with. Lines that are no JSON go; so does a page without title and plain text."""
    row = lines.select(F.from_json(value, STORED_PAGE, {"mode": "PERMISSIVE"}).alias("p")).select("p.*").where("u is not null")
    shown = row.where(~_blank(F.col("t"), F.col("x")))
    return shown.select(F.col("u").alias("url"), F.coalesce("t", F.lit("")).alias("title"), F.coalesce("d", F.lit("")).alias("description"), stored_text(F.coalesce("x", F.lit("")), F.col("z"), dictionary).alias("text"))


def follow_sitemaps(roots: DataFrame, landed: DataFrame) -> DataFrame:
    """(site, url): page addresses in the sitemaps below roots(site, addr), read from landed(addr, body).

    Each level of indexes is written, and no sitemap of a site is read twice, so indexes that name each other end; levels are
    followed until one names nothing new.
    """
    todo = materialise(roots.select("site", "addr").distinct(), "sitemaps")
    done, pages = todo, None
    while True:
        read = materialise(todo.join(landed, "addr").select("site", is_sitemap_index(F.col("body")).alias("is_index"), F.explode(sitemap_locs(F.col("body"))).alias("loc")), "locs")
        found = read.where("not is_index").select("site", F.col("loc").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        below = read.where("is_index")
        below = below.select("site", unescape_each(F.array("loc"))[0].alias("addr")).distinct()
        todo = materialise(below.join(done, ["site", "addr"], "left_anti"), "sitemaps")
        if todo.isEmpty():
            break
        done = done.unionByName(todo)
    return pages


def discover(sites: DataFrame, llms: DataFrame, listed: DataFrame, landed: DataFrame, wikis: DataFrame, submitted: DataFrame) -> DataFrame:
    """(site, method, url): how the pages of each site are found, and the pages it names.

    llms(site, body) comes first unless the owner has submitted(site, sitemap); then sitemaps: the submitted one, else those of
    the robots file, listed(site, pos, sitemap), else the usual name; then wikis(site), whose pages are listed elsewhere (null
    url); else the front page. landed(addr, body) holds the sitemaps' contents.
    """
    by_llms = llms.join(submitted, "site", "left_anti").select("site", F.explode(unescape_each(llms_links(F.coalesce("body", F.lit(""))))).alias("url"))
    first = listed.withColumn("nth", F.row_number().over(W.partitionBy("site").orderBy("pos"))).where(F.col("nth") <= ROOTS)
    roots = first_found(
        submitted.select("site", F.lit(0).alias("priority"), F.col("sitemap").alias("addr"))
        .unionByName(first.select("site", F.lit(1).alias("priority"), F.col("sitemap").alias("addr")))
        .unionByName(sites.select("site", F.lit(2).alias("priority"), F.concat("site", F.lit("/sitemap.xml")).alias("addr")))
    )
    ways = (
        ("llms.txt", by_llms),
        ("sitemap", follow_sitemaps(roots, landed)),
        ("mediawiki", wikis.select("site", F.lit(None).cast("string").alias("url"))),
        ("html", sites.select("site", F.concat("site", F.lit("/")).alias("url"))),
    )
    whole = None
    for priority, (method, rows) in enumerate(ways):
        one = rows.select("site", "url", F.lit(method).alias("method"), F.lit(priority).alias("priority"))
        whole = one if whole is None else whole.unionByName(one)
    return first_found(whole).select("site", "method", "url")
