"""Fixed inputs of the named queries: query texts, words, robots files, addresses, seed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = "src1.example.org"
PREFIX = "ti"
MISSPELT = ("attio", "attionx", "attion", "thte", "zzzzzz", "nad", "oningg")
QUERIES = {
    "search_and": "de la",
    "search_three_words": "the de ingor la estion",
    "search_coord": "de tion",
    "search_coord_empty": "de th",
    "search_prefix_kept": "ment",
    "search_prefix_variants": "tho",
    "search_stop_only": "the of",
    "search_site": f"de site:{SITE}",
    "bm25_term": "ingor",
}
#: A time in seconds: some of the orders' customers were last seen over a week before it.
NOW = 883612800
AGENT = "Mozilla/5.0 (compatible; WebloomBot/1.0; +https://webloom.example/robots.txt)"


#: Bodies of robots files by kind; {k} is the site's number.
ROBOTS = (
    "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /tie\nAllow: /tie\nDisallow: /a*b$ # star\nDisallow: /x.{k}\nDisallow: /s*t*a*r*s*x*\nDisallow:\nSitemap: https://s{k}.example/m.xml",
    "user-agent: other\nuser-agent: webloombot\ndisallow: /ours{k}\n\nuser-agent: *\ndisallow: /",
    "User-agent: *\nContent-Signal: ai=yes, search=no\nAllow: /",
    "User-agent: otherbot\nDisallow: /",
)
PATHS = ("/", "/private", "/private/open/x", "/tie", "/axxb", "/axxbc", "/x.7", "/xz7", "/s1t1a1r1s1x1", "/ours2", "/ours5/a")


def _sites(suppliers: DataFrame):
    key = F.col("s_suppkey").cast("string")
    return suppliers, key, F.concat(F.lit("s"), key, F.lit(".example"))


def robots_files(suppliers: DataFrame) -> DataFrame:
    """A site for each supplier, its file of the kind that its key's rest by four names."""
    rows, key, site = _sites(suppliers)
    bodies = F.array(*(F.replace(F.lit(body), F.lit("{k}"), key) for body in ROBOTS))
    return rows.select(site.alias("site"), F.get(bodies, F.pmod("s_suppkey", F.lit(4)).cast("int")).alias("body"))


def robots_paths(suppliers: DataFrame) -> DataFrame:
    rows, _, site = _sites(suppliers)
    return rows.select(site.alias("site"), F.explode(F.array(*map(F.lit, PATHS))).alias("path"))


def shape_pages(pages: DataFrame) -> DataFrame:
    """Addresses of seven sites with three paths and four kinds of query."""
    number = F.col("page_id").cast("string")
    queries = F.array(F.concat(F.lit("?b="), number, F.lit("&a=2")), F.concat(F.lit("?a="), number, F.lit("&b=6&b=7")), F.concat(F.lit("?a=1&&a="), number), F.lit(""))
    site = F.concat(F.lit("h"), (F.col("page_id") % 7).cast("string"), F.lit(".example"))
    url = F.concat(F.lit("https://"), site, F.lit("/p"), (F.col("page_id") % 3).cast("string"), F.get(queries, (F.col("page_id") % 4).cast("int")))
    return pages.select(F.col("page_id").alias("pos"), site.alias("site"), url.alias("url"))


def seed_lines(suppliers: DataFrame) -> DataFrame:
    """Lines of five kinds; the last two kinds name the site of the supplier before."""
    key, before = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") - 1).cast("string")
    kinds = F.array(
        F.lit("# list"), F.lit("  "), F.concat(F.lit(" one"), key, F.lit(".example ")), F.concat(F.lit("http://one"), before, F.lit(".example/x/y?q")),
        F.concat(F.lit("one"), key, F.lit(".example\thttps://one"), key, F.lit(".example/map.xml")),
    )
    return suppliers.select(F.get(kinds, F.pmod("s_suppkey", F.lit(5)).cast("int")).alias("value"))


def discovery(suppliers: DataFrame) -> dict[str, DataFrame]:
    """Sites with one way of discovery each, by the key's rest by five: an llms.txt, an index of sitemaps, a wiki, the usual name, none."""
    rows, key, host = _sites(suppliers)
    site = F.concat(F.lit("https://"), host)
    way = F.pmod("s_suppkey", F.lit(5))

    def part(n: int, **columns) -> DataFrame:
        return rows.where(way == n).select(site.alias("site"), *(c.alias(name) for name, c in columns.items()))

    def text(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    listed = part(1, pos=F.lit(0), sitemap=text(site, "/index.xml")).unionByName(part(2, pos=F.lit(0), sitemap=text(site, "/gone.xml")))
    landed = part(1, addr=text(site, "/index.xml"), body=text("<sitemapindex><loc>", site, "/a.xml?x=1&amp;y=2</loc><loc>", site, "/index.xml</loc></sitemapindex>"))
    landed = landed.unionByName(part(1, addr=text(site, "/a.xml?x=1&y=2"), body=text("<urlset><loc> ", site, "/1?a&amp;b </loc><LOC>no</LOC></urlset>")))
    landed = landed.unionByName(part(3, addr=text(site, "/sitemap.xml"), body=text("<urlset><loc>", site, "/usual</loc></urlset>")))
    return {
        "sites": rows.select(site.alias("site")),
        "llms": part(0, body=text("# x\n- [a](", site, "/a?x=1&amp;y=2)\n- [m](mailto:b)")).unionByName(part(4, body=text(" <html>[a](", site, "/no)</html>"))),
        "listed": listed, "landed": landed.select("addr", "body"),
        "wikis": part(2).unionByName(part(1)), "submitted": rows.limit(0).select(site.alias("site"), site.alias("sitemap")),
    }
