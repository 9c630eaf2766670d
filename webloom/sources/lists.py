"""Line lists, seeds, logs, landed crawl responses and sitemap scans as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.html import unescape_each
from webloom.functions.text import clip, collapse
from webloom.functions.urls import host_port, scheme, wiki_address

PAGE = "url STRING, title STRING, description STRING, text STRING, source STRING"
STORED_PAGE = "u STRING, t STRING, d STRING, x STRING, z STRING"
SITEMAP_SCAN = (
    "site STRING, scanned STRING, robots STRING, robots_code INT, robots_body STRING, found_by STRING, listed INT, "
    "sitemaps ARRAY<STRUCT<addr:STRING,`index`:BOOLEAN,total:INT,locs:ARRAY<STRING>,error:STRING,children:ARRAY<STRUCT<addr:STRING,total:INT,error:STRING>>>>"
)
_COST = "STRUCT<host:STRING,pages_indexed:INT,html_bytes:BIGINT,assets:INT,bytes_per_visit:BIGINT,usd_per_1000_visits:DOUBLE,usd_per_hour:DOUBLE,usd_per_10_hours:DOUBLE,js_bytes:BIGINT,requests:INT,basis:STRING,error:STRING>"
SITE_COSTS = f"egress_usd_per_gb DOUBLE, visits_per_hour INT, sites ARRAY<{_COST}>, unreachable ARRAY<{_COST}>"
COMMUNITY_POSTS = "posts ARRAY<STRUCT<post:STRUCT<id:BIGINT,name:STRING,body:STRING,url:STRING,deleted:BOOLEAN,removed:BOOLEAN>,community:STRUCT<title:STRING,name:STRING>>>"
COMMUNITIES = "communities ARRAY<STRUCT<community:STRUCT<id:BIGINT,name:STRING,nsfw:BOOLEAN>>>"
WIKI_TITLES = "query STRUCT<allpages:ARRAY<STRUCT<title:STRING>>>"
WIKI_EXTRACTS = "query STRUCT<pages:ARRAY<STRUCT<title:STRING,extract:STRING,description:STRING>>>"

#: Links of an llms.txt, page addresses of a sitemap (one spelling, and the lenient one).
LLMS_LINK = r"\]\((https?://[^)\s]+)\)"
LOC = r"<loc>\s*([^<\s]+)\s*</loc>"
LOC_LENIENT = r"(?is)<loc>\s*(.*?)\s*</loc>"
SITE_NAME = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"
WEEK = 7 * 24 * 3600


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines without blanks and comments; a path that is not there gives none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "value string")
    return list_lines(spark.read.text(path))


def list_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    bare = F.trim(F.regexp_replace(F.col(value), r"^\s+|\s+$", ""))
    return lines.select(bare.alias("value")).where("value <> '' and not startswith(value, '#')")


def seeds(lines: DataFrame, order: Column) -> DataFrame:
    """(site, sitemap): scheme and host of each seed line, with the owner's sitemap if it is an address. The first of equal pairs by `order` counts."""
    address, sitemap = F.get(F.split("value", "\t", 2), F.lit(0)), F.trim(F.get(F.split("value", "\t", 2), F.lit(1)))
    whole = F.when(F.trim(address).rlike("^https?://"), F.trim(address)).otherwise(F.concat(F.lit("https://"), F.trim(address)))
    kept = lines.select(F.concat(scheme(whole), F.lit("://"), host_port(whole)).alias("site"), F.when(sitemap.rlike("^https?://"), sitemap).otherwise("").alias("sitemap"), order.alias("at"))
    return kept.where("site is not null").groupBy("site", "sitemap").agg(F.min("at").alias("at"))


def last_done(log: DataFrame) -> DataFrame:
    """(site, done): the last time of each site in an append-only log of (line_no, site, ts)."""
    return log.groupBy("site").agg(F.max_by("ts", "line_no").alias("done"))


def due(sites: DataFrame, done: DataFrame, now: Column, seconds: int = WEEK) -> DataFrame:
    """Sites whose last time is more than `seconds` ago, or that were never done."""
    return sites.join(done, "site", "left").where(now - F.coalesce("done", F.lit(0)) > seconds).drop("done")


def not_in_log(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return rows.join(log.select(key).distinct(), key, "left_anti")


def first_found(candidates: DataFrame) -> DataFrame:
    """Of (site, priority, ...) the rows of each site's best priority: how a crawl chooses among ways to discover pages."""
    best = candidates.groupBy("site").agg(F.min("priority").alias("priority"))
    return candidates.join(best, ["site", "priority"], "left_semi")


def llms_links(body: Column) -> Column:
    """Links of an llms.txt; an HTML body in its place has none."""
    return F.when(F.ltrim(body).startswith("<"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(body, F.lit(LLMS_LINK), F.lit(1)))


def is_sitemap_index(body: Column) -> Column:
    return body.contains("<sitemapindex")


def sitemap_locs(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(LOC), F.lit(1))


def sitemap_report(body: Column, keep: int = 60) -> Column:
    """Struct of total, the first `keep` addresses and whether they are sitemaps themselves."""
    found = F.regexp_extract_all(body, F.lit(LOC_LENIENT), F.lit(1))
    return F.struct(F.size(found).alias("total"), unescape_each(F.slice(found, 1, keep)).alias("locs"), is_sitemap_index(body).alias("is_index"))


def robots_sitemaps(body: Column, most: int = 10) -> Column:
    """Distinct sitemap lines of a robots.txt, in order."""
    found = F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:[ \t]*(\S+)"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


def community_pages(responses: DataFrame, body: str = "body", site: str = "site") -> DataFrame:
    """(id, url, title, description, text, source) of landed community listings: no deleted, removed, nameless or empty posts."""
    post = responses.select(F.col(site).alias("site"), F.explode(F.from_json(body, COMMUNITY_POSTS)["posts"]).alias("p"))
    post = post.select("site", "p.post.*", F.col("p.community.name").alias("community"), F.coalesce("p.community.title", F.lit("")).alias("about"))
    kept = post.where("id <> 0 and not coalesce(deleted, false) and not coalesce(removed, false)")
    about = F.concat(F.lit("c/"), F.coalesce("community", F.lit("")), F.when(F.col("about") == "", "").otherwise(F.concat(F.lit(" - "), F.col("about"))))
    title, text = clip(F.coalesce("name", F.lit("")), 200), clip(collapse(F.coalesce("body", F.lit(""))), 2000)
    pages = kept.select("id", F.concat("site", F.lit("/post/"), F.col("id").cast("string")).alias("url"), title.alias("title"), about.alias("description"), text.alias("text"), F.lit("lemmy").alias("source"))
    return pages.where("title <> '' or text <> ''")


def listed_communities(responses: DataFrame, body: str = "body", host: str = "host") -> DataFrame:
    """(host, id, name, flagged) of landed community lists; entries without an id count for their name only."""
    one = responses.select(F.col(host).alias("host"), F.explode(F.from_json(body, COMMUNITIES)["communities"]).alias("c")).select("host", "c.community.*")
    return one.select("host", "id", F.lower("name").alias("name"), (F.coalesce("nsfw", F.lit(False)) & (F.coalesce("name", F.lit("")) != "")).alias("flagged"))


def wiki_chunks(titles: DataFrame, order: str, size: int = 20) -> DataFrame:
    """Titles of a site with the number of the request that asks for them, `size` in each."""
    return titles.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("site").orderBy(order)) - 1) / size).cast("int"))


def wiki_pages(responses: DataFrame, template: Column, body: str = "body") -> DataFrame:
    """(url, title, description, text, source) of landed introductions; `template` is the wiki's address with $1 for the title. Empty ones are left out."""
    page = responses.select(template.alias("template"), F.explode(F.from_json(body, WIKI_EXTRACTS)["query"]["pages"]).alias("p")).select("template", "p.*")
    text = clip(collapse(F.coalesce("extract", F.lit(""))), 2000)
    pages = page.select(wiki_address(F.col("template"), F.col("title")).alias("url"), clip(F.col("title"), 200).alias("title"), clip(F.coalesce("description", F.lit("")), 300).alias("description"), text.alias("text"), F.lit("mediawiki").alias("source"))
    return pages.where("text <> ''")


def is_site_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(SITE_NAME), F.lit(False))


def read_site_costs(spark: SparkSession, path: str) -> DataFrame:
    """One row a measured site; a missing number means 0."""
    one = spark.read.schema(SITE_COSTS).option("multiLine", True).json(path)
    rows = one.select(F.inline("sites"))
    numbers = [n for n, t in rows.dtypes if t in ("int", "bigint", "double")]
    return rows.fillna(0, numbers)


def read_sitemap_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scans of both file generations; what an old one lacks is null."""
    return spark.read.schema(SITEMAP_SCAN).option("multiLine", True).json(path)


WIKI_INFO = "query STRUCT<general:STRUCT<mainpage:STRING,articlepath:STRING>>"


def wiki_info(answers: DataFrame) -> DataFrame:
    """(site, api, article_path) of sites whose landed answers(site, nth, path, info, extract) say that they are wikis: of each site the
    first path, by nth, whose info names the articles' path and whose extract answer holds an extract."""
    told = answers.withColumn("article_path", F.from_json("info", WIKI_INFO)["query"]["general"]["articlepath"])
    kept = told.where((F.coalesce("article_path", F.lit("")) != "") & F.coalesce(F.col("extract").contains('"extract"'), F.lit(False)))
    return kept.groupBy("site").agg(F.min_by(F.struct(F.concat("site", "path").alias("api"), "article_path"), "nth").alias("best")).select("site", "best.api", "best.article_path")


#: Longest wait that an answer may ask for, in seconds.
LONGEST_WAIT = 600


def wait_seconds(asked: Column, now: Column, default: Column) -> Column:
    """How long to wait after an answer with this Retry-After: its seconds up to LONGEST_WAIT, or until its date if that is less than LONGEST_WAIT ahead; else the default."""
    seconds = F.try_to_number(F.regexp_extract(F.trim(asked), r"^\+?([0-9]{1,18})$", 1), F.lit("9" * 18)).cast("bigint")
    until = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(asked, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))) - now
    return F.when(seconds > 0, F.least(seconds, F.lit(LONGEST_WAIT))).when((until > 0) & (until < LONGEST_WAIT), until).otherwise(default)
