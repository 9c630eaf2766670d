"""robots.txt as tables: groups of agents, their rules and signals, and decisions for paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_STARS = 5


def robots_lines(files: DataFrame, site: str = "site", body: str = "body") -> DataFrame:
    """(site, pos, key, value, grp): meaningful lines; an agent line after a rule opens the next group."""
    line = files.select(F.col(site).alias("site"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    bare = line.withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"^\s+|\s+$", ""))).where(F.col("line").contains(":"))
    split = bare.select("site", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.regexp_replace(F.expr("substring(line, instr(line, ':') + 1)"), r"^\s+|\s+$", "").alias("value"))
    grouped = split.where(F.col("key").isin("user-agent", "allow", "disallow"))
    at = W.partitionBy("site").orderBy("pos")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(at), F.lit("allow")) != "user-agent")
    starts = grouped.withColumn("opens", opens.cast("int")).select("site", "pos", "opens")
    return split.join(starts, ["site", "pos"], "left").withColumn("grp", F.sum(F.coalesce("opens", F.lit(0))).over(at)).drop("opens")


def robots_rules(files: DataFrame, agent: str, site: str = "site", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """((site, allow, pat), (site, no_search)) for a crawler whose full name is `agent`: the groups that name it, else those for all.

    A group names it if one of its agents is part of the full name. A rule counts once for each agent line before it.
    """
    lines = robots_lines(files, site, body)
    agents = lines.where("key = 'user-agent' and value <> ''").select("site", "grp", F.col("pos").alias("agent_pos"), F.lower("value").alias("agent"))
    mine = F.instr(F.lit(agent.lower()), F.col("agent")) > 0
    applies = agents.select("site", "grp", "agent_pos", F.when(F.col("agent") == "*", "all").when(mine, "ours").alias("whose")).where("whose is not null")
    told = lines.where(F.col("key").isin("allow", "disallow", "content-signal")).join(applies, ["site", "grp"]).where("agent_pos < pos")
    signals = told.where("key = 'content-signal'").select("site", "whose", "pos", F.posexplode(F.split("value", ",")).alias("nth", "pair")).where(F.col("pair").contains("="))
    signals = signals.select("site", "whose", "pos", "nth", F.lower(F.trim(F.substring_index("pair", "=", 1))).alias("name"), F.lower(F.trim(F.expr("substring(pair, instr(pair, '=') + 1)"))).alias("said"))
    rules = told.where("key <> 'content-signal'").select("site", "whose", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pat"))
    named = rules.where("whose = 'ours'").select("site").union(signals.where("whose = 'ours'").select("site")).distinct().withColumn("named", F.lit(True))

    def chosen(df: DataFrame) -> DataFrame:
        return df.join(named, "site", "left").where((F.col("whose") == "ours") == F.coalesce("named", F.lit(False))).drop("named", "whose")

    searching = chosen(signals).where("name = 'search'").groupBy("site").agg(F.max_by("said", F.struct("pos", "nth")).alias("said"))
    return chosen(rules), searching.select("site", (F.col("said") == "no").alias("no_search"))


def pattern_regex(pat: Column) -> Column:
    """A rule's pattern as a regular expression: stars are any run, a closing dollar ends the path, all else is itself."""
    anchored = pat.endswith("$")
    body = F.when(anchored, F.substring(pat, F.lit(1), F.length(pat) - 1)).otherwise(pat)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(anchored, r"\z").otherwise(""))


def robots_allowed(paths: DataFrame, rules: DataFrame, signals: DataFrame) -> DataFrame:
    """(site, path, allowed): the longest matching rule decides, allowing on a tie; without one the path is allowed."""
    usable = rules.where((F.col("pat") != "") & (F.length(F.regexp_replace("pat", r"[^*]", "")) <= MOST_STARS)).distinct()
    tested = paths.join(usable.withColumn("__re", pattern_regex(F.col("pat"))), "site", "left")
    hit = F.col("pat").isNotNull() & F.expr("path rlike coalesce(__re, '')")
    best = tested.groupBy("site", "path").agg(F.max_by(F.when(hit, F.col("allow")), F.when(hit, F.struct(F.octet_length("pat"), F.col("allow")))).alias("verdict"))
    return best.join(signals, "site", "left").select("site", "path", (F.coalesce("verdict", F.lit(True)) & ~F.coalesce("no_search", F.lit(False))).alias("allowed"))


def sitemaps(files: DataFrame, site: str = "site", body: str = "body") -> DataFrame:
    return robots_lines(files, site, body).where("key = 'sitemap' and value <> ''").select("site", "pos", F.col("value").alias("sitemap"))
