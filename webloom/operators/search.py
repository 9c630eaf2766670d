"""Ranked search, suggestions and spelling over an index."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.text import STOP_WORDS, is_junk, is_stop
from webloom.functions.urls import count_label, in_site, normal_form
from webloom.operators.index import Index, corpus_stats

#: Saturation and length weight of BM25; rare words and their expansion; coordination; result sizes.
K1, B = 1.2, 0.75
RARE, LEAST_PREFIX, PREFIX_TERMS, VARIANTS = 20, 3, 100, 8
FEW, LONG_LIST = 10, 2_000_000
HITS, SITE_HITS, HOST_HITS = 300, 2000, 100
SUGGEST_TERMS, SUGGEST_DF, SPELL_DF = 60, 3, 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS_KEPT = 6


@dataclass(frozen=True)
class Query:
    words: tuple[str, ...]
    site: str


def parse_query(text: str) -> Query:
    """Words of a query, without stop words unless there are no others, and its last site: filter."""
    site, rest = "", []
    for part in text.split():
        if part.lower().startswith("site:"):
            site = part.lower()[5:].removeprefix("www.")
        else:
            rest.append(part)
    found = [t for t in re.findall(r"[^\W_]+", " ".join(rest).replace("İ", "i").replace("Σ", "σ").lower()) if len(t.encode()) <= 80]
    words = [t for t in found if t not in STOP_WORDS] or found
    return Query(tuple(dict.fromkeys(words)), site)


def _matching(terms: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Terms that begin with a query word; the literals reach the sorted term table's scan."""
    wanted = F.lit(False)
    for word in words:
        wanted = wanted | F.col("term").startswith(word)
    return terms.where(wanted)


def word_groups(index: Index, words: tuple[str, ...]) -> DataFrame:
    """(word, term, df): for each word the terms that stand for it - itself, or the commonest that begin with it if it is rare."""
    spark = index.terms.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    near = F.broadcast(asked).join(_matching(index.terms, words), F.col("term").startswith(F.col("word")))  # one row for each query word
    exact = near.where("term = word")
    rare = asked.join(exact.select("word", "df"), "word", "left").where(f"coalesce(df, 0) < {RARE} and octet_length(word) >= {LEAST_PREFIX}").select("word")
    first = W.partitionBy("word").orderBy("term")
    common = W.partitionBy("word").orderBy(F.desc("df"), "term")
    grown = near.join(F.broadcast(rare), "word").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PREFIX_TERMS)
    grown = grown.withColumn("nth", F.row_number().over(common)).where(F.col("nth") <= VARIANTS).select("word", "term", "df")
    return grown.unionByName(exact.join(grown.select("word").distinct(), "word", "left_anti").select("word", "term", "df"))


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avg_dl: Column) -> Column:
    idf = F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avg_dl))


def _group_scores(index: Index, words: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(word, doc_id, score) and the number of words that any page has. The chosen terms are VARIANTS a word at most."""
    chosen = word_groups(index, words).collect()
    spark = index.terms.sparkSession
    if not chosen:
        return spark.createDataFrame([], "word string, doc_id bigint, score double"), 0
    picked = spark.createDataFrame([tuple(r) for r in chosen], "word string, term string, df bigint")
    stats = corpus_stats(index).select("n_docs", "avg_dl").first()
    hits = index.postings.where(F.col("term").isin([r["term"] for r in chosen])).join(F.broadcast(picked), "term")
    score = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(float(stats["n_docs"])), F.lit(float(stats["avg_dl"])))
    return hits.groupBy("word", "doc_id").agg(F.sum(score).alias("score")), len({r["word"] for r in chosen})


def search(index: Index, query: str) -> DataFrame:
    """(doc_id, score, host): the best hits. All words first; if few pages have them all, most of them.

    Scores are rounded before ranking, so their order does not depend on that of the sums; ties go to the smaller id.
    """
    asked = parse_query(query)
    docs = index.docs.select("doc_id", "host")
    if not asked.words:
        return scan_host(index, asked.site) if asked.site else docs.withColumn("score", F.lit(0.0)).limit(0).select("doc_id", "score", "host")
    scores, groups = _group_scores(index, asked.words)
    by_doc = scores.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
    every = by_doc.where(F.col("matched") == groups)
    if groups > 1 and every.limit(FEW).count() < FEW:
        sizes = scores.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= LONG_LIST)
        some = scores.join(F.broadcast(sizes.select("word")), "word", "left_semi")  # one row for each query word
        by_doc = some.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
        every = by_doc.withColumn("score", F.col("score") * F.pow(F.col("matched") / groups, F.lit(2)))
    ranked = every.select("doc_id", F.round("score", DIGITS_KEPT).alias("score"))
    best = ranked.orderBy(F.desc("score"), "doc_id").limit(SITE_HITS if asked.site else HITS)
    hits = docs.join(F.broadcast(best), "doc_id")  # SITE_HITS rows at most
    if asked.site:
        hits = hits.where(in_site(F.col("host"), asked.site)).orderBy(F.desc("score"), "doc_id").limit(HITS)
    return hits.select("doc_id", "score", "host")


def search_results(index: Index, query: str, first: int = 0, many: int = 10) -> DataFrame:
    """(rank, url, title, host, score, total): one page of a result as a client shows it; total counts all hits. HITS rows at most are ranked."""
    hits = search(index, query)
    ranked = hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))).withColumn("total", F.count("*").over(W.partitionBy(F.lit(0))))
    shown = ranked.where((F.col("rank") > first) & (F.col("rank") <= first + many)).drop("host")
    return index.docs.join(F.broadcast(shown), "doc_id").select("rank", "url", "title", "host", "score", "total")


def site_info(index: Index, site: str) -> DataFrame:
    """(site, total) and whether a site is indexed at all: its first HOST_HITS pages counted, with the count's label."""
    found = scan_host(index, site).agg(F.count("*").alias("total"))
    return found.select(F.lit(site).alias("site"), "total", count_label(F.col("total")).alias("label"), (F.col("total") > 0).alias("indexed"))


def scan_host(index: Index, site: str, most: int = HOST_HITS) -> DataFrame:
    """A site's first pages, for a query without words."""
    return index.docs.where(in_site(F.col("host"), site)).orderBy("doc_id").limit(most).select("doc_id", F.lit(1.0).alias("score"), "host")


def page_indexed(index: Index, url: str, title: str, host: str, most: int = 20) -> DataFrame:
    """(doc_id, url) of the page among the first hits for its title in its site, if it is there."""
    hits = search(index, f"site:{host} {title}").orderBy(F.desc("score"), "doc_id").limit(most)
    wanted = normal_form(F.lit(url))
    return index.docs.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi").where(normal_form(F.col("url")) == wanted).select("doc_id", "url")


def suggest(index: Index, prefix: str, most: int = 10) -> DataFrame:
    """(term, df): common words that begin with `prefix`, as typed. Shorter prefixes than two bytes give none."""
    if len(prefix.encode()) < 2:
        return index.terms.limit(0)
    near = index.terms.where(F.col("term").startswith(prefix)).orderBy("term").limit(SUGGEST_TERMS)
    kept = near.where((F.col("df") >= SUGGEST_DF) & ~is_stop(F.col("term")) & ~is_junk(F.col("term")))
    return kept.orderBy(F.desc("df"), "term").limit(most)


def one_edit_away(word: Column) -> Column:
    """Spellings in the order in which they are tried: at each place a letter missing, two swapped, one wrong; one extra."""
    n = F.length(word)
    letters = F.array(*map(F.lit, LETTERS))

    def place(i: Column) -> Column:
        head, here, tail = F.substring(word, F.lit(1), i), F.substring(word, i + 1, F.lit(1)), F.substring(word, i + 2, n)
        missing = F.array(F.concat(head, tail))
        swapped = F.when(i + 1 < n, F.array(F.concat(head, F.substring(tail, F.lit(1), F.lit(1)), here, F.substring(tail, F.lit(2), n)))).otherwise(F.array().cast("array<string>"))
        wrong = F.transform(letters, lambda c: F.concat(head, c, tail))
        extra = F.transform(letters, lambda c: F.concat(head, c, here, tail))
        return F.when(i < n, F.concat(missing, swapped, wrong, extra)).otherwise(extra)

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n), place)))


def spell_fix(index: Index, words: DataFrame, word: str = "word") -> DataFrame:
    """(word, fix): for each word that almost no page has the commonest word one edit away, if it is much commoner; else null."""
    asked = words.select(F.col(word).alias("word")).distinct()
    known = asked.join(index.terms.withColumnRenamed("term", "word"), "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("base"))
    rare = known.where(f"base < {SPELL_DF} and octet_length(word) between 4 and 20")
    tried = rare.select("word", "base", F.posexplode(one_edit_away(F.col("word"))).alias("at", "term")).where("term <> word")
    found = tried.join(index.terms, "term").where("df > base * 5 + 10")
    best = found.groupBy("word").agg(F.max_by("term", F.struct("df", -F.col("at"))).alias("fix"))
    return asked.join(best, "word", "left")
