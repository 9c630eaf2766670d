import duckdb
import pytest

import __spark_entry__
from webloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    columns = sorted(df.columns)
    tidy = df[columns].astype(object).where(df[columns].notna(), "null")
    return columns, sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in tidy.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from webloom.streaming import ingest

    pages = spark.createDataFrame([(f"https://a.org/{i}", "t", "", "x") for i in range(5)] * 2, "url string, title string, description string, text string")
    path = f"file://{tmp_path}"
    ingest.commit_batch(pages.where("url < 'https://a.org/3'"), 0, path, ["url"])
    for _ in range(2):
        ingest.commit_batch(pages, 1, path, ["url"])
    docs = sorted(tuple(r) for r in ingest.read_index(spark, path).docs.select("doc_id", "url").collect())
    assert docs == [(i, f"https://a.org/{i}") for i in range(5)]


BLANK_DOCUMENTS = """SELECT i AS doc_id, CASE i % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN chr(10) || chr(9) ELSE 'some words ' || i END AS text,
  'en' AS lang, 'src' || i % 2 AS source, 0::BIGINT AS n_chars FROM range(24) t(i)"""


def same_on(spark, folder, name, table, made):
    """The query and its SQL on a table made here."""
    with duckdb.connect() as db:
        db.sql(f"copy ({made}) to '{folder}/{table}.parquet'")
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
        assert rows(catalog.queries()[name](spark, str(folder)).toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())


def test_ingested_pages_without_words_count(spark, tmp_path):
    same_on(spark, tmp_path, "ingest_stream", "documents", BLANK_DOCUMENTS)


def test_versions_of_pages_without_words(spark, tmp_path):
    same_on(spark, tmp_path, "latest_versions", "documents", BLANK_DOCUMENTS)


def test_clock_ticks_in_pauses_only(spark, tmp_path):
    same_on(spark, tmp_path, "send_batches", "pages", "SELECT i AS page_id, 'https://a.example.com/' || i AS url, '' AS html FROM range(2600) t(i)")


def test_clock_ticks_among_pages(spark):
    """A sender's ticker, step by step, where ticks fall between any two pages."""
    from pyspark.sql import functions as F

    from webloom.streaming import ingest

    at = [n * 0.01 + n // 30 * 4 for n in range(600)]
    expected, ticks, held, batch_no = [], 0, 0, 0
    for seconds in at:
        while (ticks + 1) * 3 <= seconds:
            ticks, held, batch_no = ticks + 1, 0, batch_no + (held > 0)
        expected.append(batch_no)
        held += 1
        if held == 24:  # of 90,000 bytes each: more than two MiB
            held, batch_no = 0, batch_no + 1
    pages = spark.createDataFrame(list(enumerate(at)), "nth bigint, at double").select("nth", "at", F.lit("s").alias("sender"), *(F.lit("").alias(c) for c in ("url", "title", "description")), F.repeat(F.lit("x"), F.lit(90_000)).alias("text"))
    found = ingest.send_batches(pages, "sender", "nth", "at").select("nth", "batch_no").orderBy("nth").collect()
    assert [r["batch_no"] for r in found] == expected


def test_cut_references(spark, tmp_path):
    made = """SELECT i AS page_id, 'https://a.example.com/' || i AS url, '<html><head><title>' || t || '</title></head><body><p>' || t || '</p><p>b &amp;amp; &quot;c&quot;' || t || '</p></body></html>' AS html
      FROM (SELECT unnest(range(9)) AS i, unnest(['a &amp;', 'a &amp;&amp', 'a &am', 'a &a', 'a &quot', 'a &quo', 'a &amp b', 'a &copy', 'a &ampx; &quotx &lt; &#39;']) AS t)"""
    same_on(spark, tmp_path, "html_fields", "pages", made)


SPACED_DOCUMENTS = r"""SELECT i AS doc_id, t AS text, 'en' AS lang, 'src' || i % 2 AS source, 0::BIGINT AS n_chars FROM (SELECT unnest(range(12)) AS i, unnest([
  chr(160) || 'Some title' || chr(160), chr(12288) || chr(10) || 'Some title' || chr(8195) || chr(10), '# ' || chr(160) || '# x' || chr(9), chr(160), chr(9) || chr(160) || chr(13) || chr(10) || 'Line', 'title ' || chr(13),
  repeat(' ' || chr(10), 1990) || repeat('ééé ', 50), repeat(chr(12288) || chr(10), 1500) || 'After 6000 bytes', repeat(chr(160), 7000) || repeat('wort ', 60), repeat('wort' || repeat(chr(160), 250), 40), repeat('é', 4000) || chr(10) || 'x', repeat('東' || repeat(chr(12288), 200), 59)]) AS t)"""


@pytest.mark.parametrize("name", ["text_page_fields", "doc_lengths", "latest_versions"])
def test_pages_with_spaces_of_any_kind(spark, tmp_path, name):
    same_on(spark, tmp_path, name, "documents", SPACED_DOCUMENTS)
