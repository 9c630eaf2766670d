import math

from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import frontier, hosts, index, reports, robots, search
from webloom.plans import cases
from webloom.sources import lists, responses
from webloom.streaming import ingest

PAGES = [
    (0, "https://a.org/0", "apple pie", "", "apple and cherry pie with sugar"),
    (1, "https://www.a.org/1", "cherry", "red fruit", "apple"),
    (2, "https://b.org/2", "", "", "the of and"),
    (3, "no address", "apple", "", "apple"),
    (4, "https://b.org:81/4", None, None, None),
]


def small(spark):
    return index.build_index(spark.createDataFrame(PAGES, "doc_id bigint, url string, title string, description string, text string"))


def test_index(spark):
    ix = small(spark)
    assert {(r["doc_id"], r["host"], r["dl"]) for r in ix.docs.collect()} == {(0, "a.org", 10), (1, "www.a.org", 8), (2, "b.org", 0), (4, "b.org:81", 0)}
    tf = {(r["term"], r["doc_id"]): r["tf"] for r in ix.postings.collect()}
    assert tf["apple", 0] == 4 and tf["fruit", 1] == 2 and tf["apple", 1] == 1 and ("apple", 3) not in tf
    stats = index.corpus_stats(ix).first()
    assert (stats["n_docs"], stats["total_dl"], stats["avg_dl"]) == (4, 18, 4.5)
    assert index.corpus_stats(index.build_index(spark.createDataFrame([], "doc_id bigint, url string, title string, description string, text string"))).first()["avg_dl"] == 1.0


def test_text_stops_after_forty_kept_words(spark):
    text = "the " + " ".join(f"w{i}x" for i in range(60))
    ix = index.build_index(spark.createDataFrame([(1, "http://a/", "", "", text)], "doc_id bigint, url string, title string, description string, text string"))
    assert ix.docs.first()["dl"] == 40 and ix.postings.where("term = 'w39x'").count() == 1 and ix.postings.where("term = 'w40x'").count() == 0


def test_search(spark):
    ix = small(spark)
    hits = search.search(ix, "apple").orderBy("doc_id").collect()
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert [round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 4.5)), 6) for tf, dl in ((4, 10), (1, 8))] == [r["score"] for r in hits]
    assert [r["doc_id"] for r in search.search(ix, "apple site:www.a.org").orderBy("doc_id").collect()] == [0, 1]
    assert search.search(ix, "nothingatall").count() == 0 and search.search(ix, "").count() == 0
    assert [r["doc_id"] for r in search.search(ix, "site:b.org").collect()] == [2]
    assert {r["doc_id"] for r in search.search(ix, "apple fruit").collect()} == {0, 1}  # few pages have both words
    assert search.parse_query("The of SITE:www.A.org x site:b.org") == search.Query(("x",), "b.org")
    assert search.parse_query("the The") == search.Query(("the",), "")


def test_spelling_candidates(spark):
    rows = spark.createDataFrame([("abcdef",), ("ab",)], "w string").select(search.one_edit_away(F.col("w")).alias("c")).collect()
    assert len(rows[0]["c"]) == 338 and rows[1]["c"][:3] == ["b", "ba", "ab"]


def test_spell_fix_needs_a_much_commoner_word(spark):
    terms = spark.createDataFrame([("banana", 10), ("cherry", 11), ("chery", 2), ("grape", 20), ("grapf", 2)], "term string, df bigint")
    ix = index.Index(None, None, terms)
    fixed = {r["word"]: r["fix"] for r in search.spell_fix(ix, spark.createDataFrame([("bananx",), ("cherrx",), ("grapf",), ("cat",), ("grape",)], "word string")).collect()}
    assert fixed == {"bananx": None, "cherrx": "cherry", "grapf": None, "cat": None, "grape": None}


def test_hosts(spark):
    ix = small(spark)
    assert [tuple(r) for r in hosts.top_hosts(ix, 2).collect()] == [("a.org", 1), ("b.org", 1)]
    assert hosts.pages_of(ix, "a.org", any_www=True).first()["pages"] == 2 and tuple(hosts.hosts_with_suffix(ix, "a.org").first()) == (2, 2)


def test_robots(spark):
    """What a reading of three small files by hand gives."""
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /p\nAllow: /p/open\nDisallow:\nSitemap: https://a/m.xml"), ("b", "user-agent: otherbot\nuser-agent: webloombot\ndisallow: /ours\n\nuser-agent: *\ndisallow: /"), ("c", "User-agent: *\nContent-Signal: search=no")], "site string, body string")
    rules, signals = robots.robots_rules(files, cases.AGENT)
    assert sorted(tuple(r) for r in rules.collect()) == [("a", False, ""), ("a", False, "/p"), ("a", True, "/p/open"), ("b", False, "/ours")]
    paths = spark.createDataFrame([(s, p) for s in "abcd" for p in ("/", "/p", "/p/open/x", "/ours")], "site string, path string")
    found = {(r["site"], r["path"]) for r in robots.robots_allowed(paths, rules, signals).collect() if not r["allowed"]}
    assert found == {("a", "/p"), ("b", "/ours"), ("c", "/"), ("c", "/p"), ("c", "/p/open/x"), ("c", "/ours")}
    assert [r["sitemap"] for r in robots.sitemaps(files).collect()] == ["https://a/m.xml"]


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\n a \nb\n")
    assert sorted(r[0] for r in lists.read_lines(spark, f"file://{tmp_path}/l.txt").collect()) == ["a", "b"]
    assert lists.read_lines(spark, f"file://{tmp_path}/none.txt").count() == 0
    body = spark.createDataFrame([("- [x](https://a.org/x) [y](mailto:z)", "<loc> a </loc><LOC>b</LOC>")], "l string, s string")
    row = body.select(lists.llms_links(F.col("l")).alias("l"), lists.sitemap_locs(F.col("s")).alias("s"), lists.sitemap_report(F.col("s"), 1).alias("r")).first()
    assert row["l"] == ["https://a.org/x"] and row["s"] == ["a"] and row["r"]["total"] == 2 and row["r"]["locs"] == ["a"]
    posts = '{"posts":[{"post":{"id":1,"name":"n","body":"b","url":null},"community":{"name":"c","title":"T"}},{"post":{"id":2,"name":"n","deleted":true},"community":{"name":"c"}}]}'
    assert [(r["id"], r["description"]) for r in lists.community_pages(spark.createDataFrame([("https://c.org", posts)], "site string, body string")).collect()] == [(1, "c/c - T")]
    done = spark.createDataFrame([(1, "a", 5), (2, "a", 3)], "line_no int, site string, ts bigint")
    assert tuple(lists.last_done(done).first()) == ("a", 3)
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    assert [r["site"] for r in lists.due(sites, lists.last_done(done), F.lit(lists.WEEK + 3)).collect()] == ["b"]
    assert sorted(r["site"] for r in lists.due(sites, lists.last_done(done), F.lit(lists.WEEK + 4)).collect()) == ["a", "b"]


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    found = frontier.reachable(spark.createDataFrame([("a",)], "url string"), edges, 2)
    assert {tuple(r) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_costs(spark):
    weights = spark.createDataFrame([("x", 39184251, "static", 3, 0, 0)], "host string, bytes_per_visit bigint, basis string, assets int, js_bytes bigint, requests int")
    cost = reports.site_cost(weights, 0.085, 1000)
    assert cost.first()["usd_per_1000_visits"] == 3.3307
    assert reports.cost_report_lines(cost).first()["line"] == "| x | 38265 KB | n/a | 4 | 3.3307 | 3.3307 | 33.3066 |"
    items = spark.createDataFrame([("h", f"i{i}", i < 4) for i in range(5)] + [("k", "x", True)], "h string, i string, f boolean")
    flagged = {r["host"]: r["is_flagged"] for r in reports.flagged_hosts(items, "h", "i", F.col("f")).collect()}
    assert flagged == {"h": True, "k": False}


def test_dense_ids(spark):
    rows = index.dense_ids(spark.createDataFrame([(x,) for x in "dbacb"], "u string"), ["u"], 10).orderBy("doc_id").collect()
    assert [(r["u"], r["doc_id"]) for r in rows] == [("a", 10), ("b", 11), ("b", 12), ("c", 13), ("d", 14)]


def test_content_pages(spark):
    rows = [
        ("u1", None, "<title>T &amp; U</title><body><p>one<p>two <!-- x -->"), ("u2", "TEXT/HTML", "<body> <script>x</script>"), ("u3", "text/plain", "\n# Head\nbody"),
        ("u4", "image/png", "x"), ("u5", "application/json", "{}"), ("u6", "text/plain", None), ("u7", "text/markdown", "\u00a0\n "),
    ]
    pages = responses.content_pages(spark.createDataFrame(rows, "url string, ctype string, body string"))
    assert sorted(tuple(r) for r in pages.collect()) == [("u1", "T & U", "", "one two", "html"), ("u3", "Head", "", "# Head body", "html")]
    assert responses.content_pages(spark.createDataFrame([], "url string, ctype string, body string")).count() == 0


def test_stored_pages(spark):
    lines = ['{"u":"a","t":"","x":"plain","z":"!bad!"}', '{"u":"b","x":" "}', '{"u":"c","t":"only title"}', '{"t":"no address"}', "{", "", None]
    pages = responses.stored_pages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(tuple(r) for r in pages.collect()) == [("a", "", "", "plain"), ("c", "only title", "", "")]


def test_german_frontier(spark):
    links = [("https://a.de", "https://a.de/x"), ("https://b.com", "https://b.com/en"), ("https://b.com", "https://b.com/de/y"), ("https://c.com", "https://c.com/en")]
    found = frontier.german_frontier(spark.createDataFrame(links, "site string, url string"))
    assert {tuple(r) for r in found.collect()} == {("https://a.de", "https://a.de/x"), ("https://b.com", "https://b.com/de/y"), ("https://c.com", "https://c.com/de/")}


def test_measured_pages(spark):
    html = '<img src="/1.png"><img src="/0.png"><link href="b.css"><img src="/1.png">'
    pages = spark.createDataFrame([("h", "https://h.org/d/", html), ("k", "https://k.org/", None)], "host string, url string, html string")
    sizes = spark.createDataFrame([("https://h.org/1.png", 7), ("https://h.org/0.png", 0), ("https://h.org/d/b.css", 5)], "url string, bytes bigint")
    found = {r["host"]: (r["assets"], r["bytes_per_visit"]) for r in reports.measure_pages(pages, sizes, 0.085, 1000).collect()}
    assert found["h"] == (2, len(html) + 12) and found["k"][0] == 0


def test_dense_ids_over_many_ranges(spark):
    pages = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("u"), F.repeat(F.lit("text "), 200).alias("text"))
    found = index.dense_ids(pages.dropDuplicates(["u"]), ["u"], 5)
    row = found.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    assert tuple(row) == (20_000, 20_000, 5, 20_004)


def test_addresses_that_cannot_be_parsed(spark):
    fine = {"http://h/?q=a|b": "h", "http://h/a b": "h", "http://h/a^b": "h", "http://h/?q={x}": "h", "//u@h:8/x": "h:8", "http://h/?%zz": "h", "HTTP://H": "H"}
    bad = ["http://h/%zz", "http://h h/", "http://h/\n", "no address", "", None]
    rows = spark.createDataFrame([(u,) for u in [*fine, *bad]], "u string").select("u", urls.host_port(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in rows} == fine | dict.fromkeys(bad)


def test_merges_and_versions(spark, tmp_path):
    path = f"file://{tmp_path}"
    for n in range(9):
        pages = spark.createDataFrame([(f"https://a.org/{i}", f"title{n}", "", "x") for i in range(n, n + 2)], "url string, title string, description string, text string")
        ingest.commit_batch(pages, n, path, ["url"], replace=True)
    while ingest.merge_once(spark, path):
        pass
    live = ingest.segments(spark, path)
    assert [(s.first, s.last, s.merged) for s in live] == [(0, 6, True), (7, 7, False), (8, 8, False)] and sum(s.n_docs for s in live) == 18
    ix = ingest.read_index(spark, path)
    assert sorted((r["url"][-1], r["title"]) for r in ix.docs.collect()) == [(str(i), f"title{min(i, 8)}") for i in range(10)]
    assert {r["term"]: r["df"] for r in ix.terms.collect() if r["term"].startswith("title")} == {f"title{i}": 2 if i == 8 else 1 for i in range(9)}


def test_line_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"u":"https://a.org/1","t":"one","x":"words"}\n{"u":\n')
    running = ingest.start_ingest(ingest.line_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/ix", f"file://{tmp_path}/cp", ["url"], once=True)
    running.awaitTermination()
    assert [r["url"] for r in ingest.read_index(spark, f"file://{tmp_path}/ix").docs.collect()] == ["https://a.org/1"]
