from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import codec, html, lang, text, urls


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_tokens(spark):
    given_ = ["x_y İΣ", "áb", "½ ② 東京", "a" * 81 + " b", "", None]
    assert column(spark, given_, text.tokens) == [["x", "y", "iσ"], ["a", "b"], ["½", "②", "東京"], ["b"], [], None]


def test_kept_tokens_and_page_fields(spark):
    assert column(spark, ["the 1234567 123456 cat " + "x" * 31], text.kept_tokens) == [["123456", "cat"]]
    assert column(spark, ["\n  \n## Title here \nrest", "", " \n"], text.page_title) == ["Title here", "", ""]
    assert column(spark, ["a   b\n c "], text.collapse) == ["a b c"]
    assert column(spark, ["abcdef", "ab"], lambda c: text.short(c, 3)) == ["abc…", "ab"]
    assert column(spark, ["éé"], lambda c: text.letter_runs(text.first_bytes(c, 3))) == [["é"]]


def test_urls(spark):
    given_ = ["https://u:p@WWW.Ex_a.org:8080/p?q=1#f", "http://h", "no address", "http://h/%zz q"]
    assert column(spark, given_, urls.host_port)[:3] == ["WWW.Ex_a.org:8080", "h", None]
    assert column(spark, given_[:2], urls.request_uri) == ["/p?q=1", "/"]
    assert column(spark, given_[:2], urls.site_of) == ["ex_a.org", "h"]
    assert column(spark, ["https://www.a.org/x/#y", "http://a.org/x"], urls.normal_form) == ["a.org/x", "a.org/x"]
    assert column(spark, ["a b/c(d)"], lambda t: urls.wiki_address(F.lit("https://w.org/wiki/$1"), t)) == ["https://w.org/wiki/a_b/c(d)"]
    assert column(spark, ["<a href=\"x\">&"], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]


def test_language(spark):
    english, german = "the cat and the dog are in the house with all of the toys " * 3, "der Hund und die Katze sind nicht auf dem Haus mit der Maus " * 3
    cases = [("https://a.com/", english, True), ("https://a.com/", german, False), ("https://a.com/", "kurz", True), ("https://a.de/", "日本語" * 9, False), ("https://a.com/", "123", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, u string, x string, want boolean")
    empty = F.lit("")
    assert all(r[0] == r[1] for r in rows.select("want", lang.is_english(F.col("u"), empty, empty, F.col("x"))).collect())
    assert column(spark, ["https://a.de/", "https://de.a.com/", "https://a.com/de-AT/x", "https://a.com/den/", None], lang.german_url) == [True, True, True, False, False]
    assert column(spark, [german, english, "kurz"], lambda c: lang.is_german_text(empty, empty, c)) == [True, False, False]
    assert column(spark, [german], lambda c: lang.language_ok("de", F.lit("https://a.de/"), empty, empty, c)) == [True]


def test_fnv(spark):
    assert column(spark, ["", "a", "foobar"], codec.fnv1a) == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.text(max_size=60), st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 65535)), max_size=20))
def test_codec_round_trips(raw, words, pairs):
    assert codec.base85_decode(codec.base85_encode(raw)) == raw
    assert codec.unpack_text(codec.pack_text(words, b"the and"), b"the and") == words
    ordered = sorted(pairs)
    assert codec.unpack_postings(codec.pack_postings(ordered)) == ordered


def test_codec_rejects():
    assert codec.base85_decode("0") is None and codec.base85_decode("<<") is None and codec.base85_decode("|||||") is None
    assert codec.unpack_text("~~~~~") is None and codec.unpack_postings(codec.base85_encode(b"\x80")) is None


def test_html_fields():
    page = (
        '<html><head><title>A &amp; B</title><meta property="og:description" content="d > e"><style>p{}</style></head><body>'
        '<nav><a href="/m?a=1&amp;b=2">menu</a><nav></nav>x</nav><p>Hi<br>there 1 < 2<script>var t="</p>";</script> end<!-- x --> more'
        "<footer>no <A HREF='y'>k</a></footer>tail <b title=\">\">bold"
    )
    found = html.page_fields(page)
    assert found == {"title": "A & B", "description": "d > e", "text": "Hi there 1 < 2 end moretail bold", "links": ["/m?a=1&b=2", "y"]}
    assert html.page_fields("a<!-- never ends <b>")["text"] == "a" and html.page_fields(None)["text"] == "" and html.page_fields("<p")["text"] == ""
    assert html.page_fields("x <script>never")["text"] == "x"
    assert html.resolve_links("https://a.org/d/p", ["q#f", "/r", "mailto:x", "//b.org/", "http://[bad"]) == ["https://a.org/d/q", "https://a.org/r", "https://b.org/"]


def test_package_zip(tmp_path):
    import zipfile

    from webloom.session import package_zip

    names = zipfile.ZipFile(package_zip(str(tmp_path))).namelist()
    assert {"webloom/__init__.py", "webloom/session.py", "webloom/functions/text.py"} <= set(names) and all(n.endswith(".py") for n in names)


def test_references_without_semicolon():
    written = "&amp; &amp &am &copy;&copy &ampx; &#39; &#39 &#x41; &notit; &no"
    assert html.page_fields(written)["text"] == "& & &am ©© &x; ' ' A ¬it; &no"
    assert html.page_fields(written, decode=html.unescape_terminated)["text"] == "& &amp &am ©&copy &ampx; ' &#39 A &notit; &no"
