"""SQL for DuckDB that states each named query a second time, for comparison."""

from __future__ import annotations

from webloom.functions.lang import ENGLISH_WORDS, FOREIGN_DOMAINS, GERMAN_DOMAINS, GERMAN_SEGMENTS, GERMAN_WORDS
from webloom.functions.text import STOP_WORDS
from webloom.plans import cases


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _values(rows) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
JUNK = "(strlen(t) > 30 OR (strlen(t) > 6 AND regexp_full_match(t, '[0-9]+')))"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 80)"


def _kept(x: str) -> str:
    return f"list_filter({_tokens(x)}, lambda t: t NOT IN {_list(STOP_WORDS)} AND NOT {JUNK})"


PAGES = rf"""pages_ AS (
  SELECT doc_id, lang, 'https://' || source || '.example.org/' || doc_id AS url, source || '.example.org' AS host,
    left(coalesce(list_filter(list_transform(string_split(left(text, 4000), chr(10)), lambda l: trim(ltrim(l, '# '))), lambda l: l <> '')[1], ''), 200) AS title,
    '' AS description, left(trim(regexp_replace(left(text, 12000), '{SPACE}', ' ', 'g')), 2000) AS text
  FROM documents)"""

INDEX = f"""{PAGES},
words_ AS (
  SELECT doc_id, unnest({_kept('title')}) AS term, 3 AS w FROM pages_
  UNION ALL SELECT doc_id, unnest({_kept('text')}[1:40]), 1 FROM pages_),
postings_ AS (SELECT term, doc_id, least(sum(w), 65535)::INT AS tf FROM words_ GROUP BY ALL),
docs_ AS (SELECT p.doc_id, p.url, p.host, p.title, least(coalesce(sum(w), 0), 65535)::INT AS dl FROM pages_ p LEFT JOIN words_ USING (doc_id) GROUP BY ALL),
terms_ AS (SELECT term, count(*) AS df FROM postings_ GROUP BY term),
stats_ AS (SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_dl, greatest(1.0, sum(dl) / count(*)) AS avg_dl, count(DISTINCT host) AS n_hosts FROM docs_)"""


def _on_index(select: str, more: str = "") -> str:
    return f"WITH {INDEX}{more} {select}"


def text_page_fields() -> str:
    return f"WITH {PAGES} SELECT doc_id, url, title, text FROM pages_"


def tokens() -> str:
    return f"SELECT doc_id, len({_tokens('text')})::INT AS n_tokens, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents"


def kept_terms() -> str:
    return f"SELECT doc_id, len({_kept('text')})::INT AS n_kept, len(list_distinct({_kept('text')}))::INT AS n_distinct FROM documents"


def postings() -> str:
    return _on_index("SELECT * FROM postings_")


def doc_lengths() -> str:
    return _on_index("SELECT doc_id, host, dl FROM docs_")


def term_df() -> str:
    return _on_index("SELECT * FROM terms_")


def corpus_stats() -> str:
    return _on_index("SELECT n_docs, total_dl, n_hosts, (SELECT count(*) FROM terms_) AS n_terms, round(avg_dl, 6) AS avg_dl FROM stats_")


def segment_levels() -> str:
    level = "CASE WHEN n < 1000 THEN 0 WHEN n < 8000 THEN 1 WHEN n < 64000 THEN 2 WHEN n < 512000 THEN 3 WHEN n < 4096000 THEN 4 ELSE 5 END"
    return f"SELECT l_suppkey, n, {level} AS level FROM (SELECT l_suppkey, count(*) * 1000 AS n FROM lineitem GROUP BY ALL)"


def search(text: str) -> str:
    site_ = next((w[5:].removeprefix("www.") for w in reversed(text.split()) if w.startswith("site:")), "")
    said = " ".join(w for w in text.split() if not w.startswith("site:"))
    more = f""",
said_ AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{said}'), '[\\p{{L}}\\p{{N}}]+')) AS word),
asked_ AS (SELECT word FROM said_ WHERE word NOT IN {_list(STOP_WORDS)} OR NOT EXISTS (SELECT 1 FROM said_ WHERE word NOT IN {_list(STOP_WORDS)})),
exact_ AS (SELECT word, coalesce(df, 0) AS df FROM asked_ LEFT JOIN terms_ ON term = word),
near_ AS (SELECT word, term, t.df, row_number() OVER (PARTITION BY word ORDER BY term) AS nth FROM exact_ e JOIN terms_ t ON starts_with(term, word) WHERE e.df < 20 AND strlen(word) >= 3),
grown_ AS (SELECT word, term, df FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY df DESC, term) AS k FROM near_ WHERE nth <= 100) WHERE k <= 8),
groups_ AS (SELECT * FROM grown_ UNION ALL SELECT word, word, df FROM exact_ WHERE df > 0 AND word NOT IN (SELECT word FROM grown_)),
scores_ AS (SELECT word, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
  FROM groups_ JOIN postings_ USING (term) JOIN docs_ USING (doc_id) CROSS JOIN stats_ GROUP BY ALL),
n_ AS (SELECT count(DISTINCT word) AS n FROM groups_),
sums_ AS (SELECT doc_id, sum(score) AS score, count(*) AS m FROM scores_ GROUP BY ALL),
few_ AS (SELECT count(*) < 10 AND (SELECT n FROM n_) > 1 AS few FROM sums_ WHERE m = (SELECT n FROM n_)),
ranked_ AS (SELECT doc_id, round(CASE WHEN few THEN score * (m / n) * (m / n) ELSE score END, 6) AS score FROM sums_ CROSS JOIN n_ CROSS JOIN few_ WHERE few OR m = n),
best_ AS (SELECT * FROM ranked_ ORDER BY score DESC, doc_id LIMIT {2000 if site_ else 300})"""
    site = f"WHERE regexp_replace(host, '^www\\.', '') = '{site_}' OR ends_with(host, '.{site_}')" if site_ else ""
    return _on_index(f"SELECT doc_id, score, host FROM best_ JOIN docs_ USING (doc_id) {site} ORDER BY score DESC, doc_id LIMIT 300", more)


def scan_host(site: str) -> str:
    return _on_index(f"SELECT doc_id, 1.0::DOUBLE AS score, host FROM docs_ WHERE host = '{site}' OR ends_with(host, '.{site}') ORDER BY doc_id LIMIT 100")


def suggest(prefix: str) -> str:
    near = f"(SELECT * FROM terms_ WHERE starts_with(term, '{prefix}') ORDER BY term LIMIT 60)"
    return _on_index(f"SELECT term, df FROM {near} WHERE df >= 3 AND term NOT IN {_list(STOP_WORDS)} AND NOT {JUNK.replace('(t', '(term')} ORDER BY df DESC, term LIMIT 10")


def spellfix(words) -> str:
    letters = "unnest(string_split('abcdefghijklmnopqrstuvwxyz', ''))"
    more = f""",
asked_ AS (SELECT word, coalesce(df, 0) AS base FROM (VALUES {_values([(w,) for w in words])}) v(word) LEFT JOIN terms_ ON term = word),
rare_ AS (SELECT * FROM asked_ WHERE base < 3 AND strlen(word) BETWEEN 4 AND 20),
at_ AS (SELECT word, base, unnest(range(0, length(word) + 1)) AS i FROM rare_),
tried_ AS (
  SELECT word, base, i, 0 AS kind, '' AS c, left(word, i) || substr(word, i + 2) AS term FROM at_ WHERE i < length(word)
  UNION ALL SELECT word, base, i, 1, '', left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM at_ WHERE i + 1 < length(word)
  UNION ALL SELECT word, base, i, 2, c, left(word, i) || c || substr(word, i + 2) FROM (SELECT *, {letters} AS c FROM at_) WHERE i < length(word)
  UNION ALL SELECT word, base, i, 3, c, left(word, i) || c || substr(word, i + 1) FROM (SELECT *, {letters} AS c FROM at_)),
found_ AS (SELECT word, t.term, row_number() OVER (PARTITION BY word ORDER BY df DESC, i, kind, c) AS nth FROM tried_ t JOIN terms_ USING (term) WHERE t.term <> word AND df > base * 5 + 10)"""
    return _on_index("SELECT word, f.term AS fix FROM asked_ LEFT JOIN (SELECT * FROM found_ WHERE nth = 1) f USING (word)", more)


def page_indexed(site: str) -> str:
    return _on_index(f"SELECT doc_id, url FROM docs_ WHERE host = '{site}' ORDER BY doc_id LIMIT 1")


def top_hosts(k: int) -> str:
    return _on_index(f"SELECT host, count(*) AS pages FROM docs_ GROUP BY host ORDER BY pages DESC, host LIMIT {k}")


def sites_count() -> str:
    return "SELECT count(*) AS pages, count(DISTINCT source) AS sites FROM documents"


def host_pages_any(host: str) -> str:
    return f"SELECT count(*) AS pages FROM documents WHERE source || '.example.org' IN ('{host}', 'www.{host}')"


def hosts_with_suffix(domain: str) -> str:
    return f"SELECT count(DISTINCT source) AS hosts, count(*) AS pages FROM documents WHERE ends_with(source || '.example.org', '.{domain}')"


def hosts_where() -> str:
    return "SELECT source || '.example.org' AS host, count(*) AS pages FROM documents WHERE starts_with(source, 'src1') GROUP BY ALL ORDER BY pages DESC, host LIMIT 3"


def recent_pages() -> str:
    return f"WITH {PAGES} SELECT doc_id, CASE WHEN length(title) > 90 THEN left(title, 90) || '…' ELSE title END AS title, host, url FROM pages_ ORDER BY doc_id DESC LIMIT 8"


AUTHORITY = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^.*@', '')"
HOST_NAME = f"regexp_replace({AUTHORITY}, ':[0-9]*$', '')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
BARE = f"regexp_replace({AUTHORITY}, '^www\\.', '')"


def url_parts() -> str:
    uri = f"(CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END) || regexp_extract(url, '[?][^#]*')"
    return f"SELECT page_id, {AUTHORITY} AS host, {HOST_NAME} AS host_name, {PATH} AS path, {uri} AS request_uri, regexp_replace(lower({HOST_NAME}), '^www\\.', '') AS site FROM pages"


def url_norm() -> str:
    return r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://(www\.)?', ''), '/$', '') AS norm FROM pages"


def same_site() -> str:
    def under(base: str) -> str:
        return f"({AUTHORITY} IN ('{base}', 'www.{base}') OR ends_with({AUTHORITY}, '.{base}'))"

    return f"SELECT page_id, ({AUTHORITY} IN ({BARE}, 'www.' || {BARE}) OR ends_with({AUTHORITY}, '.' || {BARE})) AS same, {under('example.com')} AS below, {under('example.net')} AS other FROM pages"


def query_shapes() -> str:
    shape = "CASE WHEN page_id % 4 < 3 THEN 'h' || page_id % 7 || '.example/p' || page_id % 3 || CASE WHEN page_id % 4 < 2 THEN '?a&b' ELSE '?a' END END"
    return f"SELECT pos, shape, shape IS NOT NULL AND row_number() OVER (PARTITION BY shape ORDER BY pos) > 1 AS repeated FROM (SELECT page_id AS pos, {shape} AS shape FROM pages)"


def not_sent() -> str:
    return "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)"


FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, strlen(url)), lambda i: ('0x' || substr(hex(encode(url)), (2 * i + 1)::INT, 2))::INT::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
FNV_HEX = f"lpad(lower(to_hex(({FNV})::UBIGINT)), 16, '0')"


def url_fnv() -> str:
    return f"SELECT page_id, {FNV_HEX} AS hash FROM pages"


def not_seen() -> str:
    return f"SELECT DISTINCT {FNV_HEX} AS hash FROM pages WHERE length(url) % 2 <> 0"


def first_pages() -> str:
    return f"SELECT page_id, site FROM (SELECT page_id, site, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM (SELECT page_id, regexp_replace(lower({HOST_NAME}), '^www\\.', '') AS site FROM pages)) WHERE k <= 2"


def recrawl_due() -> str:
    return "SELECT user_id, last FROM (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last FROM events GROUP BY ALL) WHERE epoch(TIMESTAMP '2024-01-31') - last > 21600"


def seeds_normalised() -> str:
    kinds = ("'https://one' || k || '.example', ''", "'http://one' || (k - 1) || '.example', ''", "'https://one' || k || '.example', 'https://one' || k || '.example/map.xml'")
    rows = " UNION ALL ".join(f"SELECT {kind} FROM s WHERE k % 5 = {n + 2}" for n, kind in enumerate(kinds))
    return f"WITH s AS (SELECT s_suppkey AS k FROM supplier), r(site, sitemap) AS ({rows}) SELECT DISTINCT site, sitemap FROM r"


def last_done() -> str:
    return "SELECT site, done FROM (SELECT o_custkey AS site, floor(epoch(o_orderdate))::BIGINT AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1"


def lang(which: str) -> str:
    cut = "CASE WHEN strlen(text) <= 600 THEN text ELSE left(text, list_max(list_filter(range(0, 601), lambda n: strlen(left(text, n::INT)) <= 600))::INT) END"
    whole = f"title || ' ' || description || ' ' || ({cut})"
    english = which == "english"
    runs = r"'[\p{L}\p{N}]+'" if english else r"'\p{L}+'"
    common = _list(ENGLISH_WORDS if english else GERMAN_WORDS)
    url = "'https://' || lang || '.example' || CASE WHEN doc_id % 2 = 0 THEN '.org/' ELSE '.de/' END"
    inner = rf"SELECT doc_id, {url} AS url, a, regexp_extract_all(lower(a), {runs}) AS words, len(regexp_extract_all(a, '\p{{L}}')) AS letters, len(regexp_extract_all(regexp_replace(a, '[^\x{{0}}-\x{{24F}}]', '', 'g'), '\p{{L}}')) AS latin FROM (SELECT *, {whole} AS a FROM pages_)"
    share = f"len(list_filter(words, lambda w: w IN {common})) / len(words)"
    verdict = {
        "english": f"CASE WHEN letters = 0 THEN true WHEN latin / letters < 0.8 THEN false WHEN len(words) < 15 THEN true ELSE {share} >= CASE WHEN doc_id % 2 = 1 THEN 0.14 ELSE 0.07 END END",
        "german": f"CASE WHEN NOT (doc_id % 2 = 1 OR lang = 'de') THEN false WHEN len(words) < 15 THEN true ELSE {share} >= 0.08 END",
        "german_text": f"CASE WHEN len(words) < 15 THEN false ELSE {share} >= 0.10 END",
    }[which].replace("lang = 'de'", "starts_with(url, 'https://de.')")
    return f"WITH {PAGES} SELECT doc_id, {verdict} AS verdict FROM ({inner})"


def lang_german_url() -> str:
    domain = " OR ".join(f"ends_with(h, '{d}')" for d in GERMAN_DOMAINS)
    return rf"SELECT page_id, ({domain} OR regexp_matches(h, '^(www\.)?de\.') OR lower(string_split(ltrim(p, '/'), '/')[1]) IN {_list(GERMAN_SEGMENTS)}) AS german FROM (SELECT page_id, lower({HOST_NAME}) AS h, {PATH} AS p FROM pages)"


def _robots() -> str:
    bodies = " ".join("WHEN {} THEN {}".format(n, " || chr(10) || ".join("'" + line.replace("{k}", "' || k || '") + "'" for line in body.split("\n"))) for n, body in enumerate(cases.ROBOTS))
    return f"""files_ AS (SELECT 's' || k || '.example' AS site, k, CASE k % 4 {bodies} END AS body FROM (SELECT s_suppkey AS k FROM supplier)),
split_ AS (SELECT site, unnest(range(len(ls))) AS pos, unnest(ls) AS l FROM (SELECT site, list_transform(string_split(body, chr(10)), lambda l: trim(regexp_replace(l, '#.*$', ''))) AS ls FROM files_)),
told_ AS (SELECT site, pos, lower(trim(split_part(l, ':', 1))) AS key, trim(substr(l, instr(l, ':') + 1)) AS value FROM split_ WHERE contains(l, ':')),
marked_ AS (SELECT *, CASE WHEN key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY site ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM told_ WHERE key IN ('user-agent', 'allow', 'disallow')),
grouped_ AS (SELECT *, sum(opens) OVER (PARTITION BY site ORDER BY pos) AS g FROM marked_),
agents_ AS (SELECT site, g, pos, value = '*' AS everyone FROM grouped_ WHERE key = 'user-agent' AND (value = '*' OR contains('{cases.AGENT.lower()}', lower(value)) AND value <> '')),
ours_ AS (SELECT DISTINCT site FROM agents_ WHERE NOT everyone),
rules_ AS (SELECT r.site, r.key = 'allow' AS allow, r.value AS pat FROM grouped_ r JOIN agents_ a ON a.site = r.site AND a.g = r.g AND a.pos < r.pos
  WHERE r.key <> 'user-agent' AND a.everyone = (r.site NOT IN (SELECT site FROM ours_)))"""


def robots_rules() -> str:
    return f"WITH {_robots()} SELECT site, allow, pat FROM rules_"


def robots_allowed() -> str:
    paths = ", ".join(f"('{p}')" for p in cases.PATHS)
    regex = r"""'(?s)^' || regexp_replace(regexp_replace(regexp_replace(pat, '\$$', ''), '([\\.\[\]{}()+?^$|])', '\\\1', 'g'), '[*]+', '.*', 'g') || CASE WHEN ends_with(pat, '$') THEN '$' ELSE '' END"""
    return f"""WITH {_robots()},
usable_ AS (SELECT DISTINCT site, allow, pat, {regex} AS re FROM rules_ WHERE pat <> '' AND len(pat) - len(replace(pat, '*', '')) <= 5),
asked_ AS (SELECT site, path FROM files_ CROSS JOIN (VALUES {paths}) p(path)),
hit_ AS (SELECT site, path, allow, row_number() OVER (PARTITION BY site, path ORDER BY strlen(pat) DESC, allow DESC) AS nth FROM asked_ JOIN usable_ USING (site) WHERE regexp_matches(path, re))
SELECT a.site, a.path, coalesce(allow, true) AND k % 4 <> 2 AS allowed FROM asked_ a JOIN files_ USING (site) LEFT JOIN (SELECT * FROM hit_ WHERE nth = 1) h ON h.site = a.site AND h.path = a.path"""


def sitemap_locs() -> str:
    return "SELECT page_id, url AS loc, 2 AS total FROM pages"


def asset_refs() -> str:
    return f"SELECT page_id, array_to_string(list_sort(['/' || {AUTHORITY} || '.png', '/a.css', '/b.js?v=1']), '|') AS assets FROM pages"


def site_cost() -> str:
    def usd(times: int) -> str:
        return f"floor(bytes_per_visit / 1e9 * 0.085 * {times} * 10000 + 0.5) / 10000"

    return f"SELECT host, bytes_per_visit, {usd(1000)} AS usd_per_1000_visits, {usd(1000)} AS usd_per_hour, floor(bytes_per_visit / 1e9 * 0.085 * 1000 * 10 * 10000 + 0.5) / 10000 AS usd_per_10_hours FROM (SELECT {AUTHORITY} AS host, sum(strlen(html))::BIGINT AS bytes_per_visit FROM pages GROUP BY ALL)"


def flagged_ratio(share: float) -> str:
    return f"SELECT *, seen >= 5 AND flagged / seen >= {share} AS is_flagged FROM (SELECT user_id AS host, count(DISTINCT event_id) AS seen, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id END) AS flagged FROM events GROUP BY ALL)"


def browser_weight() -> str:
    return "SELECT user_id AS host, sum(floor(value))::BIGINT AS bytes_per_visit, coalesce(sum(floor(value)) FILTER (event_id % 2 = 0 AND event_type = 'click'), 0)::BIGINT AS js_bytes, count(*) AS requests FROM events GROUP BY ALL"


def host_counts() -> str:
    return "SELECT source || '.example.org' AS host, count(*) AS pages FROM documents GROUP BY ALL"


def content_pages() -> str:
    return f"WITH {PAGES} SELECT 'https://h.example/' || doc_id AS url, title, '' AS description, text, 'sitemap' AS source FROM pages_ WHERE doc_id % 4 <> 2 AND trim(title || text) <> ''"


def stored_pages() -> str:
    title = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END"
    return f"SELECT 'https://h.example/' || doc_id AS url, {title} AS title, 'd' AS description, text FROM documents WHERE doc_id % 5 <> 0 AND trim({title} || CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END) <> ''"


def discover() -> str:
    way = "['llms.txt', 'sitemap', 'mediawiki', 'sitemap', 'html'][k % 5 + 1]"
    url = "CASE k % 5 WHEN 0 THEN site || '/a?x=1&y=2' WHEN 1 THEN site || '/1?a&amp;b' WHEN 3 THEN site || '/usual' WHEN 4 THEN site || '/' END"
    return f"SELECT site, {way} AS method, {url} AS url FROM (SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.example' AS site FROM supplier)"


def community_pages() -> str:
    about = "'c/' || source || CASE WHEN doc_id % 2 = 0 THEN ' - ' || lang ELSE '' END"
    body = f"left(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), 2000)"
    return f"SELECT doc_id AS id, 'https://c.example/post/' || doc_id AS url, source AS title, {about} AS description, {body} AS text, 'lemmy' AS source FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0"


def listed_communities() -> str:
    return flagged_ratio(0.25)


def wiki_pages() -> str:
    title = "p_name || ' (é/' || p_partkey || ')'"
    return f"SELECT 'https://w.example/wiki/' || replace(replace({title}, ' ', '_'), 'é', '%C3%A9') AS url, {title} AS title, p_brand AS description, p_type AS text, 'mediawiki' AS source FROM part WHERE p_size > 5"


def wiki_chunks() -> str:
    return "SELECT p_brand AS site, p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20)::INT AS chunk FROM part"


def sites_due() -> str:
    return f"SELECT c_custkey AS site FROM customer LEFT JOIN ({last_done()}) ON site = c_custkey WHERE {cases.NOW} - coalesce(done, 0) > 7 * 86400"


def site_names() -> str:
    return f"SELECT page_id, regexp_full_match(lower({AUTHORITY}), '[a-z0-9-]+(\\.[a-z0-9-]+)+') AS host_ok, false AS url_ok FROM pages"


def robots_sitemaps() -> str:
    return "SELECT 's' || s_suppkey || '.example' AS site, 'https://s' || s_suppkey || '.example/m.xml' AS sitemap FROM supplier WHERE s_suppkey % 4 = 0"


def german_frontier() -> str:
    def german(host: str, path: str) -> str:
        domain = " OR ".join(f"ends_with({host}, '{d}')" for d in GERMAN_DOMAINS)
        return rf"({domain} OR regexp_matches({host}, '^(www\.)?de\.') OR lower(string_split(ltrim({path}, '/'), '/')[1]) IN {_list(GERMAN_SEGMENTS)})"

    links = f"SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, url, {german('lower(' + HOST_NAME + ')', PATH)} AS german FROM pages"
    return f"WITH l AS ({links}) SELECT site, url FROM l WHERE german UNION ALL SELECT site, site || '/de/' FROM l GROUP BY site HAVING NOT bool_or(german)"


def reachable() -> str:
    return """WITH RECURSIVE e AS (SELECT p_partkey AS src, unnest([p_partkey * 2, p_partkey * 2 + 1, 1]) AS dst FROM part),
walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN e ON e.src = walk.node WHERE walk.depth < 5)
SELECT node::VARCHAR AS url, min(depth)::INT AS depth FROM walk GROUP BY ALL"""


def merged_seen() -> str:
    return f"SELECT DISTINCT {FNV_HEX} AS hash FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0"


def lang_kept() -> str:
    return f"SELECT doc_id, e.verdict OR g.verdict AS verdict FROM ({lang('english')}) e JOIN ({lang('german')}) g USING (doc_id)"


def _usd(bytes_: str, times: int) -> str:
    return f"floor({bytes_} / 1e9 * 0.085 * {times} * 10000 + 0.5) / 10000"


def measured_pages() -> str:
    html = """html || '<img src="/p' || page_id || '.png"><link href="/a.css"><script src="https://cdn.example/x.js"></script><img src="/p' || page_id || '.png">'"""
    pages = f"SELECT page_id::VARCHAR AS host, regexp_replace(url, '[?#].*$', '') || twin AS page, strlen({html})::BIGINT AS html_bytes, 1 + (page_id > 0)::BIGINT AS assets, strlen({html}) + 5000 + page_id * 10 AS bytes_per_visit FROM pages CROSS JOIN (VALUES (''), ('?twin')) t(twin)"
    return f"SELECT *, {_usd('bytes_per_visit', 1000)} AS usd_per_1000_visits, {_usd('bytes_per_visit', 1000)} AS usd_per_hour, {_usd('bytes_per_visit', 10000)} AS usd_per_10_hours FROM ({pages})"


def cost_report() -> str:
    js = "CASE WHEN n > 1 THEN ((b // 2) // 1024) || ' KB' ELSE 'n/a' END"
    line = f"printf('| %s | %d KB | %s | %d | %.4f | %.4f | %.4f |', host, b // 1024, {js}, CASE WHEN n > 1 THEN n * 3 ELSE n + 1 END, {_usd('b', 1000)}, {_usd('b', 1000)}, {_usd('b', 10000)})"
    return f"SELECT {line} AS line FROM (SELECT {AUTHORITY} AS host, sum(strlen(html))::BIGINT AS b, count(*) AS n FROM pages GROUP BY ALL)"


def latest_page_counts() -> str:
    return "SELECT coalesce(c_custkey, host) AS host, coalesce(pages, 0) AS pages FROM customer FULL JOIN (SELECT o_custkey AS host, count(*) AS pages FROM orders GROUP BY ALL) ON host = c_custkey"


def flagged_totals(share: float) -> str:
    return f"SELECT count(*) AS hosts, sum(seen)::BIGINT AS seen, sum(flagged)::BIGINT AS flagged, count(*) FILTER (is_flagged) AS flagged_hosts FROM ({flagged_ratio(share)})"


def labels() -> str:
    short = "CASE WHEN length(trim(text)) > 30 THEN left(trim(text), 30) || '…' ELSE trim(text) END"
    escaped = """replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
    return f"SELECT doc_id, {short} AS short, {escaped} AS escaped, CASE WHEN n_chars >= 100 THEN '100+' ELSE n_chars::VARCHAR END AS label, CASE WHEN n_chars >= 99 THEN '99+' ELSE n_chars::VARCHAR END AS label99 FROM documents"


def compacted_terms() -> str:
    return _on_index("SELECT term, count(*) AS df FROM postings_ JOIN docs_ USING (doc_id) GROUP BY term")


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&copy;": "©", "&middot;": "·", "&nbsp;": " ", "&amp;": "&"}
BLOCKS = "p|div|br|li|tr|td|th|h1|h2|h3|h4|h5|h6|section|article|ul|ol|table|dd|dt|blockquote|pre|form|main"


def _unescaped(x: str) -> str:
    for name, sign in ENTITIES.items():
        x = f"replace({x}, '{name}', '{sign}')"
    return x


def html_fields() -> str:
    x = "html"
    for pattern, by in (("<!--.*?-->", ""), ("<head.*?</head>", ""), ("<script.*?</script>|<style.*?</style>", ""), ("<(nav|header|footer|aside)[^>]*>.*?</(nav|header|footer|aside)>", ""), (f"</?({BLOCKS})(\\s[^>]*)?/?>", " "), ("</?[a-z0-9:_-]+[^>]*>", "")):
        x = f"regexp_replace({x}, '(?is){pattern}', '{by}', 'g')"
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    tidy = [f"left(trim(regexp_replace({_unescaped(y)}, '{SPACE}', ' ', 'g')), {most})" for y, most in ((title, 200), (x, 2000))]
    return f"SELECT page_id, {tidy[0]} AS title, '' AS description, {tidy[1]} AS text FROM pages"


def html_links() -> str:
    link = f"CASE WHEN starts_with(l, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || l ELSE l END"
    found = f"SELECT page_id, url, list_transform(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1), lambda x: regexp_replace({_unescaped('x')}, '#.*$', '')) AS ls FROM pages"
    return f"SELECT page_id, pos::INT AS pos, {link} AS link FROM (SELECT page_id, url, unnest(range(len(ls))) AS pos, unnest(ls) AS l FROM ({found}))"


def pack_roundtrip() -> str:
    return f"WITH {PAGES} SELECT doc_id, text FROM pages_"


def search_results(text: str, first: int, many: int) -> str:
    whole = search(text)
    cut = whole.index("SELECT doc_id, score, host FROM best_")
    ranked = f"SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM ({whole[cut:]})"
    return f"{whole[:cut]} SELECT rank::INT AS rank, url, title, d.host, score, total FROM ({ranked}) r JOIN docs_ d USING (doc_id) WHERE rank > {first} AND rank <= {first + many}"


def site_info(site: str) -> str:
    n = f"(SELECT least(100, count(*)) AS n FROM documents WHERE source || '.example.org' = '{site}' OR ends_with(source || '.example.org', '.{site}'))"
    return f"SELECT '{site}' AS site, n AS total, CASE WHEN n >= 100 THEN '100+' ELSE n::VARCHAR END AS label, n > 0 AS indexed FROM {n}"


def odd_addresses() -> str:
    base = "regexp_replace(url, '[?#].*$', '')"
    tails = ["'?q=a|b'", "'/a b'", "'/a^b'", "'?q={x}#f'", "'/%zz'", "'/' || chr(9)", "'?q=%zz'"]
    url = f"CASE page_id % 8 {' '.join(f'WHEN {n} THEN {base} || {tail}' for n, tail in enumerate(tails))} ELSE replace({base}, '://', '://me:pw@') END"
    path = f"(CASE WHEN {PATH.replace('url', 'plain')} = '' AND k NOT IN (1, 2) THEN '/' ELSE {PATH.replace('url', 'plain')} END)"
    uri = f"{path} || CASE k {' '.join(f'WHEN {n} THEN {tail}' for n, tail in ((0, tails[0]), (1, tails[1]), (2, tails[2]), (3, repr('?q={x}')), (6, tails[6])))} ELSE '' END"
    host = AUTHORITY.replace("url", "plain")
    site = f"regexp_replace(lower(regexp_replace({host}, ':[0-9]*$', '')), '^www\\.', '')"
    fine = "k NOT IN (4, 5)"
    return f"SELECT page_id, {url} AS url, CASE WHEN {fine} THEN {host} END AS host, CASE WHEN {fine} THEN {uri} ELSE '/' END AS request_uri, CASE WHEN {fine} THEN {site} END AS site FROM (SELECT page_id, url, {base} AS plain, page_id % 8 AS k FROM pages)"


def measured_sites() -> str:
    return "SELECT c_custkey AS host, coalesce(pages, 0) AS pages_indexed, CASE WHEN c_custkey % 3 = 0 THEN 'unreachable' ELSE 'ok' END AS list FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS pages FROM orders GROUP BY ALL) ON o_custkey = c_custkey"


def crawl_counters() -> str:
    names = ("emitted", "sent", "failed", "errors", "skipped", "sites_started", "sites_done", "foreign")
    sums = ", ".join(f"sum(count(*) FILTER (event_id % 9 = {n})) OVER (ORDER BY w)::BIGINT AS {name}" for n, name in enumerate(names))
    return f"SELECT w AS window_start, {sums}, count(*) FILTER (event_id % 9 = 0) / 3600 AS pages_per_second FROM (SELECT event_id, floor(epoch(ts))::BIGINT // 3600 * 3600 AS w FROM events WHERE event_id % 9 < 8) GROUP BY w"


def wiki_info() -> str:
    return "SELECT site, CASE WHEN a THEN site || '/w/api.php' ELSE site || '/api.php' END AS api, CASE WHEN a THEN '/wiki0/$1' ELSE '/wiki1/$1' END AS article_path FROM (SELECT 'https://s' || s_suppkey || '.example' AS site, s_suppkey % 6 = 0 AS a, s_suppkey % 5 = 0 AS b FROM supplier) WHERE a OR b"


def wait_seconds() -> str:
    return "SELECT event_id, CASE WHEN event_id % 3 = 0 AND n > 0 THEN least(n, 600) WHEN event_id % 3 = 1 AND n > 0 AND n < 600 THEN n ELSE 30 END::BIGINT AS wait FROM (SELECT event_id, event_id % 900 - 100 AS n FROM events)"


def flagged_failures() -> str:
    told = "(SELECT '{' || string_agg('\"' || n_name || '\":\"' || left(repeat(n_name, 20), 60) || '\"', ',' ORDER BY n_name) || '}' FROM nation)"
    return f"SELECT count(*) AS hosts, count(*) FILTER (is_flagged) AS flagged_hosts, {told} AS failed FROM ({flagged_ratio(0.25)})"


def latest_versions() -> str:
    newer = f"len({_kept(chr(39) + 'Newer title' + chr(39))})"
    return _on_index(f"SELECT url, CASE WHEN doc_id % 3 = 0 THEN 'Newer title' ELSE title END AS title, (CASE WHEN doc_id % 3 = 0 THEN 3 * {newer} + dl - 3 * old ELSE dl END)::INT AS dl FROM docs_ JOIN (SELECT doc_id, len({_kept('title')}) AS old FROM pages_) USING (doc_id)")


def send_batches() -> str:
    """Thirty pages come before each pause. Batches go by size: 24 pages of 90,000 bytes exceed two MiB, the other six go at the pause."""
    return "SELECT page_id, page_id % 4 AS sender, ((nth // 30) * 2 + CASE WHEN nth % 30 >= 24 THEN 1 ELSE 0 END)::INT AS batch_no FROM (SELECT page_id, (page_id // 4)::BIGINT AS nth FROM pages)"
