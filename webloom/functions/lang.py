"""Language tests as Column expressions, from word shares and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import first_bytes, letter_runs, word_runs
from webloom.functions.urls import host_name, path

#: Common words, country domains, German path segments.
ENGLISH_WORDS = (
    "the of and to in is that for it with as on are this be by at from or an was have has not but you your we can will "
    "they their its which who what when where how all more one about into than then also our these those been were"
).split()
GERMAN_WORDS = (
    "der die das und ist nicht ein eine mit von zu den für auf im dem des sich auch es an als wir sie ich aber bei oder "
    "wird nach wie über aus noch nur wenn sind dass kann zur zum um durch uns ihr mehr unsere haben werden"
).split()
FOREIGN_DOMAINS = ".de .fr .es .it .nl .pl .ru .jp .cn .br .pt .se .no .dk .fi .cz .tr .kr .at .ch .gr .ua .hu .ro".split()
GERMAN_DOMAINS = ".de .at .ch .li".split()
GERMAN_SEGMENTS = "de de-de de_de de-at de_at de-ch de_ch deu german deutsch".split()
#: Bytes of text looked at, least words, least share of Latin letters, least shares of common words.
BYTES, WORDS, LATIN = 600, 15, 0.8
ENGLISH, ENGLISH_ABROAD, GERMAN, GERMAN_TEXT = 0.07, 0.14, 0.08, 0.10


def _all(title: Column, description: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), first_bytes(F.coalesce(text, F.lit("")), BYTES))


def _ends(host: Column, domains: list[str]) -> Column:
    return F.coalesce(host.rlike("(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"), F.lit(False))


def _share(words: Column, common: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(common))) / F.size(words)


def is_english(url: Column, title: Column, description: Column, text: Column) -> Column:
    """Mostly Latin letters and the usual share of common words; too short to tell counts as English."""
    whole = _all(title, description, text)
    letters = F.size(F.regexp_extract_all(whole, F.lit(r"\p{L}"), F.lit(0)))
    latin = F.size(F.regexp_extract_all(F.regexp_replace(whole, r"[^\x{0}-\x{24F}]", ""), F.lit(r"\p{L}"), F.lit(0)))
    words = word_runs(whole)
    need = F.when(_ends(host_name(url), FOREIGN_DOMAINS), ENGLISH_ABROAD).otherwise(ENGLISH)
    return F.when(letters == 0, True).when(latin / letters < LATIN, False).when(F.size(words) < WORDS, True).otherwise(_share(words, ENGLISH_WORDS) >= need)


def german_url(url: Column) -> Column:
    """An address that says German: by country, by subdomain or by first folder."""
    host = F.lower(host_name(url))
    segment = F.lower(F.split(F.regexp_replace(path(url), "^/", ""), "/")[0])
    return F.coalesce(_ends(host, GERMAN_DOMAINS) | host.rlike(r"^(www\.)?de\.") | segment.isin(GERMAN_SEGMENTS), F.lit(False))


def is_german(url: Column, title: Column, description: Column, text: Column) -> Column:
    """A German address whose text is not plainly in another language."""
    words = letter_runs(_all(title, description, text))
    return F.when(~german_url(url), False).when(F.size(words) < WORDS, True).otherwise(_share(words, GERMAN_WORDS) >= GERMAN)


def is_german_text(title: Column, description: Column, text: Column) -> Column:
    """A German text, whatever its address."""
    words = letter_runs(_all(title, description, text))
    return F.when(F.size(words) < WORDS, False).otherwise(_share(words, GERMAN_WORDS) >= GERMAN_TEXT)


def language_ok(policy: str, url: Column, title: Column, description: Column, text: Column) -> Column:
    """What a crawl keeps: `en` (English or German), `de`, `de-site` (by text alone) or `any`."""
    if policy == "en":
        return is_english(url, title, description, text) | is_german(url, title, description, text)
    if policy == "de":
        return is_german(url, title, description, text)
    if policy == "de-site":
        return is_german_text(title, description, text)
    if policy == "any":
        return F.lit(True)
    raise ValueError(f"unknown language policy: {policy}")
