"""Text functions as Column expressions. Lengths are bytes where the name says so, else code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to search for.
STOP_WORDS = (
    "the a an of to in and or is it for on with as by at from that this are was be not but have has had you your we "
    "our they their its which who what when where how can will would there about into than then also more most some "
    "any all one two if so do does did no yes up out over under after before just only very such other these those "
    "been being were them he she him her his hers i me my mine us ours"
).split()
#: Limits of a token in bytes, of a kept one, and of a kept number.
LONGEST_TOKEN, LONGEST_KEPT, LONGEST_NUMBER = 80, 30, 6
#: The signs of Unicode's class Zs, which are trimmed; code points of a page's body that its title and text are taken from.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
TITLE_FROM, TEXT_FROM = 4000, 12000


def lower_each(s: Column) -> Column:
    """Lower case character by character: no dotted i, no final sigma."""
    return F.lower(F.translate(s, "İΣ", "iσ"))


def word_runs(s: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.regexp_extract_all(lower_each(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def letter_runs(s: Column) -> Column:
    return F.regexp_extract_all(lower_each(s), F.lit(r"\p{L}+"), F.lit(0))


def tokens(s: Column) -> Column:
    return F.filter(word_runs(s), lambda t: F.octet_length(t) <= LONGEST_TOKEN)


def is_stop(t: Column) -> Column:
    return t.isin(STOP_WORDS)


def is_junk(t: Column) -> Column:
    """Too long to be a word, or a long number."""
    return (F.octet_length(t) > LONGEST_KEPT) | ((F.octet_length(t) > LONGEST_NUMBER) & t.rlike("^[0-9]+$"))


def kept_tokens(s: Column) -> Column:
    return F.filter(tokens(s), lambda t: ~is_stop(t) & ~is_junk(t))


def trimmed(s: Column) -> Column:
    """Without spaces of any kind at its ends; tabs and other controls stay."""
    return F.trim(s, F.lit(SPACES))


def collapse(s: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def clip(s: Column, n: int) -> Column:
    return F.substring(trimmed(s), 1, n)


def short(s: Column, n: int) -> Column:
    """clip, with an ellipsis if something was cut."""
    return F.when(F.length(trimmed(s)) > n, F.concat(clip(s, n), F.lit("…"))).otherwise(trimmed(s))


def first_bytes(s: Column, n: int) -> Column:
    """The first n bytes; a character that is cut there is no letter any more."""
    return F.when(F.octet_length(s) <= n, s).otherwise(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))


def page_title(body: Column) -> Column:
    """First line that is not blank without leading hashes, of a plain-text page."""
    lines = F.transform(F.split(F.substring(body, 1, TITLE_FROM), "\n"), lambda line: trimmed(F.regexp_replace(line, "^[# ]+", "")))
    return clip(F.coalesce(F.get(F.filter(lines, lambda line: line != ""), F.lit(0)), F.lit("")), 200)


def page_text(body: Column) -> Column:
    return clip(collapse(F.substring(body, 1, TEXT_FROM)), 2000)


def is_textual(content_type: Column) -> Column:
    return F.lower(content_type).rlike("^$|text/|xml|json|markdown")


def escape_html(s: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s
