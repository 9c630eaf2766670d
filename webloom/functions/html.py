"""HTML pages to fields, as an Arrow-batched function: title, description, visible text, links.

A page is read as a sequence of comments, tags and text found by one pattern. It is not a document tree: a page that is
cut off or badly nested still gives what precedes the damage.
"""

from __future__ import annotations

import html
import re
from html.entities import html5
from itertools import accumulate
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without text for a reader, page furniture, elements that part words, description names.
SKIPPED = {"script", "style", "noscript", "svg", "template", "iframe", "object"}
FURNITURE = {"nav", "header", "footer", "aside"}
PARTING = set("p div br li tr td th h1 h2 h3 h4 h5 h6 section article ul ol table dd dt blockquote pre form main".split())
DESCRIPTIONS = {("name", "description"), ("name", "twitter:description"), ("property", "og:description")}
TITLE, DESCRIPTION, TEXT, TEXT_BYTES = 200, 300, 2000, 8000

FIELDS = "title string, description string, text string, links array<string>"
_INSIDE = r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*"
#: Marks between runs of text: a comment; an element without text, whole; a tag with quotes respected; a comment or tag that
#: never ends, with all that follows; a bare "<".
_MARK = re.compile(
    rf"<!--.*?-->|<(?P<hidden>{'|'.join(sorted(SKIPPED))})(?![A-Z0-9:_-]){_INSIDE}(?<!/)>.*?(?=</(?P=hidden)|\Z)"
    rf"|<(?P<close>/?)(?P<name>[A-Z0-9:_-]+)(?P<inside>{_INSIDE})>|(?:<!--|</?[A-Z0-9:_-]).*|<",
    re.S | re.I | re.A,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\n\r\f>]*)))?")

#: A character reference with its semicolon; group 1 if it is a number.
_TERMINATED = re.compile(r"&(?:(#[0-9]+|#[xX][0-9A-Fa-f]+)|[A-Za-z][A-Za-z0-9]*);")


def attribute(inside: str, wanted: str) -> str:
    """Value of a tag's first attribute of that name, or nothing."""
    for name, double, single, bare in _ATTRIBUTE.findall(inside):
        if name.lower() == wanted and (double or single or bare):
            return double or single or bare
    return ""


def unescape_terminated(text: str) -> str:
    """html.unescape, but a reference without its semicolon, as at the end of a text that was cut, stays as written."""
    return _TERMINATED.sub(lambda m: html.unescape(m[0]) if m[1] or m[0][1:] in html5 else m[0], text)


def _tidy(text: str, most: int, decode=html.unescape) -> str:
    return " ".join(decode(text).split())[:most]


def _states(marks: list, turn, start):
    """The state before each run of text: `turn(state, name, closing)` applied over the marks."""
    return accumulate(marks, lambda state, mark: turn(state, mark[0], mark[1]), initial=start)


def page_fields(page: str | None, with_links: bool = True, most_bytes: int = TEXT_BYTES, decode=html.unescape) -> dict:
    """A page's marks are found once. What the text between them is - title, head, furniture or shown - follows from running
    states over the marks, one for each rule; title and text are then selections of the runs."""
    page = page or ""
    found = list(_MARK.finditer(page))
    runs = [page[a:b] for a, b in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(page)])]
    marks = [((m["name"] or "").lower(), bool(m["close"]), m["inside"] or "", m[0] == "<") for m in found]
    titled = list(_states(marks, lambda on, name, closing: not closing if name == "title" else on, False))
    headed = _states(marks, lambda on, name, closing: not closing if name == "head" else on and name != "body", False)
    steps = [(inside.endswith("/"), name, closing) for name, closing, inside, _ in marks]
    depths = accumulate(steps, lambda depth, s: max(0, depth - 1 if s[2] else depth + (not s[0])) if s[1] in FURNITURE else depth, initial=0)

    # Each run is followed by what its mark shows: a bare sign, or the space of an element that parts words.
    signs = ["<" if bare and not on else " " if name in PARTING else "" for (name, _, _, bare), on in zip(marks, titled)] + [""]
    pieces = [p for run, sign, on, head, depth in zip(runs, signs, titled, headed, depths) if not head and not depth for p in ("" if on else run, sign) if p]
    spent = accumulate((len(p.encode()) for p in pieces), initial=0)
    shown = "".join(p for p, before in zip(pieces, spent) if before < most_bytes)

    opened = [(name, inside) for name, closing, inside, _ in marks if not closing]
    told = (attribute(inside, "content") for name, inside in opened if name == "meta" and any(attribute(inside, key).lower() == value for key, value in DESCRIPTIONS))
    links = [html.unescape(target) for name, inside in opened if with_links and name == "a" and (target := attribute(inside, "href"))]
    title = "".join(run for run, on in zip(runs, titled) if on)
    return {"title": _tidy(title, TITLE, decode), "description": _tidy(next(filter(None, told), ""), DESCRIPTION, decode), "text": _tidy(shown, TEXT, decode), "links": links}


def resolve_links(base: str | None, links: list[str] | None) -> list[str]:
    """Absolute http addresses without fragments, in order; what cannot be joined is left out."""
    out = []
    for link in [] if base is None or links is None else links:
        try:
            target = urldefrag(urljoin(base, link)).url
        except ValueError:
            continue
        if target.lower().startswith(("http://", "https://")):
            out.append(target)
    return out


def _fields(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_fields(p) for p in pages], columns=["title", "description", "text", "links"])


def _fields_terminated(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_fields(p, decode=unescape_terminated) for p in pages], columns=["title", "description", "text", "links"])


def _resolved(bases: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([resolve_links(b, l) for b, l in zip(bases, links)], dtype=object)


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def html_fields(page: Column, terminated: bool = False) -> Column:
    """Struct of title, description, text and links. References are decoded as browsers do, also without their semicolon, or
    with `terminated` only where it is there."""
    return F.pandas_udf(_fields_terminated if terminated else _fields, FIELDS)(page)


def resolved_links(base: Column, links: Column) -> Column:
    return F.pandas_udf(_resolved, "array<string>")(base, links)


def unescape(text: Column) -> Column:
    return F.pandas_udf(_unescaped, "string")(text)


def _each_unescaped(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: None if texts is None else [html.unescape(t) for t in texts])


def unescape_each(texts: Column) -> Column:
    return F.pandas_udf(_each_unescaped, "array<string>")(texts)


#: Fixed value: what counts as a linked file of a page.
ASSET = r"""(?i)(?:src|href)=["']([^"']+\.(?:js|css|png|jpe?g|gif|webp|avif|svg|ico|woff2?)(?:\?[^"']*)?)["']"""


def asset_links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(ASSET), F.lit(1))
