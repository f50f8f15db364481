"""Similarity of names, and plain text of HTML: Arrow functions where no built-in one has the semantics."""

import re
from collections import Counter
from difflib import SequenceMatcher
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version endings, the borders of a name's words, and the thresholds of similarity.
SUFFIX = r"_(v\d+|old|new|legacy|bak)$"
BORDER = r"[/_\-]|(?<=[a-z])(?=[A-Z])"
FLOOR_OVERLAP, FLOOR_RATIO, SHORT = 0.34, 0.75, 3


def words_of(name: str) -> set[str]:
    return {w.lower() for w in re.split(BORDER, name) if w}


def jaccard(p: set[str], q: set[str]) -> float:
    return len(p & q) / len(p | q) if p or q else 0.0


def name_similarity(a: str, b: str) -> float:
    """1 for names that differ by case or version only. Equal last parts are judged by their folders: 1 if one has none, else
    half and half their words' overlap. Otherwise the last parts count, by the best of word overlap, sequence match and
    containment; 0 for short ones, and across folders unless one of the three is strong."""
    x, y = (re.sub(SUFFIX, "", s.lower()) for s in (a, b))
    if x == y:
        return 1.0
    (folder_x, _, x), (folder_y, _, y) = x.rpartition("/"), y.rpartition("/")
    if x == y:
        return 0.5 + 0.5 * jaccard(words_of(folder_x), words_of(folder_y)) if folder_x and folder_y else 1.0
    overlap, ratio = jaccard(words_of(x), words_of(y)), SequenceMatcher(None, x, y).ratio()
    short, long = sorted((len(x), len(y)))
    inside = 0.5 + 0.5 * short / long if short and (x in y or y in x) else 0.0
    weak = overlap < FLOOR_OVERLAP and not inside and ratio < FLOOR_RATIO
    if (weak and folder_x and folder_y and folder_x != folder_y) or (short <= SHORT and overlap < 1):
        return 0.0
    return max(overlap, ratio, inside)


def may_reach(a: str, b: str, least: float) -> bool:
    """False only where the similarity of a and b can't be least: a quick test that spares the sequence match."""
    x, y = (re.sub(SUFFIX, "", s.lower()).rpartition("/")[2] for s in (a, b))
    if x == y:
        return True
    p, q = (Counter(s) for s in (x, y))
    most = 2 * (p & q).total() / (len(x) + len(y))
    return most >= least or x in y or y in x or jaccard(words_of(x), words_of(y)) >= least


def name_similarity_of(a: Column, b: Column) -> Column:
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(name_similarity(p or "", q or ""), 6) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(each, "double")(a, b)


#: Elements whose content is no text (fixed values).
HIDDEN = ("script", "style", "template")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.within: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.within.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.within:
            del self.within[self.within.index(tag) :]

    def handle_data(self, data: str) -> None:
        if data.strip() and not self.within:
            self.parts.append(data.strip())


def _as_text(m: re.Match) -> str:
    return m[0] if m[1] and (m[1].startswith("#") or m[1] in html5) else f"&amp;{m[0][1:]}"


def plain_text(html: str, closed: bool = False) -> str:
    """closed: only character references with their semicolon are decoded; a cut one stays as it is written."""
    p = _Text()
    p.feed(re.sub(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", _as_text, html) if closed else html)
    p.close()
    return " ".join(p.parts).replace("\xa0", " ").strip()


def render_html(html: Column, closed: bool = False) -> Column:
    def each(x: pd.Series) -> pd.Series:
        return x.map(lambda t: plain_text(t or "", closed))

    return F.pandas_udf(each, "string")(html)
