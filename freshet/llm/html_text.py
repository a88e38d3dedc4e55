"""Main text of web pages from flat text blocks, classified by a decision tree on a block and its neighbours."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import table
from freshet.llm.labelled_pages import PAGES

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose text is no text of the page, up to their end tag. Without one the first ones run to the page's end, the others hide nothing.
UNENDED = {"script", "style", "textarea", "title"}
RAW = UNENDED | {"noscript", "template", "iframe", "svg", "select", "button", "canvas", "audio", "video"}
#: Elements that stay inside a block; any other begins and ends blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements and roles around page furniture, and those around main text.
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
MAIN = {"article", "main"}
#: Names of furniture in class and id attributes: a whole name, its last word, or its first one before a word of UI.
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu navbar nav navigation breadcrumb breadcrumbs footer"
    " masthead comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended recommendations pagination pager toolbar topbar widget search copyright legal skip tags hidden".split()
)
UI_WORDS = set("area bar block body box button buttons card cards container content form group header icons inner item items line link links list message panel row section slot strip text title top unit wrap wrapper".split())
#: A name that begins so says what an element is or has, not that it is furniture.
MODIFIERS = {"has", "is", "no", "not", "with", "without"}
#: Lists of other texts: an article inside them is not the page's own.
LISTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side comment comments commentlist disqus respond replies related recommended recommendations popup modal overlay widget".split())
#: Features of a block; the first two are also taken of its neighbours.
FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "furniture", "page_header", "in_main", "heading"]


#: Kinds of furniture: by element or role; by the name of a list of other texts; by another name, where an article inside is the page's own.
HARD, LIST, LAYOUT = 3, 2, 1
#: Furniture by name alone is outvoted if it holds this share of the page's unlinked words outside hard furniture (and, unless it is a list
#: itself, outside lists) in whole sentences: so many blocks of so many words, a heading counting as one. A list must hold the first heading too.
OUTVOTED, LEAST_BLOCKS, LEAST_WORDS = 0.5, 3, 8


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    page_header: bool
    in_main: bool
    heading: bool
    keep: bool


def furniture_name(names: str) -> str:
    """The word of a class or id attribute that names furniture, or an empty one."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if not words or words[0] in MODIFIERS:
            continue
        if words[-1] in FURNITURE_WORDS:
            return words[-1]
        if words[0] in FURNITURE_WORDS and all(w in UI_WORDS or w in FURNITURE_WORDS or w.isdigit() for w in words[1:]):
            return words[0]
    return ""


def _role(name: str, attributes: str) -> tuple[int, bool, bool, bool]:
    """What an element's start tag speaks for: furniture (a kind below, or 0), a header, main text, the label."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    word = "" if name in ("html", "body") else furniture_name(f"{found.get('class', '')} {found.get('id', '')}")
    if hidden or (name in FURNITURE and name != "form") or role in FURNITURE_ROLES - {"form", "search"}:
        furniture = HARD
    elif word in LISTS:
        furniture = LIST
    else:
        furniture = LAYOUT if word or name == "form" or role in FURNITURE_ROLES else 0
    return furniture, name == "header", name in MAIN or role in MAIN, "data-keep" in found


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order: text without markup, references decoded, white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool, bool]] = []  # element, its furniture by number, header, main: own or of an ancestor
    kinds: list[int] = []  # of each furniture element
    inside: list[tuple[int, ...]] = []  # the furniture of each block
    text: list[str] = []
    linked: list[str] = []
    in_link = heading = keep = False
    link_depth = 0

    def end() -> None:
        nonlocal keep
        words = "".join(text).split()
        text.clear()
        if words:
            _, around, header, main = stack[-1] if stack else ("", (), False, False)
            inside.append(around)
            out.append(Block(" ".join(words), len(words), min(len(words), len("".join(linked).split())), bool(around), header and not main, main, heading, keep))
        linked.clear()

    def say(part: str) -> None:
        if part:
            part = html.unescape(part) if "&" in part else part
            text.append(part)
            if in_link:
                linked.append(part)

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else n if name in UNENDED else at
            continue
        if name == "br":
            say(" ")
        elif name == "a":
            if in_link:
                linked.append(" ")
            in_link, link_depth = not closing, len(stack)
        elif name not in INLINE:
            end()
            heading = name in HEADINGS and not closing
            keep = False
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                in_link = in_link and len(stack) >= link_depth
            elif name not in VOID:
                while stack and stack[-1][0] == "p":  # a paragraph ends where any other block begins
                    stack.pop()
                in_link = in_link and len(stack) >= link_depth
                furniture, header, main, keep = _role(name, attributes)
                _, around, h, a = stack[-1] if stack else ("", (), False, False)
                if main:  # what surrounds an article is its layout
                    around = tuple(k for k in around if kinds[k] != LAYOUT)
                if furniture and not (main and furniture == LAYOUT):
                    around = (*around, len(kinds))
                    kinds.append(furniture)
                stack.append((name, around, h or header, a or main))
    end()
    _outvote(out, inside, kinds)
    return out


def _outvote(found: list[Block], inside: list[tuple[int, ...]], kinds: list[int]) -> None:
    """Clears the furniture of blocks whose elements are furniture by name only and hold most of the page's text."""
    soft = [i for i, around in enumerate(inside) if not any(kinds[k] == HARD for k in around)]
    plain = lambda own: sum(found[i].words - found[i].linked for i in own)
    total = {LIST: plain(soft), LAYOUT: plain([i for i in soft if not any(kinds[k] == LIST for k in inside[i])])}
    first = next((i for i in soft if found[i].heading), None)
    held: dict[int, list[int]] = {}
    for i in soft:
        for k in inside[i]:
            held.setdefault(k, []).append(i)
    wrong = set()
    for k, own in held.items():
        sentences = sum(found[i].heading or found[i].words - found[i].linked >= LEAST_WORDS for i in own)
        if sentences >= LEAST_BLOCKS and plain(own) >= OUTVOTED * total[kinds[k]] and (kinds[k] == LAYOUT or first in own):
            wrong.add(k)
    for i in soft:
        found[i].furniture = any(k not in wrong for k in inside[i])


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words, b.furniture, b.page_header, b.in_main, b.heading) for b in found], np.float64).reshape(-1, 6)
    near = np.vstack([np.zeros((1, 2)), own[:, :2], np.zeros((1, 2))])
    return np.column_stack([own[:, :2], near[:-2], near[2:], own[:, 2:]])


def grown(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, limit, tree below or at it, tree above it), or a leaf's class."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, c = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        left = cut + 1.0
        right = len(y) - left
        a, b = c[cut], c[-1] - c[cut]
        impurity = 2 * a * (left - a) / left + 2 * b * (right - b) / right
        i = int(np.argmin(impurity))
        if best is None or impurity[i] < best[0] - 1e-12:
            best = (impurity[i], k, (v[cut[i]] + v[cut[i] + 1]) / 2)
    if best is None:
        return bool(2 * y.sum() >= len(y))
    _, k, limit = best
    low = x[:, k] <= limit
    return (k, float(limit), grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def tree():
    """The tree trained on the labelled table."""
    pages = [blocks(p) for p in PAGES]
    return grown(np.vstack([features(p) for p in pages]), np.array([b.keep for p in pages for b in p]))


def classified(x: np.ndarray) -> list[bool]:
    out = []
    for row in x:
        node = tree()
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        out.append(node)
    return out


def main_text(page: str | None) -> str:
    """The kept blocks in page order, a line each; empty if there are none."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, classified(features(found))) if keep) if found else ""


@F.pandas_udf(T.StringType())
def extracted(page: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in page], dtype=object)


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of whole pages in `out`; no shuffle, other columns stay."""
    return pages.withColumn(out, extracted(F.col(column)))


def op10_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page.

    Null and empty pages, and pages of furniture only, have an empty text; long pages are read whole; rows that repeat
    a page_id are treated one by one; further columns are left out; an empty table gives no rows.
    """
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: For the pages of the tables, whose main text is in paragraphs and a heading of the article element.
OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(
  regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
