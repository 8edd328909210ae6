"""Main text of web pages, with site templates removed.

Each page is parsed into a tree. Container elements are hashed as subtrees, and
Spark counts per host on how many pages of different text each subtree stands;
those that recur are the site's template and are deleted. Inside an article,
pages with the same first block count once, as edited copies share their parts. What is left
of the article, without elements that say by tag, role or class that they are
not part of it, is the text.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.markup import INLINE as _INLINE, RAW as _RAW, Node, attributes, parse
from .common import prepare, written

#: A subtree is a template if it stands on this many pages of a host, however large: templates rotate.
MIN_PAGES = 3

_DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg math button select input textarea object embed canvas dialog menu audio video map title".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent notice notices gdpr"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus discussion newsletter subscribe"
    " signup login share sharing social related recommended popup modal overlay pagination pager toolbar skip widget".split()
)
_ROOTS = frozenset(("article", "main", "body", "html"))
_CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center nav header footer aside form".split())
#: Words of a name that say nothing by themselves, so that "related-posts" is told by its first word and "related-work" is not.
_NEUTRAL_WORDS = frozenset("a area article articles bar block body bottom box boxes btn button center col column container content element footer fixed global group header holder inner item items js layer left link links list main message module number outer page panel pane posts primary region right root row secondary section site slot small stories sticky top unit view web wrap wrapper".split())
#: Words that name parts of articles as well: they count only where there is no prose.
_WEAK_WORDS = frozenset("related recommended social share sharing promo promotion banner notice notices discussion reply replies overlay skip subscribe login signup search".split())
#: Words of an element, outside its links, that are prose.
PROSE_WORDS = 25


def _names(found: dict[str, str]) -> list[list[str]]:
    """The class names and the id, each as its words."""
    return [[w for w in re.split(r"[^a-z0-9]+", name) if w] for name in [*found.get("class", "").lower().split(), found.get("id", "").lower()]]


def _measures(page: str, root: Node) -> tuple[dict[int, int], set[int]]:
    """Of all elements by their ``id``: the words outside links and dropped elements, and which hold a main heading outside menus and forms; children first, each once."""
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    words, titled = {}, set()
    for node in reversed(order):
        n = 0
        for c in node.children:
            if isinstance(c, tuple):
                n += len(page[c[0] : c[1]].split())
            else:
                n += 0 if c.tag == "a" or c.tag in _DROPPED else words[id(c)]
                if id(c) in titled and c.tag not in ("nav", "form", "ul", "ol"):
                    titled.add(id(node))
        words[id(node)] = n
        if node.tag in ("h1", "h2"):
            titled.add(id(node))
    return words, titled


def _is_dropped(measures, node: Node, inside: bool = False) -> bool:
    """Whether an element says that it is not part of the article; ``inside``: it stands in the article itself, whose header is its own."""
    words_of, titled = measures
    if node.tag in _DROPPED:
        return not (inside and node.tag == "header" and id(node) in titled)
    if not node.attributes or node.tag in ("html", "body"):
        return False
    found = {k: v.lower() for k, v in attributes(node.attributes).items()}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _DROPPED_ROLES:
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if node.tag == "main":
        return False
    told = set()
    for words in _names(found):
        # A name tells if all of its words do, or say nothing.
        if all(w in _DROPPED_WORDS or w in _NEUTRAL_WORDS or w.isdigit() for w in words):
            told |= {w for w in words if w in _DROPPED_WORDS}
    if inside and told == {"header"} and id(node) in titled:
        return False
    return bool(told - _WEAK_WORDS) or bool(told) and words_of[id(node)] < PROSE_WORDS


def subtree_hashes(page: str, root: Node) -> dict[int, int]:
    """Hashes of all elements by their ``id``, children first: each holds its own source and its children's hashes, so every character is read once."""
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    digests: dict[int, bytes] = {}
    for node in reversed(order):
        h, at = hashlib.blake2b(digest_size=8), node.start
        for c in node.children:
            if isinstance(c, Node):
                h.update(page[at : c.start].encode("utf-8", "surrogatepass") + digests[id(c)])
                at = c.end
        h.update(page[at : node.end].encode("utf-8", "surrogatepass"))
        digests[id(node)] = h.digest()
    return {k: int.from_bytes(v, "little", signed=True) for k, v in digests.items()}


def subtrees(page: str, root: Node) -> dict[int, bool]:
    """Hashes of the container elements that a template may consist of, not those that hold the article; whether they stand in an article."""
    nodes, above, holds, inside = [root], [-1], set(), [False]
    at = 0
    while at < len(nodes):
        for c in nodes[at].children:
            if isinstance(c, Node) and c.tag not in _INLINE and c.tag not in _RAW and c.tag != "head":
                nodes.append(c)
                above.append(at)
                inside.append(inside[at] or nodes[at].tag == "article")
        if nodes[at].tag in _ROOTS:
            up = at
            while up >= 0 and up not in holds:
                holds.add(up)
                up = above[up]
        at += 1
    found: dict[int, bool] = {}
    hashes = subtree_hashes(page, root)
    for i, n in enumerate(nodes):
        if n.tag in _CONTAINERS and i not in holds:
            h = hashes[id(n)]
            found[h] = found.get(h, False) or inside[i]
    return found


def main_text(page: str, root: Node, templates: set[int] = frozenset()) -> str:
    """The blocks of the article with the most text, or of the main element or body where there is none."""
    articles, mains, bodies = [], [], []
    measures = _measures(page, root)
    stack = [root]
    while stack:
        node = stack.pop()
        if node is not root and _is_dropped(measures, node):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or 'role="main"' in node.attributes:
            mains.append(node)
        if node.tag == "body":
            bodies.append(node)
        stack.extend(c for c in node.children[::-1] if isinstance(c, Node))
    blocks, words = [], []

    def end_block():
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append(text)
            words.clear()

    hashes = subtree_hashes(page, root) if templates else {}
    # Of several articles the one with the most words, the first of equals; others are teasers or comments.
    todo: list = [max(articles, key=lambda n: measures[0][id(n)])] if articles else list((mains[:1] or bodies[:1] or [root])[::-1])
    first = set(map(id, todo))
    while todo:
        item = todo.pop()
        if item is None:
            end_block()
        elif isinstance(item, tuple):
            text = page[item[0] : item[1]]
            words.append(html.unescape(text) if "&" in text else text)
        else:
            if id(item) not in first and item is not root:
                if (item.tag == "article" and articles) or _is_dropped(measures, item, bool(articles)) or (templates and item.tag in _CONTAINERS and hashes[id(item)] in templates):
                    continue
            if item.tag in _RAW:
                continue
            if item.tag == "br":
                words.append(" ")
            elif item.tag in _INLINE:
                todo.extend(item.children[::-1])
            else:
                end_block()
                todo.append(None)
                todo.extend(item.children[::-1])
    end_block()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _page_subtrees(parts):
    for rows in parts:
        out = []
        for page_id, url, page in zip(*(c.to_pylist() for c in rows.columns)):
            page = page or ""
            root = parse(page)
            text = main_text(page, root)
            whole, head = (int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in (text, text.partition("\n")[0]))
            host = host_of(url)
            out.extend((page_id, host, h, head if inside else whole) for h, inside in subtrees(page, root).items())
        if out:
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["page_id", "host", "subtree", "content"])


def _extract(parts):
    for rows in parts:
        texts = []
        for page, templates in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()):
            page = page or ""
            texts.append(main_text(page, parse(page), frozenset(templates or ())))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def site_templates(seen: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) that stand on some pages of different text of their host."""
    return seen.select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "subtree")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: ``page_id``, ``url``, ``text``, ``n_chars``.

    Null html gives an empty text, a null url counts as one more host; repeated
    rows and pages of equal text count once as evidence of a template, so that
    copies of an article never look like one; pages that share an id share their
    deletions; other columns are not read; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    seen = written(pages.mapInArrow(_page_subtrees, "page_id long, host string, subtree long, content long"), "html-subtrees")
    templates = site_templates(seen, min_pages)
    deleted = seen.join(templates, ["host", "subtree"]).groupBy("page_id").agg(F.collect_set("subtree").alias("deleted"))
    texts = pages.join(deleted, "page_id", "left").mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
