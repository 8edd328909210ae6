"""Web pages to the facts of their element trees, one row a page.

Only what needs the tree is done here, in Arrow batches: texts of elements, of their
ancestors and of content roots, addresses, headings, metadata. What follows from them
is expressed over the columns (operators/page_postings.py).
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.markup import INLINE, attributes, parse
from ..session import small_batches, workers_import

# Elements that are removed first; content roots beside the body; what may hold a posting; headings within it.
NOISE = frozenset(("script", "style", "noscript", "svg", "footer", "nav"))
ROOT_TAGS, ROOT_CLASSES = frozenset(("main", "article")), frozenset(("job-description", "content"))
CONTAINERS = frozenset(("article", "li", "div", "section"))
TITLES_WITHIN = frozenset(("h1", "h2", "h3", "h4", "h5", "strong", "b"))
SUMMARISED = frozenset(("h1", "h2", "h3", "p", "li"))
# Lengths of a container's text and of an ancestor's, and how far up a link's text is sought.
CONTAINER_CHARS, SNIPPET_CHARS, SNIPPET_LEVELS = (6, 500), (40, 520), 6
#: Markup of the pages whose facts a worker holds at once; a larger page is held alone.
BATCH_BYTES = 1_000_000

_SPACE = re.compile(r"[ \t\n\f\r\xa0]+")
_LINE_END = re.compile(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_ASCII_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")

FACTS = """title string, og_title string, description string, summary_description string, base string,
    headings array<struct<tag string, text string, in_header boolean, in_job_header boolean, in_main boolean, in_article boolean>>,
    anchors array<struct<pos int, url string, text string, above array<string>>>,
    containers array<struct<pos int, url string, text string, heading string, link string, own string>>,
    roots array<string>, items array<string>"""


class _Texts:
    """A page's visible text in order: with its own line ends, and with white space squeezed and blocks apart."""

    def __init__(self):
        self.whole, self.whole_at, self.squeezed, self.at, self.gap = [], 0, [], 0, True

    def add(self, text: str) -> None:
        self.whole.append(text)
        self.whole_at += len(text)
        text = _SPACE.sub(" ", text)
        if self.gap and text.startswith(" "):
            text = text[1:]
        if text:
            self.squeezed.append(text)
            self.at += len(text)
            self.gap = text.endswith(" ")

    def apart(self) -> None:
        if not self.gap:
            self.squeezed.append(" ")
            self.at += 1
            self.gap = True

    def line_end(self) -> None:
        self.whole.append("\n")
        self.whole_at += 1
        self.apart()


def distinct_lines(text: str) -> str:
    """Lines with content, squeezed, each once."""
    lines = (_ASCII_SPACE.sub(" ", line).strip("".join(map(chr, range(33)))) for line in _LINE_END.split(text))
    return "\n".join(dict.fromkeys(line for line in lines if line))


def _address(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:  # an address that is none stays as it is
        return href.strip()


def facts(page: str, url: str) -> dict:
    """The facts of one page, as ``FACTS`` has them. Elements are told in page order, whatever their depth."""
    texts = _Texts()
    # Of each element: tag, attributes, its parent, where its text begins and ends in either form, texts of its own.
    nodes: list[list] = []
    todo: list = [(parse(page), -1)]
    while todo:
        item, above = todo.pop()
        if item is None:
            node = nodes[above]
            if node[0] not in INLINE:
                texts.apart()
            node[4], node[6] = texts.at, texts.whole_at
        elif isinstance(item, tuple):
            text = page[item[0] : item[1]]
            raw = above >= 0 and nodes[above][0] in ("textarea", "title")
            text = html.unescape(text) if "&" in text else text
            if raw and nodes[above][0] == "title":
                nodes[above][7].append(text)
            else:
                texts.add(text)
                if above >= 0 and len(nodes[above][7]) < 64:
                    nodes[above][7].append(text)
        elif item.tag not in NOISE:
            if item.tag not in INLINE:
                texts.apart()
            if item.tag == "br":
                texts.line_end()
            at = len(nodes)
            nodes.append([item.tag, attributes(html.unescape(item.attributes)) if item.attributes else {}, above, texts.at, texts.at, texts.whole_at, texts.whole_at, []])
            todo.append((None, at))
            todo.extend((c, at) for c in reversed(item.children))
    squeezed, whole = "".join(texts.squeezed), "".join(texts.whole)
    text_of = lambda n: squeezed[n[3] : n[4]].strip()

    # The base of addresses, and the elements that each stands in.
    base = next((n[1]["href"] for n in nodes if n[0] == "base" and n[1].get("href")), "")
    base = _address(url, base) if base else url
    within = [(False,) * 4] * len(nodes)
    first_link, first_heading, own_link = {}, {}, {}
    for i, n in enumerate(nodes):
        up = within[n[2]] if n[2] >= 0 else (False,) * 4
        within[i] = up[0] or n[0] == "header", up[1] or n[1].get("id") == "job-header", up[2] or n[0] == "main", up[3] or n[0] == "article"
    # First link and heading below each element: from the last element up, so that earlier ones win.
    for i in range(len(nodes) - 1, -1, -1):
        n, up = nodes[i], nodes[i][2]
        if n[0] == "a" and "href" in n[1]:
            own_link[i] = _address(base, n[1]["href"]) or n[1]["href"]
        if up >= 0:
            link = i if i in own_link else first_link.get(i)
            heading = i if n[0] in TITLES_WITHIN else first_heading.get(i)
            if link is not None:
                first_link[up] = link
            if heading is not None:
                first_heading[up] = heading

    anchors, containers, headings, items, roots = [], [], [], [], {}
    title = og = told = summary = None
    for i, n in enumerate(nodes):
        tag = n[0]
        if i in own_link:
            above, at = [], i
            for _ in range(SNIPPET_LEVELS):
                if at < 0 or nodes[at][4] - nodes[at][3] > SNIPPET_CHARS[1] + 2:
                    break
                text = text_of(nodes[at])
                if SNIPPET_CHARS[0] <= len(text) <= SNIPPET_CHARS[1]:
                    above.append(text)
                at = nodes[at][2]
            anchors.append({"pos": i, "url": own_link[i], "text": text_of(n), "above": above})
        if tag in CONTAINERS and n[4] - n[3] <= CONTAINER_CHARS[1] + 2 and CONTAINER_CHARS[0] <= len(text := text_of(n)) <= CONTAINER_CHARS[1]:
            link, heading = first_link.get(i), first_heading.get(i)
            containers.append({"pos": i, "url": own_link.get(link, ""), "text": text, "heading": text_of(nodes[heading]) if heading is not None else "", "link": text_of(nodes[link]) if link is not None else "", "own": _SPACE.sub(" ", " ".join(n[7])).strip()})
        if tag in ("h1", "h2", "h3"):
            headings.append({"tag": tag, "text": text_of(n), "in_header": within[i][0], "in_job_header": within[i][1], "in_main": within[i][2], "in_article": within[i][3]})
        if tag in SUMMARISED:
            items.append(text_of(n))
        if tag == "title" and title is None:
            title = _SPACE.sub(" ", "".join(n[7])).strip()
        if tag == "meta":
            name, prop = n[1].get("name", "").lower(), n[1].get("property", "").lower()
            if og is None and (prop == "og:title" or name == "twitter:title"):
                og = _SPACE.sub(" ", n[1].get("content", "")).strip()
            if told is None and (prop == "og:description" or name in ("description", "twitter:description")):
                told = _SPACE.sub(" ", n[1].get("content", "")).strip()
            if summary is None and (prop == "og:description" or name == "description"):
                summary = _SPACE.sub(" ", n[1].get("content", "")).strip()
        if tag in ROOT_TAGS or not ROOT_CLASSES.isdisjoint(n[1].get("class", "").lower().split()):
            roots.setdefault((n[5], n[6]), None)
    body = next((n for n in nodes if n[0] == "body"), nodes[0])
    roots = dict.fromkeys([(body[5], body[6]), *roots])
    return {"title": title or "", "og_title": og or "", "description": told or "", "summary_description": summary or "", "base": url, "headings": headings, "anchors": anchors, "containers": containers, "roots": [distinct_lines(whole[s:e]) for s, e in roots], "items": items}


def _cuts(batches):
    """Batches of at most ``BATCH_BYTES`` of markup, or of one page: its facts are Python objects of several times its size."""
    for rows in batches:
        sizes = pc.fill_null(pc.binary_length(rows.column("p_html")), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > BATCH_BYTES:
                yield rows.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < rows.num_rows:
            yield rows.slice(begin)


def _facts(batches):
    kinds = None
    for rows in _cuts(batches):
        if kinds is None:
            kinds = pa.schema([(n, t) for n, t in _ARROW])
        found = [facts(page or "", (url or "").strip()) for page, url in zip(rows.column("p_html").to_pylist(), rows.column("p_url").to_pylist())]
        out = pa.Table.from_pylist(found, schema=kinds)
        columns = [*rows.columns[: rows.num_columns - 2], *(c.combine_chunks() for c in out.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names[:-2], *out.schema.names])


_TEXTS = pa.list_(pa.string())
_ARROW = (
    ("title", pa.string()), ("og_title", pa.string()), ("description", pa.string()), ("summary_description", pa.string()), ("base", pa.string()),
    ("headings", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string()), *((w, pa.bool_()) for w in ("in_header", "in_job_header", "in_main", "in_article"))]))),
    ("anchors", pa.list_(pa.struct([("pos", pa.int32()), ("url", pa.string()), ("text", pa.string()), ("above", _TEXTS)]))),
    ("containers", pa.list_(pa.struct([("pos", pa.int32()), *((w, pa.string()) for w in ("url", "text", "heading", "link", "own"))]))),
    ("roots", _TEXTS), ("items", _TEXTS),
)


def page_facts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key`` and the facts of every page; a null page or address counts as empty. Repeated pages give repeated rows."""
    small_batches(workers_import(pages.sparkSession))
    rows = pages.select(key, F.col(url).cast("string").alias("p_url"), F.col(html).cast("string").alias("p_html"))
    return rows.mapInArrow(_facts, f"{key} {dict(rows.dtypes)[key]}, {FACTS}")
