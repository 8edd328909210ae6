"""Markup to a tree, in one pass over the text whatever its errors."""

from __future__ import annotations

import re

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_P = (("p",), ("article", "main", "div", "section", "td", "th", "body", "button"))
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)),
}


class Node:
    __slots__ = ("tag", "attributes", "start", "end", "children")

    def __init__(self, tag, attributes, start):
        self.tag, self.attributes, self.start, self.end, self.children = tag, attributes, start, None, []


def attributes(text: str) -> dict[str, str]:
    """Names in lower case; of a repeated name the first value."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value)
    return out


def parse(page: str) -> Node:
    """The element tree; children are nodes or (start, end) of text. Errors are repaired as browsers do, roughly.

    A tag whose quotes never close ends at the next ``>``, as do all after it; one without
    any is text. Open elements are found by the depths kept for each name, so neither
    unclosed tags nor unmatched end tags make the time grow faster than the page.
    """
    root = Node("#page", "", 0)
    stack, depths, at, pos, plain = [root], {}, 0, 0, False
    ends: dict[str, re.Pattern] = {}

    def close(depth, end):
        while len(stack) > depth:
            node = stack.pop()
            node.end = end
            if stack:
                depths[node.tag].pop()

    def deepest(tags):
        return max((d[-1] for t in tags if (d := depths.get(t))), default=0)

    def open_depth(tags, barrier):
        depth = deepest(tags)
        return depth if depth > deepest(barrier) else 0

    while True:
        begin = page.find("<", pos)
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            stop = len(page) if stop < 0 else stop + 3
        elif page.startswith("<![CDATA[", begin):
            stop = page.find("]]>", begin)
            stop = len(page) if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?"), begin):
            stop = page.find(">", begin) + 1
            if not stop:
                break
        elif (name := _NAME.match(page, begin)) is None:
            pos = begin + 1
            continue
        else:
            rest = None if plain else _REST.match(page, name.end())
            if rest is None:
                plain = True
                stop = page.find(">", name.end()) + 1
                if not stop:
                    break
                said = page[name.end() : stop - 1]
            else:
                stop, said = rest.end(), rest[1]
            if begin > at:
                stack[-1].children.append((at, begin))
            at = pos = stop
            tag = name[2].lower()
            if name[1]:
                if depth := deepest((tag,)):
                    close(depth, stop)
                continue
            if tag in _CLOSES_P and (depth := open_depth(*_P)):
                close(depth, begin)
            if tag in _SIBLINGS and (depth := open_depth(*_SIBLINGS[tag])):
                close(depth, begin)
            node = Node(tag, said, begin)
            stack[-1].children.append(node)
            if tag in VOID:
                node.end = stop
                continue
            depths.setdefault(tag, []).append(len(stack))
            stack.append(node)
            if tag in RAW:
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
                found = ends[tag].search(page, pos)
                at = pos = found.start() if found else len(page)
                if at > stop:
                    node.children.append((stop, at))
            continue
        if begin > at:
            stack[-1].children.append((at, begin))
        at = pos = stop
    if at < len(page):
        stack[-1].children.append((at, len(page)))
    close(0, len(page))
    return root
