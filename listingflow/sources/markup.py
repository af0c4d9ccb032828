"""Reading elements out of HTML text inside a task.

One pass over the tags gives an index of a page: elements in document order
with their extent, by tag, class and id. Selectors look candidates up there:
tag, ``#id``, ``.class``, attribute tests, ``:first-child`` / ``:last-child``,
descendants by space and alternatives by comma.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import zip_longest

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = {name: re.compile(f"</{name}", re.I) for name in ("script", "style")}
_BLOCKS = ("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article form blockquote pre hr "
           "header footer nav").split()
# An opening tag ends these open elements, unless one of the fences lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
    **dict.fromkeys(_BLOCKS, ({"p"}, {"td", "th", "div", "li", "dd", "section", "article",
                                      "body"})),
}
# What is ended, and where the way up to it stops.
CLOSES = {name: (frozenset(ends), frozenset(ends | fences)) for name, (ends, fences) in _ENDS.items()}

# A tag, or something to pass over.
_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>"""
    r"""|!--.*?(?:-->|\Z)|!\[CDATA\[.*?\]\]>|[!?][^>]*>)""", re.S)
_RAW_START = re.compile("<(?:" + "|".join(RAW_TEXT) + ")", re.I)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


_NONE: dict[str, str] = {}

# Slots of an element record.
TAG, ATTRS, PARENT, END, FIRST, LAST, CHILD_NO, CHILDREN, LAST_CHILD, CLASSES = range(10)


def _pieces(html: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """(text before, slash, name, attributes) of each tag, without a name for what is passed over and the end.

    What stands in a script or style is left out.
    """
    if _RAW_START.search(html):
        return _pieces_around_raw(html)
    parts = iter(_TAG.split(html))
    return zip_longest(parts, parts, parts, parts)


def _pieces_around_raw(html: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    at = 0
    tags = _TAG.finditer(html)
    while (match := next(tags, None)) is not None:
        slash, name, raw = match.groups()
        yield html[at:match.start()], slash, name, raw
        at = match.end()
        if name and not slash and name.lower() in RAW_TEXT:
            end = RAW_TEXT[name.lower()].search(html, at)
            at = end.start() if end else len(html)
            tags = _TAG.finditer(html, at)
    yield html[at:], None, None, None


class Page:
    """``nodes[i]`` spans elements ``i`` to END and texts FIRST to LAST (exclusive)."""

    __slots__ = ("nodes", "texts", "by_tag", "by_class", "by_id", "_found")

    def __init__(self, html: str | None):
        self.nodes = [["#page", {}, -1, 0, 0, 0, 0, 0, -1, ()]]
        self.texts: list[str] = []
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}
        self.by_id: dict[str, list[int]] = {}
        self._found: dict[str, list[int]] = {}
        self._read(html or "")

    def _read(self, html: str) -> None:
        nodes, texts, by_tag = self.nodes, self.texts, self.by_tag
        numbers, names = [0], ["#page"]  # of the open elements

        def close(depth: int) -> None:
            for number in numbers[depth:]:
                node = nodes[number]
                node[END], node[LAST] = len(nodes), len(texts)
            del numbers[depth:], names[depth:]

        for text, slash, name, raw in _pieces(html):
            if text:
                texts.append(unescape(text) if "&" in text else text)
            if name is None:
                continue
            name = name.lower()
            if slash:
                if names[-1] == name:
                    names.pop()
                    node = nodes[numbers.pop()]
                    node[END], node[LAST] = len(nodes), len(texts)
                elif name in names:
                    close(len(names) - 1 - names[::-1].index(name))
                continue
            rule = CLOSES.get(name)
            if rule and not rule[0].isdisjoint(names):
                closes, stops = rule
                depth = len(names) - 1
                while depth and names[depth] not in stops:
                    depth -= 1
                if depth and names[depth] in closes:
                    close(depth)
            parent, number, seen = numbers[-1], len(nodes), len(texts)
            above = nodes[parent]
            if raw:
                attrs = self._attributes(raw, number)
                classes = attrs["class"].split() if "class" in attrs else ()
            else:
                attrs, classes = _NONE, ()
            nodes.append([name, attrs, parent, number + 1, seen, seen, above[CHILDREN], 0, -1, classes])
            above[CHILDREN] += 1
            above[LAST_CHILD] = number
            if name in by_tag:
                by_tag[name].append(number)
            else:
                by_tag[name] = [number]
            if name not in VOID and not (raw and raw[-1] == "/"):
                numbers.append(number)
                names.append(name)
        close(0)

    @staticmethod
    def _text(raw: str) -> str:
        return unescape(raw) if "&" in raw else raw

    def _attributes(self, raw: str, number: int) -> dict[str, str]:
        attrs: dict[str, str] = {}
        for key, a, b, c in _ATTR.findall(raw):
            attrs.setdefault(key.lower(), self._text(a or b or c))
        for cls in set(attrs["class"].split()) if "class" in attrs else ():
            self.by_class.setdefault(cls, []).append(number)
        if "id" in attrs:
            self.by_id.setdefault(attrs["id"], []).append(number)
        return attrs

    def tag(self, node: int) -> str:
        return self.nodes[node][TAG]

    def attribute(self, node: int, name: str) -> str | None:
        return self.nodes[node][ATTRS].get(name)

    def text(self, node: int) -> str:
        record = self.nodes[node]
        return "".join(self.texts[record[FIRST]:record[LAST]])

    def following(self, node: int) -> int | None:
        """The next element below the same parent."""
        after = self.nodes[node][END]
        same = after < len(self.nodes) and self.nodes[after][PARENT] == self.nodes[node][PARENT]
        return after if same else None

    def select(self, selector: str, below: int = 0) -> list[int]:
        """Elements below ``below`` that fit, in document order."""
        found = self._found.get(selector)
        if found is None:
            found = self._found[selector] = self._search(selector)
        if not below or not found:
            return found
        first = bisect_left(found, below + 1)
        return found[first:bisect_left(found, self.nodes[below][END], first)]

    def _search(self, selector: str) -> list[int]:
        """All elements that fit; what stands above them may stand anywhere."""
        found: list[int] = []
        chains = _compile(selector)
        for chain in chains:
            fit = self._fitting(*chain[0])
            for compound in chain[1:]:
                fit = self._inside(self._fitting(*compound), fit)
            found.extend(fit)
        return sorted(set(found)) if len(chains) > 1 else found

    def _fitting(self, kind: str | None, key: str | None, tests) -> list[int]:
        known = range(1, len(self.nodes)) if kind is None else getattr(self, kind).get(key, ())
        return [n for n in known if all(t(self, n) for t in tests)] if tests else list(known)

    def _inside(self, nodes: list[int], above: list[int]) -> list[int]:
        """Which of ``nodes`` lie within one of ``above``; both in document order."""
        found: list[int] = []
        end = 0
        for a in above:
            if a >= end:  # else it lies within the last one
                end = self.nodes[a][END]
                first = bisect_left(nodes, a + 1)
                found += nodes[first:bisect_left(nodes, end, first)]
        return found

    def _is(self, node: int, kind: str | None, key: str | None) -> bool:
        record = self.nodes[node]
        if kind == "by_tag":
            return record[TAG] == key
        if kind == "by_class":
            return key in record[CLASSES]
        if kind == "by_id":
            return record[ATTRS].get("id") == key
        return True


_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*)|\*|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|:(?P<pos>first|last)-child"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)["']?(?P<val>[^"'\]]*)["']?\s*(?P<fold>i)?)?\]""")
_TESTS = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith}


def _test(part: dict):
    if part["pos"] == "first":
        return lambda page, n: page.nodes[n][CHILD_NO] == 0
    if part["pos"] == "last":
        return lambda page, n: page.nodes[page.nodes[n][PARENT]][LAST_CHILD] == n
    name, fold = part["attr"], part["fold"]
    if not part["op"]:
        return lambda page, n: page.attribute(n, name) is not None
    test, value = _TESTS[part["op"]], part["val"].lower() if fold else part["val"]

    def check(page, n):
        have = page.attribute(n, name)
        return have is not None and test(have.lower() if fold else have, value)
    return check


def _compound(text: str, selector: str):
    """(index, key, tests): the most telling key to look up, the rest as tests."""
    keys, tests, at = [], [], 0
    while at < len(text):
        found = _SIMPLE.match(text, at)
        if not found:
            raise ValueError(f"cannot read selector {selector!r}")
        part, at = found.groupdict(), found.end()
        for rank, (group, kind) in enumerate((("id", "by_id"), ("cls", "by_class"),
                                              ("tag", "by_tag"))):
            if part[group]:
                key = part[group].lower() if group == "tag" else part[group]
                keys.append((rank, kind, key))
        if part["pos"] or part["attr"]:
            tests.append(_test(part))
    keys.sort()
    for _, kind, key in keys[1:]:
        tests.append(lambda page, n, kind=kind, key=key: page._is(n, kind, key))
    return (keys[0][1], keys[0][2], tests) if keys else (None, None, tests)


@lru_cache(maxsize=4096)
def _compile(selector: str):
    """Alternatives, each a list of compounds from the outermost in."""
    alternatives = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        compounds = re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", alternative.strip())
        if compounds:
            alternatives.append([_compound(c, selector) for c in compounds])
    return alternatives
