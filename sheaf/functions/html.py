"""A small HTML reader for Python workers: find elements, take their visible text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

# HTML element classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head title".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tr ul".split()
)

_STEP = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[^\]]+)\]")
_ATTR = re.compile(r"\s*([\w-]+)\s*(?:([*^$~]?=)\s*(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"]+))\s*(i)?\s*)?$")


class Element:
    __slots__ = ("tag", "attrs", "nodes")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.nodes = tag, attrs, []

    def walk(self) -> Iterator["Element"]:
        stack = [self]
        while stack:
            item = stack.pop()
            yield item
            stack.extend(n for n in reversed(item.nodes) if isinstance(n, Element))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._close_back_to("p", stop=_BLOCK - {"p"})
        if tag == "li":
            self._close_back_to("li", stop={"ul", "ol"})
        item = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].nodes.append(item)
        if tag not in _VOID:
            self.open.append(item)

    def handle_endtag(self, tag):
        self._close_back_to(tag, stop=())

    def handle_data(self, data):
        self.open[-1].nodes.append(data)

    def _close_back_to(self, tag, stop):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if self.open[at].tag in stop:
                return


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _attribute_test(body: str):
    name, op, single, double, bare, fold = _ATTR.match(body).groups()
    want = next((v for v in (single, double, bare) if v is not None), "")
    want = want.lower() if fold else want

    def test(e: Element) -> bool:
        if name not in e.attrs:
            return False
        have = e.attrs[name].lower() if fold else e.attrs[name]
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op is None:
            return True
        return bool(want) and {"*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want)}[op]

    return test


@lru_cache(maxsize=4096)
def compile_selector(selector: str):
    """A test for one simple selector: tag, #id, .class and [attribute] parts; raises on anything else."""
    tests, at = [], 0
    selector = selector.strip()
    while at < len(selector):
        m = _STEP.match(selector, at)
        if m is None or (m["attr"] and not _ATTR.match(m["attr"])):
            raise ValueError(f"selector {selector!r} is not understood from {selector[at:]!r} on")
        at = m.end()
        if m["tag"] and m["tag"] != "*":
            tests.append(lambda e, t=m["tag"].lower(): e.tag == t)
        elif m["id"]:
            tests.append(lambda e, t=m["id"]: e.attrs.get("id") == t)
        elif m["cls"]:
            tests.append(lambda e, t=m["cls"]: t in e.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(_attribute_test(m["attr"]))
    if not tests and selector != "*":
        raise ValueError("an empty selector")
    return lambda e: bool(e.tag) and all(t(e) for t in tests)


def select(root: Element, selector: str) -> Iterator[Element]:
    test = compile_selector(selector)
    return (e for e in root.walk() if e is not root and test(e))


def visible_text(element: Element) -> str:
    """Text as a reader sees it: white space folded, blocks on their own lines."""
    out: list[str] = []
    breaks = 0  # line breaks owed before the next text

    def add(text: str) -> None:
        nonlocal breaks
        if breaks:
            while out and out[-1] == " ":
                out.pop()
            if out:
                out[-1] = out[-1].rstrip(" ")
                out.append("\n" * breaks)
            breaks = 0
        out.append(text)

    stack: list[tuple[Element | str, bool]] = [(element, False)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            text = re.sub(r"[ \t\n\r\f]+", " ", node)
            if text.startswith(" ") and (breaks or not out or out[-1][-1:] in (" ", "\n")):
                text = text[1:]
            if text:
                add(text)
            continue
        if node.tag in _HIDDEN and node is not element:
            continue
        if node.tag == "br":
            add("\n")
            continue
        if node.tag in _BLOCK:
            breaks = max(breaks, 2 if node.tag == "p" else 1)
        if not leaving:
            stack.append((node, True))
            stack.extend((n, False) for n in reversed(node.nodes))
    return "".join(out).strip(" ")
