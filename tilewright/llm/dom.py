"""A tolerant HTML reader: elements with their parents, and text in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements without content, elements whose content is not text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output "
    "progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)

#: Which open elements a start tag ends.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
SCOPES = frozenset("ul ol dl table select article section div body html".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
KEPT = frozenset(("class", "id", "role"))


def attributes(text: str) -> dict[str, str]:
    """Class, id and role of a start tag; of an attribute given twice the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        if (name := name.lower()) in KEPT:
            found.setdefault(name, "".join(values))
    return found


@dataclass
class Page:
    """Elements by number, in page order; text runs with the element and the block they belong to."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text

    def add(self, tag: str, parent: int, attributes: dict[str, str]) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.attributes.append(attributes)
        return len(self.tags) - 1


def parse(text: str) -> Page:
    """Read a page. Unclosed, crossed and cut-off tags are mended the way browsers mostly do."""
    page = Page()
    stack = [page.add("#root", -1, {})]
    block, at, n = 0, 0, len(text)

    def text_to(end: int) -> None:
        if end > at:
            page.runs.append((stack[-1], block, text[at:end]))

    def close(until: int) -> None:
        del stack[until:]

    while at < n:
        m = TAG.search(text, at)
        if m is None:
            text_to(n)
            break
        text_to(m.start())
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag = name.lower()
        if tag not in INLINE:
            block += 1
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = page.tags[stack[k]]
                if open_tag == tag:
                    close(k)
                    break
                if tag in INLINE and open_tag not in INLINE:
                    break
            continue
        if tag == "br":
            page.runs.append((stack[-1], block, " "))
        if tag not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = page.tags[stack[k]]
                if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                    close(k)
                    if open_tag != "p":
                        break
                elif open_tag in SCOPES:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        found = attributes(attrs) if "=" in attrs else {}
        element = page.add(tag, stack[-1], found)
        if tag in VOID:
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
                at = end.end() if end else n
            block += 1
            continue
        stack.append(element)
    return page


def tidy(text: str) -> str:
    """Decode character references; one space for each run of white space; trim."""
    return " ".join(html.unescape(text).split())
