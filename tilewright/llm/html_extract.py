"""Main text of pages by site style trees.

The pages of a host are merged into one tree: an element is its path of tags and classes. For
every element the tree holds how its style (the sequence of its children) and its content
(its own text) are spread over the host's pages, and how much of the pages' prose lies at its
place. An element's presentation matters when its styles differ between pages: the entropy of its
styles in units of log(pages). Its content matters when pages do not share it: content found in k
of m pages has the importance 1 - log(k) / log(m + 2), so that few pages never say much.
Importance is carried up from children to parents, and a branch without any important element
is removed from each page. Prose (a paragraph, heading, list, quotation, or a table of
an article) is judged by its whole text, headings inside an article not at all.

One rule holds for hosts of every size:

* Elements that stand for menus, page headers, footers, side columns, notices, adverts, forms,
  scripts and comments by their tag or role go; those that do so by a class or id go unless they
  hold most of the page.
* The article is what the page marks as one, unless more prose lies outside of it; without a mark it is
  the innermost element that holds four fifths of the page's own prose, if prose usually lies there on this
  host. What is outside the article goes.
* Inside the article a text that most pages share at that place goes if it is short and most of the
  article stays. Elsewhere importances decide.
* Nothing is removed for being shared if no other text than headings would be left.

Statistics are counts per host, element and value, added up inside the tasks before they are
shuffled; a host with a third of all pages costs one row per element, value and task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, released, whole_text
from tilewright.llm.dom import INLINE, Page, parse, tidy
from tilewright.session import write_table

#: What marks an element as no part of an article.
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg math object canvas audio video "
    "button select textarea input dialog menu".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices alert popup "
    "modal newsletter subscribe signup login share sharing social related recommended comment comments disqus reply "
    "replies respond widget toolbar pagination pager".split()
)
#: Words of a class or id that turn its other words into something the element has or belongs to.
STATE_WORDS = frozenset("has have no with without is not".split())
HEAD_NAMES = frozenset("header masthead banner".split())
CONTENT_NAMES = frozenset("article post entry content story main title".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Prose is judged by its own text; prose inside prose stays or goes with it. Tables are prose inside an article only.
TABLE_TAGS = frozenset("table tbody thead tr td th".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption hr".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.2  # an element below this has no importance
    damping: float = 0.9  # how far children speak for their parent
    smoothing: int = 2  # pages that are added to a host's when shared content is weighed
    short: int = 120  # code points of a text that may go from an article
    most: float = 0.8  # share of a page's prose that an article holds
    usual: float = 0.3  # mean share of prose at its place on the host


def noise_words(page: Page, k: int) -> set[str]:
    """Noise words of an element's class and id, each name of them read by itself."""
    a, out = page.attributes[k], set()
    for name in f"{a.get('class') or ''} {a.get('id') or ''}".split():
        words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if STATE_WORDS.isdisjoint(words):
            found = NOISE_NAMES.intersection(words)
            out |= found if CONTENT_NAMES.isdisjoint(words) else found - HEAD_NAMES
    return out


def paths(page: Page) -> list[int]:
    """Signed 64-bit hash of each element's path of tags and classes."""
    out: list[int] = []
    for tag, parent, a in zip(page.tags, page.parents, page.attributes):
        above = out[parent] if parent >= 0 else 0
        code = xxhash.xxh3_64_intdigest(f"{above} {tag} {' '.join(sorted((a.get('class') or '').split()))}".encode())
        out.append(code - (1 << 64) if code >= 1 << 63 else code)
    return out


def places(page: Page) -> list[int]:
    """Hash of each element's path of tags, with its number among the siblings of that tag."""
    out: list[int] = []
    seen: dict[tuple[int, str], int] = {}
    for tag, parent in zip(page.tags, page.parents):
        above = out[parent] if parent >= 0 else 0
        n = seen[parent, tag] = seen.get((parent, tag), 0) + 1
        out.append(signed(f"place {above} {tag} {n}"))
    return out


def signed(text: str) -> int:
    code = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return code - (1 << 64) if code >= 1 << 63 else code


def owners(page: Page) -> list[int]:
    """For each element the nearest one around it that is not inline, which its text belongs to."""
    out: list[int] = []
    for k, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        out.append(out[parent] if tag in INLINE and parent >= 0 else k)
    return out


def inside_article(page: Page) -> list[bool]:
    """Whether each element is or lies in an article."""
    out: list[bool] = []
    for tag, parent in zip(page.tags, page.parents):
        out.append(tag in ARTICLE_TAGS or (parent >= 0 and out[parent]))
    return out


def units(page: Page, inside: list[bool]) -> list[int]:
    """For each element the outermost prose element it is part of, or -1; other blocks begin anew."""
    out: list[int] = []
    for k, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        above = out[parent] if parent >= 0 else -1
        if tag in INLINE:
            out.append(above)
        elif tag in PROSE_TAGS and (inside[k] or tag not in TABLE_TAGS):
            out.append(above if above >= 0 else k)
        else:
            out.append(-1)
    return out


def unit_values(page: Page, unit: list[int]) -> dict[int, int]:
    """Value of the whole text of each unit that has one."""
    texts: dict[int, list[str]] = {}
    for k, block, text in page.runs:
        if unit[k] >= 0 and text and not text.isspace():
            texts.setdefault(unit[k], []).append(text)
    return {k: signed(tidy("\n".join(rows))) for k, rows in texts.items()}


def unit_size(page: Page, unit: list[int], of: int) -> int:
    """Code points of the text of a unit."""
    return sum(len(text.strip()) for k, _, text in page.runs if unit[k] == of)


def unit_key(path: int, value: int) -> int:
    """One number for a text at a path."""
    return signed(f"{path} {value}")


def page_values(page: Page) -> Iterator[tuple[int, int, int]]:
    """(element path, kind, value): its style as kind 0, its content as kind 1, once per page and path.

    Each text of a unit is kind 2, once per page, path and text. The share of the page's prose
    in the branch of an element, in hundredths, is kind 3, at its place.
    """
    path, owner = paths(page), owners(page)
    children: dict[int, list[str]] = {}
    content: dict[int, list[str]] = {}
    for k in range(len(path)):
        if owner[k] != k:
            continue
        children.setdefault(path[k], [])
        if page.parents[k] >= 0:
            row = children[path[owner[page.parents[k]]]]
            if not row or row[-1] != page.tags[k]:  # a run of equal tags is one
                row.append(page.tags[k])
    for k, _, text in page.runs:
        if text and not text.isspace():
            content.setdefault(path[owner[k]], []).append(text)
    for p, row in children.items():
        yield p, 0, signed(" ".join(row))
    for p, texts in content.items():
        yield p, 1, signed("\n".join(texts))
    held = unit_values(page, units(page, inside_article(page)))
    yield from {(path[k], 2, value) for k, value in held.items()}
    mass = prose(page, removed(page), set())
    for k, place in enumerate(places(page)):
        if mass[0] and 100 * mass[k] >= mass[0] and page.tags[k] not in PROSE_TAGS | INLINE:
            yield place, 3, 100 * mass[k] // mass[0]


def importance(page: Page, tree: dict[int, tuple[float, float]], s: Settings) -> list[float]:
    """Greatest importance in the branch of each element; unknown elements count fully."""
    path, owner = paths(page), owners(page)
    has_text = {owner[k] for k, _, text in page.runs if text and not text.isspace()}
    below: list[list[float]] = [[] for _ in path]
    tags: list[list[str]] = [[] for _ in path]
    best = [0.0] * len(path)
    for k in range(len(path) - 1, -1, -1):
        if owner[k] != k:
            continue
        style, content = tree.get(path[k], (1.0, 1.0))
        parts = below[k] + ([content] if k in has_text else [])
        kinds = sum(a != b for a, b in zip(tags[k], tags[k][1:])) + bool(tags[k])
        weight = s.damping ** kinds
        own = ((1 - weight) * style + weight * sum(parts) / len(parts)) if parts else 0.0
        best[k] = max(best[k], own)
        if page.parents[k] >= 0:
            parent = owner[page.parents[k]]
            if parts:
                below[parent].append(own)
            tags[parent].append(page.tags[k])
            best[parent] = max(best[parent], best[k])
    return best


def removed(page: Page) -> list[bool]:
    """Whether each element is no part of an article by its tag, role, class or id, or lies in one that is not."""
    n = len(page.tags)
    inside, holds = inside_article(page), [False] * n
    for k in range(n - 1, -1, -1):
        holds[k] |= page.tags[k] in ARTICLE_TAGS
        if holds[k] and page.parents[k] >= 0:
            holds[page.parents[k]] = True
    noise, named = [False] * n, [False] * n
    for k in range(n):
        tag, a = page.tags[k], page.attributes[k]
        own = tag in NOISE_TAGS or (tag == "header" and not inside[k]) or (a.get("role") or "").lower() in NOISE_ROLES
        words = set() if own or tag in INLINE or tag in ("html", "body", "main") else noise_words(page, k)
        if tag == "article":
            own = own or bool(words & COMMENT_NAMES)
        noise[k] = own or (page.parents[k] >= 0 and noise[page.parents[k]])
        named[k] = bool(words) and tag != "article" and not holds[k]
    size = [0] * n
    for k, _, text in page.runs:
        if not noise[k]:
            size[k] += len(text.strip())
    for k in range(n - 1, 0, -1):
        size[page.parents[k]] += size[k]
    for k in range(1, n):
        minor = named[k] and 2 * size[k] <= size[0]  # a name does not take the most of a page
        noise[k] = noise[k] or minor or noise[page.parents[k]]
    return noise


def prose(page: Page, gone: list[bool], shared: set[int]) -> list[int]:
    """Code points of prose in the branch of each element, without links, what is gone and the units in ``shared``."""
    n = len(page.tags)
    unit, link, mass = units(page, inside_article(page)), [False] * n, [0] * n
    for k in range(n):
        link[k] = page.tags[k] == "a" or (page.parents[k] >= 0 and link[page.parents[k]])
    for k, _, text in page.runs:
        if unit[k] >= 0 and not gone[k] and not link[k] and unit[k] not in shared:
            mass[k] += len(text.strip())
    for k in range(n - 1, 0, -1):
        mass[page.parents[k]] += mass[k]
    return mass


def article_of(page: Page, gone: list[bool], shared: set[int], tree: dict, s: Settings) -> list[bool] | None:
    """Whether each element belongs to the page's article; None if it has none that stands out."""
    n, inside = len(page.tags), inside_article(page)
    held = {True: 0, False: 0}  # text of a marked article, prose outside of it
    mass = prose(page, gone, shared)
    for k, _, text in page.runs:
        if not gone[k] and inside[k]:
            held[True] += len(text.strip())
    outer = [k for k in range(1, n) if inside[k] and not inside[page.parents[k]]]
    held[False] = mass[0] - sum(mass[k] for k in outer)
    if held[True]:
        return inside if held[False] <= held[True] else None
    now, place = 0, places(page)
    while True:
        below = [k for k in range(now + 1, n) if page.parents[k] == now and mass[0] and mass[k] >= s.most * mass[0]]
        if not below or page.tags[below[0]] in PROSE_TAGS or page.tags[below[0]] in INLINE:
            break
        now = below[0]
    # The page itself is one of its host's, so on a host of one page prose usually lies where it does.
    usual = tree.get(place[now], (1.0, 1.0))[0]
    if page.tags[now] in ("#root", "html", "body") or usual < s.usual:
        return None
    own = [False] * n
    for k in range(now, n):
        own[k] = k == now or (page.parents[k] >= 0 and own[page.parents[k]])
    return own


def main_blocks(page: Page, tree: dict[int, tuple[float, float]], s: Settings) -> list[str]:
    """Text blocks of the page that belong to its article."""
    n, gone = len(page.tags), removed(page)
    path, unit = paths(page), units(page, inside_article(page))
    values = unit_values(page, unit)

    def importance_of(k: int) -> float:
        return tree.get(unit_key(path[k], values[k]), (1.0, 1.0))[1]

    shared = {k for k in values if not gone[k] and importance_of(k) < s.threshold}
    article = article_of(page, gone, shared, tree, s)
    best, weak = importance(page, tree, s), [False] * n
    listed = [k for k in values if not gone[k] and (article is None or article[k])]
    body = [k for k in listed if page.tags[k] not in HEADINGS]
    drop = {k for k in shared if k in listed}
    if article is not None:
        drop = {k for k in drop if page.tags[k] not in HEADINGS and unit_size(page, unit, k) <= s.short}
        drop = drop if 2 * len(drop) <= len(listed) else set()
    if body and all(k in drop for k in body):
        drop = set()
    for k in range(1, n):
        follows = page.tags[k] in INLINE or (unit[k] >= 0 and unit[k] != k)
        if unit[k] == k:
            own = k in drop
        else:
            own = not follows and article is None and best[k] < s.threshold
        weak[k] = weak[page.parents[k]] or own

    def blocks(tests: list[list[bool]]) -> list[str]:
        parts: dict[int, list[str]] = {}
        for k, block, text in page.runs:
            if not gone[k] and not any(t[k] for t in tests):
                parts.setdefault(block, []).append(text)
        return [t for texts in parts.values() if (t := tidy("".join(texts)))]

    outside = [not x for x in article] if article is not None else [False] * n
    return blocks([weak, outside]) or blocks([outside])


def style_trees(pages: DataFrame, s: Settings) -> DataFrame:
    """One row per host with several pages: host and its tree, a list of
    (path, style importance, content importance). ``pages`` has the columns host and html.
    Texts of units that several pages hold are rows of their ``unit_key``; rows of places hold
    the mean share of prose there in place of the style.

    Elements on a single page say nothing and are left out; they count fully.
    """

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, rows = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [(unit_key(p, v), 2, 0) if kind == 2 else (p, kind, v) for p, kind, v in page_values(parse(text))]
                host += [h] * len(own)
                rows += own
            path, kind, value = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())],
                names=["host", "path", "kind", "value"],
            )

    rows = pages.where("host <> ''").mapInArrow(released(values), "host string, path long, kind int, value long")
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    spread = counts.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("weight"), F.sum(F.col("n") * F.col("value")).alias("total")
    )
    host_pages = pages.groupBy("host").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    size = F.log(F.col("m") + s.smoothing)
    style = F.when(F.col("kind") == 0, (F.log("pages") - F.col("weight") / F.col("pages")) / F.log("m"))
    style = style.when(F.col("kind") == 3, F.col("total") / (100 * F.col("m")))
    shared = F.when(F.col("kind") == 1, F.col("weight") / F.col("pages")).when(F.col("kind") == 2, F.log("pages"))
    content = 1 - shared / size
    style = F.coalesce(style, F.when(F.col("kind") == 2, 0.0))
    # A text that this many pages do not share, and a place that holds prose often enough, decide nothing.
    decides = (F.col("kind") < 2) | (content < s.threshold + 1e-9) | ((F.col("kind") == 3) & (style < s.usual))
    elements = spread.where("pages > 1 OR kind = 3").join(host_pages, "host").where(decides).groupBy("host", "path")
    elements = elements.agg(F.max(style).alias("style"), F.coalesce(F.max(content), F.lit(1.0)).alias("content"))
    known = elements.where("style is not null")
    return known.groupBy("host").agg(F.collect_list(F.struct("path", "style", "content")).alias("tree"))


def extract_main(
    pages: DataFrame, settings: Settings | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    ``text`` is the article's blocks in page order, joined by two line ends; inside a block
    white space is one space. Null and empty html give an empty text. Pages without a host
    have no style tree, and those of a host of one page only its own. Null ids, repeated rows and other columns do not matter.
    """
    s = settings or Settings()
    columns_of(pages, id_col, url_col, html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        whole_text(html_col).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST, 1)).alias("host"),
    )
    trees = write_table(style_trees(rows.select("host", "html"), s), "trees")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            out = []
            for k, (host, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host] = {e["path"]: (e["style"], e["content"]) for e in batch.column(4)[k].as_py() or ()}
                out.append("\n\n".join(main_blocks(parse(text), known[host], s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = rows.join(trees, "host", "left").select("page_id", "url", "host", "html", "tree")
    kinds = [joined.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return joined.mapInArrow(released(extract), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
