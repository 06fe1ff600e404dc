"""Main text of web pages by tag-path ratios.

The page is read into blocks: runs of text between tags of block elements, each with its path of block elements from the root. An element stands in a path with its
classes and id, less their digits, so that like siblings share a path; a div or section with neither counts by its place. Text length
and punctuation are summed per path over the blocks that end there. Length per block, smoothed over the paths in page order, and
punctuation per block are fused by the root of their product, times the path's share of text in that of the path with most. Paths from THRESHOLD of the best on are
content. Their parents are containers: what is plain in one (paragraphs, headings, quotes) is content too, and what is grouped or named in it if its own
ratio is OWN of the best.

What sites never name their main text weighs LISTED, nothing: elements, classes or ids of menus, forms, adverts, comments and so on. A class or id counts
by whole words: all parts of it name what is never main text ("cookie-notice", but not "has-sidebar"). It doesn't count on html, body, main or article (one
that is a comment aside), or on a wrapper: what holds most of the page's text and is named by a place in the layout, or holds a main element or h1. Names alone leave no page empty. Where the page
marks articles, paths in them weigh MARKED times as much, and a marked article is a container of its own: all of it is content if a path in it is, and none
of it through a container around it. What is outside the marks is chosen by its ratios as on any page. With both weights at 1 ratios alone decide.

Defined cases: null or empty html, or none selected: empty text; markup that isn't closed ends where HTML's rules or the page end it, a tag without > is text;
paths that tie at a threshold are content alike; rows
that repeat are read each by itself; an empty table gives no row; columns besides those named are left out.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table

# Names of HTML elements, and words by which sites name what isn't main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video select button noframes xmp".split())
NEVER = frozenset("head nav header footer aside form menu dialog fieldset search".split())
NEVER_NAMED = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dfp disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted recommended replies reply respond share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget".split())
REPLIES = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body article section".split())
LAYOUT = frozenset("banner footer header masthead modal notice notices notification overlay share sharing sidebar social toolbar widget".split())
MAIN = frozenset(["article", "main"])
UNNAMED = MAIN | {"html", "body"}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

GROUPS = frozenset("div section article main aside nav header footer form table ul ol dl".split())
THRESHOLD = 0.3
OWN = 0.2
LISTED = 0.0
MARKED = 2.0
MOST = 0.5  # of the page's text: what holds more can be a wrapper
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)|[^>]*+>)|<[!?/][^>]*+>""", re.S)
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MARKS = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？،؟।]")


def _named(attributes: str) -> set[str]:
    """The words of those classes, ids and roles of which every word is in NEVER_NAMED."""
    out: set[str] = set()
    for m in _NAME.finditer(attributes):
        for token in markup.unescape(next((g for g in m.groups() if g), "")).lower().split():
            words = _WORDS.findall(token)
            if NEVER_NAMED.issuperset(words):
                out.update(words)
    return out


def blocks_of(page: str) -> list[tuple[tuple[str, ...], tuple[str, ...], bool, str]]:
    """(names of elements, path, in what is never main text, text) of every block with text, in page order."""
    found = _read(page)
    total = sum(len(text) for _, _, never, _, text in found if not never)
    held: dict[int, int] = {}
    wrappers: set[int] = set()
    for path, _, never, named, text in found:
        for n, depth, layout in named:
            held[n] = held.get(n, 0) + (0 if never else len(text))
            if not never and (layout or "main" in path[depth:] or "h1" in path[depth:]):
                wrappers.add(n)
    out = [(path, keys, never or any(n not in wrappers or held[n] <= MOST * total for n, _, _ in named), text) for path, keys, never, named, text in found]
    return out if any(not never for _, _, never, _ in out) else [(path, keys, never, text) for path, keys, never, _, text in found]


def _key(name: str, attributes: str) -> str:
    """An element in a path: its name with its classes and id, without their digits, so that like siblings are one."""
    out = name
    for m in _MARKS.finditer(attributes):
        sign = "." if m[1].lower() == "class" else "#"
        out += "".join(sorted(sign + _DIGITS.sub("", token) for token in next((g for g in m.groups()[1:] if g), "").lower().split()))
    return out


def _read(page: str) -> list[tuple[tuple[str, ...], tuple[str, ...], bool, tuple[tuple[int, int, bool], ...], str]]:
    """(names of elements, path, in an element that is never main text, named elements around it, text) of every block. Of a named element: where it
    starts, how many are around it, whether it is named by places in the layout alone. A path has each element with its classes and id; one of GROUPS
    without either counts by its place among its parent's, unless it is the block itself."""
    stack: list[tuple[str, bool, tuple[tuple[int, int, bool], ...], str, int, dict[str, int]]] = []
    top: dict[str, int] = {}
    out: list[tuple[tuple[str, ...], tuple[str, ...], bool, tuple[tuple[int, int, bool], ...], str]] = []
    held: list[str] = []
    at, n = 0, len(page)
    # Tags are looked for up to the last > alone: one that is never closed then isn't read to the page's end again and again.
    closed = page.rfind(">") + 1

    def flush() -> None:
        if held:
            text = " ".join(markup.unescape("".join(held)).split())
            held.clear()
            if text:
                keys = [x[3] if x[4] < 0 else f"{x[3]}@{x[4]}" for x in stack[:-1]] + [x[3] for x in stack[-1:]]
                out.append((tuple(x[0] for x in stack), tuple(keys), *(stack[-1][1:3] if stack else (False, ())), text))

    def close(names, stops=()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    while at < n:
        m = _TAG.search(page, at, closed) if at < closed else None
        if not m:
            held.append(page[at:].partition("<!--")[0])
            break
        held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = n
            continue
        name, end = m[2].lower(), bool(m[1])
        if name in RAW:
            if not end and not m[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at, closed)
                at = stop.end() if stop else n
            held.append(" ")
        elif name == "br":
            held.append(" ")
        elif name in BLOCKS:
            flush()
            if end:
                if any(x[0] == name for x in stack):
                    close({name})
                continue
            if name in CLOSES_P:
                close({"p"}, SCOPES | {"div", "blockquote", "td", "li"})
            if name in CLOSES_OWN:
                close(CLOSES_OWN[name], SCOPES - {name})
            if name not in VOID:
                words = _named(m[3])
                kept_title = name == "header" and any(x[0] in MAIN for x in stack)
                never = bool(stack) and stack[-1][1] or name in NEVER and not kept_title
                named = stack[-1][2] if stack else ()
                if words and (name not in UNNAMED or name == "article" and not REPLIES.isdisjoint(words)):
                    named += ((m.start(), len(stack), words <= LAYOUT),)
                key, siblings = _key(name, m[3]), stack[-1][5] if stack else top
                siblings[name] = siblings.get(name, 0) + 1
                stack.append((name, never, named, key, siblings[name] if key == name and name in GROUPS else -1, {}))
    flush()
    return out


def path_ratios(blocks: list[tuple[tuple[str, ...], float, str]]) -> dict[tuple[str, ...], float]:
    """The fused ratio of each path: text length and punctuation per block, the former smoothed over the paths in page order, by the root of their product; times the
    path's share of text in that of the path with most, and its weight."""
    order: dict[tuple[str, ...], list] = {}
    for path, weight, text in blocks:
        own = order.setdefault(path, [0, 0, 0, 0.0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(_PUNCTUATION.findall(text))
        own[3] = max(own[3], weight)
    count, size, marks, weight = np.array(list(order.values()), dtype=float).T
    length = size / count
    smooth = np.convolve(np.pad(length, 1, mode="edge"), [0.25, 0.5, 0.25], mode="valid")
    fused = np.sqrt(np.maximum(smooth, length) * (marks + 0.5) / count)
    weighed = size * weight
    return dict(zip(order, (fused * weight * weighed / max(weighed.max(), 1.0)).tolist(), strict=True))


def _in_main(names: tuple[str, ...]) -> bool:
    return any(t in MAIN for t in names)


def main_text(page: str | None, listed: float = LISTED, marked: float = MARKED) -> str:
    """listed: the weight of what the lists name; marked: of marked articles. With 1 for both, ratios alone decide."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    # A header in an article holds its title; the rest of it isn't main text.
    weights = [listed if never or "header" in names and names[-1] not in HEADINGS else 1.0 for names, _, never, _ in blocks]
    ratios = path_ratios([(keys, w * (marked if _in_main(names) else 1.0), text) for (names, keys, _, text), w in zip(blocks, weights, strict=True)])
    best = max(ratios.values())
    if best <= 0:
        return ""
    content = {keys for keys, r in ratios.items() if r >= THRESHOLD * best}
    marks = marked > 1
    containers = {_container(names, keys, marks) for names, keys, _, _ in blocks if keys in content}
    return "\n".join(text for (names, keys, _, text), w in zip(blocks, weights, strict=True) if w and (keys in content or _belongs(names, keys, containers, ratios[keys], best, marks)))


def _belongs(names: tuple[str, ...], keys: tuple[str, ...], containers: set[tuple[str, ...]], ratio: float, best: float, marks: bool) -> bool:
    """Whether a block is main text by a container around it: a marked article has all of it; any other has what is plain in it, and what is grouped
    or named in it if its own ratio is OWN of the best at least."""
    if marks and _in_main(names):
        return _container(names, keys, marks) in containers
    inner = next((k for k in range(len(keys), 0, -1) if keys[:k] in containers), 0)
    if not inner:
        return False
    return not any(x in GROUPS or "." in key or "#" in key for x, key in zip(names[inner:], keys[inner:], strict=True)) or ratio >= OWN * best


def _container(names: tuple[str, ...], keys: tuple[str, ...], marks: bool) -> tuple[str, ...]:
    """The outermost marked article on the path, or the block's parent."""
    for k, t in enumerate(names):
        if marks and t in MAIN:
            return keys[: k + 1]
    return keys[:-1] if len(keys) > 1 else keys


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col)).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
