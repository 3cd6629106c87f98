"""Main text of HTML pages by wrappers: union-free regular expressions inferred per host.

The pages of a host come from few templates. A page's token stream (tags with their class and id,
and texts; inline tags don't count) is nested by its tags. The wrapper of a host is inferred by
aligning the streams of a sample of its pages one after the other: where the tags are the same one
by one they match and their contents are aligned in turn. At a mismatch, neighbours with equal
tags, or equal runs of tags, become a repeated group on both sides, and a tag that only one side
has an optional group; texts that differ become a text slot, equal ones stay part of the template. No alternatives arise, so the expression is
union-free and each slot is known by its path of tags.

Each page's tags are then matched with its host's wrapper, from the outside in, placing as many as
can be (a single occurrence fills a repeated group too); its texts thereby fill slots. Texts that
the wrapper lacks are known by their path of tags. What lies in menus, headers, footers, asides,
forms, adverts, notices or comments, or is hidden on the page, isn't main text (told by tag, role,
class or id; inside an article only by tag, role and whole classes of known widgets); of the rest a page's main text is that of its article or main element. Only where
it has none the slots decide: all texts are kept but template text and slots that are mostly
links, both counted over all distinct pages of the host. Inside an article no slot is left out for repeating or for its links: a title that many pages share is text.

The sample serves alignment alone and is bounded (``SAMPLE`` pages of a host, the smallest hashes,
distinct content only); wrappers are applied to every page, whole. Pages aren't shuffled: choices and wrappers are small
tables in the shared folder, cut into files by a hash of the host, that tasks read as they need.
"""

from __future__ import annotations

import contextlib
import hashlib
import html
import pickle
import re
import sys
import uuid
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.url_reputation import host_of
from marlstone.session import cut, scratch

SAMPLE = 12
FILES = 256
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")  # any attribute, so that values aren't read as names
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")

# Fixed by HTML: which tags are inline, void, raw text; what an opening tag closes.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg".split())
BLOCK_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}, "tfoot": {"tbody", "tr"}}
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())

# What isn't main text, by tag, role, and word of a class or id.
BAD_TAGS = frozenset("head nav footer aside form script style noscript template iframe button select option textarea svg dialog menu object canvas".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar sidenav footer masthead "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "announcement disclaimer legal discussion responses feedback promoted login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget widgets search form copyright".split()
)
# Inside an article, where ids and classes are made from headings too: whole classes of known widgets only.
WIDGETS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle ad-container ad-slot ad-unit ad-wrapper comments comment-list commentlist comment-form comment-respond comments-area disqus disqus_thread "
    "cookie-banner cookie-bar cookie-consent cookie-notice newsletter-form newsletter-signup subscribe-form social-share share-bar share-buttons sharing-buttons social-links sharedaddy jp-relatedposts "
    "related-posts related-articles recommended-posts recommended-articles breadcrumb breadcrumbs pagination pager navbar sidebar toolbar popup modal sponsored sponsored-content".split()
)
HEADER_NAMES = frozenset(["header", "topbar"])
ARTICLES = ("article", "main")


class Node:
    __slots__ = ("label", "tag", "bad", "kids")

    def __init__(self, label: str, tag: str, bad: bool):
        self.label, self.tag, self.bad, self.kids = label, tag, bad, []


def _open(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """(label, whether it opens something that isn't main text); inside: an article or main element."""
    label, bad = tag, tag in BAD_TAGS or tag == "header" and not inside
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true":
                bad = True
            elif name == "role":
                bad |= value.lower() in BAD_ROLES
                label += f"@{value.lower()}"
            elif name in ("class", "id"):
                label += ("." if name == "class" else "#") + re.sub(r"\d+", "0", value)
                if tag in ("html", "body", *ARTICLES):
                    continue
                if inside:
                    bad |= name == "class" and not WIDGETS.isdisjoint(value.lower().split())
                else:
                    parts = {x.lower() for x in _PART.findall(value)}
                    bad |= bool(parts & BAD_NAMES) or bool(parts & HEADER_NAMES)
    return label, bad


class Tags:
    """The tags of a page in turn, in linear time whatever the markup: (start, end, name, closing, attributes).

    Name None: a comment or declaration. A tag ends at the first > outside quotes or, where a quote
    isn't closed, at the first >; a < that starts nothing, or that no > follows, is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.open = page, page.rfind(">"), set()
        self.quotes = {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """Where the first > outside quotes lies, -1 if there is none."""
        seen = []
        while m := _STOP.search(self.page, at):
            i, c = m.start(), m[0]
            if c == ">":
                return i
            seen.append(i)
            # from some places of an opened quote it is known that no end follows
            if i in self.open or i >= self.quotes[c]:
                break
            at = self.page.index(c, i + 1) + 1
        self.open.update(seen)
        return -1

    def after(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        page, last = self.page, self.last
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, None, False, ""
            if start > last:  # only a comment needs no >
                at = start + 1
                continue
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, None, False, ""
            closing = page.startswith("</", start)
            m = _NAME.match(page, start + 1 + closing)
            if m:
                end = self._end(m.end())
                if end >= 0:
                    return start, end + 1, m[0].lower(), closing, page[m.end() : end]
                if (end := page.find(">", m.end())) >= 0:
                    return start, end + 1, m[0].lower(), closing, ""
            at = start + 1
        return None


def parse(page: str) -> Node:
    """The page's tags as a tree; a text is a (text, characters in links) pair between block tags."""
    root = Node("", "", False)
    stack, buf, linked, links = [root], [], 0, 0
    articles, counts, tags = 0, Counter(), Tags(page)  # counts: open tags by name

    def flush() -> None:
        nonlocal linked
        if buf:
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            if text:
                stack[-1].kids.append((text, min(linked, len(text))))
            buf.clear()
        linked = 0

    def pop() -> None:
        nonlocal articles
        tag = stack.pop().tag
        articles -= tag in ARTICLES
        counts[tag] -= 1

    at, n = 0, len(page)
    while at < n:
        m = tags.after(at)
        piece = page[at : m[0]] if m else page[at:]
        if piece:
            buf.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        _, at, tag, closing, attrs = m
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                buf.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if counts[tag] else ():
                if stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
                    break
                if tag not in SCOPES and stack[k].tag in SCOPES:
                    break
            links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, tags.last + 1)
            at = end.end() if end else n
            continue
        shut = SIBLINGS.get(tag, {"p"} if tag in BLOCK_ENDS_P else ())
        for k in range(len(stack) - 1, 0, -1) if any(counts[x] for x in shut) or tag in BLOCK_ENDS_P and counts["p"] else ():
            if stack[k].tag in shut or "p" == stack[k].tag and tag in BLOCK_ENDS_P:
                while len(stack) > k:
                    pop()
                break
            if stack[k].tag in SCOPES:
                break
        label, bad = _open(tag, attrs, articles > 0)
        node = Node(label, tag, bad)
        stack[-1].kids.append(node)
        stack.append(node)
        counts[tag] += 1
        articles += tag in ARTICLES
        links = 0
    flush()
    return root


class Item:
    """A part of a wrapper: a tag with its contents, a repeated group of tags, or a text.

    most: how often it occurs in a row (2: any number); least: 0 if optional. Texts: text is the
    template's (None: a slot), with its size and linked characters over the pages seen. folded:
    whether repeated groups were looked for among its kids.
    """

    __slots__ = ("label", "tag", "bad", "least", "most", "kids", "text", "chars", "linked", "pages", "folded")

    def __init__(self, label, tag="", bad=False, kids=(), text=None, chars=0, linked=0):
        self.label, self.tag, self.bad, self.kids = label, tag, bad, list(kids)
        self.least = self.most = self.pages = 1
        self.folded = False
        self.text, self.chars, self.linked = text, chars, linked


TEXT = "#text"


def _merge(a: Item, b: Item, row: bool = False) -> Item:
    """One item for both; row: they follow one another in a page."""
    out = Item(a.label, a.tag, a.bad and b.bad)  # what only some pages hide is judged page by page
    out.least, out.most = min(a.least, b.least), 2 if row else max(a.most, b.most)
    out.pages = a.pages if row else a.pages + b.pages
    if a.label == TEXT:
        out.text = a.text if a.text == b.text else None
        out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    else:
        out.kids, out.folded = joined(a.kids, a.folded, b.kids, b.folded, row)
    return out


def joined(a: list[Item], a_folded: bool, b: list[Item], b_folded: bool, row: bool) -> tuple[list[Item], bool]:
    """One sequence for both: item by item while their labels agree, else aligned after folding."""
    if not a_folded and not b_folded and [x.label for x in a] == [x.label for x in b]:
        return [_merge_row(x, y) if row else _merge(x, y) for x, y in zip(a, b, strict=True)], False
    return align(a if a_folded else fold(a), b if b_folded else fold(b), row), True


def fold(items: list[Item]) -> list[Item]:
    """Neighbours with equal labels, then equal runs of labels, as repeated groups."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].label == x.label:
            out[-1] = _merge(out[-1], x, True)
        else:
            out.append(x)
    for size in periods([x.label for x in out]):
        i = 0
        while i + 2 * size <= len(out):
            labels = [x.label for x in out]
            same = np.array([a == b for a, b in zip(labels[i:], labels[i + size :], strict=False)])
            # the first place from which size labels in a row recur size places on
            runs = np.flatnonzero(np.convolve(same, np.ones(size, np.int64), "valid") == size) if len(same) >= size else []
            if not len(runs):
                break
            i += int(runs[0])
            run, times = labels[i : i + size], 2
            while labels[i + times * size : i + (times + 1) * size] == run:
                times += 1
            group = out[i : i + size]
            for k in range(1, times):
                group = [_merge(a, b, True) for a, b in zip(group, out[i + k * size : i + (k + 1) * size], strict=True)]
            whole = Item(f"({' '.join(run)})", kids=group)
            whole.folded = True
            whole.most = 2
            out[i : i + times * size] = [whole]
            i += 1
    return out


def periods(labels: list[str]) -> list[int]:
    """Lengths, in order, that a repeated run may have: a run holds the label that is rarest in it, which recurs a length on.

    The distances of equal labels that are one, two or three occurrences apart, at least 2.
    """
    at: dict[str, list[int]] = {}
    found: set[int] = set()
    for i, x in enumerate(labels):
        held = at.setdefault(x, [])
        found.update(i - j for j in held[-3:])
        held.append(i)
    return sorted(d for d in found if 2 <= d <= len(labels) // 2)


def schema(node: Node) -> list[Item]:
    """A page as an expression of its own, with the repeated groups that it shows alone."""
    return fold(_items(node, schema))


def listed(node: Node) -> list[Item]:
    """A page's tags and texts as they come."""
    return _items(node, listed)


def _items(node: Node, inner) -> list[Item]:
    return [Item(TEXT, text=k[0], chars=len(k[0]), linked=k[1]) if isinstance(k, tuple) else Item(k.label, k.tag, k.bad, inner(k)) for k in node.kids]


def common(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """(place in a or -1, place in b or -1) in order, equal labels of a longest common subsequence as one.

    Exact at any length: a bit for each of a says where the longest common subsequence of what
    follows grows (Hyyro's bit-parallel recurrence, from the end). A row of bits for each of b would
    be much for long lists, so every root of their number one is kept and those between computed again.
    """
    n, m = len(a), len(b)
    full, places = (1 << n) - 1, {}
    for i, x in enumerate(a):  # the bit n - 1 - i is a's place i
        places[x] = places.get(x, 0) | 1 << (n - 1 - i)

    def before(row: int, label: str) -> int:
        u = row & places.get(label, 0)
        return (row + u | row - u) & full

    size = max(1, int(m**0.5))
    kept, row = {m: full}, full
    for j in range(m - 1, -1, -1):
        row = before(row, b[j])
        if j % size == 0:
            kept[j] = row
    i, rows = 0, {}
    for j in range(m):
        if j % size == 0:
            end = min(j + size, m)
            rows = {end: kept[end]}
            for k in range(end - 1, j - 1, -1):
                rows[k] = before(rows[k + 1], b[k])
        while i < n and a[i] != b[j] and rows[j] >> (n - 1 - i) & 1:
            yield i, -1
            i += 1
        if i < n and a[i] == b[j]:
            yield i, j
            i += 1
        else:
            yield -1, j
    for k in range(i, n):
        yield k, -1


def align(a: list[Item], b: list[Item], row: bool = False) -> list[Item]:
    """One sequence for both: a longest common subsequence of labels matches, the rest is optional."""
    out = []
    for i, j in common([x.label for x in a], [x.label for x in b]):
        if i >= 0 and j >= 0:
            out.append(_merge(a[i], b[j], False) if not row else _merge_row(a[i], b[j]))
        else:
            out.append(a[i] if i >= 0 else b[j])
            out[-1].least = 0
    return out


def _merge_row(a: Item, b: Item) -> Item:
    out = _merge(a, b, True)
    out.most = max(a.most, b.most)
    return out


def infer(pages: list[str]) -> list[Item]:
    """The wrapper of pages, aligned one after the other."""
    out, folded = None, False
    with nested():
        for p in pages:
            one = listed(parse(p))
            out, folded = (one, False) if out is None else joined(out, folded, one, False, False)
    return out or []


@contextlib.contextmanager
def nested():
    """Tags may be nested to any depth: Python's limit on calls is lifted, which take no room on the machine's stack."""
    most = sys.getrecursionlimit()
    sys.setrecursionlimit(1 << 30)
    try:
        yield
    finally:
        sys.setrecursionlimit(most)


def expression(items: list[Item]) -> str:
    """A wrapper as a regular expression over tags; #text is a slot, other texts are quoted."""
    parts = []
    for x in items:
        if x.label == TEXT:
            s = TEXT if x.text is None else repr(x.text)
        elif x.label.startswith("("):
            s = f"({expression(x.kids)})"
        else:
            s = f"<{x.label}>{expression(x.kids)}</{x.tag}>"
        mark = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[x.least, x.most]
        parts.append(f"({s}){mark}" if mark else s)
    return "".join(parts)


def slots(wrapper: list[Item], pages: int) -> dict[str, bool]:
    """Which paths of tags hold main text, by the sample alone."""
    found: dict[str, list] = {}

    def walk(items: list[Item], path: tuple, bad: bool, inside: bool) -> None:
        for x in items:
            if x.label == TEXT:
                key = "/".join(path)
                held = found.setdefault(key, [0, 0, bad, inside, True, path])
                held[0] += x.chars
                held[1] += x.linked
                held[4] &= x.text is not None and x.pages >= max(3, pages // 2) and not inside
            elif x.label.startswith("("):
                walk(x.kids, path, bad, inside)
            else:
                walk(x.kids, (*path, x.label), bad or x.bad, inside or x.tag in ARTICLES)

    walk(wrapper, (), False, False)
    good = {k: v for k, v in found.items() if not v[2] and not v[4] and (v[3] or v[0] > 2 * v[1])}
    return {k: k in kept for kept in [_main(good)] for k in found}


def _main(good: dict[str, list]) -> set[str]:
    """Of the candidate slots (see slots) those in an article or main element, or all if there is none."""
    return {k for k, v in good.items() if v[3]} or set(good)


class Wrapper:
    """A wrapper to match pages with: per tag the flat sequence of what it contains.

    seqs: (places, reach, to) a sequence, the first for the page. places has the positions of each
    label; reach the last position that may come just before one, further on where a group repeats;
    to the sequence of a tag's contents or the number of a text's slot. template, links: slots that
    repeat one text, or are mostly links, over all pages of the host (see left_out).
    """

    def __init__(self, items: list[Item]):
        self.seqs, self.template, self.links, texts, todo = [None], set(), set(), 0, [(0, items)]

        def flat(items: list[Item], places: dict, reach: list, to: list) -> None:
            nonlocal texts
            for x in items:
                lo = len(to)
                if x.label.startswith("("):
                    flat(x.kids, places, reach, to)
                else:
                    places.setdefault(x.label, []).append(lo)
                    reach.append(lo - 1)
                    if x.label == TEXT:
                        to.append(texts)
                        texts += 1
                    else:
                        to.append(len(self.seqs))
                        todo.append((len(self.seqs), x.kids))
                        self.seqs.append(None)
                if x.most == 2:
                    reach[lo:] = [len(to) - 1] * (len(to) - lo)

        while todo:
            at, items = todo.pop()
            self.seqs[at] = ({}, [], [])
            flat(items, *self.seqs[at])


def _restored(state: dict | None) -> Wrapper | None:
    """A Wrapper from its variables: only these are stored, as executors needn't be able to import the class."""
    if state is None:
        return None
    out = object.__new__(Wrapper)
    out.__dict__ |= state
    return out


def placed(labels: list[str], places: dict[str, list[int]], reach: list[int]) -> list[int]:
    """The position in a wrapper's sequence of each of a page's labels, -1 for what it lacks: as many as can be."""
    out, at = [], -1
    for label in labels:
        s = -1
        if (found := places.get(label)) is not None:
            last = reach[at] if at >= 0 else -1
            s = next((x for x in found if at < x <= last), None)
            if s is None:
                s = next((x for x in found if x > at or reach[x] >= at), None)
            if s is None:
                return _placed_best(labels, places, reach)
            at = s
        out.append(s)
    return out


def _placed_best(labels: list[str], places: dict[str, list[int]], reach: list[int]) -> list[int]:
    """placed() where the first fit fails: best[s + 1] is the most labels that can be placed with the last at s.

    Every root of the labels' number a copy is kept, from which the way back is computed again.
    """
    before = np.array([0, *(x + 1 for x in reach)])
    where = {k: np.array(v) + 1 for k, v in places.items()}
    size = max(1, int(len(labels) ** 0.5))

    def after(best: np.ndarray, label: str) -> np.ndarray:
        if label not in where:
            return best
        out, c = best.copy(), where[label]
        out[c] = np.maximum(out[c], np.maximum.accumulate(best)[before[c]] + 1)
        return out

    kept, best = [], np.zeros(len(before), np.int64)
    for i, label in enumerate(labels):
        if i % size == 0:
            kept.append(best)
        best = after(best, label)
    out, bound, left = [-1] * len(labels), len(before) - 1, int(best.max())
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for label in labels[k * size : (k + 1) * size]:
            rows.append(after(rows[-1], label))
        for i in range(len(rows) - 2, -1, -1):
            if left and rows[i][: bound + 1].max() < left:
                c = where[labels[k * size + i]]
                s = int(c[(c <= bound) & (rows[i + 1][c] == left)][0])
                out[k * size + i], bound, left = s - 1, int(before[s]), left - 1
    return out


def filled(page: str, wrapper: Wrapper | None) -> list[tuple[int, str, int, bool, bool]]:
    """(slot, text, characters in links, bad, inside an article or main element) of the page's texts in order.

    The page's tags are matched with the wrapper's from the outside in. Texts that the wrapper
    lacks have a negative number made from their path of tags.
    """
    out, names = [], {}
    todo = [(parse(page), 0 if wrapper else -1, "", False, False)]
    while todo:
        node, to, path, bad, inside = todo.pop()
        if isinstance(node, tuple):
            if to < 0:
                if path not in names:
                    names[path] = -1 - int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=7).digest())
                to = names[path]
            out.append((to, *node, bad, inside))
            continue
        path, bad, inside = f"{path}/{node.label}", bad or node.bad, inside or node.tag in ARTICLES
        at = [-1] * len(node.kids)
        if to >= 0:
            places, reach, tos = wrapper.seqs[to]
            at = [x if x < 0 else tos[x] for x in placed([TEXT if isinstance(k, tuple) else k.label for k in node.kids], places, reach)]
        todo.extend((k, x, path, bad, inside) for k, x in zip(reversed(node.kids), reversed(at), strict=True))
    return out


def text_of(page: str | None, wrapper: Wrapper | None) -> str:
    """The page's main text: the texts of its main slots in order, joined by line ends."""
    if not page:
        return ""
    blocks = [b for b in filled(page, wrapper) if not b[3]]
    own: dict[int, list[int]] = {}
    for slot, text, linked, _, _ in blocks:
        held = own.setdefault(slot, [0, 0])
        held[0] += len(text)
        held[1] += linked
    prose = [b for b in blocks if own[b[0]][0] > 2 * own[b[0]][1]]
    kept = [b for b in blocks if b[4]]
    if not kept and wrapper:
        linked = {k for k, v in own.items() if v[0] <= 2 * v[1]} & wrapper.links
        kept = [b for b in blocks if b[0] not in wrapper.template and b[0] not in linked]
    return "\n".join(b[1] for b in kept or prose)


class Side:
    """A table (name, value) in the shared folder, cut into files by a hash of the name; also files without names are written."""

    def __init__(self, folder: str, files: int = FILES):
        self.folder, self.files, self.held = folder, files, OrderedDict()

    def _fs(self):
        uri = self.folder if not re.match("file:/[^/]", self.folder) else "file://" + self.folder[5:]
        return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def write(self, df: DataFrame) -> None:
        """df: (name string, value binary), each name once."""
        me = self

        def put(pdf: pd.DataFrame) -> pd.DataFrame:
            fs, path = me._fs()
            fs.create_dir(path, recursive=True)
            part = f"{path}/{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as out:
                pickle.dump({k: bytes(v) for k, v in zip(pdf["name"], pdf["value"], strict=True) if k is not None}, out)
            fs.move(part, f"{path}/{int(pdf['file'].iloc[0])}")
            return pd.DataFrame({"file": pdf["file"].iloc[:1]})

        empty = df.sparkSession.range(self.files).select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("value"), F.col("id").alias("file"))
        rows = df.select("name", "value", (F.crc32("name") % self.files).alias("file")).unionByName(empty)
        rows.groupBy("file").applyInPandas(put, "file long").count()

    def get(self, name: str):
        file = zlib.crc32(name.encode()) % self.files
        if file not in self.held:
            fs, path = self._fs()
            with fs.open_input_stream(f"{path}/{file}") as f:  # every file is there: a missing one is a fault
                self.held[file] = pickle.loads(f.read())
            if len(self.held) > 64:
                self.held.popitem(last=False)
        value = self.held[file].get(name)
        return pickle.loads(value) if value is not None else None


def _chosen(side: Side):
    def ask(host: pa.Array, h: pa.Array, k: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for a, b, c in zip(host.to_pylist(), h.to_pylist(), k.to_pylist(), strict=True):
            if a not in known:
                known[a] = side.get(a) or frozenset()
            out.append((b, c) in known[a])
        return pa.array(out, pa.bool_())

    return ask


def _infer(pdf: pd.DataFrame) -> pd.DataFrame:
    pages = pdf.drop_duplicates("h").sort_values("h")["html"].tolist()
    w = infer(pages)
    with nested():
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "value": [pickle.dumps(vars(Wrapper(w)))], "expression": [expression(w)]})


COUNTS = "name string, h long, slot long, chars long, linked long, least long, most long"


def _counted(side: Side):
    def count(batches):
        for b in batches:
            known: dict = {}
            rows: list[tuple] = []
            for name, h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if name not in known:
                    known[name] = _restored(side.get(name))
                held: dict[int, list[int]] = {}
                for slot, text, linked, bad, inside in filled(page.as_py(), known[name]):
                    if not bad and not inside:
                        x = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest())
                        v = held.setdefault(slot, [0, 0, x, x])
                        held[slot] = [v[0] + len(text), v[1] + linked, min(v[2], x), max(v[3], x)]
                rows.extend((name, h, slot, *v) for slot, v in held.items())
            if rows:
                n, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), *(pa.array(c, pa.int64()) for c in rest)], names=[f.split()[0] for f in COUNTS.split(", ")])

    return count


def left_out(pages: DataFrame, side: Side, url: str = "url", body: str = "html") -> DataFrame:
    """(name, value): each host's slots that are template text or mostly links, by all its distinct pages.

    Template text is one and the same on all pages that have it, at least half of the host's and
    three; where a single page differs the slot holds text. Only texts outside articles count.
    """
    rows = pages.where(F.col(body).isNotNull()).select(host_of(F.col(url)).alias("name"), F.xxhash64(F.col(body)).alias("h"), F.col(body).alias("html"))
    total = rows.select("name", "h").distinct().groupBy("name").agg(F.count("*").alias("total"))
    largest = [F.max(c).alias(c) for c in ("chars", "linked", "least", "most")]  # equal pages count once
    once = rows.mapInArrow(_counted(side), COUNTS).groupBy("name", "slot", "h").agg(*largest)
    slot = once.groupBy("name", "slot").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("most").alias("most"))
    template = (F.col("least") == F.col("most")) & (F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("total") / 2)))
    found = slot.join(total, "name").select("name", "slot", template.alias("template"), (F.col("chars") <= 2 * F.col("linked")).alias("links")).where("template or links")
    pack = lambda pdf: pd.DataFrame({"name": pdf["name"].iloc[:1], "value": [pickle.dumps({c: set(pdf["slot"][pdf[c]].tolist()) for c in ("template", "links")})]})
    return found.groupBy("name").applyInPandas(pack, "name string, value binary")


def _apply(side: Side, left: Side):
    def extract(host: pa.Array, page: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for a, b in zip(host.to_pylist(), page, strict=True):
            if a not in known:
                state = side.get(a)
                known[a] = _restored(state and state | (left.get(a) or {}))
            out.append(text_of(b.as_py(), known[a]))
        return pa.array(out, pa.string())

    return extract


def wrappers(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(name, value, expression): each host's Wrapper and the same as a regular expression."""
    spark = pages.sparkSession
    h = F.xxhash64(F.col(body))
    rows = pages.select(host_of(F.col(url)).alias("name"), F.col(key).cast("string").alias("k"), h.alias("h"), F.col(body).alias("html")).where(F.col("html").isNotNull())
    distinct = rows.groupBy("name", "h").agg(F.min("k").alias("k"))
    # the smallest hashes of each host, first within 1024 parts of a host, then of what they leave
    part = Window.partitionBy("name", F.pmod("h", F.lit(1024))).orderBy("h")
    whole = Window.partitionBy("name").orderBy("h")
    few = distinct.withColumn("r", F.row_number().over(part)).where(F.col("r") <= sample)
    few = few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= sample)
    pack = lambda pdf: pd.DataFrame({"name": pdf["name"].iloc[:1], "value": [pickle.dumps(frozenset(zip(pdf["h"].tolist(), pdf["k"].tolist(), strict=True)))]})
    choice = Side(scratch(spark, "sampled"))
    choice.write(few.groupBy("name").applyInPandas(pack, "name string, value binary"))
    picked = rows.where(F.arrow_udf(_chosen(choice), "boolean")("name", "h", "k"))
    return cut(picked.groupBy("name").applyInPandas(_infer, "name string, value binary, expression string"), "wrappers")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(key, url, text, n_chars), a row a row of pages.

    Null or empty html, and pages without main text, give an empty text. Pages without a host
    share the wrapper of the empty host. Nothing of a main block is dropped or cut.
    """
    side = Side(scratch(pages.sparkSession, "slots"))
    side.write(wrappers(pages, key, url, body, sample).select("name", "value"))
    left = Side(scratch(pages.sparkSession, "left"))
    left.write(left_out(pages, side, url, body))
    text = F.arrow_udf(_apply(side, left), "string")(host_of(F.col(url)), F.col(body))
    return pages.select(key, F.col(url).alias("url"), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
