"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

Every page is a stream of element and text tokens.  Folding a page's repeated neighbours gives its own expression; aligning two
expressions keeps what matches, turns what only one has into optional groups and what one repeats into repeated
groups, and makes text a slot that remembers on how many pages it was seen and whether it ever differed.  Alignment
is a fold that may start anywhere, so each task aligns its own pages host by host, and what tasks found is aligned
again: no host's pages come together.  A host's wrapper says which part holds its articles, which parts of doubtful names never vary,
and which hold most of what varies, so that no name can drop them; pages that lack the part are judged by their own expression.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import lean, small_side, written

MOST_HOSTS, BROADCAST_BYTES = 20_000, 16 << 20
MATRIX_BITS = 1 << 31  # of the alignment's rows that are kept at once
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 20))  # expressions are as deep as pages; frames of functions lie on the heap

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "nav header footer aside form script style head title noscript template iframe svg canvas object select button textarea menu dialog audio video map datalist noembed noframes xmp".split()
)
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table article section div body td th nav aside header footer main form".split())
#: Words of classes, ids and roles that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors banner promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager skip contentinfo complementary search".split()
)
#: Those of them that name parts of articles as well: an element marked by no other goes only if its text does not vary over the host's pages.
DOUBTFUL = frozenset(
    "header masthead banner notice notices notification notifications alert alerts related recommended recommendations social share sharing search widget widgets skip menu menus overlay".split()
)
#: Words for what readers write: never the article, however much of it there is.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words beside them that say what kind of box it is; a name with any other word (`comment-analysis`, `ad-hoc`) is a subject's, not a mark.
BOXES = frozenset(
    "area aside bar block body bottom box btn button buttons card cards column columns container content desktop entry extra field fields first fixed float footer form global group head heading holder home html icon icons image inline inner "
    "input item items js label large last layout left level line link links list lists main medium meta middle mobile module nav outer page panel parent part parts placeholder post posts primary region right roll root row rows secondary section sections slot small "
    "site size space stack static sticky sub tab table tag tags text thread title top trail unit view wrap wrapper zone author avatar date time user users count counter new old the and for has with without css dfp gpt google double click amp "
    "leaderboard skyscraper mpu billboard rectangle interstitial embed media article articles story stories news topics you facebook twitter linkedin whatsapp pinterest reddit email mail print toggle info warning success error danger dismissible show fade active open close".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the words apply to, by class or role; ids of headings and sections are made of their titles.
MARKABLE = BLOCK - HEADINGS - {"main", "article", "body", "html"}

TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
STOP = re.compile(r"""[>"']""")
CUT = re.compile(r"<(?:[/!?]|[A-Za-z])[^<>]*\Z")
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

Node = list  # [label, sign ("" or "+" or "?" or "?+"), [pages, least and greatest text mark, characters], children]


def marked(tag: str, attributes: str) -> tuple[bool, str]:
    """(whether the element is shown on no account, its label in paths).

    A label ends in % if a class, id or role marks the element as readers' own, in ! if class or role mark it as no part of an article, in ^ if
    only its id does, in ~ if the words that mark it are doubtful.
    """
    dropped, label, sign = tag in DROPPED, tag, ""
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                dropped = True
            elif name in ("class", "id", "role"):
                for part in value.split() if tag in MARKABLE and not (name == "id" and tag == "section") else ():
                    names = [w.lower() for w in WORD.findall(part)]
                    if names and names[0] not in ("has", "no", "with", "without") and (found := MARKS.intersection(names)) and BOXES.issuperset(w for w in names if len(w) > 2 and w not in found):
                        how = "%" if found & READERS and name != "id" else "~" if found <= DOUBTFUL and name != "role" else "^" if name == "id" else "!"
                        sign = max(sign, how, key=["", "~", "^", "!", "%"].index)
                if name == "class" and value.split():
                    label += "." + re.sub(r"[\d%!^~]+", "#", value.split()[0])
    return dropped, label + sign


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """(0, tag, attributes) for an opened element, (1, tag, "") for a closed one, (2, text, "") for text; markup apart from these is passed over."""
    at, n, quotes = 0, len(page), True
    while at < n:
        m = TAG.search(page, at)
        end = page.find(">", m.end()) + 1 if m else 0
        if m and m[0] == "<!--":
            end = page.find("-->", m.end()) + 3
            end = n if end < 3 else end
        if not end:  # a tag that the page's end cuts off is markup still
            cut = CUT.search(page, at)
            text = page[at : cut.start() if cut else n]
            if text:
                yield 2, text, ""
            return
        if m.start() > at:
            yield 2, page[at : m.start()], ""
        tag = (m[2] or "").lower()
        if tag and quotes:  # a > in quotes ends no tag; once a quote does not end, quotes are not trusted in this page
            pos = m.end()
            while (stop := STOP.search(page, pos)) and stop[0] != ">":
                pos = page.find(stop[0], stop.end()) + 1
                if not pos:
                    break
            quotes = bool(stop and pos)
            end = stop.end() if quotes else end
        at = end
        if not tag:
            continue
        attributes = page[m.end() : end - 1]
        if m[1]:
            yield 1, tag, ""
            continue
        yield 0, tag, attributes
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "title" or tag == "textarea":
                yield 2, page[at : close.start() if close else n], ""
            at = close.end() if close else n
            yield 1, tag, ""


def walk(page: str) -> Iterator[tuple[str, list[tuple[str, str, bool]], str]]:
    """(kind, open elements as (tag, label, dropped), value); kind: open, close, text or break.  Ends that HTML implies are made."""
    stack: list[tuple[str, str, bool]] = []
    opened: Counter[str] = Counter()  # of tags that may be open: no search for others

    def cut(k: int) -> None:
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]

    for kind, value, attributes in events(page):
        if kind == 2:
            yield "text", stack, value
        elif kind == 0:
            if value in VOID:
                yield "break" if value in ("br", "hr", "img") else "void", stack, value
                continue
            if value in BLOCK:
                close = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in SCOPE), None) if opened["p"] > 0 else None
                if close is not None and stack[close][0] == "p":
                    yield "close", stack, "p"
                    cut(close)
            if ends := ENDS.get(value):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        yield "close", stack, stack[k][0]
                        cut(k)
                    elif stack[k][0] in SCOPE:
                        break
            dropped, label = marked(value, attributes)
            if value == "header" and opened["article"] > 0:
                dropped = False
                label = "header*"
            stack.append((value, label, dropped))
            opened[value] += 1
            yield "open", stack, value
            if attributes.endswith("/") and value in RAW:
                yield "close", stack, value
                cut(len(stack) - 1)
        elif opened[value] > 0:
            close = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == value)
            yield "close", stack, value
            cut(close)


# wrappers


def noted(tag: str, label: str, dropped: bool) -> bool:
    """Whether an element is a part of expressions and paths: blocks, and what is not shown."""
    return dropped or tag in BLOCK


def inner(path: str, label: str) -> str:
    """The path of an element with this label in one with that path: a digest, so paths are short however deep."""
    return hashlib.md5(f"{path}/{label}".encode("utf-8", "replace")).hexdigest()


def expression(page: str) -> Node:
    """A page's own union-free expression: of its blocks; inline elements' text belongs to theirs."""
    root: Node = ["", "", [0, 0, 0, 0], []]
    nodes = [root]
    for kind, stack, value in walk(page):
        del nodes[len(stack) + (kind != "open") :]
        if kind == "open":
            tag, label, dropped = stack[-1]
            node: Node = nodes[-1]
            if noted(tag, label, dropped):
                node = [label, "", [0, 0, 0, 0], []]
                nodes[-1][3].append(node)
            nodes.append(node)
        elif kind == "text" and (text := value.strip()):
            slot, mark = nodes[-1][2], zlib.crc32(text.encode("utf-8", "replace"))
            mark = both(slot[1], mark) if slot[0] else mark
            nodes[-1][2] = [1, mark, mark, slot[3] + len(text)]
    return fold(root)


def both(a: int, b: int) -> int:
    """The mark of two texts of one page, one after the other."""
    return zlib.crc32(b.to_bytes(4, "little"), a)


def fold(node: Node) -> Node:
    """Neighbours with one label become a repeated group."""
    out: list[Node] = []
    for child in node[3]:
        child = fold(child)
        if out and out[-1][0] == child[0]:
            out[-1] = align(out[-1], child, same_page=True)
            out[-1][1] = "?+" if "?" in out[-1][1] else "+"
        else:
            out.append(child)
    node[3] = out
    return node


def _sign(*signs: str, optional: bool = False) -> str:
    return ("?" if optional or any("?" in s for s in signs) else "") + ("+" if any("+" in s for s in signs) else "")


def align(a: Node, b: Node, same_page: bool = False) -> Node:
    """The least expression of this kind that covers both: mismatches become optional groups, repetitions repeated ones."""
    p, q = a[2], b[2]
    if not p[0] or not q[0]:
        slot = list(p if p[0] else q)
    elif same_page:
        # texts that differ from each other, but on every page alike, do not vary
        slot = [max(p[0], q[0]), *sorted((both(p[1], q[1]), both(p[2], q[2]))), p[3] + q[3]]
        if slot[1] == slot[2] and (p[1] != p[2] or q[1] != q[2]):
            slot[1] ^= 1
            slot[1:3] = sorted(slot[1:3])
    else:
        slot = [p[0] + q[0], min(p[1], q[1]), max(p[2], q[2]), p[3] + q[3]]
    x, y = a[3], b[3]
    out: list[Node] = []
    if [n[0] for n in x] == [n[0] for n in y]:
        out = [align(m, n, same_page) for m, n in zip(x, y, strict=True)]
    else:
        for i, j in matches([n[0] for n in x], [n[0] for n in y]):
            if i is None or j is None:
                n = y[j] if i is None else x[i]
                out.append([n[0], _sign(n[1], optional=True), n[2], n[3]])
            else:
                out.append(align(x[i], y[j], same_page))
        joined: list[Node] = []
        for n in out:
            if joined and joined[-1][0] == n[0]:
                joined[-1] = align(joined[-1], n, True)
                joined[-1][1] = "?+" if "?" in joined[-1][1] else "+"
            else:
                joined.append(n)
        out = joined
    return [a[0], _sign(a[1], b[1]), slot, out]


def _rows(x: list[str], y: list[str]) -> Iterator[int]:
    """After each label of x: a number whose bit j is 0 where the longest common subsequence grows at y[j]."""
    places: dict[str, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        up = row & places.get(v, 0)
        row = ((row + up) | (row - up)) & full
        yield row


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """The longest common subsequence of x with y[:j], for each j."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as places in both.  Rows of bits, and halves of x on their own where those would be too many."""
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > MATRIX_BITS:
        half = len(x) // 2
        at = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _common(x[:half], y[:at]) + [(half + i, at + j) for i, j in _common(x[half:], y[at:])]
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    out: list[tuple[int, int]] = []
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def matches(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """An alignment of two label sequences with as many matches as can be."""
    n, m, head, tail = len(x), len(y), 0, 0
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    while tail < min(n, m) - head and x[n - 1 - tail] == y[m - 1 - tail]:
        tail += 1
    pairs = [(k, k) for k in range(head)]
    pairs += [(head + i, head + j) for i, j in _common(x[head : n - tail], y[head : m - tail])]
    pairs += [(n - k, m - k) for k in range(tail, 0, -1)]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for p, q in [*pairs, (n, m)]:
        out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)]
        if p < n or q < m:
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def pattern(node: Node) -> str:
    """The expression in writing; # is a text slot that varies, a quoted # one that never did."""
    slot = "" if not node[2][0] else ("#" if node[2][1] != node[2][2] else "'#'")
    inner = slot + "".join(map(pattern, node[3]))
    return inner if not node[0] else f"(<{node[0]}>{inner}){node[1]}" if node[1] else f"<{node[0]}>{inner}"


def _unfit(label: str) -> bool:
    """Whether the element holds no article, whatever its text."""
    return label[-1:] in ("!", "^", "%") or re.split(r"[.~]", label)[0] in DROPPED


def _shown(label: str) -> bool:
    """Whether the element may hold article text but for the words that name it."""
    return label[-1:] != "%" and re.split(r"[.~!^]", label)[0] not in DROPPED


def measures(root: Node) -> dict[int, tuple[int, int, int, int]]:
    """Of each element (by id): characters of text that varies over the pages, and of all text, without those of unfit elements; of text
    that varies without those of elements that tags or readers' marks rule out; the most pages that a text was seen on."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node[3]
    out: dict[int, tuple[int, int, int, int]] = {}
    for node in reversed(order):
        slot = node[2]
        all_ = slot[3] if slot[0] else 0
        varies = all_ if slot[0] == 1 or slot[1] != slot[2] else 0
        total = [varies, all_, varies, slot[0]]
        for child in node[3]:
            m = out[id(child)]
            if not _unfit(child[0]):
                total[0] += m[0]
                total[1] += m[1]
            if _shown(child[0]):
                total[2] += m[2]
            total[3] = max(total[3], m[3])
        out[id(node)] = tuple(total)
    return out


def below(root: Node) -> Iterator[tuple[Node, str]]:
    """Every element with its path, in order; send a true value to pass over what is in it."""
    todo = [(c, inner("", c[0])) for c in reversed(root[3])]
    while todo:
        node, path = todo.pop()
        if not (yield node, path):
            todo += [(c, inner(path, c[0])) for c in reversed(node[3])]


def _where(root: Node, keep: Callable[[Node, str], bool], leave: Callable[[Node, str], bool]) -> list[str]:
    """Paths of the elements to keep; those and what is left are not entered."""
    out: dict[str, None] = {}
    each = below(root)
    try:
        node, path = next(each)
        while True:
            if kept := keep(node, path):
                out[path] = None
            node, path = each.send(kept or leave(node, path))
    except StopIteration:
        return list(out)


def same_parts(root: Node) -> list[str]:
    """Paths of elements marked by id or by doubtful words that hold no text that varies.  To be the same on every page does not suffice: an article may say so."""
    of = measures(root)
    return _where(root, lambda n, path: n[0][-1:] in ("^", "~") and not of[id(n)][2], lambda n, path: False)


def most_parts(root: Node, parts: list[str]) -> list[str]:
    """Paths of elements within `parts` that their names would drop although they hold most of the text that varies there."""
    wanted, of, out = set(parts), measures(root), []
    for node, path in [(root, ""), *below(root)]:
        if path in wanted or not parts and path == "":
            out += _at(node, path, lambda n, p: n[0][-1:] in ("!", "^") and 2 * of[id(n)][2] > of[id(node)][2])  # noqa: B023
    return list(dict.fromkeys(out))


def _at(root: Node, path: str, keep: Callable[[Node, str], bool]) -> list[str]:
    out, todo = [], [(c, inner(path, c[0])) for c in reversed(root[3])]
    while todo:
        node, here = todo.pop()
        if keep(node, here):
            out.append(here)
        todo += [(c, inner(here, c[0])) for c in reversed(node[3])]
    return out


def main_parts(root: Node) -> list[str]:
    """Paths of the parts that hold the article: outermost article elements, else main ones, else the smallest element with all
    text that varies from page to page (all text, if none does)."""
    for tag in ("article", "main"):
        if found := _where(root, lambda n, p: not _unfit(n[0]) and n[0][-1:] != "~" and n[0].partition(".")[0] == tag, lambda n, p: _unfit(n[0]) or n[0][-1:] == "~"):  # noqa: B023
            return found

    of = measures(root)
    kind = 0 if of[id(root)][0] else 1
    node, path = root, ""
    while True:
        fit = [c for c in node[3] if not _unfit(c[0])]
        best = max(fit, key=lambda c: of[id(c)][kind], default=None)
        if best is None or "+" in best[1] or of[id(best)][kind] < of[id(node)][kind] or re.split(r"[.~]", best[0])[0] in ("p", "li"):
            return [path]
        node, path = best, inner(path, best[0])


def text_of(page: str, parts: list[str], same: list[str] | tuple[str, ...] = (), most: list[str] | tuple[str, ...] = ()) -> tuple[str, bool]:
    """(text of the page's main parts in page order, a line a block, without those of `same` and without those that names mark, but for
    `most`; whether the page has such a part)."""
    blocks: list[str] = []
    now: list[str] = []
    seen, opened = not parts or "" in parts, [""]
    wanted, unwanted, kept, states = set(parts), set(same), set(most), [(seen, False, False)]  # (in a part, dropped, in a header of an article)

    def flush() -> None:
        if now and (text := " ".join("".join(now).split())):
            blocks.append(text)
        now.clear()

    for kind, stack, value in walk(page):
        del opened[len(stack) + (kind != "open") :], states[len(stack) + (kind != "open") :]
        if kind == "open":
            tag, label, dropped = stack[-1]
            opened.append(inner(opened[-1], label) if noted(tag, label, dropped) else opened[-1])
            was, new = states[-1], opened[-1] is not opened[-2]
            here = was[0] or opened[-1] in wanted
            seen |= here
            header = was[2] or label == "header*"
            # words count within the part only: what it stands in does not tell
            by_name = was[0] and new and (label[-1:] == "%" or opened[-1] in unwanted or label[-1:] == "!" and opened[-1] not in kept)
            states.append((here, was[1] or dropped or by_name, header and value not in HEADINGS))
            if value in BLOCK:
                flush()
        elif kind == "close":
            if value in BLOCK:
                flush()
        elif kind == "break":
            now.append(" ")
            if value == "hr":
                flush()
        elif kind == "text":
            here, dropped, header = states[-1]
            if here and not dropped and not header:
                now.append(entities.unescape(value))
    flush()
    return "\n".join(blocks), seen


def flat(root: Node) -> str:
    """An expression as JSON: its elements in order, each with its depth."""
    out, todo = [], [(root, 0)]
    while todo:
        (label, sign, slot, inside), depth = todo.pop()
        out.append([depth, label, sign, slot])
        todo += [(c, depth + 1) for c in reversed(inside)]
    return json.dumps(out)


def nested(text: str) -> Node:
    path: list[Node] = []
    for depth, label, sign, slot in json.loads(text):
        node: Node = [label, sign, slot, []]
        del path[depth:]
        if path:
            path[-1][3].append(node)
        path.append(node)
    return path[0]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper, parts, same, most): each host's expression as JSON, and by path its main parts, those that do not vary, and those that
    no name may drop, from all of its pages."""

    @lean
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Node] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": list(found), "wrapper": [flat(w) for w in found.values()]})

        for batch in batches:
            for link, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                host, own = host_of(link), expression(text.as_py() or "")
                found[host] = align(found[host], own) if host in found else own
                if len(found) > MOST_HOSTS:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    @lean
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, node = None, None

        def done() -> pa.RecordBatch:
            parts = main_parts(node)
            paths = {"parts": parts, "same": same_parts(node), "most": most_parts(node, parts)}
            return pa.RecordBatch.from_pydict({"host": [host], "wrapper": [flat(node)]} | {k: pa.array([v], pa.list_(pa.string())) for k, v in paths.items()})

        for batch in batches:
            for h, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if h != host:
                    if host is not None:
                        yield done()
                    host, node = h, nested(w.as_py())
                else:
                    node = align(node, nested(w.as_py()))
        if host is not None:
            yield done()

    partial = pages.select(url, page).mapInArrow(infer, "host string, wrapper string")
    return partial.repartition("host").sortWithinPartitions("host").mapInArrow(combine, "host string, wrapper string, parts array<string>, same array<string>, most array<string>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null pages have an empty text, pages with a null or broken url form a host of their own; every row gives one, null and
    repeated ids included; other columns are ignored; an empty table gives none.
    """
    parts = written(wrappers(pages, url, page).select("host", "parts", "same", "most"), "wrappers")

    @lean
    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, texts = batch.slice(lo, 256), []
                for page, parts, same, most in zip(part.column(2), *(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                    page = page.as_py() or ""
                    text, seen = text_of(page, parts or [], same or [], most or [])
                    if page and not (parts and seen):
                        own = expression(page)
                        text, _ = text_of(page, parts := main_parts(own), (), most_parts(own, parts))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(small_side(parts, BROADCAST_BYTES), "host", "left").select("page_id", "url", "html", "parts", "same", "most")
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
