"""Main text of web pages by wrappers: regular expressions without unions, inferred for each host.

1. Each page becomes a stream of block tags and text slots; runs that repeat
   in tandem fold into repeated groups.  Equal streams of a host are counted
   once (combined before the shuffle), so a host with a third of all pages is
   a few rows a task.
2. A host's streams are aligned one after the other.  Where two streams
   differ, texts become a slot, a group that repeats in one is a repeated
   group, and what only one has is an optional group; the result, the host's
   wrapper, matches all its pages.  Alignment runs in a tree over chunks of
   bounded size and never gathers a host in one task.
3. Each page is matched against its host's wrapper, which gives each of its
   texts a slot: a place in the wrapper, so two blocks of one kind at different
   places are different slots (a text whose place is not found stands for its
   path of labels).  A slot is told by where it stands and by what
   the host's pages hold in it: slots inside menus, headers, footers, sidebars,
   notices, adverts, forms and reader comments are not content; a slot that
   reads the same on pages of different main texts is template text.
4. Each page is matched again and keeps the texts in its content slots: those
   in its article or main element, else those inside the lowest wrapper node
   that holds all of the page's varying text that is not mostly links, without
   the template text before and behind that text.  So a host may hold any
   number of templates; a page without a host is judged by itself.

Defined cases: null or empty html, and an empty table's pages, give an empty
text or no rows; a page without a host belongs to the host ''; character
references are decoded; white space is what Unicode calls so, no-break and
ideographic spaces too; a quote opens a value only behind an equals sign;
unclosed and misnested tags close as browsers close them; pages cut short end
where they end, a last tag without its end is no text; repeated rows give
repeated rows, and copies of a page make none of its text template text; a
page of very many siblings is matched in time that grows with their number;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .kernel import tidy
from .store import BROADCAST_BYTES, cut, meet, table

#: Streams aligned by one call; a host with more is aligned in a tree.
CHUNK = 64
#: A slot is a template's own text if it reads the same on pages of so many different main texts or more.
CONSTANT_PAGES = 3
#: Siblings times siblings up to which two lists are aligned by a table, beyond it by one walk.
TABLE = 1 << 18
#: Blocks nested deeper than this only part texts, they are no nodes of their own.
DEPTH = 100
#: Between a label and its place among a wrapper's siblings.
AT = "\x1f"

_BLOCK = frozenset(
    "html head body div section article main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset address details summary center menu dialog hgroup".split()
)
_VOID_BREAK = frozenset("br hr wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object canvas textarea select button audio video noframes title".split())
_OUT = frozenset("head nav footer aside form menu dialog fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"html", "head", "body"}
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share "
    "sharing social related recommended comment comments commentlist disqus reply replies respond pagination pager toolbar widget widgets login search skip".split()
)
#: Words that say nothing beside one of the above.
_PLACE_WORDS = frozenset("site list box area wrap wrapper container link links button buttons bar left right top bottom 0".split())
#: A container named so in part only is content if it holds this share of its page, mostly not links.
PART_SHARE = 0.05
LINKED_SHARE = 0.5
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: No container of a main text by themselves.
_PARTS = _HEADING | {"p", "li", "td", "th", "tr"}
_KEEPS_CLASS = frozenset("html body main article".split())
#: A comment or the like; a tag; a tag that the page's end cuts off; text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|</?[a-zA-Z][^>]*\Z|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


@lru_cache(maxsize=4096)
def _label(tag: str, attrs: str) -> str:
    """A block tag with what of its attributes tells its place: '-' marks it as never content, '~' as named so in part, '+' as main."""
    found: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs) if attrs else ():
        found.setdefault(k.lower(), (v or "").strip("\"'").lower())
    names = sorted(re.sub(r"\d+", "0", x).replace("/", "|") for x in f"{found.get('class', '')} {found.get('id', '')}".split())
    role = found.get("role", "")
    out = tag in _OUT or role in _OUT_ROLE or "hidden" in found or found.get("aria-hidden") == "true" or tag == "header"
    part = False
    for words in (set(re.split("[-_]+", x)) for x in names if tag not in _KEEPS_CLASS and not re.match(r"(?:has|with|no|without)[-_]", x)):
        if words & _OUT_WORDS:
            part = True
            out = out or words <= _OUT_WORDS | _PLACE_WORDS
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articlebody"
    return ("-" if out else "~" if part else "") + ("+" if main else "") + tag + "".join("." + x for x in dict.fromkeys(names))


def read(page: str):
    """Yield ('<', label), ('>', label) and ('#', (text, linked share)) in page order, tags balanced."""
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = total = in_a = deep = 0
    at, n = 0, len(page)

    def flush():
        nonlocal linked, total
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            share = linked / total if total else 0.0
            linked = total = 0
            if joined:
                return ("#", (joined, share))
        return None

    match = _TOKEN.match
    while at < n:
        m = match(page, at)
        at = m.end()
        if m[4] is not None:
            text.append(m[4])
            total += len(m[4])
            linked += len(m[4]) * (in_a > 0)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_a = max(0, in_a - 1)
            if tag in _BLOCK and deep:
                deep -= 1
                if (t := flush()) is not None:
                    yield t
            elif tag in _BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if (t := flush()) is not None:
                            yield t
                        while len(stack) > k:
                            yield (">", stack.pop()[1])
                        in_a = 0
                        break
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            text.append(" ")
            continue
        if tag in _VOID_BREAK:
            text.append(" ")
            if tag == "hr" and (t := flush()) is not None:
                yield t
            continue
        if tag not in _BLOCK:
            in_a += tag == "a"
            continue
        if (t := flush()) is not None:
            yield t
        in_a = 0
        if deep or len(stack) >= DEPTH:
            deep += 1
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                open_tag = stack[k][0]
                if open_tag == "p" or open_tag == tag == "li" or (tag in ("td", "th", "tr") and open_tag in ("td", "th")) or (tag in ("dt", "dd") and open_tag in ("dt", "dd")):
                    while len(stack) > k:
                        yield (">", stack.pop()[1])
                    break
                if open_tag in ("ul", "ol", "table", "td", "th", "div", "section", "article", "main", "body", "dl"):
                    break
        label = _label(tag, m[3])
        stack.append((tag, label))
        yield ("<", label)
    if (t := flush()) is not None:
        yield t
    while stack:
        yield (">", stack.pop()[1])


# --- wrappers ---------------------------------------------------------------
# An item is '#' (a text slot), ['n', label, items] (a block) or a group [kind, items] with kind '?' or '+'.


def fold(items: list, longest: int = 24) -> list:
    """Tandem repeats of runs of siblings become one repeated group; a longer run only stays written out."""
    out: list = []
    for x in items:
        out.append(x)
        while True:
            for k in range(1, min(longest, len(out) // 2) + 1):
                tail = out[-k:]
                if tail == out[-2 * k : -k]:
                    del out[-2 * k :]
                    out.append(["+", tail] if not (k == 1 and isinstance(tail[0], list) and tail[0][0] == "+") else tail[0])
                    break
                before = out[-k - 1]
                if isinstance(before, list) and before[0] == "+" and before[1] == tail:
                    del out[-k:]
                    break
            else:
                break
    return out


def _folded(siblings: list) -> list:
    """A page's siblings as wrapper items, the innermost folded first."""
    return fold(["#" if label == "#" else ["n", label, _folded(value)] for label, value in siblings])


def _core(x) -> tuple[str, object]:
    """(kind of group or '', the single member or the whole body)."""
    if isinstance(x, list) and x[0] in "?+":
        return x[0], x[1]
    return "", [x]


def _same(a, b) -> bool:
    """Whether two items may stand for the same part of a page."""
    ka, xa = _core(a)
    kb, xb = _core(b)
    if ka == "?" or kb == "?" or (ka == "+") or (kb == "+"):
        return len(xa) == len(xb) and all(_same(x, y) for x, y in zip(xa, xb, strict=True))
    x, y = xa[0], xb[0]
    if x == "#" or y == "#":
        return x == y
    return x[1] == y[1]


def _join(a, b):
    ka, xa = _core(a)
    kb, xb = _core(b)
    if not ka and not kb:
        return a if a == "#" else ["n", a[1], align(a[2], b[2])]
    body = [_join(x, y) for x, y in zip(xa, xb, strict=True)]
    kinds = {ka, kb}
    if "?" in kinds:
        return ["?", [_repeat(body)] if "+" in kinds else body]
    return _repeat(body)


def _repeat(body: list) -> list:
    """A repeated group; of a group that repeats already, that group."""
    if len(body) == 1 and isinstance(body[0], list) and body[0][0] == "+":
        return body[0]
    return ["+", body]


def align(a: list, b: list) -> list:
    """The wrapper of two sibling lists: a common subsequence, the rest optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    pairs = _pairs(a, b) if n * m <= TABLE else _walk(a, b)
    out: list = []
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        while i < x or j < y:
            one = a[i] if i < x else b[j]
            i, j = (i + 1, j) if i < x else (i, j + 1)
            # one more of what already repeats, or the second of two alike, joins that group
            if out and _same(out[-1], one):
                merged = _join(out[-1], one)
                kind, body = _core(merged)
                out[-1] = ["?", [_repeat(body)]] if kind == "?" else _repeat([merged])
            else:
                out.append(one if _core(one)[0] == "?" else ["?", [one]])
        if x < n:
            out.append(_join(a[x], b[y]))
            i, j = x + 1, y + 1
    return out


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places."""
    n, m = len(a), len(b)
    alike = [[_same(x, y) for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if alike[i][j] else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if alike[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _kind(x) -> str:
    """What two items that may stand for the same part have in common."""
    _, body = _core(x)
    while isinstance(body[0], list) and body[0][0] in "?+":
        body = body[0][1]
    return "#" if body[0] == "#" else body[0][1]


def _walk(a: list, b: list) -> list[tuple[int, int]]:
    """A common subsequence of long lists: each item of a with the next of its kind in b, unless that is far off."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, y in enumerate(b):
        where[_kind(y)].append(j)
    out, j = [], 0
    reach = max(64, 2 * abs(len(a) - len(b)))
    for i, x in enumerate(a):
        at = where.get(_kind(x), [])
        k = bisect_left(at, j)
        if k < len(at) and at[k] - j <= reach and _same(x, b[at[k]]):
            out.append((i, at[k]))
            j = at[k] + 1
    return out


def stream(page: str) -> str:
    """The folded stream of a page, as text (what is counted and aligned)."""
    return json.dumps(_folded(_page_tree(list(read(page)))), ensure_ascii=False, separators=(",", ":"))


class Level:
    """Siblings of a wrapper in a row, groups opened: what each place takes, and the repeated groups it stands in."""

    def __init__(self, wrapper: list, path: str = ""):
        self.items: list[tuple[str, Level | None, str]] = []
        self.loops: list[tuple[int, int]] = []
        self._fill(wrapper, path)
        self.where: dict[str, list[int]] = defaultdict(list)
        for k, (label, _, _) in enumerate(self.items):
            self.where[label].append(k)
        m = len(self.items)
        # from behind a place, what to search, innermost group first: on in the group, again from its beginning, on beyond
        self.spans = [[x for s, e in sorted(self.loops, key=lambda g: g[1] - g[0]) if s < j <= e for x in ((j, e), (s, j))] + [(j, m)] for j in range(m + 1)]
        self.from_ = [min([s for s, e in self.loops if s < j <= e], default=j) for j in range(m + 1)]

    def _fill(self, wrapper: list, path: str) -> None:
        for x in wrapper:
            if x == "#":
                self.items.append(("#", None, f"{path}/#{AT}{len(self.items)}"))
            elif x[0] == "n":
                here = f"{path}/{x[1]}{AT}{len(self.items)}"
                self.items.append((x[1], Level(x[2], here), here))
            else:
                begin = len(self.items)
                self._fill(x[1], path)
                if x[0] == "+":
                    self.loops.append((begin, len(self.items)))

    def places(self, labels: list[str]) -> list[int]:
        """The place of each of a page's siblings; -1 for one that the wrapper does not have there."""
        out, j = [], 0
        for label in labels:
            at = self.where.get(label, ())
            k = -1
            for low, high in self.spans[j] if at else ():
                x = bisect_left(at, low)
                if x < len(at) and at[x] < high:
                    k = at[x]
                    break
            out.append(k)
            j = k + 1 if k >= 0 else j
        if -1 in out and len(labels) * len(self.items) <= TABLE:
            return self._most(labels)
        return out

    def _most(self, labels: list[str]) -> list[int]:
        """As above, with as many siblings placed as can be."""
        n, m = len(labels), len(self.items)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        step = [[-1] * (m + 1) for _ in range(n)]
        for i in range(n - 1, -1, -1):
            at = self.where.get(labels[i], ())
            after = best[i + 1]
            for j in range(m + 1):
                most, to = after[j], -1
                for k in at:
                    if k >= self.from_[j] and after[k + 1] + 1 > most:
                        most, to = after[k + 1] + 1, k
                best[i][j], step[i][j] = most, to
        out, j = [], 0
        for i in range(n):
            k = step[i][j]
            out.append(k)
            j = k + 1 if k >= 0 else j
        return out


def _page_tree(tokens: list) -> list:
    """A page's siblings: [label, children] and ['#', (text, linked share)]."""
    root: list = []
    stack = [root]
    for kind, value in tokens:
        if kind == "<":
            node = [value, []]
            stack[-1].append(node)
            stack.append(node[1])
        elif kind == ">":
            stack.pop()
        else:
            stack[-1].append(["#", value])
    return root


def match(tokens: list, wrapper: Level | None) -> list[tuple[str, str, float]]:
    """(slot, text, linked share) of each text of a page in order; without a wrapper a slot is the path of labels."""
    out: list[tuple[str, str, float]] = []
    todo: list = [(_page_tree(tokens), wrapper, "")]
    while todo:
        siblings, level, path = todo.pop()
        if isinstance(level, str):  # a text
            out.append((level, *siblings))
            continue
        places = level.places([x[0] for x in siblings]) if level else [-1] * len(siblings)
        later = []
        for (label, value), k in zip(siblings, places, strict=True):
            _, inner, here = level.items[k] if k >= 0 else ("", None, f"{path}/{label}")
            later.append((value, here if label == "#" else inner, here))
        todo += reversed(later)
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a readable regular expression."""
    def one(x) -> str:
        if x == "#":
            return "#"
        if x[0] == "n":
            return f"<{x[1]}>{expression(x[2])}</{x[1].lstrip('-~+')}>"
        return f"({expression(x[1])}){x[0]}"
    return "".join(map(one, wrapper))


# --- which slots are content --------------------------------------------------


def _parts(path: str) -> list[str]:
    return [x.partition(AT)[0] for x in path.split("/")[1:]]


def _excluded(path: str, by_class: bool) -> bool:
    inside = False
    parts = _parts(path)
    for part in parts:
        name = part.lstrip("-~+").split(".")
        if part[0] == "-":
            if name[0] == "header" and inside and len(name) == 1:
                if not any(x.lstrip("-~+").split(".")[0] in _HEADING for x in parts):
                    return True
            elif by_class or name[0] in _OUT or name[0] == "header":
                return True
        inside = inside or "+" in part[:2]
    return False


def host_slots(stats: dict[str, tuple[int, int, float, bool]]) -> list[tuple[str, float, float, bool]]:
    """(slot, unlinked and linked characters a page, template text) of the slots that may be content. stats: slot -> (pages, characters, linked characters, template text)."""
    varying = {p: chars - linked for p, (_, chars, linked, constant) in stats.items() if not constant}
    # names mean nothing on a host where they leave out nearly all text
    by_class = sum(v for p, v in varying.items() if not _excluded(p, True)) >= 0.1 * (sum(varying.values()) or 1)
    return [(p, (chars - linked) / n, linked / n, constant) for p, (n, chars, linked, constant) in stats.items() if not _excluded(p, by_class)]


def _small_parts(found: dict[str, tuple[float, float, bool]]) -> set[str]:
    """Slots inside containers that are named as never content in part, and hold little of the page or mostly links."""
    inside: dict[str, list[str]] = defaultdict(list)
    for p in found:
        if "/~" in p:
            nodes = p.split("/")
            for k, x in enumerate(nodes):
                if x[:1] == "~":
                    inside["/".join(nodes[: k + 1])].append(p)
    whole = sum(w for w, _, constant in found.values() if not constant)
    out: set[str] = set()
    for container, paths in inside.items():
        plain, linked = (sum(found[p][i] for p in paths) for i in (0, 1))
        little = plain < PART_SHARE * whole and "+" not in container
        if little or linked >= LINKED_SHARE * (plain + linked):
            out.update(paths)
    return out if len(out) < len(found) else set()


def content_slots_of(found: dict[str, tuple[float, float, bool]]) -> frozenset[str]:
    """The content slots among those of one page. found: slot -> (weight, linked characters, template text).

    Template text and lists of links have no say in where the main container is.
    Inside an article or main element they are content.  Inside a container found
    by its varying text, template text is content from that text's beginning to
    its end, and headings before it.
    """
    small = _small_parts(found)
    found = {p: x for p, x in found.items() if p not in small}
    varying = [p for p, (w, linked, constant) in found.items() if not constant and linked < LINKED_SHARE * (w + linked)]
    mains = [p for p in found if any("+" in x[:2] for x in _parts(p))]
    if mains and sum(found[p][0] for p in varying if p in mains) >= 0.3 * sum(found[p][0] for p in varying):
        return frozenset(mains)
    if not varying:
        return frozenset(p for p, (_, _, constant) in found.items() if not constant)
    nodes = [p.split("/")[:-1] for p in varying]
    depth = 0
    while all(len(x) > depth for x in nodes) and len({x[depth] for x in nodes}) == 1:
        depth += 1
    while depth and _parts("/" + nodes[0][depth - 1])[0].lstrip("-~+").split(".")[0] in _PARTS:
        depth -= 1
    main = "/".join(nodes[0][:depth]) + "/"
    inside = [p for p in found if p.startswith(main)]
    first, last = inside.index(varying[0]), inside.index(varying[-1])

    def belongs(k: int, p: str) -> bool:
        heading = any(x.lstrip("-~+").split(".")[0] in _HEADING for x in _parts(p))
        return not found[p][2] or first <= k <= last or (heading and k < first)

    return frozenset(p for k, p in enumerate(inside) if belongs(k, p))


# --- the operator -------------------------------------------------------------


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _streams(batches):
    """Streams, one row for each host and stream in a batch."""
    for batch in batches:
        seen = {(host_of(url), stream(page)) for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if page and host_of(url)}
        hosts, shapes = zip(*sorted(seen), strict=True) if seen else ((), ())
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(shapes, pa.string())], ["host", "shape"])


def _observe(url: str | None, found: list[tuple[str, str, float]], seen: dict[tuple[str, str], list]) -> None:
    """Count a page's slots: pages, characters, linked characters, least and greatest hash of whole texts, prints.

    prints are hashes of the pages' longest texts outside menus and the like, by
    which copies and near copies of a page count once; CONSTANT_PAGES are enough.
    """
    host = host_of(url)
    longest = (False, 0, 0)
    met: dict[str, list] = {}
    for slot, text, share in found:
        row = seen.setdefault((host, slot), [0, 0, 0.0, None, None, set()])
        row[0] += slot not in met
        met[slot] = row
        row[1] += len(text)
        row[2] += len(text) * share
        h = _hash(text)
        row[3] = h if row[3] is None else min(row[3], h)
        row[4] = h if row[4] is None else max(row[4], h)
        longest = max(longest, (not _excluded(slot, True), len(text), h))
    for row in met.values():
        if len(row[5]) < CONSTANT_PAGES:
            row[5].add(longest[2])


_SEEN = "host string, slot string, n long, chars long, linked double, least long, most long, prints array<long>"


def _observed(seen: dict[tuple[str, str], list]) -> pa.RecordBatch:
    keys = list(seen)
    cols = list(zip(*(seen[k] for k in keys), strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([k[i] for k in keys], pa.string()) for i in range(2)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [pa.array([sorted(x) for x in cols[5]], pa.list_(pa.int64()))], ["host", "slot", "n", "chars", "linked", "least", "most", "prints"])


def _align_batches(batches):
    """Rows (host, chunk, streams) to (host, chunk, wrapper)."""
    for batch in batches:
        out = []
        for shapes in batch.column(2).to_pylist():
            trees = [json.loads(s) for s in sorted(shapes, key=lambda s: (len(s), s))]
            wrapper = trees[0]
            for t in trees[1:]:
                wrapper = align(wrapper, t)
            out.append(json.dumps(wrapper, ensure_ascii=False, separators=(",", ":")))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["host", "chunk", "shape"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host; pages: (url, html)."""
    ship(pages.sparkSession)
    shapes = cut(pages.mapInArrow(tidy(_streams), "host string, shape string").distinct())
    while True:
        counted = shapes.groupBy("host").agg(F.count("*").alias("n"))
        most = counted.agg(F.max("n")).first()[0] or 0
        chunks = F.ceil(F.col("_n") / CHUNK)
        dealt = shapes.join(counted.select(F.col("host").alias("_h"), F.col("n").alias("_n")), F.col("host") == F.col("_h")).withColumn("chunk", F.pmod(F.xxhash64("shape"), chunks))
        grouped = dealt.groupBy("host", "chunk").agg(F.collect_list("shape").alias("shapes"))
        shapes = grouped.mapInArrow(_align_batches, "host string, chunk long, shape string")
        if most <= CHUNK:
            return shapes.select("host", F.col("shape").alias("wrapper"))
        shapes = cut(shapes)


_SLOTS = "array<struct<path: string, weight: double, linked: double, same: boolean>>"


def slot_rules(seen: DataFrame) -> DataFrame:
    """(host, slots): the wrappers' slots that may be content, from rows of _SEEN."""
    per = seen.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("most").alias("most"), F.array_distinct(F.flatten(F.collect_set("prints"))).alias("prints"))
    same = (F.col("least") == F.col("most")) & (F.size("prints") >= CONSTANT_PAGES)
    stats = per.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "chars", "linked", same.alias("same"))).alias("slots"))
    kind = pa.list_(pa.struct([("path", pa.string()), ("weight", pa.float64()), ("linked", pa.float64()), ("same", pa.bool_())]))

    def task(batches):
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                ordered = {s["slot"]: (s["n"], s["chars"], s["linked"], s["same"]) for s in sorted(found, key=lambda s: s["slot"])}
                out.append([dict(zip(("path", "weight", "linked", "same"), x, strict=True)) for x in host_slots(ordered)])
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["host", "slots"])

    return stats.mapInArrow(task, f"host string, slots {_SLOTS}")


def page_text(found: list[tuple[str, str, float]], rules: dict[str, tuple[float, float, bool]] | None) -> str:
    """Text in the content slots of a matched page; rules: its host's slots (slot -> weight, linked characters, template text), None without a host.

    Slots are chosen among the page's own, so pages of another template on the
    host have no say in them.  A slot weighs what it holds on the host's pages
    that have it, or on this page if that is more.
    """
    own: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for slot, text, share in found:
        own[slot][0] += len(text) * (1 - share)
        own[slot][1] += len(text) * share
    if rules is None or not any(p in rules for p in own):  # all of this page is named as its host's menus are
        rules = {p: tuple(x) for p, *x in host_slots({p: (1, a + b, b, False) for p, (a, b) in own.items()})}
    keep = content_slots_of({p: (max(rules[p][0], a), max(rules[p][1], b), rules[p][2]) for p, (a, b) in own.items() if p in rules})
    return "\n\n".join(text for slot, text, _ in found if slot in keep)


def main_text(page: str | None) -> str:
    """The main text of a page judged by itself."""
    return page_text(match(list(read(page or "")), None), None)


@lru_cache(maxsize=256)
def _level(wrapper: str) -> Level:
    return Level(json.loads(wrapper))


class _Hosts:
    """What each task needs of the hosts: a broadcast where its checked size allows, else a join in which pages of large hosts do not move."""

    def __init__(self, per_host: DataFrame, values: list[str], n_bytes: Column):
        self.per_host, self.values = cut(per_host.select("host", *values)), values
        got = self.per_host.agg(F.sum(n_bytes).alias("b")).first()["b"] or 0
        self.small = got <= BROADCAST_BYTES
        if self.small:
            held = {r["host"]: tuple(r[v] for v in values) for r in self.per_host.collect()}
            self.shared = per_host.sparkSession.sparkContext.broadcast(held)

    def map(self, pages: DataFrame, need: list[str], work, schema: str) -> DataFrame:
        """work(rows of the columns need, one tuple of values or None for each row) -> record batch; pages have url."""
        if self.small:
            shared, url = self.shared, need.index("url")

            def task(batches):
                for batch in batches:
                    cols = [c.to_pylist() for c in batch.columns]
                    yield work(cols, [shared.value.get(host_of(u)) for u in cols[url]])

            return pages.select(*need).mapInArrow(tidy(task), schema)
        host = F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit(""))
        rows = pages.select(*need, host.alias("host"))
        n_rows = rows.count()
        counts = rows.groupBy("host").agg(F.count("*").alias("many"))
        per = cut(counts.join(self.per_host.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h"), "left").select("host", "many", F.struct(*self.values).alias("held"), F.col("_h").isNotNull().alias("known")))

        def joined(batches):
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns]
                held = [tuple(h.values()) if ok else None for h, ok in zip(cols[-2], cols[-1], strict=True)]
                yield work(cols[:-2], held)

        return meet(rows, per, "host", "many", n_rows).select(*need, "held", "known").mapInArrow(tidy(joined), schema)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    need = pages.select("page_id", "url", "html")
    found = _Hosts(wrappers(need.select("url", "html")), ["wrapper"], F.length("wrapper") + 64)

    def observe(cols, held):
        seen: dict[tuple[str, str], list] = {}
        for url, page, wrapper in zip(*cols, held, strict=True):
            if page and wrapper:
                _observe(url, match(list(read(page)), _level(wrapper[0])), seen)
        return _observed(seen)

    rules = slot_rules(found.map(need, ["url", "html"], observe, _SEEN)).withColumnRenamed("host", "_rh")
    both = found.per_host.join(rules, F.col("host") == F.col("_rh"), "left").select("host", "wrapper", "slots")
    size = F.length("wrapper") + 64 + F.coalesce(F.aggregate("slots", F.lit(0), lambda a, x: a + F.length(x["path"]) + 64), F.lit(0))
    ruled = _Hosts(both, ["wrapper", "slots"], size)

    def read_text(cols, held):
        texts, known = [], {}
        for url, page, host in zip(cols[1], cols[2], held, strict=True):
            if host is None:
                texts.append(main_text(page))
                continue
            name = host_of(url)
            if name not in known:
                known[name] = {x["path"]: (x["weight"], x["linked"], x["same"]) for x in host[1] or []}
            texts.append(page_text(match(list(read(page or "")), _level(host[0])), known[name]))
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ruled.map(need, ["page_id", "url", "html"], read_text, "page_id bigint, url string, text string, n_chars bigint")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
