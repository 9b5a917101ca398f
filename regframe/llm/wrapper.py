"""HTML extraction by inferred wrappers.

A page becomes a tree of block tags with text slots (inline tags belong to the
text; unclosed and implied tags are closed as browsers do). The pages of a host are
aligned one after another into a wrapper, a regular expression without unions:
children that differ become optional, neighbours that repeat become one repeated
node or a repeated group, and texts become slots that know how much text, and how
much of it in links, they hold and whether it is the same on every page.

The wrapper tells which slots are the article: inside the outermost ``article``
and ``main`` where the host has one (without those inside that hold less free text than
the outer one's own: comments and teasers), else inside the deepest node that holds most of the free text;
never inside menus, headers, footers, sidebars, notices, adverts, forms or comments
(by tag, role, or a word of class or id, unless the node so named holds most of the
page's free text; ``html``, ``body``, ``main`` and ``article`` are flagged by no word),
and outside ``article`` and ``main`` never
a text that stays the same from page to page while others change.

Every task merges its pages into one wrapper per host (streaming; what leaves the
task is as large as the wrappers), those are merged by (host, salt), then by host:
all pages are covered and a hot host is no hot task.

Defined cases: a null or empty html gives an empty text; a null url is the host "";
a page that does not fit its host's wrapper is judged by its own tree; repeated
rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

#: Tags of running text: they do not break a block (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never article text.
RAW = "script|style|title|textarea|noscript|template|iframe|svg|math|select|option|object|canvas|audio|video"
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id that name what is not the article.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe signup login "
    "popup modal overlay pagination pager toolbar widget".split()
)
#: Words of comments, which may hold more text than the article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Elements that no word of class or id flags.
CONTENT_TAGS = frozenset("html body main article".split())
AREAS = frozenset(("article", "main"))
#: Containers, whose ids name parts of the template.
ID_TAGS = frozenset("div section table td ul".split())
#: Start tags that close an open element: <p> before any block, and an item before the next.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SALTS = 32
#: A wrapper node with more kids becomes a bag: its kids, told apart by tag and flag only, in any order.
WIDTH = 100
#: Elements nested deeper are open until their own end tag, but no nodes: their texts are slots of
#: the element around. Boilerplate by tag, role or hidden is a node at any depth; so are, up to so many, articles and what a word flags.
DEPTH, AREA_DEPTH = 150, 30
FREE_SHARE = 0.6

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<[/!?a-zA-Z][^<>]*>",
    re.S | re.I,
)
#: One attribute, in sequence: a whole name and its value, so that nothing inside a value is read as a name.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_DIGITS = re.compile(r"[0-9].*")
_SPACE = re.compile(r"\s+")
#: Tags of HTML, and text slots; tags of a page's own making may be any number.
_KNOWN = re.compile(
    r"[!?]?(?:#|html|body|head|main|article|section|nav|aside|header|footer|div|p|h[1-6r]|ul|ol|li|dl|dt|dd|pre|blockquote|figure|"
    r"figcaption|address|hgroup|search|table|caption|colgroup|col|thead|tbody|tfoot|tr|td|th|form|fieldset|legend|details|summary|"
    r"dialog|menu|center|button|input|output|progress|meter|optgroup|link|meta|base|area|map|embed|param|track|frame|frameset)"
)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """A block element: label (tag and the names that matter, "!" before boilerplate), kids and own text slots."""

    __slots__ = ("tag", "names", "kids", "bad", "why", "minor", "text", "links")

    def __init__(self, tag: str, names: str = "", bad: bool = False, why: str = ""):
        self.tag, self.names, self.bad = tag, names, bad
        self.why = why  # what flags the node, where the page's text may overrule it: "word", "comment", "form"
        self.minor = False  # an article inside another one's text: a comment or a teaser
        self.kids: list[Node] = []
        self.text, self.links = "", 0  # of slots (label "#")

    @property
    def label(self) -> str:
        # the flag is part of the label: boilerplate is never aligned or folded with what is none
        return ("!" if self.bad else "?" if self.minor else "") + f"{self.tag} {self.names}".strip()


def _stable(tag: str, found: dict[str, str]) -> str:
    """Words of class, and the id of a container, for the label: from a word's first digit
    on a placeholder stands. Other ids (of posts, headings, paragraphs) are a page's own."""
    words = found.get("class", "").split() + (found.get("id", "").split() if tag in ID_TAGS else [])
    return " ".join(dict.fromkeys(_DIGITS.sub("#", w) for w in words))


def _names(tag: str, attrs: str) -> tuple[str, str]:
    """Class and id without what varies by page, and what flags boilerplate: "", "sure" (role, hidden), "comment" or "word"."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)  # the first of a name counts
    names = [v for k, v in found.items() if k in ("class", "id")]
    if "hidden" in found and found["hidden"].lower() != "false" or found.get("role", "").strip().lower() in BOILER_ROLES:
        return _stable(tag, found), "sure"
    words = {w.lower() for v in names for w in _WORDS.findall(v)} & BOILER_WORDS
    return _stable(tag, found), "comment" if words & COMMENT_WORDS else "word" if words else ""


def _relax(root: Node) -> None:
    """Lift flags that the page's text speaks against: a class or id word on a node with
    most of the free text; for comments (which may be longer than the article) and forms,
    only where they hold the title or hardly anything is left outside."""
    free: dict[Node, int] = {}
    title: set[Node] = set()

    def measure(n: Node) -> None:
        free[n] = max(0, len(n.text) - 2 * n.links)
        for k in n.kids:
            measure(k)
            free[n] += free[k]
            if k.tag in ("h1", "main") or k in title:
                title.add(n)

    def lift(n: Node) -> None:
        for k in n.kids:
            if 2 * free[k] <= free[root]:
                continue
            if k.why == "word" or k.why and (k in title or 10 * free[k] >= 9 * free[root]):
                k.bad = False
            if not k.bad:
                lift(k)

    measure(root)
    lift(root)


def _rank(root: Node) -> None:
    """Tell an ``article`` or ``main`` inside another that is a comment or a teaser there:
    it holds less free text than the outer one has outside of those inside it."""

    def free(n: Node, inner: list[Node]) -> int:
        got = max(0, len(n.text) - 2 * n.links)
        for k in n.kids:
            if k.tag in AREAS and not k.bad:
                inner.append(k)
            elif not k.bad:
                got += free(k, inner)
        return got

    def judge(area: Node) -> int:
        inner: list[Node] = []
        own = free(area, inner)
        sizes = [judge(k) for k in inner]
        for k, size in zip(inner, sizes):
            k.minor = size < own
        return own + sum(sizes)

    outer: list[Node] = []
    free(root, outer)
    for area in outer:
        judge(area)


def parse(page: str) -> Node:
    """The tree of blocks and text slots of a page."""
    root = Node("")
    #: Open elements: tag and the node that takes their kids, whether that is boilerplate for sure, and its depth.
    stack: list[tuple[str, Node, bool, int]] = [("", root, False, 0)]
    opened: dict[str, int] = {}
    buf: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if buf:
            text = _SPACE.sub(" ", _html.unescape("".join(buf))).strip()
            if text:
                slot = Node("#")
                slot.text, slot.links = text, min(links, len(text))
                stack[-1][1].kids.append(slot)
            buf.clear()
            links = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buf.append(piece)
            if in_link:
                links += len(piece.strip())
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
            if tag == "br":
                buf.append(" ")
            continue
        flush()
        in_link = 0
        if m[2]:
            if opened.get(tag):
                last = ""
                while last != tag:
                    last = stack.pop()[0]
                    opened[last] -= 1
            continue
        while len(stack) > 1:
            top = stack[-1][0]
            if top == "p" or top in CLOSED_BY.get(tag, ()):
                stack.pop()
                opened[top] -= 1
            else:
                break
        names, why = _names(tag, m[4]) if m[4] else ("", "")
        if tag in CONTENT_TAGS and why in ("word", "comment"):
            why = ""  # a class word says how such an element looks, not what it is
        if tag in BOILER_TAGS and why != "sure":
            why = "form" if tag in ("form", "fieldset") else "sure"
        node = Node(tag, names, bool(why), "" if why == "sure" else why)
        _, around, inside, depth = stack[-1]
        opens = tag not in VOID and not m[4].endswith("/")
        # deep down only what decides on texts is a node: boilerplate, and articles outside of it
        sure = node.bad and not node.why
        kept = depth < DEPTH or not inside and (sure or depth < DEPTH + AREA_DEPTH and (node.bad or tag in AREAS))
        if kept:
            around.kids.append(node)
        if opens:
            stack.append((tag, node, inside or sure, depth + 1) if kept else (tag, around, inside, depth))
            opened[tag] = opened.get(tag, 0) + 1
    buf.append(page[at:])
    flush()
    _relax(root)
    _rank(root)
    return root


# --- wrappers -------------------------------------------------------------------
# A wrapper node is a dict: l label, k kids, b boilerplate (or comment or teaser), o optional, r repeated,
# n pages, and for slots c characters, a characters in links, t the 128-bit hash
# of the text if it was the same so far (None once it changed). Label "()" is a repeated group, g marks a bag.


def learn(node: Node) -> dict:
    """A page's tree as a wrapper, repeats folded."""
    w = {"l": node.label, "b": node.bad or node.minor, "o": False, "r": False, "n": 1}
    if node.label == "#":
        t = node.text
        return w | {"c": len(t), "a": node.links, "t": blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()}
    return _narrow(w, [learn(k) for k in node.kids])


def _plain(label: str) -> str:
    """A label's flag and tag, the only thing kids of a bag are told apart by; unknown tags are alike."""
    tag = label.split(" ", 1)[0]
    return tag if _KNOWN.fullmatch(tag) else (tag[0] if tag[0] in "!?" else "") + "unknown"


def _flat(kids: list[dict]) -> list[dict]:
    """The kids with groups opened."""
    return [x for k in kids for x in (_flat(k["k"]) if k["l"] == "()" else [k])]


def _narrow(w: dict, kids: list[dict]) -> dict:
    """``w`` with these kids, folded; as a bag if they are many or ``w`` is one already."""
    if not w.get("g"):
        kids = fold(kids)
        if w["l"] == "()" or len(_flat(kids)) <= WIDTH:
            w["k"] = kids
            return w
    bag: dict[str, dict] = {}
    for x in _flat(kids):
        x = x | {"l": _plain(x["l"]), "o": True, "r": x["l"] != "#"}
        bag[x["l"]] = merge(bag[x["l"]], x, repeat=True) if x["l"] in bag else x
    w["k"], w["g"] = [bag[x] for x in sorted(bag)], True
    return w


def fold(kids: list[dict]) -> list[dict]:
    """Equal neighbours become one repeated node, repeated runs one repeated group."""
    out: list[dict] = []
    for k in kids:
        if out and out[-1]["l"] == k["l"] and k["l"] != "()":
            out[-1] = merge(out[-1], k, repeat=True)
        else:
            out.append(k)
    for size in range(2, 7):
        i = 0
        while i + 2 * size <= len(out):
            labels = [k["l"] for k in out[i : i + size]]
            if labels == [k["l"] for k in out[i + size : i + 2 * size]]:
                inside = [merge(a, b, repeat=True) for a, b in zip(out[i : i + size], out[i + size : i + 2 * size])]
                j = i + 2 * size
                while labels == [k["l"] for k in out[j : j + size]]:
                    inside = [merge(a, b, repeat=True) for a, b in zip(inside, out[j : j + size])]
                    j += size
                for a in inside:
                    a["r"] = a["r"] and a["l"] != "#"
                out[i:j] = [{"l": "()", "b": False, "o": False, "r": True, "n": 1, "k": inside}]
            i += 1
    return out


def _key(w: dict) -> str:
    """What alignment compares: the label, for a group the labels inside."""
    return w["l"] if w["l"] != "()" else "(" + "|".join(_key(k) for k in w["k"]) + ")"


def _align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of indexes of a longest common subsequence, the rest with None."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(lead)]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((lead + i, lead + j))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append((lead + i, None))
            i += 1
        else:
            out.append((None, lead + j))
            j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def merge(a: dict, b: dict, *, repeat: bool = False) -> dict:
    """One wrapper for both: of two pages, or (``repeat``) of two neighbours on one."""
    w = {"l": a["l"], "b": a["b"], "o": a["o"] or b["o"], "r": a["r"] or b["r"] or repeat}
    w["n"] = max(a["n"], b["n"]) if repeat else a["n"] + b["n"]
    if a["l"] == "#":
        return w | {"c": a["c"] + b["c"], "a": a["a"] + b["a"], "t": a["t"] if a["t"] == b["t"] else None}
    x, y = a["k"], b["k"]
    if a.get("g") or b.get("g"):
        return _narrow(w | {"g": True}, x + y)
    kids = []
    for i, j in _align([_key(k) for k in x], [_key(k) for k in y]):
        if i is not None and j is not None:
            kids.append(merge(x[i], y[j], repeat=repeat))
        else:
            kids.append((x[i] if j is None else y[j]) | {"o": True})
    return _narrow(w, kids)


def choose(w: dict) -> dict:
    """Mark the slots of the article (``m``) in a host's wrapper."""
    areas: list[dict] = []

    def walk(n: dict, out: bool) -> int:
        """Free text below (outside links and boilerplate); ``out``: in boilerplate or an area."""
        if n["l"] == "#":
            n["f"] = max(0, n["c"] - 2 * n["a"])
            return n["f"]
        is_area = not n["b"] and n["l"].split(" ", 1)[0] in AREAS
        n["f"] = sum([walk(k, out or n["b"] or is_area) for k in n["k"]])
        if n["b"]:
            n["f"] = 0
        if is_area and not out and n["f"] > 0:
            areas.append(n)
        return n["f"]

    total = walk(w, False)
    changing = _changes(w)
    if not areas:
        best = w
        while True:
            below = [k for k in _flat(best["k"]) if "k" in k and not k["b"]]
            top = max(below, key=lambda k: k["f"], default=None)
            if top is None or top["r"] or top["f"] < FREE_SHARE * max(total, 1) or not any("k" in k for k in top["k"]):
                break
            best = top
        areas.append(best)
        _mark(best, changing)
    else:
        for a in areas:
            _mark(a, False)
    return w


def _changes(w: dict) -> bool:
    """Whether some slot outside boilerplate differs between pages."""
    return w["t"] is None if w["l"] == "#" else any(_changes(k) for k in w["k"] if not k["b"])


def _mark(n: dict, drop_constant: bool) -> None:
    if n["l"] == "#":
        n["m"] = not (drop_constant and n["n"] > 2 and n["t"] is not None)
    elif not n["b"]:
        for k in n["k"]:
            _mark(k, drop_constant)


def blocks(node: Node, w: dict) -> list[str] | None:
    """Texts of the slots that ``w`` marks, in page order; None if the page does not fit."""
    out: list[str] = []

    def step(n: Node, w: dict) -> bool:
        if n.label == "#":
            if w.get("m"):
                out.append(n.text)
            return True
        # the wrapper's kids in order, groups opened; a repeat goes back to its group's start
        flat = _flat(w["k"])
        at = 0
        for kid in n.kids:
            label = _plain(kid.label) if w.get("g") else kid.label
            hit = next((i for i in range(at, len(flat)) if flat[i]["l"] == label), None)
            if hit is None:
                hit = next((i for i in range(at) if flat[i]["l"] == label), None)
            if hit is None or not step(kid, flat[hit]):
                return False
            at = hit
        return True

    return out if step(node, w) else None


def main_text(page: str | None, wrapper: dict | None) -> str:
    if not page:
        return ""
    tree = parse(page)
    got = blocks(tree, wrapper) if wrapper else None
    if not got:  # does not fit, or the host's article is missing here: the page by itself
        got = blocks(tree, choose(learn(tree)))
    return "\n\n".join(got or [])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


#: Wrappers of up to so many bytes in all are broadcast, looked up by host.
BROADCAST = 48_000_000

_WRAPPER = T.StructType([T.StructField("host", T.StringType()), T.StructField("wrapper", T.StringType())])


def infer(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """One wrapper (JSON, slots of the article marked) per host, from all pages."""
    common.short_batches(pages.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page:
                    w = learn(parse(page))
                    held[host] = merge(held[host], w) if host in held else w
        names = ["host", "wrapper"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=names
        )

    def together(df: pd.DataFrame) -> dict:
        all_of = iter(sorted(df["wrapper"]))
        w = json.loads(next(all_of))
        for x in all_of:
            w = merge(w, json.loads(x))
        return w

    def salted(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(together(df))]})

    def final(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(choose(together(df)))]})

    src = pages.select(host_of(pages[f"`{url}`"]).alias("host"), pages[f"`{html}`"].alias("html"))
    parts = src.mapInArrow(local, _WRAPPER)
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInPandas(salted, _WRAPPER)
    return parts.groupBy("host").applyInPandas(final, _WRAPPER)


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Per page: struct ``row`` (the ``carry`` columns) and ``text``."""
    wrappers = common.written(infer(pages, url=url, html=html), "wrappers")
    src = pages.select(
        F.struct(*[pages[f"`{c}`"].alias(c) for c in carry]).alias("row"),
        host_of(pages[f"`{url}`"]).alias("page_host"),
        pages[f"`{html}`"].alias("html"),
    )
    schema = T.StructType([src.schema["row"], T.StructField("text", T.StringType())])
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    by_host = None
    if size <= BROADCAST:
        by_host = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
        src = src.select("row", "html", F.col("page_host").alias("wrapper"))
    else:
        src = src.join(wrappers, F.col("page_host") == F.col("host"), "left").select("row", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key is not None and key not in known:
                    if len(known) >= 256:
                        known.clear()
                    w = by_host.value.get(key) if by_host else key
                    known[key] = json.loads(w) if w else None
                texts.append(main_text(page, known.get(key)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return src.mapInArrow(run, schema)
