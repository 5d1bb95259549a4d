"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A token is the start or the end of a block element on its path, or a line of text on its path. Tokens of a host whose
occurrence vectors over its pages are equal form a class. A class is valid if its tokens come in one order on the pages,
again and again, and if its occurrences nest: each lies whole within a gap between two neighbouring tokens of another. The
valid classes, nested this way, are the host's template. Text that is a token of it is fixed; what stands in the gaps are
the slots, told apart by the gaps that they lie in from the outside in.

Slots are judged once a host, by what all its pages have there: a slot that is mostly links, or mostly within elements that
are marked as no part of an article, is out. The article is the article or main element of the template that holds most of
the text; on hosts that mark none, the least part of the template that does, extended as long as no slot that is out comes
in. What lies outside of it is out as well, but for first-rank headings.

Three passes over the pages: occurrence vectors, orders with what the slots hold, and the text. Vectors are compared by
hashes that add up over pages, so tasks send one row per token and batch, and a host with a third of all pages is no heavier
than another.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_or_empty

#: Least pages of a host from which a template is deduced, and least share of them that a class occurs on.
LEAST_PAGES, SUPPORT = 4, 0.6
#: Least share of its pages on which a class must keep its order.
ORDERED = 0.9
#: A slot with at least this share of its letters in links is a menu; least share of the text that the article holds.
LINKED, MOST = 0.7, 0.6
#: Under this share of free text a template isn't believed: pages that are copies of one another look fixed throughout.
FREE = 0.05
#: Bytes of templates that are broadcast; beyond that pages meet them by host, dealt out in so many parts a host.
BROADCAST_BYTES, SALTS = 16 << 20, 64

# fixed values: element names of HTML, and words that name parts of pages
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "dialog"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUT_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "search"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note"}
OUT_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "search",
    "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# of names of several words, those that count as their first or as their last; and words that make them name something else
OUT_FIRST = {"ad", "ads", "advert", "breadcrumb", "comment", "comments", "cookie", "footer", "nav", "navbar", "newsletter", "sidebar", "sponsor", "sponsored"}
OUT_LAST = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comments", "commentlist", "cookies", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "sidebar", "toolbar"}
NOT_OUT = {"with", "has", "no", "without", "not", "is", "js", "free", "open", "closed", "hoc"}
# within an article: elements of text, on which only names of adverts count, and names that count where there are controls or mostly links
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "table", "tbody", "caption", "blockquote", "pre", "figure", "figcaption"}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "promo", "promotion", "sponsor", "sponsored"}
IF_CONTROLS = {"search", "social", "share", "sharing", "related", "recommended", "login", "signup", "subscribe", "respond"}
CONTROLS = {"input", "select", "textarea", "button"}
# why an element is left out: by what it is, because it is hidden; beyond these, an element that is judged by what it holds
OUT, HIDES = 1, 2
OUT_ARTICLES = {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
PART = re.compile(r"[a-z]+(?=[A-Z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
LONG_NUMBER = re.compile(r"&#\d{8,};?")
M63, K1, K2 = (1 << 63) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _decoded(s: str) -> str:
    if "&" not in s:
        return s
    try:
        return unescape(s)
    except ValueError:  # numbers too long for one
        return unescape(LONG_NUMBER.sub("�", s))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _decoded(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)} if raw.strip("/ \t\r\n") else {}


@lru_cache(1 << 14)
def _named_out(tag: str, names: str, inside: bool) -> bool:
    """Whether a class or id says that an element is no part of an article: a whole name, or its first or last word."""
    for name in names.split():
        words = [w.lower() for w in PART.findall(name)]
        if tag == "article":
            if name.lower() in OUT_ARTICLES:
                return True
        elif name.lower() in OUT_NAMES or (name.lower() == "header" and not inside):
            return True
        elif len(words) > 1 and (words[0] in OUT_FIRST or words[-1] in OUT_LAST) and not NOT_OUT.intersection(words):
            return True
    return False


def _left_out(tag: str, a: dict[str, str], inside: bool) -> int | None:
    """Why an element is left out, 0 if it isn't, None if what it holds decides."""
    if a and tag not in ("html", "body") and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "").lower())):
        return HIDES
    names = f"{a.get('class', '')} {a.get('id', '')}" if a else ""
    role = a.get("role", "").lower() if a else ""
    if tag == "form":
        return OUT if role in OUT_ROLES or _named_out(tag, names, inside) else None
    if tag in OUT_TAGS and not (tag == "menu" and inside) or (tag == "header" and not inside):
        return OUT
    if not a or tag in ("html", "body", "main"):
        return 0
    if role in OUT_ROLES:
        return OUT
    if inside and tag in TEXT_TAGS:
        return OUT if ADVERTS.intersection(names.lower().split()) else 0
    if not _named_out(tag, names, inside):
        return 0
    return None if inside and all(n.lower() in IF_CONTROLS or not _named_out(tag, n, inside) for n in names.split()) else OUT


@lru_cache(1 << 16)
def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s)


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{re.escape(tag)}(?=[\\s>/])[^>]*>", re.I)


class Page:
    """The tokens of a page in their order, and its blocks of text.

    ``tokens``: numbers; ``what`` has each one's kind, ``+tag``, ``-tag`` or ``text``. ``blocks``: (place among the tokens, text,
    letters in links, within an element that is left out, within an article, in a first-rank heading). Time is linear in
    the html, however broken: after one tag without an end quotes count no more, and what has no end is looked for once.
    """

    def __init__(self, html: str):
        self.tokens: list[int] = []
        self.what: dict[int, str] = {}
        self.blocks: list[tuple[int, str, int, bool, bool, bool]] = []
        # tag, path, why left out, within an article, name of its kind
        self.stack: list[tuple[str, int, int, bool, str]] = []
        # elements that what they hold decides on, from number 3: the one around it, whether a form, letters, letters in links, controls
        self.held: list[list] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.links = 0
        self._read(html)
        while self.stack:
            self._pop()
        self._flush()
        self._decide()

    def _decide(self) -> None:
        """Settle which of the elements that are judged by what they hold are out: forms, unless most of the page's text is theirs, and
        named parts of an article with controls or mostly links."""
        rest = 0
        for _, text, linked, gone, _, _ in self.blocks:
            if gone > HIDES:
                self.held[gone - HIDES - 1][2] += len(text)
                self.held[gone - HIDES - 1][3] += linked
            elif not gone:
                rest += len(text)
        for around, _, letters, linked, controls in reversed(self.held):  # inner ones have larger numbers
            if around:
                x = self.held[around - HIDES - 1]
                x[2] += letters
                x[3] += linked
                x[4] += controls
        out: list[bool] = []
        for around, form, letters, linked, controls in self.held:
            own = letters <= rest if form else controls > 0 or linked >= LINKED * letters
            out.append(own or (around > 0 and out[around - HIDES - 1]))
        self.blocks = [(at, text, linked, out[gone - HIDES - 1] if gone > HIDES else gone > 0, inside, head) for at, text, linked, gone, inside, head in self.blocks]

    def _control(self) -> None:
        if self.stack and self.stack[-1][2] > HIDES:
            self.held[self.stack[-1][2] - HIDES - 1][4] += 1

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            tag, path, gone, inside, _ = self.stack[-1] if self.stack else ("", 0, 0, False, "")
            token = (path * K2 + xxhash.xxh64_intdigest(text)) & M63
            self.what[token] = "text"
            head = tag == "h1" or self.open["h1"] > 0
            self.blocks.append((len(self.tokens), text, min(self.linked, len(text)), gone, inside, head))
            self.tokens.append(token)
        self.parts.clear()
        self.linked = 0

    def _pop(self) -> str:
        self._flush()
        tag, path, _, _, kind = self.stack.pop()
        self.open[tag] -= 1
        token = (path ^ 0x5555555555555555) & M63
        self.what[token] = "-" + kind
        self.tokens.append(token)
        return tag

    def _text(self, raw: str) -> None:
        if raw and not self.skipping:
            s = _decoded(raw)
            self.parts.append(s)
            if self.links:
                self.linked += len(s.strip())

    def _read(self, html: str) -> None:
        at, n, pattern, self.skipping = 0, len(html), TAG, False
        endless: set[str] = set()
        while at < n:
            i = html.find("<", at)
            if i < 0 or ">" in endless:
                self._text(html[at:])
                return
            self._text(html[at:i])
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith("<![CDATA[", i) and (end := html.find("]]>", i)) >= 0:
                if not self.skipping:
                    self.parts.append(html[i + 9 : end])
                at = end + 3
                continue
            m = pattern.match(html, i + 1)
            if m is None and html[i + 1 : i + 3].lstrip("/")[:1].isalpha() and pattern is TAG:
                pattern = LOOSE_TAG
                m = pattern.match(html, i + 1)
            if m is None:
                end = html.find(">", i) if html[i + 1 : i + 2] in ("!", "?") else -1
                if end >= 0:
                    at = end + 1
                    continue
                if html.find(">", i) < 0:
                    endless.add(">")
                self._text("<")
                at = i + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW and not m[3].rstrip().endswith("/"):
                if tag in CONTROLS:
                    self._control()
                end = None if tag in endless else _end_of(tag).search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    return
                else:  # what it holds ends where the next block begins
                    endless.add(tag)
                    self.skipping = True
                if tag not in ("svg", "math", "button", "select", "script", "style", "noscript") and not self.skipping:
                    self.parts.append(" ")
            else:
                self._start(tag, m[3])

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCK:
            self.skipping = False
            if self.open[tag] > 0:
                while self._pop() != tag:
                    pass
            elif tag == "p":
                self._flush()

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links += 1
        if tag in CONTROLS:
            self._control()
        if tag not in BLOCK:
            return
        self.skipping = False
        self._flush()
        self.links = 0 if tag in ("p", "div", "section", "article") else self.links
        ends = CLOSES.get(tag, ())
        while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in ends or (self.stack[-1][0] == "head" and tag == "body")):
            self._pop()
        _, path, gone, inside, _ = self.stack[-1] if self.stack else ("", 0, 0, False, "")
        a = _attributes(raw)
        why = _left_out(tag, a, inside)
        central = tag in ("article", "main") or a.get("itemprop") == "articleBody" or a.get("role") == "main"
        if central and not why and (gone > HIDES or (gone == OUT and tag != "article")):
            gone = 0  # a form that holds an article isn't left out, nor is whatever holds the main element
        if why is None and (not gone or gone > HIDES):
            self.held.append([gone, tag == "form", 0, 0, 0])
            gone = len(self.held) + HIDES
        elif not gone or gone > HIDES:
            gone = why or gone
        kind = "article" if central and not gone else tag
        path = (path * K1 + _hash(f"{tag}.{'.'.join(sorted(a['class'].split()))}" if a.get("class") else tag)) & M63
        self.what[path] = "+" + kind
        self.tokens.append(path)
        if tag not in VOID:
            self.stack.append((tag, path, gone, inside or (central and not gone), kind))
            self.open[tag] += 1


def plain(block: tuple) -> bool:
    """Whether a block may be main text by what its page says: no element leaves it out, and it is no link list outside an article."""
    _, text, linked, gone, inside, _ = block
    return not gone and (inside or linked < LINKED * len(text))


def chains(page: Page, classes: list[tuple[int, ...]], orders: list[tuple[int, ...] | None] | None = None):
    """``(where, seen)``: for each block the class of its own text or -1, followed by the gaps that it lies in, from the
    outside in (class << 32 | number of the token before); and for each class on the page its order, empty for none.

    ``orders`` are the orders to go by; without them each class's first run of tokens sets it."""
    member = {t: c for c, tokens in enumerate(classes) for t in tokens}
    seq: dict[int, list[int]] = defaultdict(list)
    for t in page.tokens:
        if (c := member.get(t)) is not None:
            seq[c].append(t)
    seen: dict[int, tuple[int, ...]] = {}
    place: dict[int, int] = {}
    for c, s in seq.items():
        m = len(classes[c])
        order = tuple(s[:m]) if orders is None else orders[c]
        if order and len(s) % m == 0 and len(set(order)) == m and all(tuple(s[k : k + m]) == order for k in range(0, len(s), m)):
            seen[c] = order
            place.update((t, j) for j, t in enumerate(order))
        else:
            seen[c] = ()
    while True:  # until what is left nests
        stack: list[tuple[int, int]] = []
        chain: tuple[int, ...] = ()
        at, where, crossed = iter(page.blocks), [], None
        block = next(at, None)
        for i, t in enumerate(page.tokens):
            j = place.get(t)
            if block is not None and block[0] == i:
                where.append((member[t] if j is not None else -1, *chain))
                block = next(at, None)
            if j is None:
                continue
            c, m = member[t], len(seen[member[t]])
            if j == 0:
                if m > 1:
                    stack.append((c, 0))
                    chain = (*chain, c << 32)
                continue
            if stack[-1][0] != c:  # the smaller of two classes that cross goes
                crossed = min(c, stack[-1][0], key=lambda x: (len(classes[x]), x))
                break
            if j == m - 1:
                stack.pop()
                chain = chain[:-1]
            else:
                stack[-1] = (c, j)
                chain = (*chain[:-1], c << 32 | j)
        if crossed is None:
            return where, seen
        for t in seen[crossed]:
            del place[t]
        seen[crossed] = ()


def judge(classes, orders, slots) -> list[tuple[int, ...]] | None:
    """The gaps whose text is main text, or None if the template says nothing.

    ``classes``: (tokens, their kinds) of each; ``orders``: by class the order of its tokens, for the valid ones; ``slots``:
    (own class and gaps, letters, letters in links, letters left out, letters in first-rank headings)."""
    held: dict[tuple[int, ...], list[int]] = defaultdict(lambda: [0] * 4)
    free = fixed = 0
    for (own, *gaps), *letters in slots:
        clear = max(0, letters[0] - letters[1] - letters[2])
        if own in orders:
            fixed += clear
            continue
        free += clear
        x = held[tuple(g for g in gaps if g >> 32 in orders)]
        for k in range(4):
            x[k] += letters[k]
    if not orders or not free or free < FREE * (free + fixed):
        return None
    out = {g for g, (n, linked, gone, _) in held.items() if linked >= LINKED * n or 2 * gone >= n}
    kinds = [dict(zip(tokens, what, strict=True)) for tokens, what in classes]
    nodes: list[tuple[bool, set]] = []  # parts that hold most of the text, from the largest: whether an article, its gaps

    def look(prefix: tuple[int, ...], below: list[tuple[int, ...]]) -> None:
        k = len(prefix)
        by_class: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for g in below:
            if len(g) > k:
                by_class[g[k] >> 32].append(g)
        for c, inner in sorted(by_class.items()):
            order, starts, ranges = orders[c], [], []
            for j, t in enumerate(order):
                what = kinds[c][t]
                if what[0] == "+":
                    starts.append((j, what[1:]))
                elif what[0] == "-" and (i := next((i for i in range(len(starts) - 1, -1, -1) if starts[i][1] == what[1:]), None)) is not None:
                    ranges.append((starts[i][0], j, what == "-article"))
                    del starts[i:]
            gaps = Counter()
            for g in inner:
                n, linked, gone, _ = held[g]
                gaps[g[k] & 0xFFFFFFFF] += max(0, n - linked - gone)
            upto = [0]
            for j in range(len(order)):
                upto.append(upto[-1] + gaps[j])
            for i, j, article in sorted([*ranges, *((i, i + 1, False) for i in gaps)], key=lambda r: (r[0] - r[1], r)):
                if upto[j] - upto[i] >= MOST * free:
                    nodes.append((article, {g for g in inner if i <= g[k] & 0xFFFFFFFF < j}))
            for i, n in gaps.items():
                if n >= MOST * free:
                    look((*prefix, c << 32 | i), [g for g in inner if g[k] & 0xFFFFFFFF == i])

    look((), sorted(held))
    main = next((gaps for article, gaps in nodes if article), None)
    if main is None:
        main = nodes[-1][1] if nodes else set(held)
        for _, gaps in reversed(nodes):
            if (gaps - main) & out:
                break
            main = gaps
    heads = {g for g, (n, _, _, head) in held.items() if 2 * head > n}
    return sorted((main | heads) - out)


def main_text(html: str, classes=(), orders=(), kept=frozenset()) -> str:
    """Main text of one page under its host's template, if any; a page of which next to nothing lies in the template's main
    text is read as if it had none.

    Where article and main elements hold most of a page's text, fixed text in them stays under any template, and without a template
    nothing else does but first-rank headings."""
    page = Page(html)
    blocks = [b for b in page.blocks if plain(b)]
    all_letters = sum(len(b[1]) for b in blocks)
    marked = sum(len(b[1]) for b in blocks if b[4]) >= MOST * all_letters > 0
    if kept:
        where, _ = chains(page, classes, orders)
        fixed = lambda b: marked and b[4] and b[2] < LINKED * len(b[1])
        free = [b[1] for b, (own, *gaps) in zip(page.blocks, where, strict=True) if plain(b) and (fixed(b) if own >= 0 else tuple(gaps) in kept)]
        if free and sum(map(len, free)) >= FREE * all_letters:
            return "\n\n".join(free)
    return "\n\n".join(b[1] for b in blocks if not marked or b[4] or b[5])


def _host() -> Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST")), F.lit("")))


def tokens(rows: DataFrame) -> DataFrame:
    """Per host and token, over all pages: its kind, ``support`` (pages), and ``v1, v2``, hashes of its occurrence vector; token 0 stands
    for the page itself. ``rows``: host, key, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[tuple[str, int], list] = {}
            for host, key, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page = Page(html)
                code: dict[int, tuple[int, int]] = {}
                for t, k in [*Counter(page.tokens).items(), (0, 1)]:
                    if k not in code:
                        x = ((key ^ k * K1) * K2) & M63
                        x = ((x ^ x >> 32) * K1) & M63
                        code[k] = (x >> 32, x & 0x7FFFFFFF)
                    x = got.setdefault((host, t), [page.what.get(t, "page"), 0, 0, 0])
                    x[1] += 1
                    x[2] += code[k][0]
                    x[3] += code[k][1]
            cols = [*zip(*((h, t, *x) for (h, t), x in got.items()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, s) for c, s in zip(cols, kinds, strict=True)], names)

    names, kinds = ["host", "token", "what", "support", "v1", "v2"], [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
    out = rows.select("host", "key", "html").mapInArrow(run, "host string, token long, what string, support long, v1 long, v2 long")
    return out.groupBy("host", "token").agg(F.min("what").alias("what"), *[F.sum(c).alias(c) for c in ("support", "v1", "v2")])


def token_classes(rows: DataFrame) -> DataFrame:
    """``host, classes``: the equivalence classes that are frequent on their host and hold a tag, each with its tokens and their
    kinds. A host has at most ``1 / SUPPORT`` times as many such tokens as its pages have on average."""
    t = cut(tokens(rows))
    n = t.filter("token = 0").select("host", F.col("support").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    # tokens of a page or two are never frequent: they don't join
    often = t.filter((F.col("token") != 0) & (F.col("support") >= SUPPORT * LEAST_PAGES)).join(n, "host").filter(F.col("support") >= SUPPORT * F.col("pages"))
    one = often.groupBy("host", "support", "v1", "v2").agg(F.sort_array(F.collect_list(F.struct("token", "what"))).alias("c"))
    one = one.filter(F.exists("c", lambda x: x["what"] != "text"))
    return one.groupBy("host").agg(F.sort_array(F.collect_list("c")).alias("classes"))


def _met(rows: DataFrame, table: DataFrame, size: Column) -> DataFrame:
    """``rows`` with what ``table`` has for their hosts."""
    if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "host", "left")
    salts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left").drop("salt")


def templates(rows: DataFrame) -> DataFrame:
    """``host, classes, orders, kept``: the valid classes with their orders, and the gaps of the main text, of each host that has a template."""
    known = cut(token_classes(rows))
    met = _met(rows, known, F.aggregate("classes", F.lit(0).cast("long"), lambda n, c: n + 24 * F.size(c))).filter("classes is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[tuple[int, ...]]] = {}
        for b in batches:
            got: dict[tuple, list[int]] = defaultdict(lambda: [0] * 5)
            for host, html, tokens_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if host not in cache:
                    if len(cache) > 64:
                        cache.clear()
                    cache[host] = [tuple(x["token"] for x in c) for c in tokens_.as_py()]
                page = Page(html)
                where, seen = chains(page, cache[host])
                for c, order in seen.items():
                    got[host, c, order][0] += 1
                for (_, text, linked, gone, _, head), gaps in zip(page.blocks, where, strict=True):
                    x = got[host, -1, gaps]
                    for k, n in enumerate((1, len(text), linked, len(text) * gone, len(text) * head)):
                        x[k] += n
            cols = [*zip(*((*k, *x) for k, x in got.items()), strict=True)]
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, s) for c, s in zip(cols, kinds, strict=True)], names)

    names, kinds = ["host", "class", "seq", "n", "letters", "linked", "gone", "head"], [pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 5]
    ddl = "host string, class int, seq array<long>, n long, letters long, linked long, gone long, head long"
    facts = met.select("host", "html", "classes").mapInArrow(run, ddl).groupBy("host", "class", "seq")
    facts = cut(facts.agg(*[F.sum(c).alias(c) for c in names[3:]]))
    best = facts.filter("class >= 0").groupBy("host", "class").agg(F.sum("n").alias("n"), F.max(F.struct("n", "seq")).alias("best"))
    best = best.filter((F.col("best.n") >= ORDERED * F.col("n")) & (F.size("best.seq") > 0))
    orders = best.groupBy("host").agg(F.collect_list(F.struct("class", F.col("best.seq").alias("seq"))).alias("orders"))
    slots = facts.filter("class < 0").groupBy("host").agg(F.collect_list(F.struct("seq", "letters", "linked", "gone", "head")).alias("slots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, known_, orders_, slots_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                classes = [([x["token"] for x in c], [x["what"] for x in c]) for c in known_]
                by = {x["class"]: tuple(x["seq"]) for x in orders_}
                kept = judge(classes, by, [tuple(s.values()) for s in slots_])
                if kept:
                    row = {"host": host, "classes": [c for c, _ in classes], "orders": [list(by.get(k, ())) for k in range(len(classes))], "kept": [list(g) for g in kept]}
                    yield pa.RecordBatch.from_pylist([row], schema)

    nested = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("host", pa.string()), ("classes", nested), ("orders", nested), ("kept", nested)])
    out = known.join(orders, "host").join(slots, "host").select("host", "classes", "orders", "slots")
    return out.mapInArrow(decide, "host string, classes array<array<long>>, orders array<array<long>>, kept array<array<long>>")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``; the whole html is read.

    Null or empty html, and pages without main text, give an empty text. A form is left out unless it holds an article, the main element or most of
    the page's text. Within an article, names of parts count on containers only (those of adverts everywhere), and names like ``search`` or ``share``
    where there are controls or mostly links. Where articles hold most of a page's text, what all pages of the host share in them stays, and what is
    outside of them goes but for first-rank headings, whether the host has a template or not. Hosts with fewer than ``LEAST_PAGES`` pages, or whose
    pages are copies of one another, have no template, nor have single pages that don't follow their host's: there the
    tags, roles, classes and link lists of the page itself decide. Null ids and urls are carried; null or odd urls share one host without a name. Repeated rows give equal
    texts and count as pages of their own. Html may be of any length and as broken as it likes. Other columns are ignored;
    an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    html = text_or_empty("html")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), _host().alias("host"))
    known = cut(templates(base.withColumn("key", F.xxhash64("page_id", "url", "html"))))
    size = sum(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + 8 + 8 * F.size(x)) for c in ("classes", "orders", "kept"))
    rows = _met(base, known, size).select("page_id", "url", "host", "html", "classes", "orders", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for host, html, *t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), *b.columns[4:], strict=True):
                if host not in cache:
                    if len(cache) > 64:
                        cache.clear()
                    classes, orders, kept = ([tuple(x) for x in c.as_py() or ()] for c in t)
                    cache[host] = (classes, orders, frozenset(kept))
                texts.append(main_text(html, *cache[host]))
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
