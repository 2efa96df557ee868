"""Operator 6: main text by equivalence-class template deduction across the pages of a host.

Pages become tokens in page order: start and end tags with their path, and text blocks with theirs. Tokens of a host that
occur equally often on each of its pages share an occurrence vector; the vector is reduced to an order-free hash by a
map-side aggregate, so a host with a third of all pages is one row a token and task. Tokens with equal vectors form a
class. A class is valid if its tokens keep one order, and is split where they don't; it needs a tag, so that it stands for
a layout or a record of one. Classes whose tokens occur once a page are frames; the others are nested in the slots between
a frame's tokens. Frames and the classes nested in their slots are the template. Of a page, the slots' contents are
extracted: texts between template tokens that are none themselves, in the element of the template that holds the article.
Names of elements, classes and roles are a filter on that: what they mark as menu, advert or form is left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import mark_members, materialize, table

#: Pages that a class needs to count as template: fewer pages may share a text by chance.
MIN_PAGES = 8
#: Hosts up to which their templates are broadcast (a few hundred bytes each).
BROADCAST_HOSTS = 20_000
# Fixed values of HTML: elements whose content is no text, elements without an end, elements within a line of text,
# elements that end an open paragraph's siblings, elements within which such an end is not looked for.
_RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_PASSED = {"p", "td", "th", "dd", "dt"}
#: Elements that are never part of the article; an article's own header and footer are headers and footers, too.
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "noscript", "template", "svg", "object"}
#: Words of class and id names, and roles, that mark what is not the article, and words that may stand beside them.
_MARKED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}
_BESIDE = {"area", "bar", "block", "bottom", "box", "buttons", "container", "form", "inner", "left", "links", "list", "main", "outer", "right", "section", "site", "slot", "top", "unit", "widget", "wrap", "wrapper"}
_ARTICLE = {"article", "main"}
_WHOLE = {"html", "body"} | _ARTICLE
_NAMES = ("class", "id", "role", "hidden", "aria-hidden")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[^\s/>]+")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}
_COMMENT_END = re.compile(r"--!?>|(?<=<!--)-?>")
_SPLIT = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag from ``at``, whether it closes itself, and the place behind its ``>`` (-1: the page ends before)."""
    found: dict[str, str] = {}
    while True:
        begin, at = at, _GAP.match(page, at).end()
        if at >= len(page):
            return found, False, -1
        if page[at] == ">":
            return found, page[at - 1] == "/" and at > begin, at + 1
        end = _KEY.match(page, at).end()
        key, value = page[at:end].lower(), ""
        at = end
        if (equals := _EQUALS.match(page, at)) is not None:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = page[at + 1 : end], end + 1
            else:
                end = _BARE.match(page, at).end()
                value, at = page[at:end], end
        if key in _NAMES:
            found.setdefault(key, value.lower())


def scan(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) in page order: ``text``, ``start``, ``void`` or ``end``.

    Each character is passed once. Comments, declarations and the content of raw elements give nothing. As HTML has it, a
    quote inside an unquoted value is part of it, and a tag that the page's end cuts off is none.
    """
    at, none = 0, {}
    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at:] if lt < 0 else page[at:lt], none
            if lt < 0:
                return
        following = page[lt + 1 : lt + 2]
        if (plain := _PLAIN.match(page, lt)) is not None:
            is_end, name, attributes, closed, at = plain[1], plain[2].lower(), none, False, plain.end()
        elif following.isascii() and following.isalpha() or (following == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            is_end = following if following == "/" else ""
            end = _NAME.match(page, lt + 1 + len(is_end)).end()
            name = page[lt + 1 + len(is_end) : end].lower()
            attributes, closed, at = _attributes(page, end)
            if at < 0:
                return
        elif following in ("!", "?", "/") and following:
            if page.startswith("<!--", lt):
                end = _COMMENT_END.search(page, lt + 4)
                at = len(page) if end is None else end.end()
            else:
                end = page.find(">", lt + 2)
                at = len(page) if end < 0 else end + 1
            continue
        else:
            yield "text", "<", none
            at = lt + 1
            continue
        if is_end:
            yield "end", name, none
        elif name in _VOID or closed:
            yield "void", name, attributes
        elif name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            yield "void", name, attributes
        else:
            yield "start", name, attributes


def _marked(words: str) -> bool:
    """Whether a name is made of marked words, or of such and words that stand beside them."""
    parts = set(_SPLIT.split(words)) - {""}
    return bool(parts & _MARKED) and parts <= _MARKED | _BESIDE


def _is_outside(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is not part of the article, by its name, class, id or role."""
    if name in _OUTSIDE:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if name in _WHOLE:
        return False
    return any(_marked(word) for key in ("class", "id", "role") for word in attributes.get(key, "").split())


def _key(path: int, kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\x00{text}", path)


def _signed(key: int) -> int:
    return key - (1 << 63)


@dataclass(slots=True)
class Element:
    name: str
    path: int
    outside: bool
    token: int
    begin: int


@dataclass(slots=True)
class Token:
    """A tag or a text block of a page; ``depth`` and ``n_region`` count the elements and the regions that it stands in."""

    key: int
    kind: str
    text: str
    depth: int
    in_article: bool
    outside: bool
    n_region: int


@dataclass(slots=True)
class Page:
    """Open elements while a page is read, by place and by name, so that each end is found at once.

    ``sizes`` gets the characters of text, outside elements apart, inside the elements of each start tag.
    """

    region: frozenset[int]
    sizes: dict[int, int]
    n_chars: int = 0
    stack: list[Element] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[int] = field(default_factory=list)
    barriers: list[int] = field(default_factory=list)
    n_article: int = 0
    n_outside: int = 0
    n_region: int = 0

    def path(self) -> int:
        return self.stack[-1].path if self.stack else 0

    def token(self, key: int, kind: str, text: str) -> Token:
        return Token(_signed(key), kind, text, len(self.stack), self.n_article > 0, self.n_outside > 0, self.n_region)

    def open(self, name: str, attributes: dict[str, str]) -> Token | None:
        inline = name in _INLINE
        role = " ".join(_DIGITS.sub("", attributes[k]) for k in ("class", "id") if k in attributes) if attributes else ""
        key = self.path() if inline else _key(self.path(), "start", f"{name} {role}")
        outside = _is_outside(name, attributes)
        out = None if inline else self.token(key, "start", name)
        at = len(self.stack)
        self.stack.append(Element(name, key, outside, _signed(key), self.n_chars))
        self.places.setdefault(name, []).append(at)
        if not inline:
            self.blocks.append(at)
            if name not in _PASSED:
                self.barriers.append(at)
        self.n_article += name in _ARTICLE
        self.n_outside += outside
        self.n_region += not inline and _signed(key) in self.region
        return out

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            e = self.stack.pop()
            self.places[e.name].pop()
            if e.name not in _INLINE:
                self.blocks.pop()
                if e.name not in _PASSED:
                    self.barriers.pop()
                self.n_region -= e.token in self.region
                self.sizes[e.token] = self.sizes.get(e.token, 0) + self.n_chars - e.begin
            self.n_article -= e.name in _ARTICLE
            self.n_outside -= e.outside

    def end_of(self, name: str) -> Token | None:
        """Close an element; an end without a start does nothing, nor does one within a line for a start outside it."""
        found = self.places.get(name)
        if not found or (name in _INLINE and self.blocks and found[-1] < self.blocks[-1]):
            return None
        key = _key(self.stack[found[-1]].path, "end", name)
        self.close_to(found[-1])
        return None if name in _INLINE else self.token(key, "end", name)

    def end_before(self, name: str) -> None:
        """A block ends an open paragraph, and an item, cell or the like one of its own name in the same list or table."""
        for known in {"p", name} if name in _SELF_ENDING else {"p"}:
            found = self.places.get(known)
            if found and not (self.barriers and self.barriers[-1] > found[-1]):
                self.close_to(found[-1])


def tokens_of(page: str, region: frozenset[int] = frozenset(), sizes: dict[int, int] | None = None) -> Iterator[Token]:
    """Tags (but for those within a line) and text blocks of a page in its order.

    A block's text has its references decoded and its white space turned into single spaces; a line break is a space.
    ``region`` are keys of start tags whose elements are counted in ``n_region``; ``sizes`` gets those of the elements.
    """
    state, parts = Page(region, {} if sizes is None else sizes), []

    def flush() -> Token | None:
        text = " ".join("".join(parts).split()) if parts else ""
        parts.clear()
        if not state.n_outside:
            state.n_chars += len(text)
        return state.token(_key(state.path(), "text", text), "text", text) if text else None

    for kind, name, attributes in scan(page):
        if kind == "text":
            parts.append(html.unescape(name) if "&" in name else name)
            continue
        if name == "br":  # a new line of the same block: a constant line of a text that varies is content
            parts.append(" ")
            continue
        inline = name in _INLINE
        if not inline and (block := flush()):
            yield block
        if kind == "void":
            continue
        if kind == "start":
            if not inline:
                state.end_before(name)
            elif _is_outside(name, attributes) != (state.n_outside > 0) and (block := flush()):
                yield block  # a hidden part of a line
            tag = state.open(name, attributes)
        else:
            if inline and state.places.get(name) and state.stack[state.places[name][-1]].outside and (block := flush()):
                yield block
            tag = state.end_of(name)
        if tag:
            yield tag
    if block := flush():
        yield block
    state.close_to(0)


_TOKEN_SCHEMA = "host string, page_key long, token long, kind string, n long, at long, chars long, depth long, inside boolean, is_article boolean"
#: Stands for the class members of a host's tokens, in the order of their mean places.
_MEMBER = ("at", "token", "first", "last", "kind", "chars", "depth", "inside", "is_article")
_TEMPLATE_SCHEMA = "host string, vector long, n_pages long, is_frame boolean, tokens array<long>, texts array<long>, region long"


def page_tokens(page: str) -> list[tuple]:
    """(token, kind, occurrences, place of the first, characters, depth, whether in an article, whether one) of a page's tokens."""
    sizes: dict[int, int] = {}
    found: dict[int, list] = {}
    for at, t in enumerate(tokens_of(page, sizes=sizes)):
        own = found.setdefault(t.key, [t.kind, 0, at, 0, t.depth, t.in_article, t.kind == "start" and t.text in _ARTICLE])
        own[1] += 1
        own[3] += 0 if t.outside or t.kind != "text" else len(t.text)
    return [(k, kind, n, at, sizes.get(k, 0) if kind == "start" else chars, *rest) for k, (kind, n, at, chars, *rest) in found.items()]


def _tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _TOKEN_SCHEMA.split(", ")]
    for pdf in batches:
        rows = [(h, i, *t) for h, i, page in zip(pdf["host"], pdf["page_key"], pdf["html"], strict=True) for t in page_tokens(page)]
        yield pd.DataFrame(rows, columns=names)


def _hosted(pages: DataFrame) -> DataFrame:
    text = F.coalesce(pages["html"], F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(pages["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(pages["page_id"], pages["url"], host.alias("host"), F.xxhash64(pages["page_id"], pages["url"], text).alias("page_key"), text.alias("html"))


def in_order(members: list[dict]) -> list[list[dict]]:
    """A class split where a member's first or last place falls behind that of an earlier member: each run keeps one order."""
    runs: list[list[dict]] = []
    for m in members:
        if runs and m["first"] >= runs[-1][-1]["first"] and m["last"] >= runs[-1][-1]["last"]:
            runs[-1].append(m)
        else:
            runs.append([m])
    return runs


def described(run: list[dict]) -> tuple[list[int], list[int], int | None]:
    """A valid class's tokens; those of its texts that are template; the start tag of its region.

    An article that says the same on all pages is a repeated article and no template with slots: the texts of an article
    element are template only if they are at most half of its text, and those of a class without one only if there is other
    text. The region is the deepest element that holds at least half of the widest one's text.
    """
    starts = [m for m in run if m["kind"] == "start"]
    texts = [m for m in run if m["kind"] == "text"]
    widest, article = (max((m["chars"] for m in starts if m["is_article"] or not named), default=0) for named in (False, True))
    named = any(m["is_article"] for m in starts)
    held = [m for m in texts if m["inside"] or not named]
    constant = sum(m["chars"] for m in held)
    repeated = 2 * constant > article if named else constant >= widest
    kept = {m["token"] for m in held} if repeated else set()
    region = max((m for m in starts if 2 * m["chars"] >= widest > 0), key=lambda m: (m["depth"], m["chars"], m["token"]), default=None)
    return [m["token"] for m in run], [m["token"] for m in texts if m["token"] not in kept], region and region["token"]


def _classes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _TEMPLATE_SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for host, vector, n_pages, most, members in zip(pdf["host"], pdf["vector"], pdf["n_pages"], pdf["most"], pdf["members"], strict=True):
            for run in in_order(list(members)):
                if any(m["kind"] != "text" for m in run):
                    rows.append((host, vector, n_pages, most == 1, *described(run)))
        yield pd.DataFrame(rows, columns=names).astype({"region": "Int64"})


def _one_each(hosted: DataFrame) -> DataFrame:
    """The rows of each page once; only rows that may be repeated are shuffled."""
    repeated = materialize(hosted.groupBy("page_key").agg(F.count("*").alias("n")).filter("n > 1").select("page_key"))
    rows = mark_members(hosted.select("host", "page_key", "html"), repeated, "page_key")
    once = rows.filter("maybe").dropDuplicates(["page_key"])
    return rows.filter("not maybe").union(once).select("host", "page_key", "html")


def templates(hosted: DataFrame) -> DataFrame:
    """(host, vector, n_pages, is_frame, tokens, texts, region): valid equivalence classes, their tokens in page order.

    ``is_frame`` marks classes whose tokens occur once a page; the others nest in slots of frames. ``texts`` are the tokens
    of texts that are template, ``region`` is the start tag of the element that holds the article. Only classes with a tag,
    on MIN_PAGES different pages or more, are kept. A page's repeated rows are one page.
    """
    tokens = _one_each(hosted).mapInPandas(_tokens, _TOKEN_SCHEMA)
    vectors = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page_key", "n")).alias("vector"),
        F.count("*").alias("n_pages"),
        F.max("n").alias("most"),
        F.avg("at").alias("at"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.min("kind").alias("kind"),
        F.sum("chars").alias("chars"),
        F.min("depth").alias("depth"),
        F.bool_or("inside").alias("inside"),
        F.bool_or("is_article").alias("is_article"),
    )
    # A text that few pages share is in no class; dropping it here keeps the classes small.
    vectors = materialize(vectors.filter(F.col("n_pages") >= MIN_PAGES))
    classes = vectors.groupBy("host", "vector", "n_pages").agg(F.array_sort(F.collect_list(F.struct(*_MEMBER))).alias("members"), F.max("most").alias("most"))
    return classes.mapInPandas(_classes, _TEMPLATE_SCHEMA)


@dataclass(slots=True)
class Template:
    """A host's template: frames and nested classes as ordered tokens, texts that are template, start tags of regions."""

    frames: list[dict[int, int]]
    nested: list[dict[int, int]]
    texts: frozenset[int]
    regions: frozenset[int]


def template_of(classes: Iterable[dict]) -> Template:
    ordered = sorted(classes, key=lambda c: (-len(c["tokens"]), c["vector"], list(c["tokens"])))
    places = [{int(t): k for k, t in enumerate(c["tokens"])} for c in ordered]
    return Template(
        [p for p, c in zip(places, ordered, strict=True) if c["is_frame"]],
        [p for p, c in zip(places, ordered, strict=True) if not c["is_frame"]],
        frozenset(int(t) for c in ordered for t in c["texts"]),
        frozenset(int(c["region"]) for c in ordered if c["is_frame"] and c["region"] is not None),
    )


def _rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for k, p in enumerate(places):
        at = bisect_left(tails, p)
        before[k] = ends[at - 1] if at else -1
        tails[at:], ends[at:] = ([p], [k]) if at == len(tails) else ([p, *tails[at + 1 :]], [k, *ends[at + 1 :]])
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def template_places(keys: list[int], template: Template) -> set[int]:
    """Places of a page's tokens that are template tokens there.

    Of a frame, those that keep its order on this page. The tokens of the widest frame here part the page into slots; a
    nested class is valid if all its tokens stand in one slot and repeat in its order; it makes slots of its own.
    """
    at: dict[int, list[int]] = {}
    for place, key in enumerate(keys):
        at.setdefault(key, []).append(place)
    fixed: set[int] = set()
    slot_of: list[int] = []
    for frame in template.frames:
        found = sorted(p for key in frame.keys() & at.keys() for p in at[key])
        held = [found[k] for k in _rising([frame[keys[p]] for p in found])]
        if not slot_of:
            slot_of = held
        fixed.update(held)
    for nested in template.nested:
        found = sorted(p for key in nested.keys() & at.keys() for p in at[key])
        cyclic = all(nested[keys[p]] == k % len(nested) for k, p in enumerate(found))
        if found and cyclic and bisect_left(slot_of, found[0]) == bisect_left(slot_of, found[-1]):
            fixed.update(found)
    return fixed


def main_text(page: str, template: Template | None) -> str:
    """Main text of a page: the texts in the slots of the article.

    The article is an element of that name, or else the innermost region of the host's template, or else the page. Template
    texts are left out, and so is what stands in elements that are marked as no part of the article.
    """
    tokens = list(tokens_of(page, template.regions if template else frozenset()))
    fixed = template_places([t.key for t in tokens], template) if template else set()
    texts = [(place, t) for place, t in enumerate(tokens) if t.kind == "text" and not t.outside]
    if any(t.kind == "start" and t.text in _ARTICLE and not t.outside for t in tokens):
        texts = [(place, t) for place, t in texts if t.in_article]
    else:
        innermost = max((t.n_region for _, t in texts), default=0)
        texts = [(place, t) for place, t in texts if t.n_region == innermost]
    return " ".join(t.text for place, t in texts if place not in fixed or t.key not in template.texts)


def _texts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, Template] = {}
    for pdf in batches:
        texts = []
        for host, page, classes in zip(pdf["host"], pdf["html"], pdf["classes"], strict=True):
            if classes is not None and host not in known:
                known = known if len(known) < 4096 else {}
                known[host] = template_of(classes)
            texts.append(main_text(page, known[host] if classes is not None else None))
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    A null html is empty and has the empty text; a null or odd url belongs to the host "". Repeated rows are
    pages of their own in the result, but one page for the template. No pages give no rows. Other columns are
    dropped. Hosts with fewer than MIN_PAGES pages have no template; their pages are read by elements alone. An
    article's own header, footer and asides are left out like the page's.
    """
    hosted = _hosted(pages)
    one = F.struct("vector", "is_frame", "tokens", "texts", "region")
    classes = materialize(templates(hosted).groupBy("host").agg(F.collect_list(one).alias("classes")))
    classes = F.broadcast(classes) if classes.count() <= BROADCAST_HOSTS else classes
    kind = pages.schema["page_id"].dataType.simpleString()
    joined = hosted.join(classes, "host", "left").select("page_id", "url", "host", "html", "classes")
    return joined.mapInPandas(_texts, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
